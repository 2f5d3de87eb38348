import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalspark.llm import induced_sort, lsm_dedup, sentence_dedup, simhash, suffix_dedup
from signalspark.llm.components import connected_components
from signalspark.llm.induced_sort import BucketQueue, suffix_order


def lower(t):
    return (t or "").encode().lower()


# --- SimHash -------------------------------------------------------------------------------------------------
def slow_fingerprint(t):
    w = lower(t).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(items):
    """(id, fp) -> component id of each, by union-find over all pairs."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(items):
        low[find(i)].append(d)
    return [min((d for d in low[find(i)] if d is not None), default=None) for i in range(len(items))]


def test_simhash_matches_brute_force(docs, rows):
    items = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(items, slow_components(items), strict=True)), key=str)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_fingerprints_in_crowded_shards(spark):
    r = np.random.default_rng(3)
    centre = r.integers(0, 2**63, 4, dtype=np.uint64)
    fps = set(r.integers(0, 2**63, 200, dtype=np.uint64).tolist())
    for c in centre.tolist():
        for _ in range(150):
            f = c
            for b in r.integers(0, 64, r.integers(0, 6)):
                f ^= 1 << int(b)
            fps.add(f & (2**63 - 1))
    fps = sorted(fps)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {row["node"]: row["root"] for row in connected_components(simhash.links(table, 3, shard_rows=25)).collect()}
    want = slow_components([(f, f) for f in fps])
    assert [roots.get(f, f) for f in fps] == want


def test_simhash_of_no_rows(none):
    assert simhash.near_duplicates(none).count() == 0


def test_walsh_shells_tell_blocks_apart():
    x = np.arange(1 << 16, dtype=np.uint16)
    shells = np.stack([np.bitwise_count(x ^ np.uint16(v)) for v in simhash.VANTAGE_POINTS], axis=1)
    assert len(np.unique(shells, axis=0)) > 50_000


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- exact dedup ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("keep,bits", [("largest", 256), ("smallest", 256), ("largest", 8), ("smallest", 16)])
def test_exact_dedup_matches_brute_force(docs, rows, keep, bits):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    pick = max if keep == "largest" else min
    got = lsm_dedup.exact_duplicates(docs, keep=keep, digest_bits=bits).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256(t).hexdigest(): t for t in groups}
    kept = defaultdict(int)
    for g in got:
        ids = groups[sha[g["sha"]]]
        assert g["group_size"] == len(ids)
        assert g["keep_id"] == pick((i for i in ids if i is not None), default=None)
        kept[g["sha"]] += g["kept"]
        assert not g["kept"] or g["doc_id"] == g["keep_id"]
    assert set(kept.values()) == {1}


def test_index_flushes_and_compacts(spark):
    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(30)], "doc_id long, text string").coalesce(1)
    out = lsm_dedup._digests(df, "doc_id", "text", 256)
    index = lsm_dedup.DigestIndex(spark, memtable_rows=3)
    index.add(out)
    assert spark.read.parquet(index.flushed[0]).select("run").distinct().count() > 1
    index.compact()
    index.add(out.selectExpr("doc_id + 100 as doc_id", "digest"))
    assert sorted((r["first_id"], r["last_id"], r["n"]) for r in index.entries().collect()) == [(k, 125 + k, 12) for k in range(5)]
    assert lsm_dedup.DigestIndex(spark).entries().count() == 0


def test_exact_dedup_of_no_rows(none):
    assert lsm_dedup.exact_duplicates(none).count() == 0


# --- suffix arrays -------------------------------------------------------------------------------------------
def slow_order(t, cap):
    t = list(t)
    order = sorted(range(len(t)), key=lambda i: t[i:])
    shared = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k] and k < cap:
            k += 1
        shared.append(k)
    return order, shared


def test_induced_sort_matches_sorting():
    r = np.random.default_rng(0)
    for n in range(250):
        t = r.integers(0, r.choice([1, 2, 4, 30]) + 1, r.integers(1, 60))
        if n % 3 == 0:
            t = np.tile(t, r.integers(1, 4))
        cap = int(r.choice([5, 64]))
        order, shared = suffix_order(t, cap, memory_bytes=int(r.choice([16, 1 << 20])), base=int(r.choice([0, 2, 1 << 20])))
        assert (order.tolist(), shared.tolist()) == slow_order(t, cap)


def test_queue_spills_and_keeps_order():
    q = BucketQueue(memory_bytes=8)
    for k in range(5):
        q.push(np.array([1, 1, 2]), np.array([k, k + 10, k + 20]), np.array([k, k, k], np.uint8))
    assert q.file is not None
    assert q.pop(1)[0].tolist() == [0, 10, 1, 11, 2, 12, 3, 13, 4, 14]
    assert q.pop(1) is None
    assert q.pop(2)[1].tolist() == [0, 1, 2, 3, 4]
    q.close()


def slow_removed(rows, length):
    order = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, 1 << 63), order(r[0]))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order(r[0]):
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((r[0], kept, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())))
    return sorted(out, key=str)


def test_substrings_match_brute_force(docs, rows):
    got = suffix_dedup.dedup_substrings(docs, shard_bytes=20_000, memory_bytes=4096, block_bytes=5000)
    got = [(r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()]
    assert sorted(got, key=str) == slow_removed(rows, 50)


def test_windows_of_a_text_cut_into_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 100, n, dtype=np.uint8)) for n in (0, 10, 49, 50, 51, 300, 64, 1000)]
    seen, anchors = set(), defaultdict(set)
    for t, o, n, h, _ in zip(*(a.tolist() for a in suffix_dedup.text_stretches(texts, 50)), strict=True):
        for k in range(n):
            assert (t, o + k) not in seen
            seen.add((t, o + k))
            anchors[texts[t][o + k : o + k + 50]].add(h)
    assert len(seen) == sum(max(0, len(t) - 49) for t in texts)
    assert all(len(a) == 1 for a in anchors.values())  # equal windows have equal anchors


def test_anchors_fill_their_parts_alike():
    text = np.random.default_rng(9).integers(97, 123, 400_000, dtype=np.uint8).tobytes()
    anchors = np.unique(suffix_dedup.text_stretches([text], 50)[3])
    slots = suffix_dedup._slots(anchors, 4)
    times = np.bincount((slots >> np.uint64(32)).astype(np.int64), minlength=16)
    assert len(times) == 16 and times.max() < 1.2 * times.mean()  # least hashes begin with zeros
    assert len(np.unique(slots)) == len(anchors)


def test_runs_of_windows_with_their_earliest_document():
    r = np.random.default_rng(10)
    for _ in range(50):
        parts = [bytes(r.integers(97, 99, n, dtype=np.uint8)) for n in r.integers(5, 12, r.integers(1, 20))]
        ords = r.integers(0, 9, len(parts))
        low: dict = {}
        for p, o in zip(parts, ords.tolist(), strict=True):
            for k in range(len(p) - 4):
                low[p[k : k + 5]] = min(low.get(p[k : k + 5], 9), o)
        per, at, windows, docs = suffix_dedup.earliest(parts, ords, 5, 64)
        owner = np.repeat(np.arange(len(parts)), per)
        assert np.repeat(docs, windows).tolist() == [low[p[k : k + 5]] for p in parts for k in range(len(p) - 4)]
        assert [k for a, n in zip(at.tolist(), windows.tolist(), strict=True) for k in range(a, a + n)] == [k for p in parts for k in range(len(p) - 4)]
        assert np.bincount(owner, windows).tolist() == [len(p) - 4 for p in parts]


def test_only_snippets_that_share_a_window_are_sorted(monkeypatch):
    r = np.random.default_rng(11)
    letters = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8))
    parts, anchor = [], []
    for k in range(60):
        mid, left, right = letters(20), letters(30), letters(30)
        for cut in (0, 12, 15, 25, 30):  # bytes that agree beside the anchor, fewer or more than a window's 30
            for other in range(2):
                both = int(r.integers(0, cut + 1))
                parts.append(letters(30 - both) + left[30 - both :] + mid + right[: cut - both] + letters(30 - cut + both))
                anchor.append(k)
    times = defaultdict(set)
    for i, p in enumerate(parts):
        for o in range(len(p) - 49):
            times[p[o : o + 50]].add(i)
    want = {i for v in times.values() if len(v) > 1 for i in v}
    order = r.permutation(len(parts))
    parts, anchor = [parts[i] for i in order], np.array(anchor)[order]
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "COMPARED_BYTES", size)
        got = suffix_dedup.comparable(parts, anchor, 50)
        assert {int(i) for i in order[got]} == want and 0 < len(want) < len(parts)
    assert suffix_dedup.comparable([], np.empty(0, np.int64), 50).tolist() == []


def test_prefixes_by_four_characters_at_once(monkeypatch):
    r = np.random.default_rng(12)
    for n, kinds, cap in ((3000, 1, 50), (3000, 2, 9), (500, 300, 254), (700, 1, 1000)):
        t = r.integers(0, kinds, n).astype(np.int16)
        t[r.integers(0, n, 9)] = kinds
        a = r.integers(0, n, 5000)
        b = (a + r.integers(1, n, 5000)) % n
        fours = induced_sort.common_prefix(t, a, b, cap)
        monkeypatch.setattr(induced_sort, "AT_ONCE", 1 << 30)
        assert np.array_equal(fours, induced_sort.common_prefix(t, a, b, cap)) and fours.max() > 0
        monkeypatch.undo()


def test_sort_on_disk_gives_the_same_order():
    r = np.random.default_rng(5)
    t = np.tile(r.integers(0, 5, 700), 3)
    order, shared = suffix_order(t, 64, memory_bytes=64, base=1 << 20)
    assert isinstance(order, np.memmap) and (order.tolist(), shared.tolist()) == slow_order(t, 64)


def test_anchor_with_many_continuations_is_dealt_by_window(spark, monkeypatch):
    r = np.random.default_rng(3)
    letters = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = letters(150)
    rows = [(i, letters(60) + passage + letters(60)) for i in range(600)]
    rows += [(600, None), (None, passage), (601, passage)]
    settle = suffix_dedup._settle

    def watched(length, memory_bytes):
        inner = settle(length, memory_bytes)

        def run(t):
            if t.column("shard")[0].as_py() < 0:
                return inner(t)
            keys = [np.frombuffer(b.as_buffer(), np.uint64) for b in t.column("anchors")]
            _, times = np.unique(np.concatenate(keys), return_counts=True)
            if times.max() > 100:
                raise AssertionError(f"one anchor brings {times.max()} snippets to a task")
            return inner(t)

        return run

    monkeypatch.setattr(suffix_dedup, "HOT", 100)
    monkeypatch.setattr(suffix_dedup, "_settle", watched)
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=20_000, block_bytes=20_000)
    got = [(x["doc_id"], bytes(x["kept"]), x["n_bytes"], x["n_removed"], x["n_spans"]) for x in got.collect()]
    assert sorted(got, key=str) == slow_removed(rows, 50)


@pytest.mark.parametrize("block_bytes", [3000, 8 << 20])
def test_places_that_follow_another_one_in_their_block(spark, block_bytes):
    r = np.random.default_rng(6)
    letters = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    a, b = letters(130), letters(90)
    rows = [(5, a + letters(20) + a + b + a), (5, b + a), (5, b + a), (9, a[40:] + b[:60] + letters(30)), (2, letters(30) + a[:70]), (2, a[:70] + a[:70])]
    rows += [(None, a + letters(9) + a), (None, b + letters(70) + b), (None, (c := letters(80)) + c), (None, c), (30, "x" * 400), (31, "x" * 300), (8, b * 3)]
    rows += [(40 + k, letters(15) + (a, b, c)[k % 3] + letters(15) + a[10:100]) for k in range(40)]
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), shard_bytes=20_000, block_bytes=block_bytes)
    got = [(x["doc_id"], bytes(x["kept"]), x["n_bytes"], x["n_removed"], x["n_spans"]) for x in got.collect()]
    assert sorted(got, key=str) == slow_removed(rows, 50)


def test_a_shared_passage_is_an_entry_a_block_in_its_shard(spark):
    passage = bytes(np.random.default_rng(7).integers(97, 123, 300, dtype=np.uint8)).decode()
    most = []
    for n in (2000, 8000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(passage), F.sha2((-F.col("id")).cast("string"), 256)).alias("text"))
        blocks, total = suffix_dedup.text_blocks(docs.coalesce(1), "doc_id", "text")
        bits = suffix_dedup.part_bits_of(total)
        skipped = suffix_dedup.copies(blocks)
        marks = suffix_dedup.repeated(suffix_dedup.anchors(blocks, skipped, 50, bits))
        sent = suffix_dedup.snippets(blocks, suffix_dedup.info(skipped).unionByName(suffix_dedup.info(marks)), 50, bits, 64)
        whole = sent.where("shard >= 0").groupBy("shard").agg((F.sum(F.octet_length("nos")) / 4).alias("places"), (F.sum(F.octet_length("sizes")) / 4).alias("kinds"))
        assert whole.where("places <> kinds").count() == 0
        most.append(sent.where("shard < 0").groupBy("shard").agg(F.sum(F.octet_length("nos") / 4).alias("own")).agg(F.sum("own")).first()[0])
    assert most[1] > 3.9 * most[0] > 0  # what repeats in a block stays with the block


def test_substrings_when_nothing_repeats(spark):
    r = np.random.default_rng(8)
    rows = [(i, bytes(r.integers(97, 123, 200, dtype=np.uint8)).decode()) for i in range(20)]
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], bytes(x["kept"]).decode(), x["n_removed"]) for x in got) == [(*row, 0) for row in rows]


def test_substrings_of_no_rows(none):
    assert suffix_dedup.dedup_substrings(none).count() == 0


# --- sentences -----------------------------------------------------------------------------------------------
def slow_sentences(rows, span):
    order = lambda i: (1 << 63) - 1 if i is None else i
    ident = lambda r: (order(r[0]), r[1])
    runs = defaultdict(set)
    for r in rows:
        words = [p.lower().split() for p in sentence_dedup.sentences(r[1] or "")]
        solid = [i for i, w in enumerate(words) if any(c.isalnum() for x in w for c in x)]
        for k in range(len(solid) - span + 1):
            runs[tuple(" ".join(words[i]) for i in solid[k : k + span])].add((ident(r), k, solid[k], solid[k + span - 1]))
    gone = defaultdict(set)
    for places in runs.values():
        key = lambda p: (p[0][0], int.from_bytes(hashlib.sha256((p[0][1] or "").encode()).digest()[:8], "big", signed=True), p[1])
        for p in sorted(places, key=key)[1:]:
            gone[p[0]] |= set(range(p[2], p[3] + 1))
    out = []
    for r in rows:
        parts = sentence_dedup.sentences(r[1] or "")
        g = gone[ident(r)]
        text = None if r[1] is None else "".join(p for i, p in enumerate(parts) if i not in g)
        out.append((r[0], text, len(parts), len(g), sum(i - 1 not in g for i in g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [2000, 8 << 20])
def test_sentence_spans_match_brute_force(docs, rows, block_bytes):
    got = sentence_dedup.dedup_sentences(docs, block_bytes=block_bytes).collect()
    got = sorted(((r["doc_id"], r["text"], r["n_sentences"], r["n_removed"], r["n_spans"]) for r in got), key=str)
    assert got == slow_sentences(rows, 3)
    assert any(g[3] for g in got)


def slow_run_ends(sizes, span, least, long):
    out = []
    for k in range(len(sizes)):
        words = 0
        for e in range(k, len(sizes)):
            words += sizes[e]
            if words >= long or (e + 1 - k >= span and words >= least):
                out.append((k, e + 1))
                break
        else:
            if k == 0 and words >= least:
                return [(0, len(sizes))]
    return out


def test_runs_adapt_to_the_length_of_sentences():
    r = np.random.default_rng(4)
    for n in [0, 1, 1, 2, 2, 3, 3, *range(4, 30)] * 5:
        sizes = r.integers(1, r.integers(2, 30), n)
        got = sentence_dedup.run_ends(sizes, 3, 12, 20)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == slow_run_ends(sizes.tolist(), 3, 12, 20)


def test_passages_of_fewer_whole_sentences_than_a_span_go(spark):
    word = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    passage = f"{word(0, 24)}. {word(1, 29)}."  # 53 words, two sentences
    short = "Yes. No. Well then."
    rows = [(1, f"{word(2, 9)}. {passage} {word(3, 9)}."), (2, f"{word(4, 9)}. {passage} {word(5, 9)}."), (3, f"{word(6, 9)}. {short} {word(7, 9)}."), (4, f"{word(8, 9)}. {short} {word(9, 9)}.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in sentence_dedup.dedup_sentences(docs, min_words=12, long_words=20).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, rows[1][1].replace(passage + " ", "")), 3: (0, rows[2][1]), 4: (0, rows[3][1])}


def test_sentences_join_to_the_text(rows):
    for r in rows:
        assert "".join(sentence_dedup.sentences(r[1] or "")) == (r[1] or "")


def test_sentences_of_no_rows(none):
    assert sentence_dedup.dedup_sentences(none).count() == 0
