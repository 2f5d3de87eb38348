"""Line dedup, phrases and the prefix trie against brute force on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalspark.llm import conversation_trie, line_dedup, phrases
from tests.llm.conftest import SCHEMA


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- lines ---------------------------------------------------------------------------------------------------
def lined_rows():
    r = random.Random(5)
    lines = [" Home | About ", "home | about", "HOME | ABOUT\t", "née Ä", "x", "", "  ", "a\x0bb", "word " * 40]
    rows = []
    for i in range(60):
        text = "\n".join(r.choice(lines) if r.random() < 0.6 else f"own {i} {r.random()}" for _ in range(r.randint(0, 9)))
        rows.append((i, text, "en", "a", 1))
    rows += [(60, None, None, None, None), (61, "", "en", "a", 0), (62, "\n\n", "en", "a", 2), (63, "long " * 40_000 + "\nx", "en", "a", 1), (None, "née Ä\nx", None, None, 1)]
    rows += [(None, None, None, None, None), rows[3], rows[3], rows[60], *[(64, "only here\nx", "en", "a", 1)] * 12]
    return [(*row, "x", 1, 2, 0.5, 3, "k", 4, 5) for row in rows]


def slow_lines(rows, min_docs, min_chars, keep_first):
    def key(line):
        return low(line.strip(" \t\n\x0b\x0c\r"))

    places = defaultdict(set)
    for i, text, *_ in rows:
        sha = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big", signed=True)
        for no, line in enumerate((text or "").split("\n")):
            if len(key(line)) >= min_chars:
                places[key(line)].add((float("inf") if i is None else i, sha, no))
    gone = {k: min(p) for k, p in places.items() if len({q[:2] for q in p}) >= min_docs}
    out = []
    for i, text, *_ in rows:
        sha = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big", signed=True)
        lines = (text or "").split("\n")
        stays = [key(x) not in gone or keep_first and gone[key(x)] == (float("inf") if i is None else i, sha, n) for n, x in enumerate(lines)]
        out.append((i, len(lines), len(lines) - sum(stays), "\n".join(x for x, s in zip(lines, stays, strict=True) if s)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_docs", "min_chars", "keep_first", "block_bytes"), [(10, 1, False, 700), (2, 2, True, 700), (3, 1, True, 8 << 20), (1, 1, False, 300)])
def test_lines_against_brute_force(spark, min_docs, min_chars, keep_first, block_bytes):
    rows = lined_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = line_dedup.dedup_lines(docs, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first, with_text=True, block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out), key=str) == slow_lines(rows, min_docs, min_chars, keep_first)
    for r in out:
        assert r["n_dropped"] == int((~line_dedup.unpack_keep(r["keep"], r["n_lines"])).sum())


def test_a_block_sends_a_shared_line_once(spark):
    docs = spark.createDataFrame([(i, "menu\n" + str(i)) for i in range(3000)], "doc_id long, text string").repartition(1)
    blocks, total = line_dedup.text_blocks(docs, "doc_id", "text", 8 << 20)
    sent = line_dedup.send(blocks, 10, 1, 0).toPandas()
    assert sum(len(w) // 4 for w in sent.weights) == 3001


def test_lines_of_no_rows(none):
    assert line_dedup.dedup_lines(none).count() == 0


# --- phrases -------------------------------------------------------------------------------------------------
def phrase_rows():
    r = random.Random(3)
    rows = []
    for i in range(150):
        words = [r.choice(["New", "york", "city", "of", "the", "the", "É", "a b", "x-y"]) for _ in range(r.randint(0, 40))]
        text = "".join(w + r.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "! "]) for w in words) + r.choice(["", " machine learning model here", "United Nations"])
        rows.append((i, text, r.choice(["en", "en", None, "und", "fr"]), "a", 1))
    rows += [(None, None, None, None, None), (200, "", "en", "a", 0), (201, " \t\n,.", "en", "a", 0), (202, "big data big " * 20_000, "en", "a", 1)]
    rows += [rows[0], rows[0]]
    return [(*row, "x", 1, 2, 0.5, 3, "k", 4, 5) for row in rows]


def slow_phrases(rows, least, percent, first):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(text)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * cand[p[i : i + m]]}
        found = []
        for p, a in cand.items():
            if p not in inside:
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "percent", "first", "block_bytes"), [(30, 80, 2000, 2000), (3, 50, 7, 8 << 20), (1, 80, 2000, 900)])
def test_phrases_against_brute_force(spark, least, percent, first, block_bytes):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = phrases.collocations(docs, least=least, percent=percent, first=first, block_bytes=block_bytes).collect()
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out)
    assert got == slow_phrases(rows, least, percent, first)


def test_phrases_of_no_rows(none):
    assert phrases.collocations(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3)), max_size=200))
def test_perfect_hash(pairs):
    high, low_ = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    table = phrases.PerfectHash(high, low_)
    assert table.size == len(set(pairs))
    slots = table.slots(high, low_)
    assert {s: p for s, p in zip(slots.tolist(), pairs, strict=True)} == dict(enumerate(zip(table.high.tolist(), table.low.tolist(), strict=True)))
    assert (table.slots(high + np.uint64(20), low_) == -1).all()


# --- trie ----------------------------------------------------------------------------------------------------
def turn_rows():
    r = random.Random(8)
    rows = []
    for c in range(0, 130):
        if c in (20, 47):
            continue
        for t in range(r.choice([1, 1, 2, 3, 4, 5, 9])):
            rows.append((c, t, r.choice(["user", "user", "user", None]), r.choice(["hi", "hi", "hi there you", "", None])))
    rows += [(60, None, "system", "be good now"), (60, None, "system", "be good now"), (61, 0, "user", "x" * 300_000), (None, 1, "user", "hi"), (400, 1, None, None)]
    rows += [(500, t, "user", f"turn {t} of many") for t in range(700)] + [(520, t, "user", f"turn {t} of many") for t in range(650)]
    rows += [rows[0], rows[5], (-7, 0, "user", "hi"), (-7, 1, "user", "hi")]
    return [(*row, "k", 1, "p") for row in rows]


TURNS = "conv_id long, turn long, role string, text string, key string, depth int, path string"


def slow_trie(rows, share):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], role, text))
    convs = {c: [x[3:] for x in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if share else 0
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = (convs.get(base, [])[:h] + own[h:]) if share else own
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        p = tuple(paths[c])
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += worth
    return sorted(
        str((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
        for p, m in members.items()
    )


@pytest.mark.parametrize(("share", "part_bytes"), [(True, 32 << 20), (True, 500), (False, 200), (False, 3000)])
def test_trie_against_brute_force(spark, share, part_bytes):
    rows = turn_rows()
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    convs = conversation_trie.paths(turns)
    convs = conversation_trie.shared_starts(convs) if share else convs.selectExpr("conv_id", "array_join(units, '') AS path")
    out = conversation_trie.prefix_trie(convs, part_bytes=part_bytes).collect()
    assert sorted(str(tuple(r[c] for c in conversation_trie.RESULT)) for r in out) == slow_trie(rows, share)


def test_ids_of_a_shared_path_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 7)
    convs = spark.range(100).selectExpr("id AS conv_id", "'' AS path")
    (root,) = conversation_trie.prefix_trie(convs).collect()
    assert (root["n_convs"], root["n_leaves"], root["n_children"]) == (100, 1, 0)
    assert root["ends_sha256"] == hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest()


def test_trie_of_no_rows(spark):
    turns = spark.createDataFrame([], TURNS)
    assert conversation_trie.prefix_trie(conversation_trie.shared_starts(conversation_trie.paths(turns))).count() == 0
