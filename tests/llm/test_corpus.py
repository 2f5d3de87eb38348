import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex

from signalspark.llm import language_id, license_scan, matroska, mixing, packing, token_counts
from tests.llm.conftest import SCHEMA


def in_duckdb(rows, sql):
    con = duckdb.connect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    table = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})[["doc_id", "text", "lang", "source"]]
    con.register("documents", table)
    return con.sql(sql).fetchall(), [d[0] for d in con.sql(sql).description]


# --- mixing --------------------------------------------------------------------------------------------------
def slow_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > limit * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def test_mix(docs, rows):
    got = mixing.mix(docs, bucket_rows=8).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target = slow_targets(sizes)
    taken = defaultdict(int)
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert g["target"] == pytest.approx(target[g["source"]])
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    for s in sizes:
        assert taken[s] == round(target[s])
    again = mixing.mix(docs.repartition(5), bucket_rows=50).collect()
    key = lambda g: (g["doc_id"] is None, g["doc_id"], g["size"], g["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_equals_sql(docs, rows):
    want, names = in_duckdb(rows, mixing.MIX_SQL)
    got = mixing.mix(docs).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_mix_of_whole_documents(docs):
    for g in mixing.mix(docs, whole_documents=True).collect():
        assert g["size"] == 0 or g["taken"] % g["size"] == 0


def test_mix_of_no_rows(none):
    assert mixing.mix(none).count() == 0


def test_targets_when_a_source_has_no_words(spark):
    t = spark.createDataFrame([("a", 0), ("b", 10), (None, 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(t).collect()}
    assert got == pytest.approx(slow_targets({"a": 0, "b": 10, None: 1000}))


# --- packing -------------------------------------------------------------------------------------------------
def test_pack(docs, rows):
    got = packing.pack(docs, capacity=100, per_source=2, shard_rows=50).toPandas()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    whole = got.assign(d=got.doc_id.fillna(-1)).groupby("bin_id")
    assert whole.n_tokens.sum().max() <= 100
    assert (whole.n_tokens.sum() == whole.bin_tokens.first()).all()
    assert got.groupby("bin_id").cluster.apply(lambda c: c.duplicated().any()).sum() == 0
    assert got.assign(s=got.source.fillna("")).groupby(["bin_id", "s"]).size().max() <= 2
    assert sum(sizes) == got.n_tokens.sum()
    for _, b in got.sort_values("bin_offset").groupby("bin_id"):
        ends = (b.bin_offset + b.n_tokens).tolist()
        assert all(o >= e for o, e in zip(b.bin_offset.tolist()[1:], ends, strict=False))


def slow_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, where = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fit = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins)]
        fit = [(r, i) for r, i in fit if r >= n and (c is None or all(x[2] != c for x in bins[i])) and sum(x[1] == s for x in bins[i]) < per_source]
        r = min(fit)[0] if fit else None
        where.append(r)
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        bins[i].append((n, s, c))
    return where


def test_best_fit_takes_the_tightest_compatible_bin():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 40)
        sizes = sorted((r.randint(0, 10) for _ in range(n)), reverse=True)
        sources = [r.choice("ab") for _ in range(n)]
        clusters = [r.choice([None, 1, 2, 3, 4 + i]) for i in range(n)]
        bin_of, offset = packing.best_fit(sizes, sources, clusters, 10, 2)
        # Replayed: each piece went where the residual was the least among compatible bins.
        bins = defaultdict(list)
        for p, (b, o, s, so, c) in enumerate(zip(bin_of, offset, sizes, sources, clusters, strict=True)):
            ok = [10 - sum(x[0] for x in y) for y in bins.values() if sum(x[0] for x in y) + s <= 10 and (c is None or all(x[2] != c for x in y)) and sum(x[1] == so for x in y) < 2]
            used = sum(x[0] for x in bins[b])
            assert o == used
            if ok:
                assert 10 - used == min(ok), p
            else:
                assert not bins[b]
            bins[b].append((s, so, c))


def test_pack_of_no_rows(none):
    assert packing.pack(none).count() == 0


# --- language ID ---------------------------------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    r = random.Random(2)
    words = {"en": ["the", "and", "thing", "with", "other", "water"], "de": ["und", "der", "nicht", "schön", "straße"], "fr": ["le", "être", "où", "avec", "chose"]}
    rows = []
    for i in range(400):
        lang = r.choice(list(words))
        rows.append((i, " ".join(r.choice(words[lang]) + r.choice(["", "", "s"]) for _ in range(30)), lang, None))
    rows += [(400, None, "en", None), (401, "12 34 !!", "en", None), (402, "thingly waterish", None, None), (None, "le chose où", "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {g["doc_id"]: g for g in language_id.identify(df).collect()}
    assert len(got) == len(rows)
    held = [g for g in got.values() if g["held_out"] and g["doc_id"] is not None and g["doc_id"] < 400]
    assert held and all(zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2 for g in held)
    truth = {i: lang for i, _, lang, _ in rows}
    assert np.mean([g["lang_pred"] == truth[g["doc_id"]] for g in held]) >= 0.97
    assert got[400]["lang_pred"] == got[401]["lang_pred"] == "und"
    assert got[402]["lang_pred"] == "en"
    assert all(0 <= g["score"] <= 1 for g in got.values())


def slow_languages(rows):
    """(doc_id, held out, language, score) by counting in dicts."""
    letters = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    cut_up = lambda w, n: [f"\x02{w}\x03"[k : k + n] for k in range(len(w) + 3 - n)]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 4 == 2 for r in rows]
    learned = [r for r, h in zip(rows, held, strict=True) if not h and r[1] is not None and r[2] is not None]
    langs = sorted({r[2] for r in learned})
    tables = {n: {x: Counter() for x in langs} for n in (0, 4, 3, 2, 1)}
    for r in learned:
        for w in letters(r[1]):
            tables[0][r[2]][w] += 1
            for n in (4, 3, 2, 1):
                tables[n][r[2]].update(cut_up(w, n))

    def score(keys, n):
        return np.array([np.mean([np.log(tables[n][x][k] + 1) - np.log(sum(tables[n][x].values()) + 1) for k in keys]) for x in langs])

    def of(word):
        for n in (0, 4, 3, 2, 1):
            seen = [k for k in ([word] if n == 0 else cut_up(word, n)) if any(tables[n][x][k] for x in langs)]
            if seen:
                return score(seen, n)
        return np.zeros(len(langs))

    out = []
    for r, h in zip(rows, held, strict=True):
        found = letters(r[1])
        if not found:
            out.append((r[0], h, "und", 0.0))
            continue
        total = sum((of(w) for w in found), np.log([sum(x == q[2] for q in learned) / len(learned) for x in langs]))
        out.append((r[0], h, langs[int(total.argmax())], round(float(1 / np.exp(total - total.max()).sum()), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 1 << 17])
def test_language_matches_brute_force(spark, hot):
    r = random.Random(4)
    stock = {"en": ["the", "and", "thing", "water"], "hi": ["पानी", "और", "क्या"], "fr": ["être", "où", "chose", "the"]}
    rows = []
    for i in range(80):
        lang = r.choice(list(stock))
        rows.append((i, " ".join(r.choice(stock[lang]) + r.choice(["", "", "x", "qy"]) for _ in range(r.randint(1, 9))), r.choice([lang, lang, None])))
    rows += [(90, "½ ² ① 12", "en"), (91, None, "en"), (92, "", None), (93, "ज़़", None), (94, "İstanbul", "fr"), (None, "water", "en"), (95, "zzz " * 3000, "en"), rows[0], rows[0]]
    df = spark.createDataFrame([(*row, "x", 1.0, True) for row in rows], "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    got = [(g["doc_id"], g["held_out"], g["lang_pred"], round(g["score"], 6)) for g in language_id.identify(df, hot_words=hot).collect()]
    assert sorted(got, key=str) == slow_languages(rows)
    rest = df.drop("lang_pred", "score", "held_out")
    model = language_id.fit(rest.where(~language_id.held_out()))
    other = language_id.predict(rest, model, hot_words=hot).collect()
    assert sorted((g["doc_id"], g["lang_pred"], round(g["score"], 6)) for g in other if g["doc_id"]) == sorted((g[0], *g[2:]) for g in got if g[0])


def test_language_without_labels_or_rows(spark, none):
    assert language_id.identify(none).count() == 0
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.identify(df).collect()] == [(1, False, "und", 0.0)] or language_id.identify(df).first()["lang_pred"] == "und"


def test_language_on_odd_rows(docs, rows):
    assert language_id.identify(docs).count() == len(rows)


# --- Matroska ------------------------------------------------------------------------------------------------
def test_media_round_trip(docs, rows):
    got = matroska.read_back(matroska.store(docs)).collect()
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = [(g["doc_id"], g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) for g in got]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_packets_of_all_lacings():
    payload = bytes(random.Random(1).randbytes(200_000 // 64 * 64))
    media = matroska.parse(m := matroska.build(payload))
    assert {p[5] for p in media.packets} == {0, 1, 2, 3} or {p[5] for p in media.packets} == {1, 2, 3}
    assert b"".join(m[p[2] : p[2] + p[3]] for p in media.packets) == payload
    times = [p[1] for p in media.packets]
    assert times == sorted(times) and times[1] == 128_000_000
    assert all(at in media.clusters for _, _, at in media.cues) and len(media.cues) == len(media.clusters)


def test_unknown_sizes_and_block_groups():
    e, u = matroska.element, matroska.unsigned
    block = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x82\x00\x05\x00abc") + u(0xFB, 1))
    cluster = lambda t: b"\x1f\x43\xb6\x75\xff" + u(matroska.TIMESTAMP, t) + block
    data = e(matroska.EBML, e(matroska.DOC_TYPE, b"webm")) + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster(10) + cluster(20)
    m = matroska.parse(data)
    assert [(p[0], p[1], p[3], p[4], p[6]) for p in m.packets] == [(2, 15_000_000, 3, False, 0), (2, 25_000_000, 3, False, 1)]


def test_packet_table_reports_errors(spark):
    good = matroska.build(b"x" * 64)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None), (4, bytearray(good[:-3]))], "id long, media binary")
    got = matroska.packets(df, "id", "media").collect()
    assert [(r["id"], r["size"]) for r in got if r["error"] is None] == [(1, 64)]
    assert {r["id"] for r in got if r["error"]} == {2, 4}


def test_media_of_no_rows(none):
    assert matroska.read_back(matroska.store(none)).count() == 0


def test_media_that_are_null_or_have_no_packets(spark):
    empty = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"matroska")) + matroska.element(matroska.SEGMENT, matroska.element(matroska.INFO, b""))
    rows = [(1, 2, None), (None, 2, matroska.build(b"x" * 64)), (3, 0, empty)]
    got = {r["doc_id"]: r for r in matroska.read_back(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["payload_bytes"] is None and got[1]["feature"] is None
    assert got[None]["payload_sha256"] == hashlib.sha256(b"x" * 64).hexdigest()
    assert got[3]["payload_bytes"] == 0 and got[3]["feature"].startswith("packets=0;")


# --- tokens --------------------------------------------------------------------------------------------------
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))


def test_no_piece_crosses_pre_tokens(encoder):
    for i in range(encoder.get_piece_size()):
        p = encoder.id_to_piece(i)
        assert not re.search("[^▁]▁", p) and "\n" not in p


def test_pre_tokens_count_like_the_library(encoder):
    r = random.Random(7)
    parts = [" ", "  ", "\n", "a", "the", "▁", "é", "\t", ".", "<s>", "日本", "\0", "   ", "\r", "1", "\xa0", "x\n\n", "🙂"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert sum(token_counts.piece_counts(token_counts.pre_tokens(t), encoder)) == len(encoder.encode(t)), repr(t)


@pytest.mark.parametrize("hot", [0, 20, 1 << 17])
def test_token_counts(docs, rows, encoder, hot):
    got = token_counts.count_tokens(docs, tokenizers.path("piece_bpe_32k.model"), hot_words=hot).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(encoder.encode(r[1] or "")), n > 4096) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_tokens_of_no_rows(none):
    assert token_counts.count_tokens(none, tokenizers.path("piece_bpe_32k.model")).count() == 0


# --- licenses ------------------------------------------------------------------------------------------------
def slow_scan(rows):
    out = []
    for r in rows:
        t = (r[1] or "").translate({c: c + 32 for c in range(65, 91)})
        split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
        w = split(t)
        at, base, more, best = [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            base |= {label} if hits else set()
        for label, text, must in license_scan.TEMPLATES:
            tokens, n = set(text.split()), len(text.split())
            stretches = (set(w[i : i + n + n // 4]) for i in range(len(w)))
            share = max((len(s & tokens) / len(tokens) for s in stretches if set(must.split()) <= s), default=0.0)
            if share >= 0.8:
                more.add(label)
                best = max(best, share)
        out.append((r[0], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best))
    return out


def test_license_scan(spark, docs, rows):
    extra = [
        (900, "Licensed under the Apache License, Version 2.0.\nmit LICENSE mit license", None, None, None),
        (901, "x This work is licensed under GNU General  Public\nLicense version 3", None, None, None),
        (902, "Licensed under CC BY-NC 4.0.", None, None, None),
        (903, "Redistribution and use in source and binary forms with or without modification are permitted provided the conditions are met", None, None, None),
        (904, "# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and\n# associated documentation files (the", None, None, None),
        (905, "Licensed under CC BY 4.0.", None, None, None),
        (906, "It was released under the license of the city", None, None, None),
        (907, "released " + "far " * 60 + "under the mit, license", None, None, None),
        (908, "of the and to " * 3000 + "This is free and unencumbered software\r\nreleased into the public domain." + " to the" * 500, None, None, None),
    ]
    extra = [(*e, "x", 1, 2, 0.5, 3, "k", 4, 5) for e in extra]
    both = rows + extra
    got = license_scan.scan(docs.unionByName(spark.createDataFrame(extra, SCHEMA))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_scan(both), key=str)
    labels = {g["doc_id"]: g["labels"] for g in got}
    assert labels[900] == "apache,mit" and labels[902] == "cc-by-nc" and "bsd" in labels[903]
    assert labels[904] == "mit" and labels[905] == labels[906] == "" and labels[908] == "unlicense"


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_license_thresholds_and_own_templates(spark, threshold):
    table = [("one", "a b c d", ""), ("two", "c d e a f g h", "e"), ("three", "b b b z", "")]
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghxyz") for _ in range(r.randint(0, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {g["doc_id"]: (g["labels"], g["score"]) for g in license_scan.scan(docs, table=table, threshold=threshold).collect()}
    for i, t in enumerate(texts):
        w, want = t.split(), {}
        for label, text, must in table:
            tokens, n = set(text.split()), len(text.split())
            stretches = (set(w[k : k + n + n // 4]) for k in range(len(w)))
            share = max((len(s & tokens) / len(tokens) for s in stretches if set(must.split()) <= s), default=0.0)
            if share >= threshold:
                want[label] = share
        assert got[i] == (",".join(sorted(want)), max(want.values(), default=0.0))


def test_licenses_equal_their_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = license_scan.scan(spark.read.parquet(path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({license_scan.oracle_sql()})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_license_scan_plan_has_no_python(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_licenses_of_no_rows(none):
    assert license_scan.scan(none).count() == 0
