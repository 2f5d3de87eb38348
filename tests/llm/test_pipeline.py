import random
from collections import defaultdict

import corpus_pipeline
from signalspark.llm import language_id
from tests.llm.test_corpus import slow_targets
from tests.llm.test_dedup import lower, slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]

    def step(name, df):
        stages[name](spark, df, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    known = step("language_id", docs)
    assert known.columns == columns
    pred = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    want = {i for i, r in pred.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert {r["doc_id"] for r in known.collect()} == want

    unique = step("exact_dedup", known)
    groups = defaultdict(list)
    for r in known.collect():
        groups[lower(r["text"])].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(max(g) for g in groups.values())

    apart = step("near_dedup", unique)
    rows = unique.collect()
    want = set(slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in rows]))
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(want)

    mixed = step("mixing", apart)
    assert mixed.columns == columns
    sizes, longest = defaultdict(int), defaultdict(int)
    for r in apart.collect():
        n = len(r["text"].split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    for s, t in slow_targets(sizes).items():
        assert abs(taken[s] - t) <= longest[s]

    packed = step("packing", mixed).toPandas()
    assert packed.n_tokens.sum() == sum(taken.values())
    assert packed.groupby("bin_id").n_tokens.sum().max() <= 4096
    assert packed.groupby("bin_id").cluster.apply(lambda c: c.duplicated().any()).sum() == 0


def test_odd_rows_pass_all_stages(spark, docs, tmp_path):
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, SF).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
    assert df.count() > 0


def test_no_rows_pass_all_stages(spark, none, tmp_path):
    df = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, SF).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
    assert df.count() == 0


def test_rows_of_one_id_or_none_stay_if_texts_differ(spark, tmp_path):
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    rows = [(None, text(), "en", "a", 1) for _ in range(6)] + [(7, text(), "en", "a", 1) for _ in range(3)] + [(8, text(), "en", "a", 1)]
    odd = [rows[0], (None, rows[1][1].upper(), "en", "a", 1), (9, rows[6][1], "en", "a", 1), (7, rows[7][1], "en", "a", 1)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted([(i, t) for i, t, *_ in rows if t != rows[6][1]] + [(9, rows[6][1])], key=str)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("exact_dedup", "near_dedup", "mixing"):
        stages[name](spark, df, SF).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert sorted(((x["doc_id"], x["text"].lower()) for x in df.collect()), key=str) == want


def test_each_stage_alone_takes_repeated_rows(spark):
    r = random.Random(6)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    rows = [(i, text(), "en", r.choice("ab"), 1) for i in range(12)] + [(None, text(), None, None, None)]
    rows += [rows[0]] * 2 + [rows[12]] * 2 + [(1, rows[1][1], "en", "b" if rows[1][3] == "a" else "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("exact_dedup", "near_dedup"):
        got = [(x["doc_id"], x["text"]) for x in stages[name](spark, df, SF).collect()]
        assert sorted(got, key=str) == sorted({x[:2] for x in rows}, key=str)
    sizes, want = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    mixed = stages["mixing"](spark, df, SF).collect()
    for x in mixed:
        want[x["source"]] += 40
    for s, t in slow_targets(sizes).items():
        assert abs(want[s] - t) <= 40


def test_run_equals_its_stages_and_every_query_gives_whole_tables(spark):
    from signalspark.llm import queries

    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert len(packed) and packed.groupby("bin_id").n_tokens.sum().max() <= 4096
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    per_document = ["op1_simhash", "op2_mixing", "op4_exact_dedup", "op5_language_id", "op6_matroska", "op7_token_counts", "op8_suffix_dedup", "op9_license_scan", "op10_sentence_dedup", "op13_line_dedup"]
    for name in per_document:
        ids = [x["doc_id"] for x in queries.queries()[name](spark, SF).select("doc_id").collect()]
        assert len(ids) == len(set(ids)) == n, name
