"""Work that must not grow faster than its input or its result, and ties."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalspark.functions import kernels
from signalspark.operators import connectivity, coupling, graph, series, subspace
from signalspark.plans import catalog


def shares(rows):
    inside, models = defaultdict(list), {m for _, m, _ in rows}
    for i, m, v in rows:
        if None not in (i, m, v):
            inside[m, v].append(i)
    met = Counter((a, b) for c in inside.values() for a in c for b in c if a < b)
    return {p: n / len(models) for p, n in met.items()}


@pytest.mark.parametrize("models", [3, 70])
@pytest.mark.parametrize("block", [1, 4, 2048])
def test_coassociation_by_blocks(spark, models, block):
    r = np.random.default_rng(2)
    rows = [(i, m, int(v) if v else None) for i in range(25) for m in range(models) for v in [r.integers(0, 4 if models == 3 else 40)]]
    rows += [(3, 0, 1), (3, 0, 1), (7, 1, 2), (None, 0, 1), (4, None, 1), (99, 2, 3)]
    got = graph.coassociation(spark.createDataFrame(rows, "item int, model int, label int"), "item", "model", "label", block, 10)
    found = {(g["a"], g["b"]): g["share"] for g in got.collect()}
    assert got.count() == len(found) and found == pytest.approx(shares(rows))


def test_pairs_of_items_are_not_shuffled(spark):
    rows = spark.range(3000).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("model"), F.lit(0).alias("label"))
    got = graph.coassociation(rows, "id", "model", "label")
    written = got.where("share = 1")
    assert written.count() == 3000 * 2999 // 2
    assert len(got.groupBy(F.spark_partition_id()).count().collect()) > 2
    assert graph.coassociation(rows.limit(0), "id", "model", "label").count() == 0


def test_items_alike_share_one_comparison(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def shown(share):
        seen.add(1)
        return round(share, 3)

    rows = spark.range(1200).select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model")).select("id", "model", (F.col("id") % F.col("model")).alias("label"))
    got = graph.coassociation(rows, "id", "model", "label", shown=shown).groupBy("share").count().collect()
    assert {g["share"]: g["count"] for g in got} == {0.333: 400 * 600, 0.667: 600 * 400 // 2 + 400 * 600, 1.0: 6 * 200 * 199 // 2}
    assert seen.value < 1000


def test_extremes_with_ties_take_the_least_id(spark, tmp_path):
    rows = [(i, "a", float(v)) for i, v in ((5, 2), (3, 2), (9, 2), (4, 1), (2, 1), (8, 1))] + [(1, "a", None), (6, "b", None)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_type"]: (r["top"], r["low"]) for r in catalog.QUERIES["arg_extremes"](spark, str(tmp_path)).collect()}
    assert got == {"a": (3, 2), "b": (None, None)}


def test_penalties_of_equal_error_go_to_the_first(spark):
    r = np.random.default_rng(1)
    rows = [(i, *map(float, r.normal(100, 40, 3))) for i in range(60)]  # one row a key: no other row to learn from
    got = coupling.ridge_loo(spark.createDataFrame(rows, "g int, a double, b double, y double"), ["g"], ["a", "b"], "y", [1e2, 1e5, 1e8])
    assert {r["alpha"] for r in got.collect()} == {1e2}


def test_the_penalty_of_single_rows_is_that_of_the_sql(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = []
    for u in range(200):
        at = np.sort(r.integers(1, 86_400_000_000, 30))
        rows += [(u, "view", int(t), float(v)) for t, v in zip(at, r.exponential(60, 30).round(2), strict=True)]
        rows += [(u, "click", int(t), float(v)) for t, v in zip(r.integers(at[20], at[29], 1 + u % 2), r.exponential(60, 2).round(2), strict=False)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "event_id long, user_id long, event_type string, us long, value double")
    df.select("event_id", "user_id", "event_type", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "value").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["heart_to_brain"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES['heart_to_brain']})").fetchall()
    assert len({w[3] for w in want if w[2] == 1}) == 3 and sorted(map(tuple, got.collect())) == sorted(want)


def test_kernels_see_a_bounded_block_of_epochs(spark):
    rows = spark.range(0, 3000, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.col("id") * k % 17).cast("double")).alias("x"))

    def seen(x):
        return {"n": np.full(len(x), float(x.size)), "s": x.sum(axis=1)}

    got = kernels.map_epochs(rows, ["id"], seen, "n double, s double").collect()
    assert len(got) == 3000 and max(r["n"] for r in got) <= kernels.BLOCK
    assert all(r["s"] == sum(r["id"] * k % 17 for k in range(64)) for r in got)
    long = spark.createDataFrame([(1, [1.0] * (kernels.BLOCK + 1))], "id int, x array<double>")
    assert kernels.map_epochs(long, ["id"], seen, "n double, s double").first()["n"] == kernels.BLOCK + 1


def test_pairs_of_channels_reach_python_in_slices():
    batches = [pa.record_batch({"v": list(range(n))}) for n in (300, 0, 5)]
    got = list(connectivity._slices(iter(batches), 128))
    assert max(b.num_rows for b in got) <= 128 and [v for b in got for v in b.column(0).to_pylist()] == [*range(300), *range(5)]


def test_a_segment_gets_its_model_once(spark):
    rows = spark.range(0, 4000).select(F.lit("r").alias("rec"), (F.col("id") % 4).alias("chan"), F.floor(F.col("id") / 4).alias("t"), F.sin("id").alias("x"))
    model = subspace.subspace_model(rows, ["rec"], 50, 3.0)
    got = subspace.subspace_clean(rows, model, ["rec"], 64, 16, 32, 256)
    sides = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in sides and "FlatMapGroupsInPandas" not in sides
    whole = subspace.subspace_clean(rows, model, ["rec"], 64, 16, 32, 1 << 16)
    assert [round(r["x"], 9) for r in got.orderBy("t", "chan").collect()] == [round(r["x"], 9) for r in whole.orderBy("t", "chan").collect()]


def test_block_errors_do_not_depend_on_stretches(spark):
    r = np.random.default_rng(5)
    rows = [(k, i, None if r.random() < 0.05 else float(v)) for k, n in (("a", 400), (None, 150), ("b", 3)) for i, v in enumerate(r.normal(size=n))]
    df = spark.createDataFrame([("a", -1, None), *rows], "k string, i long, x double").where("i >= 0")
    sizes = [{(g["k"], g["scale"], round(g["error"], 9)) for g in series.block_errors(df, ["k"], 4, 1.2, size=s).collect()} for s in (7, 64, 1 << 16)]
    assert sizes[0] == sizes[1] == sizes[2] and {k for k, _, _ in sizes[0]} == {"a", None}
    assert series.block_errors(df.limit(0), ["k"], 4, 1.2).count() == 0
