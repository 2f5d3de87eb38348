import math
import random

import pytest

from signalspark.operators import stats


@pytest.mark.parametrize("kappa", [1.0, 0.7, 30.0])
def test_far_pairs_have_their_weight(spark, kappa):
    r = random.Random(1)
    near = [r.choice("ab") for _ in range(700)]
    rows = [("s", i, c) for i, c in enumerate(near)] + [("t", i, "x" if i == 0 else "y" if i == 60 else "z") for i in range(61)]
    got = {(g["rec"], g["u"], g["v"]): g for g in stats.sequence_graph(spark.createDataFrame(rows, "rec string, i long, sym string"), ["rec"], "i", "sym", kappa).collect()}
    want: dict = {}
    for key in "st":
        seq = [c for k, _, c in rows if k == key]
        for j in range(len(seq)):
            for i in range(j):
                n, total = want.get((key, seq[i], seq[j]), (0, 0.0))
                want[key, seq[i], seq[j]] = n + 1, total + math.exp(-kappa * (j - i))
    assert set(got) == set(want)
    for k, (n, total) in want.items():
        assert got[k]["n"] == n and got[k]["weight"] == pytest.approx((total / n) ** (1 / kappa), rel=1e-9)
    if kappa == 1.0:
        assert got["t", "x", "y"]["weight"] == pytest.approx(math.exp(-60), rel=1e-9)
