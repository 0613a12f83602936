import random

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def values(kind, n=3000):
    rng = random.Random(7)
    if kind == "spread":
        return [rng.gauss(10, 50) for _ in range(n)]
    if kind == "ties":
        return [float(rng.randrange(6)) for _ in range(n)]
    if kind == "one hot value":
        return [5.0] * (n // 2) + [rng.random() * 10 for _ in range(n // 2)]
    if kind == "two hot values":
        return [1.0] * (n // 2) + [2.0] * (n // 2 - 1) + [9.0]
    return [rng.random() ** 9 * 1e12 for _ in range(n - 200)] + [-1.0] * 200


@pytest.mark.parametrize("kind", ["spread", "ties", "one hot value", "two hot values", "tail"])
def test_search_by_rank_equals_pandas(spark, kind):
    data = values(kind)
    df = spark.createDataFrame(pd.DataFrame({"v": data}))
    found = quantiles.quantiles(df, ["v"], PROBS, buffer_values=20)["v"]
    expected = pd.Series(data).quantile(PROBS).tolist()
    assert np.allclose(found, expected, rtol=1e-12)


def test_one_pass_and_missing_values(frame):
    df = frame("v double, w double", (1.0, None), (2.0, None), (float("nan"), None), (4.0, None))
    found = quantiles.quantiles(df, ["v", "w"], [0.25, 0.5])
    assert found["v"] == [1.5, 2.0]
    assert found["w"] == [None, None]


def test_group_medians_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(500))) for _ in range(2000)]
    rows += [(f"k{i % 40}", rng.random()) for i in range(1000)] + [(None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    expected = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].median().dropna()
    for limit in (1_000_000, 100):
        found = quantiles.group_medians(df, "k", "v", buffer_values=limit).toPandas()
        found = found.set_index("k")["value"].sort_index()
        assert np.allclose(found, expected.sort_index())
        assert list(found.index) == list(expected.sort_index().index)
