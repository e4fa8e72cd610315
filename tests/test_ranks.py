"""Exact percentiles by narrowing value ranges, against NumPy."""

import numpy as np
import pytest

from optionlake.operators.ranks import percentiles
from optionlake.sources.stages import StageTables

SHARES = (0.0, 0.1, 0.5, 0.95, 1.0)


@pytest.mark.parametrize(("ranges", "held"), [(4, 1), (7, 20), (1024, 65_536)])
def test_percentiles_equal_numpy(spark, ranges, held):
    rng = np.random.default_rng(5)
    groups = {
        "hot": np.concatenate([rng.lognormal(0, 3, 700), np.full(300, 2.5), [1e12, -1e12]]),
        "ties": np.repeat([3.0, -1.0, 0.0], [50, 2, 9]), "one": np.array([7.0]),
        "huge": np.array([-1.7e308, 1.7e308, 0.0, 5e-324]), None: rng.normal(size=40),
        "zeros": np.array([0.0, -0.0, 0.0]),
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "share string, v double").repartition(5)
    got = percentiles(StageTables(spark), df.withColumnRenamed("share", "model"), ["model"], "v",
                      SHARES, "p", ranges, held).collect()
    assert len(got) == len(groups) * len(SHARES)
    for r in got:
        xs = np.sort(groups[r.model])
        at = (len(xs) - 1) * r.share
        low, high, f = xs[int(np.floor(at))], xs[int(np.ceil(at))], at - np.floor(at)
        assert r.n == len(xs) and np.isclose(r.value, low * (1 - f) + high * f, rtol=1e-12, atol=0)


def test_percentiles_edges(spark):
    stages = StageTables(spark)
    empty = spark.createDataFrame([], "k string, v double")
    assert percentiles(stages, empty, ["k"], "v", (0.5,), "empty").count() == 0
    bad = spark.createDataFrame([("a", float("nan"))], "k string, v double")
    with pytest.raises(Exception, match="not finite"):
        percentiles(stages, bad, ["k"], "v", (0.5,), "bad").count()
