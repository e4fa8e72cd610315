"""Hard negatives against brute force and SQL; Strassen products against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect
from optionlake.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, n int, part long, score long"


def brute(rows, is_anchor, s=negatives.MiningSettings()):
    whole = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None:
            continue
        if all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, label, tuple(math.floor(s.scale * x) for x in v)))
    out = []
    for i, label, v in sorted({r for r in whole if is_anchor(r[0])}):
        dots = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole)
        positive = [(-p, j) for p, j, other in dots if other == label and j != i][:s.positives]
        for p, j in positive:
            fit = [(k, -n) for n, k, other in dots
                   if other != label and s.low * p <= 100 * -n <= s.high * p]
            out += [(i, j, r + 1, k, p, n) for r, (k, n) in enumerate(fit[:s.negatives])]
    return sorted(out)


def mined(spark, rows, modulus=5, **settings):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = negatives.hard_negatives(spark, docs, F.col("vec_id") % modulus == 0,
                                     negatives.MiningSettings(**settings))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                             "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (17, 33, 40), (64, 64, 64), (100, 1, 90)])
def test_strassen_equals_plain_products(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a = rng.integers(-(1 << 28), 1 << 28, (m, k))
    b = rng.integers(-(1 << 28), 1 << 28, (k, n))
    want = a.astype(object) @ b.astype(object)
    for leaf in (1, 4, 16):
        assert (negatives.strassen(a, b, leaf).astype(object) == want).all()


def test_scores_that_leave_int64_raise():
    big = np.full((1, 2), 1 << 31)
    with pytest.raises(OverflowError):
        negatives.tile_scores(big, big, 4)
    assert negatives.tile_scores(big[:, :1], big[:, :1] - 1, 4)[0, 0] == (1 << 31) * ((1 << 31) - 1)


def test_order_breaks_ties_by_column_for_scores_of_any_size():
    rng = np.random.default_rng(3)
    small = rng.integers(-3, 4, (6, 50))
    allowed = rng.random((6, 50)) < 0.7
    for scores in (small, small * (1 << 60)):
        for count in (None, 4):
            got = negatives.descending(scores, allowed, count)
            for i in range(6):
                want = sorted(np.flatnonzero(allowed[i]), key=lambda j: (-int(scores[i, j]), j))
                want = want[:count]
                assert got[i, :len(want)].tolist() == want


@pytest.mark.parametrize("blocks", [(2048, 512), (7, 2)])
def test_hard_negatives_match_brute_force(spark, blocks):
    rng = random.Random(5)
    rows = []
    for i in range(-20, 90):
        v = [rng.choice([0.0, 0.25, -0.5, 1.0, 1.5]) for _ in range(rng.choice([6, 6, 3]))]
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2, 3]), 1, 2, 3))
    rows += [rows[7], rows[7], (15, [1.0, 1.0], 2, 1, 2, 3)]        # repeated rows, a shared id
    rows += [(200, None, 1, 1, 2, 3), (205, [1.0, None], 1, 1, 2, 3), (None, [1.0], 1, 1, 2, 3),
             (210, [float("nan")], 1, 1, 2, 3), (215, [float("inf")], 0, 1, 2, 3),
             (220, [1.0], None, 1, 2, 3), (225, [], 0, 1, 2, 3)]
    got = mined(spark, rows, block=blocks[0], anchor_block=blocks[1])
    assert got == brute(rows, lambda i: i % 5 == 0) and got


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(3, [1.0], 1, 1, 2, 3)]) == []


def test_components_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="does not fit int64"):
        mined(spark, [(5, [1e300], 1, 1, 2, 3), (6, [1.0], 1, 1, 2, 3)])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    sf_dir = f"/root/testdata/{size}"
    got = queries.op11_negatives(spark, sf_dir)
    sql = connect(sf_dir).sql(queries.oracle_sql()["op11_negatives"])
    columns = sorted(got.columns)
    assert sorted(sql.columns) == columns
    want = sorted(sql.select(*columns).fetchall())
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and want
