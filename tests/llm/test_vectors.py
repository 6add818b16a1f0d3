"""Hard negatives and whitening against brute force, and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from doorflux.llm import negatives, whitening
from doorflux.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, anchor string, _vector int, score int"
BAD = [
    (None, [1.0, 0.0], 1), (20, None, 1), (21, [float("nan"), 1.0], 1), (22, [float("inf"), 1.0], 1),
    (23, [None, 1.0], 1), (24, [3e38, 1.0], 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def plain_negatives(rows, is_anchor, positives=5, negatives_=10):
    """Every anchor against every row, by the contract's words."""
    rows = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None
            and all(x is not None and math.isfinite(x) and abs(x) < 2**14 for x in v)]
    out = []
    for k, (a, va, la) in enumerate(rows):
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, lab == la) for n, (i, v, lab) in enumerate(rows) if n != k)
        for ps, pi, _ in [s for s in scored if s[2]][:positives]:
            inside = [(s, i) for s, i, same in scored if not same and -30 * ps <= -100 * s <= -90 * ps]
            out += [(a, pi, r + 1, i, -ps, -s) for r, (s, i) in enumerate(inside[:negatives_])]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0, F.col("label"), **options).collect())


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_negatives_equal_every_pair(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(int(k), rng.normal(size=6).astype("f4").tolist(), int(rng.integers(0, 4))) for k in range(150)]
    # a third of the rows are one vector, half of those under one id
    rows += [(1000 + k, rows[0][1], int(k % 2)) for k in range(40)] + [(20, rows[0][1], 2)] * 40
    # vectors of whole numbers tie often; repeated anchors; other lengths
    rows += [(2000 + k, [float(x) for x in rng.integers(0, 2, 6)], 3) for k in range(60)]
    rows += [rows[10], rows[10], (30, rows[7][1], 1), (3000, [1.0, 1.0], 1), (3001, [], 0), (3010, [0.5] * 9, 2)]
    df = frame(spark, rows + BAD).repartition(5)
    assert mined(df, block_rows=block_rows) == plain_negatives(rows + BAD, lambda i: i % 10 == 0)


def test_slots_answer_every_window():
    rng = np.random.default_rng(5)
    positives = rng.integers(-50, 400, (30, 5))
    positives[0], positives[1] = 0, -5
    positives[2, 1:] = positives[2, 0]
    low, high = negatives.limits(positives, 30, 90)
    upper, lower = negatives.slots_of(low, high)
    for k in range(len(positives)):
        for score in range(-100, 401):
            held = [s for s in range(5) if lower[k, s] <= score <= upper[k, s]]
            wanted = any(low[k, n] <= score <= high[k, n] for n in range(5))
            assert len(held) <= 1 and (held or not wanted)


def test_hard_negatives_of_edge_tables(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, BAD)) == []
    assert mined(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)])) == []
    assert mined(frame(spark, [(0, [-1.0], 1), (10, [1.0], 1), (3, [0.5], 2)])) == []
    assert mined(frame(spark, [(0, [1.0], 1), (1, [1.0], 1), (3, [0.5], 2), (4, [0.5], 3)])) == [
        (0, 1, 1, 3, 65536, 32768), (0, 1, 2, 4, 65536, 32768)
    ]


# -- whitening -------------------------------------------------------------------


@pytest.mark.parametrize("values", [
    [5.0, 4.0, 3.0, 2.0, 1.0], [2.0, 2.0, 2.0, 1.0, 1.0], [1.0] * 4, [1.0, 1 + 1e-13, 1 - 1e-13, 0.5],
    [1e8, 1.0, 1e-8, 0.0], [3.0, 0.0, 0.0, 0.0], [7.0], [1.0, 0.0], list(np.geomspace(1, 1e-12, 40)), list(range(64)),
])
def test_divide_and_conquer(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    for a in (a, np.diag(values), np.roll(np.diag(values), 1, axis=(0, 1))):
        wanted = np.sort(np.linalg.eigvalsh((a + a.T) / 2))[::-1][:8]
        got, vectors = whitening.leading(a, 8)
        scale = np.linalg.norm(a)
        assert np.abs(got - wanted).max() < 1e-13 * scale
        assert np.abs(a @ vectors - vectors * got).max() < 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-12


def plain_whitening(rows):
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in x], object)
    centred = d.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    return n, (d * d).sum(axis=1), centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_a_plain_one(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, white, share = plain_whitening(rows)
    place = {r.vec_id: k for k, r in enumerate(rows)}
    found = QUERIES["op12_embedding_whitening"](spark, sf_dir).collect()
    assert len(found) == 8 * n
    got = np.zeros_like(white)
    for r in found:
        k = place[r.vec_id]
        got[k, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[k] and r.identity_error < 1e-12
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-10
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-9


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=3).tolist(), 1) for k in range(30)]
    rows += [rows[0]] * 20 + [(None, [0.5, 0.25, 0.0], None), (3000, [1.0, 1.0], 1), (3001, [], 0)] + BAD[1:]
    found = whitening.whiten(frame(spark, rows).repartition(3)).collect()
    kept = [(i, v) for i, v, _ in rows if v is not None and len(v) == 3]
    assert len(found) == 3 * len(kept) and {r.n for r in found} == {len(kept)}
    kept = [(i, np.array(v, "f4").astype(float).tolist()) for i, v in kept]
    _, deviation, white, _ = plain_whitening(kept)
    assert sorted({int(r.deviation) for r in found}) == sorted(set(deviation.tolist()))
    assert max(r.identity_error for r in found) < 1e-12
    assert sorted(round(abs(r.whitened), 6) for r in found) == pytest.approx(np.sort(np.abs(white).ravel()), abs=2e-6)
    for few in ([], BAD[1:], [(1, [1.0, 2.0], 1)], [(k, [1.0, 2.0], 1) for k in range(5)], [(1, [], 1)]):
        assert whitening.whiten(frame(spark, few)).collect() == []


def test_large_numbers_are_exact():
    x = np.array([[2**53 - 1, -(2**53) + 1, 5], [1, 2, 3]])
    moments = whitening.Moments(10**12, [3, -(10**27), 10**25])
    d = whitening.centred(x, moments)
    wanted = [sum((moments.count * int(c) - s) ** 2 for c, s in zip(row, moments.sums, strict=True)) for row in x.tolist()]
    assert whitening.deviations(d) == wanted
    small = whitening.centred(np.array([[3_000_000_000, 1]]), whitening.Moments(2, [0, 0]))
    assert whitening.deviations(small) == [36 * 10**18 + 4]
