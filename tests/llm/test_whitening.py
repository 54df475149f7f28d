"""Whitening against numpy's eigenproblem on all vectors at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import op13_whitening
from marginalia.llm.op13_whitening import Spectrum, whiten

SHAPE = "vec_id long, embedding array<float>"


def grown(x, size):
    out = Spectrum(size)
    for row in x:
        out.add(row)
    return out


def scatter(x):
    off = x - x.mean(0)
    return off.T @ off


@pytest.mark.parametrize("kind", ["plain", "copies", "few", "flat", "close", "one dimension"])
def test_updates_and_merges_equal_the_scatter_matrix(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1 if kind == "one dimension" else 12)) * 300 + 1e5
    if kind == "copies":
        x = x[rng.integers(0, 3, 400)]
    elif kind == "few":
        x = x[:5]
    elif kind == "flat":
        x[:, 6:] = x[:, :6]
    elif kind == "close":
        x[:, 1] = x[:, 0] + rng.normal(size=400) * 1e-7
    whole, size = scatter(x), x.shape[1]
    for cuts in ([], [3], [1, 2, len(x) // 2]):
        parts = [grown(p, size) for p in np.split(x, cuts)]
        for other in parts[1:]:
            parts[0].merge(Spectrum.from_bytes(other.to_bytes(), size))
        s = parts[0]
        scale = np.abs(whole).max()
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0), rtol=1e-13)
        assert np.abs(s.vectors * s.values @ s.vectors.T - whole).max() < 1e-12 * scale
        assert np.abs(s.vectors.T @ s.vectors - np.eye(size)).max() < 1e-12
        assert np.abs(s.values - np.linalg.eigvalsh(whole)).max() < 1e-12 * scale


def expected(vectors, k=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = (x - sums / n).astype(float)
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return deviation, y @ turn, values, (y * y).sum() / n


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    x[100:400] = x[100]  # a common vector
    odd = [(1, None), (2, []), (3, [None] * 12), (4, [float("nan")] * 12), (5, [float("inf")] + [0.0] * 11), (6, [1.0] * 5), (None, None)]
    rows = [(i + 100, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (100, x[1].tolist())] + odd
    table = spark.createDataFrame(rows, SHAPE).withColumns({"n": F.lit(1), "id": F.lit("clash"), "x": F.lit(2)}).repartition(40)
    kept = [(i, v) for i, v in rows if v and len(v) == 12 and None not in v and np.isfinite(v).all()]
    deviation, projected, values, trace = expected([v for _, v in kept])
    got = whiten(table).collect()
    assert len(got) == 8 * len(kept) and {r.n for r in got} == {len(kept)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    by = {c: [r for r in got if r.component == c] for c in range(1, 9)}
    for c, found in by.items():
        assert abs(found[0].explained - values[c - 1] / trace) < 1e-12
        want = projected[:, c - 1] / math.sqrt(values[c - 1])
        at = {}
        for (i, _), d, w in zip(kept, deviation, want):
            at.setdefault((i, d), []).append(abs(w))
        for r in found:
            w = at[(r.vec_id, r.deviation)].pop()
            assert abs(abs(r.whitened) - w) < 1e-9
        assert not any(at.values())
        signs = {np.sign(r.whitened * w) for r in found if r.vec_id not in (None, 100) for w in [want[r.vec_id - 100]] if abs(w) > 1e-6}
        assert len(signs) == 1  # one sign for all rows


def test_few_equal_and_no_vectors(spark):
    one = whiten(spark.createDataFrame([(7, [1.0, 2.0])], SHAPE)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    two = sorted(whiten(spark.createDataFrame([(7, [1.0, 2.0, 0.5]), (8, [1.0, 3.0, 0.5])], SHAPE)).collect(), key=lambda r: (r.vec_id, r.component))
    assert [None if r.whitened is None else round(abs(r.whitened), 12) for r in two] == [1, None, None] * 2
    assert [r.explained for r in two] == pytest.approx([1, 0, 0] * 2) and {r.deviation for r in two} == {1024**2}
    empty = spark.createDataFrame([], SHAPE)
    assert whiten(empty).count() == 0 and whiten(spark.createDataFrame([(1, None)], SHAPE)).columns == whiten(empty).columns


def test_large_entries_are_exact_or_null(spark):
    rows = [(1, [3.0e5, 1.0]), (2, [-3.0e5, 2.0]), (3, [1.0e8, 0.0]), (4, [1.0e30, 0.0])]
    got = {r.vec_id: r for r in whiten(spark.createDataFrame(rows, SHAPE)).where("component = 1").collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows[:3]]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert set(got) == {1, 2, 3} and [got[i + 1].deviation for i in range(3)] == [w if w < 1 << 63 else None for w in want]


def test_states_meet_in_a_tree(spark):
    rows = spark.createDataFrame([(i, np.array([float(i)]).tobytes()) for i in range(300)], "part long, state binary")
    assert np.frombuffer(op13_whitening.folded(rows, op13_whitening.added), float)[0] == sum(range(300))
