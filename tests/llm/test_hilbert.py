"""The curve itself, ties, odd vectors and inner products of vectors of any length."""

import numpy as np
import pytest

from corpus_spark.llm.hilbert import hilbert_index, nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>, curve int"


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (6, 2)])
def test_curve_visits_every_cell_and_steps_to_a_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_index(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def plain(rows, k, divisor=20):
    known = {}
    for i, v, _ in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            known[i] = np.array(v)
    return {
        q: sorted(((-float(known[q] @ x), i) for i, x in known.items() if i != q))[:k] for q in known if q % divisor == 0
    }


def test_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.1, 5)).tolist(), 0) for i in range(300)]
    rows += [(i, [1.0] * 8, 0) for i in range(300, 420)]  # one vector, many ids
    rows += [(500, None, 0), (520, [0.0] * 8, 0), (540, [float("nan")] + [1.0] * 7, 0), (560, [None] + [1.0] * 7, 0)]
    rows += [(580, [1.0] * 3, 0), (600, [], 0), (None, [1.0] * 8, 0), (620, [float("inf")] * 8, 0), (20, rows[20][1], 0)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = plain(rows, 10)
    assert set(got) == set(wanted)
    for q, best in wanted.items():
        assert [v for _, v, _ in sorted(got[q])] == [i for _, i in best]
        assert np.allclose([s for _, _, s in sorted(got[q])], [-s for s, _ in best], atol=1e-9)
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, len(best) + 1))


def test_recall_with_many_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 8)) * 3
    rows = [(i, (centres[i % 40] + rng.standard_normal(8) * 0.3).tolist(), 0) for i in range(8000)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), k=20, query_divisor=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    wanted = plain(rows, 20, 100)
    assert sum(len(got[q] & {i for _, i in best}) for q, best in wanted.items()) >= 0.9 * 20 * len(wanted)


def test_few_rows(spark):
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest_neighbours(spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)).count() == 0
    two = nearest_neighbours(spark.createDataFrame([(20, [1.0, 2.0], 0), (21, [2.0, 1.0], 0)], SCHEMA)).collect()
    assert [tuple(r) for r in two] == [(20, 1, 21, 4.0)]
