import numpy as np
import pytest

from corvane.operators import geometry


@pytest.mark.parametrize("few", [1, 10, 1000])
def test_quantile_in_pieces(few):
    r = np.random.default_rng(1)
    for x in (r.standard_normal(200), r.integers(0, 3, 200).astype(float), np.full(200, 0.25), r.standard_normal(1)):
        pieces = lambda x=x: iter(np.array_split(x, 7))
        for p in (0.0, 0.5, 0.95, 1.0):
            assert geometry.quantile(pieces, len(x), p, few, 16) == pytest.approx(np.quantile(x, p), abs=1e-12)


@pytest.mark.parametrize("entries", [1, 30, 1 << 20])
def test_cosines_of_each_pair_once(entries):
    u = np.random.default_rng(2).standard_normal((13, 4))
    got = np.sort(np.concatenate(list(geometry._cosines(u, entries))))
    assert got == pytest.approx(np.sort((u @ u.T)[np.triu_indices(13, 1)]))


def test_shape_of_few_windows(spark):
    rows = [(0, 0, 0, i, 1, v) for i, v in enumerate([[3.0, 0.0], [0.0, 2.0], [0.0, 0.0]])] + [(1, 0, 0, 9, 1, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "site int, genre int, model int, doc_idx long, chunk_no int, v array<double>")
    a = geometry.anisotropy(d).collect()
    assert len(a) == 1 and (a[0].mean_cos, a[0].p95_cos) == (0.0, 0.0) and a[0].mean_norm == pytest.approx(5 / 3)
    assert {r.site: r.mean_cos for r in geometry.mean_cosine(d).collect()} == {0: 0.0, 1: None}
