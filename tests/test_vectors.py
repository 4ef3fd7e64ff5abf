"""The vector index against the exact search."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from fernweft.functions.ivf import Lists, VectorIndex, k_means, nearest
from fernweft.functions.vectors import Best, top_neighbours
from fernweft.plans.extensions import CATALOG as EXTENSIONS


@pytest.fixture(scope="module")
def rows(spark):
    """Vectors around some directions, repeated ones and a null among them."""
    rng = np.random.default_rng(4)
    around = rng.standard_normal((12, 16)) * 3
    vectors = [(around[i % 12] + rng.standard_normal(16)).tolist() for i in range(600)]
    return spark.createDataFrame([*enumerate(vectors), (900, vectors[0]), (901, vectors[0]), (902, None)], "i int, v array<double>").repartition(4)


def found(df):
    return sorted((r.query_id, r.rank, r.neighbour_id, round(r.score, 9)) for r in df.collect())


def test_all_lists_give_the_exact_result(rows):
    index = VectorIndex.build(rows, "i", "v", Lists(lists=9))
    queries = rows.where("i % 7 = 0 or i >= 900")
    exact = found(top_neighbours(rows, queries, "i", "v", 5))
    assert found(index.search(queries, "i", "v", 5, probes=9)) == exact
    assert found(index.search(queries, "i", "v", 5, probes=9, block_bytes=2000)) == exact
    assert index.scanned_share(queries, "i", "v", 9) == 1.0


def test_every_row_is_indexed_whatever_the_sample(rows):
    index = VectorIndex.build(rows, "i", "v", Lists(sample=40))
    assert sorted(r.id for r in index.rows.collect()) == sorted(r.i for r in rows.where("v is not null").collect())
    again = VectorIndex(rows.sparkSession, index.path)
    assert np.array_equal(again.centroids, index.centroids) and again.rows.count() == 602


def recall(got, exact):
    return len({(q, n) for q, _, n, _ in got} & {(q, n) for q, _, n, _ in exact}) / len(exact)


def test_recall_grows_with_the_lists_that_are_read(rows):
    index = VectorIndex.build(rows, "i", "v", Lists(lists=24))
    queries = rows.where("i % 5 = 0")
    exact = found(top_neighbours(rows, queries, "i", "v", 10))
    shares = [index.scanned_share(queries, "i", "v", p) for p in (1, 6, 24)]
    recalls = [recall(found(index.search(queries, "i", "v", 10, p)), exact) for p in (1, 6, 24)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0 and recalls[1] >= 0.9
    assert shares == sorted(shares) and shares[1] < 0.5 and shares[2] == 1.0


def test_recall_on_the_given_vectors(spark):
    sf_dir = "/root/testdata/sf0.01"
    exact = EXTENSIONS.queries["x2_top_neighbours"](spark, sf_dir)
    got = EXTENSIONS.queries["x2_index_neighbours"](spark, sf_dir)
    assert got.columns == exact.columns and recall(found(got), found(exact)) >= 0.9


def test_empty_tables(rows):
    index = VectorIndex.build(rows.limit(0), "i", "v")
    assert index.search(rows, "i", "v", 3, 2).count() == 0
    full = VectorIndex.build(rows, "i", "v")
    assert full.search(rows.limit(0), "i", "v", 3, 2).count() == 0


def test_k_means_fills_all_lists():
    rng = np.random.default_rng(1)
    points = np.repeat(rng.standard_normal((5, 3)), 30, axis=0)
    centroids = k_means(points, 5, 10, 2)
    assert len(np.unique(nearest(points, centroids))) == 5


@pytest.mark.parametrize("rows_back", [False, True])
def test_memory_is_not_that_of_all_scores(rows_back):
    """20,000 queries and a batch of 10,000 rows, many of them copies: their
    scores alone are 1.6 GB."""
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.standard_normal((500, 8)), 20, axis=0)
    ids = np.arange(10_000)[:: -1 if rows_back else 1].copy()
    queries = rng.standard_normal((20_000, 8))
    best = Best(np.arange(20_000) + 9_990, queries, 5)
    tracemalloc.start()
    best.meet(ids, rows)
    got = [b.to_pydict() for b in best.batches()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    found = {}
    for b in got:
        for q, n in zip(b["query_id"], b["neighbour_id"]):
            found.setdefault(q, []).append(n)
    for q in (0, 5, 19_999):
        scores = np.einsum("ij,ij->i", np.repeat(queries[q : q + 1], 10_000, 0), rows)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q + 9_990][:5]
        assert found[q + 9_990] == ids[order].tolist()


def test_numbers_of_lists_are_chosen_in_tiles(rows):
    """Lists of a batch are not made into Python numbers; all queries have theirs."""
    index = VectorIndex.build(rows, "i", "v", Lists(lists=24))
    asked = index.probed(rows, "i", "v", 24).collect()
    assert len(asked) == 602 and all(sorted(r.lists) == list(range(24)) for r in asked)


def test_lists_are_found_in_tiles():
    """10,000 rows and 1,250 lists: their distances alone are 100 MB."""
    rng = np.random.default_rng(2)
    rows, centroids = rng.standard_normal((10_000, 4)), rng.standard_normal((1250, 4))
    tracemalloc.start()
    got = nearest(rows, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(got) == 10_000
    assert all(got[i] == ((rows[i] - centroids) ** 2).sum(1).argmin() for i in range(0, 10_000, 97))
