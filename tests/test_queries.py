import pytest

from strandloom.plans import catalog as queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), sf_dir, queries.ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cluster_xmeans", "cluster_gmeans", "cluster_ap", "cluster_knn", "cluster_local", "cluster_modularity", "cluster_spectral", "cluster_dbscan"])
def test_clusters_cover_all_haplotypes(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block_ord"], []).append(r["cluster"])
    assert len(blocks) == 16
    for labels in blocks.values():
        assert set(labels) == set(range(max(labels) + 1))


def test_bigld_tiles_the_index(spark, sf_dir):
    rows = sorted((r["left_c"], r["right_c"]) for r in queries.QUERIES["bigld_like_partition"](spark, sf_dir).collect())
    assert rows[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(rows, rows[1:]))
