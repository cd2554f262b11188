"""Graph rounds over packed neighbours."""

import numpy as np

from loomgraph.lineage import cut
from loomgraph.operators import vectors


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashes_are_sparks(spark):
    rows = spark.sql("select xxhash64(s) as h, xxhash64(s, 7) as want from values ('a'), ('bc'), ('') as t(s)").collect()
    assert vectors.hash_int(7, np.array([r["h"] for r in rows])).tolist() == [r["want"] for r in rows]


def test_numbers_have_no_gaps(spark):
    v, n = vectors.numbered(spark.range(1000).repartition(7).selectExpr("cast(id % 900 as string) as id"))
    assert n == 900 and sorted(r["i"] for r in v.collect()) == list(range(900))


def test_a_turn_of_the_communities_shuffles_nothing(spark):
    v = cut(spark.sql("select cast(i as bigint) as i, xxhash64(cast(i as string)) as h, 1.0D as k, cast(i as bigint) as c from range(4) as t(i)"))
    links = cut(spark.sql("select cast(i as bigint) as i, array(i + 1 - i % 2 * 2) as ends, array(1.0D) as weights from range(4) as t(i)"))
    turn = vectors.louvain_turn(links, 4, 4.0, v._cut_path, v._cut_path, v._cut_path, 0)
    assert "Exchange" not in _plan(turn)
    assert all(r["c"] in (r["i"], r["i"] + 1 - r["i"] % 2 * 2) for r in turn.collect())


def test_a_round_of_pagerank_reads_packed_links_and_counts_pairs_once(spark):
    links = cut(spark.sql("select cast(i as bigint) as i, case when i = 0 then array(1L, 2L) else array() end as sources from range(3) as t(i)"))
    ranks = vectors.pagerank_rounds(links, 3, 0.85, 2)
    assert "Exchange" not in _plan(ranks)
    assert abs(sum(r["rank"] for r in ranks.collect()) - 1) < 1e-12
