"""Interval joins ask only the levels that there are, and each place once."""

from loomgraph.operators import ranges


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_site_asks_levels_that_have_scopes(spark):
    a = spark.sql("select 's' || id as site, 'f' as file, id as start, id + 1 as end from range(50)")
    b = spark.sql("select 'f' as f, id as s, id + id % 40 as e, id as o from range(-9, 50)")
    found = ranges.around(a, b)
    assert "sequence(0, 40" not in _plan(found)
    want = {(f"s{x}", o) for x in range(50) for o in range(-9, 50) if o <= x and (o + (abs(o) % 40 * (1 if o >= 0 else -1))) >= x + 1}
    assert {(r["site"], r["o"]) for r in found.select("site", "o").collect()} == want


def test_qualifying_joins_once_and_keeps_repeated_functions(spark):
    d = spark.createDataFrame([("x", "function", "a", 0, 9, 0), ("x", "function", "b", 2, 3, 1), ("x", "function", "c", 20, 21, 2), ("x", "function", "c", 20, 21, 2)], "file string, kind string, name string, start long, end long, ordinal long")
    ids = ranges.qualify(d)
    assert sorted(r["id"] for r in ids.collect()) == ["x#a", "x#a.b", "x#c", "x#c"]
    assert "LeftOuter" not in _plan(ids)


def test_a_place_of_many_uses_is_sought_once(spark):
    occ = [("t", 1, "function", "a", 0, 0, 5), ("u", 1, "function", "a", 0, 1, 1)] + [("t", 0, "function", "a", 0, 2 + k, 1) for k in range(4)] + [("t", 0, "function", "a", 0, 9, 99), ("t", 0, "function", "a", 0, 10, 5)]
    occurrences = spark.createDataFrame(occ, "symbol string, symbol_roles int, kind string, file string, doc_idx int, occ_idx int, row long")
    scopes = spark.createDataFrame([("a#u", "a", 0, 2, 0), ("a#t", "a", 4, 6, 1)], "id string, file string, start long, end long, ordinal long")
    _, edges, counts = ranges.index_edges(occurrences, scopes)
    assert [(r["src"], r["dst"], r["call_count"]) for r in edges.collect()] == [("a#u", "a#t", 4)]
    assert tuple(counts.select("symbols", "resolved", "unresolved", "call_sites", "outside", "recursive").first()) == (2, 2, 0, 6, 1, 1)
    assert "occ_idx" not in _plan(edges).split("Aggregate")[1]
