"""The plans that queries should have."""

from larkspur import queries as Q
from larkspur.plans import inspect as P

SF = "/root/testdata/sf0.001"


def plan(spark, sql, params=()):
    return Q.engine(spark, SF).sql(sql, params)


def test_filters_and_columns_reach_the_scan(spark):
    df = plan(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
    (pushed,) = P.pushed_filters(df)
    assert "GreaterThan(o_totalprice,1000.0)" in pushed and "EqualTo(o_orderstatus,F)" in pushed
    (cols,) = P.read_columns(df)
    assert set(cols) <= {"o_orderkey", "o_totalprice", "o_orderstatus"}


def test_integer_keys_stay_bare(spark):
    df = plan(spark, "SELECT c_name FROM customer WHERE c_nationkey = 7")
    assert "EqualTo(c_nationkey,7)" in P.pushed_filters(df)[0]


def test_top_n_keeps_a_bounded_heap(spark):
    assert "TakeOrderedAndProject" in P.text(plan(spark, "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 5"))


def test_aggregates_combine_before_the_exchange(spark):
    t = P.text(plan(spark, "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"))
    assert "partial_count" in t


def test_no_python_in_plain_queries(spark):
    for name in ("range_scan", "like_nocase", "three_way_join", "json_extract", "substr_neg", "fts_bm25_topk"):
        assert "Python" not in P.text(Q.queries()[name](spark, SF)), name


def test_count_of_pairs_makes_no_pairs(spark):
    df = Q.queries()["self_join_count"](spark, SF)
    assert "Join" not in P.text(df) and "rangepartitioning" in P.text(df)
    assert "Join" in P.text(plan(spark, "SELECT COUNT(*) FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey"))
