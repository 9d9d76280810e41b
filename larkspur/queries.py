"""Registered queries of the dialect, one for each operator, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .fts.index import FtsIndex
from .scratch import shared_folder
from .search import DENORMALISED, OUTPUT, PLATFORMS, WEIGHTS, Params, search

ROWIDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "labels": "doc_id"}


class _Tables(dict):
    """Tables are read when a statement names them."""

    def __init__(self, engine: Engine, sf_dir: str):
        super().__init__()
        self.engine, self.sf_dir = engine, sf_dir

    def __contains__(self, name) -> bool:
        return dict.__contains__(self, name) or name in (*ROWIDS, "lineitem", "benchmark", "conversations", "embeddings")

    def __missing__(self, name):
        self.engine.register_parquet(name, f"{self.sf_dir}/{name}.parquet", ROWIDS.get(name))
        return self[name]


def engine(spark: SparkSession, sf_dir: str, root: str | None = None) -> Engine:
    e = Engine(spark, root)
    e.external = _Tables(e, sf_dir)
    return e


def _sql(text: str, params=()) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).sql(text, params)

    return run


def _fts(text: str, params=(), tokenize: str = "unicode61") -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.register_fts(index_of(spark, sf_dir, tokenize))
        return e.sql(text, params)

    return run


_built: dict[tuple, str] = {}


def index_of(spark: SparkSession, sf_dir: str, tokenize: str = "unicode61", again: bool = False) -> FtsIndex:
    """The index of documents."""
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path).select(F.col("doc_id").alias("docid"), F.col("text").alias("body"), F.col("source"))
    return _stored(spark, path, FtsIndex(spark, "fts", ["body", "source"], tokenize), docs, again)


def _stored(spark: SparkSession, path: str, index: FtsIndex, docs: DataFrame, again: bool = False) -> FtsIndex:
    """An index of a table is built once for each state of the table's files and kept in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))
    key = (spark.sparkContext.applicationId, path, index.manifest(), files)
    if key in _built and not again:
        return index.load(_built[key])
    place = f"{shared_folder(spark)}/fts-{uuid.uuid4().hex}"
    out = index.build(docs, place)
    _built[key] = place
    return out


def _written(steps: list, result: str) -> Callable:
    """Statements on managed tables of their own, then a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex}")
        for s in steps:
            e.run(s)
        return e.sql(result)

    return run


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_low = LOWER.format

#: name: (statement, parameters, SQL)
PLAIN: dict[str, tuple] = {
    "scan_full": ("SELECT c_custkey, c_name, c_acctbal FROM customer", (), "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "rowid_get": ("SELECT * FROM customer WHERE c_custkey = ?", (77,), "SELECT * FROM customer WHERE c_custkey = 77"),
    "rowid_in": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 5, 77, 999999999)", (), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 77)"),
    "index_prefix": ("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7", (), "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7"),
    "range_scan": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000", (), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000"),
    "prefix_range": ("SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 500", (), "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 500"),
    "covering_scan": ("SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY l_returnflag", (), "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1"),
    "where_3vl": ("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1 OR l.toxic = 1)", (), "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1 OR l.toxic = 1)"),
    "truthiness": ("SELECT c_custkey FROM customer WHERE c_nationkey AND c_acctbal > 0", (), "SELECT c_custkey FROM customer WHERE c_nationkey <> 0 AND c_acctbal > 0"),
    "like_nocase": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%AN%'", (), f"SELECT p_partkey, p_name FROM part WHERE {_low('p_name')} LIKE '%an%'"),
    "like_prefix_param": ("SELECT p_partkey FROM part WHERE p_type LIKE $p", {"p": "st%"}, f"SELECT p_partkey FROM part WHERE {_low('p_type')} LIKE 'st%'"),
    "in_list_null": ("SELECT p_partkey, p_size NOT IN (1, 2, NULL) AS x FROM part", (), "SELECT p_partkey, CAST(p_size NOT IN (1, 2, NULL) AS BIGINT) AS x FROM part"),
    "between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1200", (), "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1200"),
    "is_null": ("SELECT d.doc_id, l.quality IS NULL AS x FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", (), "SELECT d.doc_id, CAST(l.quality IS NULL AS BIGINT) AS x FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c FROM orders", (), "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS BIGINT) AS c FROM orders"),
    "case_searched": ("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS tier FROM customer", (), "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS tier FROM customer"),
    "collate_nocase_eq": ("SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE NOCASE = 'Building'", (), f"SELECT c_custkey FROM customer WHERE {_low('c_mktsegment')} = 'building'"),
    "text_number_compare": ("SELECT doc_id FROM documents WHERE n_chars > '3000' AND source > 5", (), "SELECT doc_id FROM documents WHERE n_chars > 3000"),
    "int_div": ("SELECT o_orderkey, o_custkey / 7 AS q, -o_custkey / 7 AS r FROM orders", (), "SELECT o_orderkey, o_custkey // 7 AS q, -(o_custkey // 7) AS r FROM orders"),
    "mod": ("SELECT o_orderkey, o_custkey % 7 AS m, -o_custkey % 7 AS k FROM orders", (), "SELECT o_orderkey, o_custkey % 7 AS m, (-o_custkey) % 7 AS k FROM orders"),
    "safe_div": ("SELECT l_orderkey, l_linenumber, l_extendedprice / (l_linenumber - 1) AS x FROM lineitem", (), "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice / (l_linenumber - 1) END AS x FROM lineitem"),
    "arithmetic": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS x FROM lineitem", (), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS x FROM lineitem"),
    "concat": ("SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS x FROM customer", (), "SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS x FROM customer"),
    "cast_prefix_int": ("SELECT o_orderkey, CAST(o_orderpriority AS INTEGER) AS p FROM orders", (), "SELECT o_orderkey, coalesce(TRY_CAST(regexp_extract(o_orderpriority, '^\\s*([-+]?\\d+)', 1) AS BIGINT), 0) AS p FROM orders"),
    "cast_real_int": ("SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS x, CAST(c_custkey AS REAL) AS r, CAST(c_custkey AS TEXT) AS t FROM customer", (), "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS x, CAST(c_custkey AS DOUBLE) AS r, CAST(c_custkey AS VARCHAR) AS t FROM customer"),
    "lower_upper_ascii": ("SELECT doc_id, LOWER(text) AS l, UPPER(lang) AS u FROM documents", (), f"SELECT doc_id, {_low('text')} AS l, upper(lang) AS u FROM documents"),
    "length": ("SELECT doc_id, LENGTH(text) AS n FROM documents", (), "SELECT doc_id, length(text) AS n FROM documents"),
    "instr": ("SELECT doc_id, INSTR(text, 'the') AS i FROM documents", (), "SELECT doc_id, instr(text, 'the')::BIGINT AS i FROM documents"),
    "substr_neg": ("SELECT doc_id, SUBSTR(text, -12) AS a, SUBSTR(text, 3, 7) AS b, SUBSTR(text, 0, 4) AS c FROM documents", (), "SELECT doc_id, right(text, 12) AS a, substr(text, 3, 7) AS b, left(text, 3) AS c FROM documents"),
    "coalesce": ("SELECT d.doc_id, COALESCE(l.quality, l.toxic, -1) AS x FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", (), "SELECT d.doc_id, coalesce(l.quality, l.toxic, -1)::BIGINT AS x FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "inner_join": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", (), "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "hash_join_residual": ("SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_extendedprice > o.o_totalprice / 4", (), "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_extendedprice > o.o_totalprice / 4"),
    "left_join": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey", (), "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey"),
    "left_join_on_residual": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000", (), "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000"),
    "anti_left_null": ("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' WHERE o.o_orderkey IS NULL", (), "SELECT c.c_custkey FROM customer c ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o.o_custkey = c.c_custkey"),
    "theta_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey", (), "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey"),
    "self_join_count": ("SELECT COUNT(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey", (), "SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey"),
    "merge_join_count": ("SELECT COUNT(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey", (), "SELECT count(*) AS n FROM orders"),
    "three_way_join": ("SELECT r.r_name, COUNT(*) AS n, SUM(c.c_acctbal) AS s FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", (), "SELECT r_name, count(*) AS n, sum(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "existence_count": ("SELECT c.c_mktsegment, COUNT(*) AS n FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment", (), "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "group_count_sum": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, SUM(l_linenumber) AS k FROM lineitem GROUP BY l_returnflag, l_linestatus", (), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, sum(l_linenumber)::BIGINT AS k FROM lineitem GROUP BY 1, 2"),
    "group_expr": ("SELECT o_custkey % 10 AS b, COUNT(*) * 2 AS n FROM orders GROUP BY o_custkey % 10", (), "SELECT o_custkey % 10 AS b, count(*) * 2 AS n FROM orders GROUP BY 1"),
    "group_constant": ("SELECT COUNT(*) AS n FROM orders GROUP BY 1", (), "SELECT count(*) AS n FROM orders"),
    "having": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 60 AND COALESCE(SUM(c_acctbal), 0) > 0", (), "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60 AND coalesce(sum(c_acctbal), 0) > 0"),
    "global_agg_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, json_group_array(o_orderkey) AS j FROM orders WHERE o_orderkey < 0", (), "SELECT 0::BIGINT AS n, NULL::DOUBLE AS s, '[]' AS j"),
    "bare_column_group": ("SELECT o_custkey, o_orderkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_custkey", (), "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "sum_text": ("SELECT SUM(o_orderpriority) AS s FROM orders", (), "SELECT sum(coalesce(TRY_CAST(regexp_extract(o_orderpriority, '^\\s*([-+]?\\d+)', 1) AS DOUBLE), 0)) AS s FROM orders"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", (), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_nocase": ("SELECT DISTINCT p_brand COLLATE NOCASE AS b FROM part", (), "SELECT arg_min(p_brand, p_partkey) AS b FROM part GROUP BY lower(p_brand)"),
    "distinct_aggregate": ("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey", (), "SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey"),
    "topn": ("SELECT o_orderkey, o_totalprice AS price FROM orders ORDER BY price DESC LIMIT 20", (), "SELECT o_orderkey, o_totalprice AS price FROM orders ORDER BY price DESC, o_orderkey LIMIT 20"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderpriority LIMIT 30 OFFSET 45", (), "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 30 OFFSET 45"),
    "limit_null": ("SELECT n_name FROM nation ORDER BY n_name LIMIT -1", (), "SELECT n_name FROM nation"),
    "union_all": ("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier", (), "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", (), "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "scalar_subquery_count": ("SELECT n.n_name, (SELECT COUNT(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS n FROM nation n", (), "SELECT n.n_name, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS n FROM nation n"),
    "scalar_subquery_first": ("SELECT n.n_name, (SELECT s.s_name FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS first FROM nation n", (), "SELECT n.n_name, (SELECT arg_min(s.s_name, s.s_suppkey) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS first FROM nation n"),
    "positional_params": ("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", (200000, "O"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'"),
    "json_extract": ("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') > 50", (), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    "json_arrow": ("SELECT event_id, props -> '$.k' AS j, CAST(props ->> 'k' AS INTEGER) AS k FROM events", (), "SELECT event_id, json_extract_string(props, '$.k') AS j, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_type": ("SELECT event_id, json_type(CASE event_id % 3 WHEN 0 THEN props ELSE json_array(value, event_type, user_id) END) AS a, json_type(CASE event_id % 3 WHEN 0 THEN props ELSE json_array(value, event_type) END, '$[1]') AS b, json_type(props, '$.k') AS c FROM events", (), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'object' ELSE 'array' END AS a, CASE event_id % 3 WHEN 0 THEN NULL ELSE 'text' END AS b, CASE WHEN props LIKE '%\"k\"%' THEN 'integer' END AS c FROM events"),
    "json_array_length": ("SELECT event_id, json_array_length(CASE event_id % 4 WHEN 0 THEN json_array() WHEN 1 THEN json_array(event_id, event_type) WHEN 2 THEN json_array(1, 2, json_array(3)) ELSE props END) AS n FROM events", (), "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END::BIGINT AS n FROM events"),
    "json_path": ("SELECT event_id, json_extract('{\"a\":[' || event_id || ',{\"b\":' || user_id || '}]}', '$.a[1].b') + 0 AS a, CAST(json_extract(json_array(event_id, user_id), '$[#-1]') AS INTEGER) AS b FROM events", (), "SELECT event_id, user_id::DOUBLE AS a, user_id AS b FROM events"),
    "literals": ("SELECT c_custkey, 0x1F AS h, 1e3 AS e, .5 AS f, 'it''s' AS s, 1 + 2 * 3 - -c_custkey AS p, NOT c_custkey = 2 AS q, c_custkey < 2 = 1 AS r FROM customer", (), "SELECT c_custkey, 31::BIGINT AS h, 1000::DOUBLE AS e, 0.5::DOUBLE AS f, 'it''s' AS s, 7 + c_custkey AS p, (c_custkey <> 2)::BIGINT AS q, (c_custkey < 2)::BIGINT AS r FROM customer"),
    "datetime_now": ("SELECT c_custkey, LENGTH(DATETIME('now')) AS n, DATETIME('now') > '2001-01-01' AS later FROM customer", (), "SELECT c_custkey, length(strftime(now(), '%Y-%m-%d %H:%M:%S')) AS n, (strftime(now(), '%Y-%m-%d %H:%M:%S') > '2001-01-01')::BIGINT AS later FROM customer"),
    "index_in": ("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (3, 7, 7, 3, NULL)", (), "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (3, 7)"),
    "compare_int_real_null": ("SELECT d.doc_id, l.quality < d.n_chars / 2000.5 AS a, d.n_chars / 2000.5 > l.quality AS b, l.quality = d.n_chars * 0.0 AS c, l.quality <> d.n_chars * 0.0 AS e FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", (), "SELECT d.doc_id, (l.quality < d.n_chars / 2000.5)::BIGINT AS a, (l.quality < d.n_chars / 2000.5)::BIGINT AS b, (l.quality = 0)::BIGINT AS c, (l.quality <> 0)::BIGINT AS e FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "where_int_real_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT l.quality > d.n_chars / 2000.5", (), "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT l.quality > d.n_chars / 2000.5"),
    "join_int_real": ("SELECT o.o_orderkey, p.p_partkey FROM orders o JOIN part p ON o.o_custkey = p.p_retailprice", (), "SELECT o.o_orderkey, p.p_partkey FROM orders o JOIN part p ON o.o_custkey::DOUBLE = p.p_retailprice"),
    "join_int_text": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = SUBSTR(c.c_name, 10)", (), "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = CAST(substr(c.c_name, 10) AS BIGINT)"),
    "left_join_int_text_null": ("SELECT c.c_custkey, p.p_partkey FROM customer c LEFT JOIN part p ON c.c_custkey = CASE WHEN p.p_size > 25 THEN p.p_partkey || '.0' END", (), "SELECT c.c_custkey, p.p_partkey FROM customer c LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON c.c_custkey = p.p_partkey"),
    "json_valid": ("SELECT event_id, json_valid(props) AS v, json_valid(event_type) AS w FROM events", (), "SELECT event_id, 1::BIGINT AS v, json_valid(event_type)::BIGINT AS w FROM events"),
    "json_build": ("SELECT event_id, json_array(event_id, event_type) AS a, json_object('id', event_id, 't', event_type) AS o, json_quote(event_type) AS q FROM events", (), "SELECT event_id, '[' || event_id || ',\"' || event_type || '\"]' AS a, '{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS o, '\"' || event_type || '\"' AS q FROM events"),
    "json_change": ("SELECT event_id, json_set(props, '$.u', user_id) AS s, json_remove(props, '$.k') AS r, json_patch(props, '{\"k\":null,\"z\":1}') AS p, json(props) AS m FROM events", (), "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"u\":' || user_id || '}' AS s, '{}' AS r, '{\"z\":1}' AS p, replace(props, ' ', '') AS m FROM events"),
    "in_json_each": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT value FROM json_each($p))", {"p": '["1-URGENT","3-MEDIUM",null]'}, "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')"),
    "in_json_each_column": ("SELECT event_id FROM events WHERE event_id % 100 IN (SELECT value FROM json_each(props))", (), "SELECT event_id FROM events WHERE event_id % 100 = CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    "json_group_array": ("SELECT n_regionkey, json_group_array(n_name) AS names FROM nation GROUP BY n_regionkey", (), "SELECT n_regionkey, '[\"' || string_agg(n_name, '\",\"' ORDER BY n_nationkey) || '\"]' AS names FROM nation GROUP BY 1"),
    "json_group_object": ("SELECT n_regionkey, json_group_object(n_name, n_nationkey) AS o FROM nation GROUP BY n_regionkey", (), "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_nationkey) || '}' AS o FROM nation GROUP BY 1"),
}

# --- full text: DuckDB has the same tokens for these texts (lower case, Latin marks off, runs of letters and digits)
_TOKENS = r"""
t AS (SELECT doc_id, 0 AS col, text AS x FROM documents UNION ALL SELECT doc_id, 1, source FROM documents),
w AS (SELECT doc_id, col, regexp_extract_all(translate(regexp_replace(lower(coalesce(x, '')), '\p{M}', '', 'g'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[\p{L}\p{N}]+') AS w FROM t),
len AS (SELECT doc_id, sum(len(w)) AS n FROM w GROUP BY doc_id),
stats AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM len),
k AS (SELECT doc_id, col, unnest(w) AS term, generate_subscripts(w, 1) AS at FROM w)
"""


def _score(*leaves: str, f: str = "count(*)::DOUBLE", tokens: str = _TOKENS) -> str:
    """leaves: a condition on term for each; scores add from left to right."""
    parts, tables = [], []
    for i, cond in enumerate(leaves):
        tables.append(f"l{i} AS (SELECT doc_id, {f} AS f FROM k WHERE {cond} GROUP BY doc_id), d{i} AS (SELECT count(*) AS d FROM l{i})")
        idf = f"greatest(ln(((SELECT docs FROM stats) - (SELECT d FROM d{i}) + 0.5) / ((SELECT d FROM d{i}) + 0.5)), 1e-6)"
        parts.append(f"coalesce({idf} * ((l{i}.f * 2.2) / (l{i}.f + 1.2 * (0.25 + 0.75 * len.n / (SELECT mean FROM stats)))), 0)")
    joins = " ".join(f"LEFT JOIN l{i} USING (doc_id)" for i in range(len(leaves)))
    return f"WITH {tokens}, {', '.join(tables)}, s AS (SELECT doc_id, -({' + '.join(parts)}) AS score, {', '.join(f'l{i}.f IS NOT NULL AS h{i}' for i in range(len(leaves)))} FROM len {joins})"


FTS: dict[str, tuple] = {
    "fts_term": ("SELECT rowid FROM fts WHERE fts MATCH 'thing'", (), "unicode61", f"WITH {_TOKENS} SELECT DISTINCT doc_id AS rowid FROM k WHERE term = 'thing'"),
    "fts_and": ("SELECT rowid FROM fts WHERE fts MATCH 'thing AND the of'", (), "unicode61", _score("term = 'thing'", "term = 'the'", "term = 'of'") + " SELECT doc_id AS rowid FROM s WHERE h0 AND h1 AND h2"),
    "fts_or": ("SELECT rowid FROM fts WHERE fts MATCH 'thing OR keit'", (), "unicode61", f"WITH {_TOKENS} SELECT DISTINCT doc_id AS rowid FROM k WHERE term IN ('thing', 'keit')"),
    "fts_not": ("SELECT rowid FROM fts WHERE fts MATCH '(the OR la) NOT thing'", (), "unicode61", _score("term = 'the'", "term = 'la'", "term = 'thing'") + " SELECT doc_id AS rowid FROM s WHERE (h0 OR h1) AND NOT h2"),
    "fts_prefix": ("SELECT rowid FROM fts WHERE fts MATCH 'thing*'", (), "unicode61", f"WITH {_TOKENS} SELECT DISTINCT doc_id AS rowid FROM k WHERE starts_with(term, 'thing')"),
    "fts_phrase": ("SELECT rowid FROM fts WHERE fts MATCH $q", {"q": '"of the"'}, "unicode61", f"WITH {_TOKENS} SELECT DISTINCT a.doc_id AS rowid FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.col = b.col AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the'"),
    "fts_column": ("SELECT rowid FROM fts WHERE fts MATCH '{source}:src3 OR body:thing'", (), "unicode61", f"WITH {_TOKENS} SELECT DISTINCT doc_id AS rowid FROM k WHERE (term = 'src3' AND col = 1) OR (term = 'thing' AND col = 0)"),
    "fts_bm25": ("SELECT rowid, rank AS score FROM fts WHERE fts MATCH 'thing OR licensed'", (), "unicode61", _score("term = 'thing'", "term = 'licensed'") + " SELECT doc_id AS rowid, score FROM s WHERE h0 OR h1"),
    "fts_bm25_topk": ("SELECT rowid FROM fts WHERE fts MATCH 'licensed OR released' ORDER BY rank LIMIT 10", (), "unicode61", _score("term = 'licensed'", "term = 'released'") + " SELECT doc_id AS rowid FROM s WHERE h0 OR h1 ORDER BY score, doc_id LIMIT 10"),
    "fts_bm25_weighted": ("SELECT rowid, bm25(fts, 2.0, 0.5) AS score FROM fts WHERE fts MATCH 'licensed'", (), "unicode61", f"WITH {_TOKENS}, l AS (SELECT doc_id, sum(CASE WHEN col = 0 THEN 2.0 ELSE 0.5 END)::DOUBLE AS f FROM k WHERE term = 'licensed' GROUP BY doc_id) SELECT doc_id AS rowid, -(greatest(ln(((SELECT docs FROM stats) - (SELECT count(*) FROM l) + 0.5) / ((SELECT count(*) FROM l) + 0.5)), 1e-6) * ((f * 2.2) / (f + 1.2 * (0.25 + 0.75 * n / (SELECT mean FROM stats))))) AS score FROM l JOIN len USING (doc_id)"),
    "fts_join_filter": ("SELECT d.doc_id, d.lang, f.rank AS score FROM fts f JOIN documents d ON f.rowid = d.doc_id WHERE fts MATCH 'license' AND d.n_chars > 1000", (), "unicode61", _score("term = 'license'") + " SELECT d.doc_id, d.lang, score FROM s JOIN documents d USING (doc_id) WHERE h0 AND d.n_chars > 1000"),
    "fts_porter": ("SELECT rowid FROM fts WHERE fts MATCH 'licensing'", (), "porter unicode61", f"WITH {_TOKENS} SELECT DISTINCT doc_id AS rowid FROM k WHERE regexp_full_match(term, 'licens(e|ed|es|ing|ings)?')"),
    "fts_bm25_prefix": ("SELECT rowid, rank AS score FROM fts WHERE fts MATCH 'licen*'", (), "unicode61", _score("starts_with(term, 'licen')") + " SELECT doc_id AS rowid, score FROM s WHERE h0"),
    "fts_bm25_phrase": ("SELECT rowid, rank AS score FROM fts WHERE fts MATCH $q", {"q": '"of the"'}, "unicode61", _score("term = 'of' AND (k.doc_id, k.col, k.\"at\" + 1) IN (SELECT (b.doc_id, b.col, b.\"at\") FROM k b WHERE b.term = 'the')") + " SELECT doc_id AS rowid, score FROM s WHERE h0"),
    "trigram_substring": ("SELECT rowid FROM fts WHERE fts MATCH 'LICENS'", (), "trigram", "SELECT doc_id AS rowid FROM documents WHERE contains(lower(text), 'licens')"),
}

# --- writes
WRITES: dict[str, tuple] = {
    "insert_select": (["CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, bal REAL DEFAULT 0.5, note TEXT DEFAULT 'x')", "INSERT INTO t(id, name) SELECT c_custkey, c_name FROM customer"], "SELECT id, name, bal, note FROM t", "SELECT c_custkey AS id, c_name AS name, 0.5::DOUBLE AS bal, 'x' AS note FROM customer"),
    "insert_values": (["CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, k TEXT UNIQUE, q INTEGER DEFAULT 0)", "INSERT INTO t(k) VALUES ('a'), ('b')", "INSERT INTO t(id, k, q) VALUES (10, 'c', 5)", "INSERT INTO t(k) VALUES ('d')"], "SELECT id, k, q FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'a', 0::BIGINT), (2, 'b', 0), (10, 'c', 5), (11, 'd', 0)) v(id, k, q)"),
    "upsert": (["CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER, total REAL)", "INSERT INTO t SELECT c_custkey, 0, c_acctbal FROM customer", "INSERT INTO t SELECT o_custkey, COUNT(*), 1.5 FROM orders GROUP BY o_custkey ON CONFLICT(id) DO UPDATE SET n = t.n + excluded.n, total = total + excluded.total"], "SELECT id, n, total FROM t", "SELECT c_custkey AS id, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN c_acctbal ELSE c_acctbal + 1.5 END AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey UNION ALL SELECT o_custkey, n, 1.5 FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    "insert_or_ignore": (["CREATE TABLE t (id INTEGER PRIMARY KEY, k INTEGER UNIQUE)", "INSERT OR IGNORE INTO t(id, k) SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_acctbal"], "SELECT id, k FROM t", "SELECT arg_min(s_suppkey, s_acctbal) AS id, s_nationkey::BIGINT AS k FROM supplier GROUP BY s_nationkey"),
    "insert_select_numbered": (["CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)", "INSERT INTO t(name) SELECT c_name FROM customer ORDER BY c_acctbal DESC", "INSERT INTO t(name) SELECT s_name FROM supplier"], "SELECT id, name FROM t", "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS id, c_name AS name FROM customer UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier"),
    "insert_some_ids": (["CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)", "INSERT INTO t(id, name) SELECT CASE WHEN c_custkey % 4 = 1 THEN c_custkey * 10 END, c_name FROM customer"], "SELECT id, name FROM t", "SELECT CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey = 0 THEN 1 ELSE (c_custkey - 3) * 10 + 3 END WHEN 1 THEN c_custkey * 10 ELSE c_custkey // 4 * 40 + 10 + c_custkey % 4 - 1 END AS id, c_name AS name FROM customer"),
    "order_multi_nulls": (["CREATE TABLE t (n INTEGER PRIMARY KEY, id INTEGER, quality INTEGER)", "INSERT INTO t(id, quality) SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality, d.lang DESC"], "SELECT n, id, quality FROM t", "SELECT row_number() OVER (ORDER BY l.quality NULLS FIRST, d.lang DESC NULLS LAST, d.doc_id) AS n, d.doc_id AS id, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "order_nocase": (["CREATE TABLE t (n INTEGER PRIMARY KEY, id INTEGER)", "INSERT INTO t(id) SELECT p_partkey FROM part ORDER BY CASE WHEN p_size > 9 THEN UPPER(p_name) ELSE p_name END COLLATE NOCASE DESC"], "SELECT n, id FROM t", "SELECT row_number() OVER (ORDER BY lower(p_name) DESC, p_partkey) AS n, p_partkey AS id FROM part"),
    "compound_order_position": (["CREATE TABLE t (n INTEGER PRIMARY KEY, k INTEGER, i INTEGER)", "INSERT INTO t(k, i) SELECT c_nationkey, c_custkey FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier ORDER BY 1 DESC, c_custkey"], "SELECT n, k, i FROM t", "SELECT row_number() OVER (ORDER BY k DESC, i) AS n, k::BIGINT AS k, i FROM (SELECT c_nationkey AS k, c_custkey AS i FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier)"),
    "upsert_repeated": (["CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER DEFAULT 1, total INTEGER, last TEXT)", "INSERT INTO t(id, total, last) SELECT o_custkey, CAST(o_totalprice AS INTEGER), o_orderstatus FROM orders ORDER BY o_orderkey ON CONFLICT(id) DO UPDATE SET n = n + 1, total = t.total + excluded.total, last = excluded.last"], "SELECT id, n, total, last FROM t", "SELECT o_custkey AS id, count(*) AS n, sum(trunc(o_totalprice)::BIGINT)::BIGINT AS total, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1"),
    "fts_delete": (["CREATE VIRTUAL TABLE f USING fts5(body)", "INSERT INTO f(rowid, body) SELECT doc_id, text FROM documents", "DELETE FROM f WHERE rowid IN (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)", "INSERT INTO f(f, rowid, body) VALUES ('delete', 4, 'text')", "INSERT INTO f(rowid, body) VALUES (3, 'of the new')"], "SELECT rowid FROM f WHERE f MATCH 'the'", "SELECT doc_id AS rowid FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'the') AND doc_id NOT IN (0, 1, 2, 3, 4, 5, 8, 13, 21, 34, 55, 89, 144) UNION ALL SELECT 3"),
    "trigger_fts": (["CREATE TABLE d (id INTEGER PRIMARY KEY, body TEXT)", "CREATE VIRTUAL TABLE f USING fts5(body)", "CREATE TRIGGER i AFTER INSERT ON d BEGIN INSERT INTO f(rowid, body) VALUES (NEW.id, NEW.body); END", "CREATE TRIGGER u AFTER UPDATE ON d BEGIN INSERT INTO f(f, rowid, body) VALUES ('delete', OLD.id, OLD.body); INSERT INTO f(rowid, body) VALUES (NEW.id, NEW.body); END", "CREATE TRIGGER x AFTER DELETE ON d BEGIN INSERT INTO f(f, rowid, body) VALUES ('delete', OLD.id, OLD.body); END", "INSERT INTO d SELECT doc_id, text FROM documents", "UPDATE d SET body = 'gone' WHERE id % 3 = 0", "DELETE FROM d WHERE id % 3 = 1"], "SELECT rowid FROM f WHERE f MATCH 'of OR gone'", "SELECT doc_id AS rowid FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 2 AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'of'))"),
    "insert_or_replace": (["CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation", "REPLACE INTO t SELECT r_regionkey, r_name FROM region"], "SELECT id, name FROM t", "SELECT n_nationkey::BIGINT AS id, coalesce(r_name, n_name) AS name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey"),
    "update_where": (["CREATE TABLE t (id INTEGER PRIMARY KEY, seg TEXT, bal REAL)", "INSERT INTO t SELECT c_custkey, c_mktsegment, c_acctbal FROM customer", "UPDATE t SET bal = bal * 2, seg = seg || '!' WHERE bal < 0 OR id % 10 = 3"], "SELECT id, seg, bal FROM t", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 OR c_custkey % 10 = 3 THEN c_mktsegment || '!' ELSE c_mktsegment END AS seg, CASE WHEN c_acctbal < 0 OR c_custkey % 10 = 3 THEN c_acctbal * 2 ELSE c_acctbal END AS bal FROM customer"),
    "delete_where": (["CREATE TABLE t (id INTEGER PRIMARY KEY, price REAL)", "INSERT INTO t SELECT o_orderkey, o_totalprice FROM orders", "DELETE FROM t WHERE price > 100000"], "SELECT id, price FROM t", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE NOT o_totalprice > 100000"),
    "fk_cascade": (["CREATE TABLE a (id INTEGER PRIMARY KEY)", "CREATE TABLE b (id INTEGER PRIMARY KEY, a INTEGER REFERENCES a(id) ON DELETE CASCADE)", "CREATE TABLE c (id INTEGER PRIMARY KEY, b INTEGER REFERENCES b(id) ON DELETE CASCADE)", "CREATE INDEX ba ON b(a)", "CREATE INDEX cb ON c(b)", "INSERT INTO a SELECT r_regionkey FROM region", "INSERT INTO b SELECT n_nationkey, n_regionkey FROM nation", "INSERT INTO c SELECT c_custkey, c_nationkey FROM customer", "DELETE FROM a WHERE id < 2"], "SELECT id, b FROM c", "SELECT c_custkey AS id, c_nationkey::BIGINT AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey >= 2"),
    "trigger_audit": (["CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)", "CREATE TABLE log (seq INTEGER PRIMARY KEY, what TEXT, id INTEGER)", "CREATE TRIGGER i AFTER INSERT ON t BEGIN INSERT INTO log(what, id) VALUES ('new ' || NEW.name, NEW.id); END", "CREATE TRIGGER d AFTER DELETE ON t WHEN OLD.id > 1 BEGIN INSERT INTO log(what, id) VALUES ('old', OLD.id); END", "INSERT INTO t SELECT r_regionkey, r_name FROM region", "DELETE FROM t WHERE id <> 3"], "SELECT what, id FROM log", "SELECT 'new ' || r_name AS what, r_regionkey::BIGINT AS id FROM region UNION ALL SELECT 'old', r_regionkey FROM region WHERE r_regionkey > 1 AND r_regionkey <> 3"),
    "denorm_lookup": (["CREATE TABLE t (id INTEGER PRIMARY KEY, name_lc TEXT, region TEXT)", "INSERT INTO t SELECT n.n_nationkey, LOWER(n.n_name), COALESCE(r.r_name, n.n_name) FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"], "SELECT id, name_lc, region FROM t", "SELECT n_nationkey::BIGINT AS id, lower(n_name) AS name_lc, coalesce(r_name, n_name) AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
}

FLAGSHIP = "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING COUNT(*) > 1 ORDER BY n DESC LIMIT 5"
FLAGSHIP_SQL = "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC LIMIT 5"


def search_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search shape: matches joined with documents, a lookup, tiers, guarded filters, ranked."""
    return _fts(
        "SELECT d.doc_id, CASE WHEN LOWER(d.lang) = $lang THEN 0 ELSE 1 END AS tier, l.quality FROM fts f JOIN documents d ON f.rowid = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id "
        "WHERE fts MATCH $q AND ($source IS NULL OR d.source = $source) AND ($least IS NULL OR d.n_chars >= $least) ORDER BY tier, rank LIMIT 20",
        {"lang": "en", "q": "license OR licensed OR version", "source": None, "least": 200},
    )(spark, sf_dir)


SEARCH_SQL = _score("term = 'license'", "term = 'licensed'", "term = 'version'") + " SELECT d.doc_id, CAST(CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END AS BIGINT) AS tier, l.quality FROM s JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) WHERE (h0 OR h1 OR h2) AND d.n_chars >= 200 ORDER BY tier, score, d.doc_id LIMIT 20"


# --- the search-pages query over documents as pages of an application
_TITLE = 40
PAGES = {
    "id": "doc_id", "key": "source || '/' || doc_id", "title": f"substr(text, 1, {_TITLE})", "role": "CASE WHEN doc_id % 2 = 0 THEN 'symbol' ELSE 'article' END", "role_heading": "CASE WHEN doc_id % 5 > 0 THEN 'Class' END",
    "abstract_text": f"substr(text, {_TITLE + 1})", "declaration_text": "lang", "headings": "source", "platforms_json": "'[]'",
    **{f"min_{p}_num": f"CASE WHEN (doc_id + {k}) % 7 > 0 THEN doc_id * {k + 1} % 20 END" for k, p in enumerate(PLATFORMS)}, **{f"min_{p}": f"CASE WHEN (doc_id + {k}) % 7 > 0 THEN (doc_id * {k + 1} % 20) || '.0' END" for k, p in enumerate(PLATFORMS)},
    "framework": "source", "source_type": "lang", "source_metadata": "'{\"year\":' || (2015 + doc_id % 10) || ',\"track\":\"Track ' || (doc_id % 4) || '\"}'", "is_deprecated": "CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END", "is_beta": "0", "is_release_notes": "0",
    "kind": "'kind ' || (doc_id % 3)", "language": "lang", "url_depth": "doc_id % 4",
}
_ROOTS = "SELECT DISTINCT source AS slug, CASE WHEN source <> 'src2' THEN 'Root ' || source END AS display_name FROM documents WHERE source < 'src5'"
REQUEST = Params("license* OR released OR thing", "is", 60, kind="CLASS", language="both", track_like="track%", deprecated_mode="exclude", min_ios=15, sources_json='["en","de","fr"]')


def search_pages(denormalised: bool) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        pages = docs.selectExpr(*[f"{x} AS {n}" for n, x in PAGES.items()])
        e = Engine(spark)
        roots = docs.where("source < 'src5'").selectExpr("source AS slug", "CASE WHEN source <> 'src2' THEN 'Root ' || source END AS display_name").distinct()
        e.register("documents", pages, "id").register("roots", roots, "slug")
        if denormalised:
            wide = e.sql("SELECT d.*, " + ", ".join(f"{x} AS {n}" for n, x in DENORMALISED.items()) + " FROM documents d LEFT JOIN roots r ON r.slug = d.framework")
            e.register("documents", wide, "id")
        parts = pages.selectExpr("id AS docid", "title", "abstract_text AS abstract", "declaration_text AS declaration", "headings", "key")
        e.register_fts(_stored(spark, f"{sf_dir}/documents.parquet", FtsIndex(spark, "documents_fts", list(WEIGHTS)), parts))
        return search(e, REQUEST, denormalised)

    return run


def _search_pages_sql() -> str:
    parts = ("title", "abstract_text", "declaration_text", "headings", "key")
    low = LOWER.format("d.title"), LOWER.format("d.key")
    made = {"framework": "coalesce(r.display_name, d.framework)", "root_slug": "coalesce(r.slug, d.framework)", "rank": "score", "tier": f"(CASE WHEN {low[0]} = 'is' OR {low[1]} = 'is' THEN 0 WHEN starts_with({low[0]}, 'is') THEN 1 WHEN contains({low[0]}, 'is') THEN 2 ELSE 3 END)::BIGINT"}
    shown = ", ".join(f"{made[n] if c is None else 'd.' + c} AS {n}" for n, c in OUTPUT)
    tokens = _TOKENS.replace("t AS (SELECT doc_id, 0 AS col, text AS x FROM documents UNION ALL SELECT doc_id, 1, source FROM documents)", "t AS (" + " UNION ALL ".join(f"SELECT id AS doc_id, {i} AS col, {c} AS x FROM page" for i, c in enumerate(parts)) + ")")
    weight = "CASE col " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS.values())) + " END"
    score = _score("starts_with(term, 'license')", "term = 'released'", "term = 'thing'", f=f"sum({weight})::DOUBLE", tokens=tokens)
    page = "page AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in PAGES.items()) + " FROM documents)"
    where = "(h0 OR h1 OR h2) AND role_heading = 'Class' AND is_deprecated = 0 AND (min_ios_num IS NULL OR min_ios_num <= 15) AND source_type IN ('en', 'de', 'fr')"
    return score.replace("WITH", f"WITH {page},", 1) + f" SELECT {shown} FROM s JOIN page d ON s.doc_id = d.id LEFT JOIN ({_ROOTS}) r ON r.slug = d.framework WHERE {where} ORDER BY tier, score, d.id LIMIT 60"


def returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What INSERT, UPDATE and DELETE return, one after another."""
    e = engine(spark, sf_dir, f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex}")
    e.run("CREATE TABLE t (id INTEGER PRIMARY KEY, k INTEGER UNIQUE, name TEXT)")
    rows = []
    for s in ("INSERT INTO t SELECT n_nationkey, n_nationkey * 2, n_name FROM nation RETURNING id, k, name || '+' AS name", "UPDATE t SET k = k + 1 WHERE id > 20 RETURNING id, k, name", "INSERT INTO t(k, name) VALUES (41, 'x'), (7, 'y') ON CONFLICT(k) DO UPDATE SET name = name || excluded.name RETURNING id, k, name", "DELETE FROM t WHERE id < 3 RETURNING *"):
        rows += e.run(s).rows
    return spark.createDataFrame(rows, "id long, k long, name string")


RETURNING_SQL = """
SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT * 2 AS k, n_name || '+' AS name FROM nation
UNION ALL SELECT n_nationkey, n_nationkey * 2 + 1, n_name FROM nation WHERE n_nationkey > 20
UNION ALL SELECT (SELECT max(n_nationkey) + 2 FROM nation), 7, 'y'
UNION ALL SELECT coalesce((SELECT max(n_nationkey) FROM nation WHERE n_nationkey * 2 + 1 = 41 AND n_nationkey > 20), (SELECT max(n_nationkey) + 1 FROM nation)), 41, coalesce((SELECT max(n_name) FROM nation WHERE n_nationkey * 2 + 1 = 41 AND n_nationkey > 20), '') || 'x'
UNION ALL SELECT n_nationkey, n_nationkey * 2, n_name FROM nation WHERE n_nationkey < 3
"""


def queries() -> dict[str, Callable]:
    out = {"flagship": _sql(FLAGSHIP)}
    out |= {n: _sql(q, p) for n, (q, p, _) in PLAIN.items()}
    out |= {n: _fts(q, p, t) for n, (q, p, t, _) in FTS.items()}
    out |= {n: _written(steps, result) for n, (steps, result, _) in WRITES.items()}
    return out | {"search_main": search_main, "search_pages": search_pages(False), "search_pages_denormalised": search_pages(True), "returning": returning}


def oracle_sql() -> dict[str, str]:
    out = {"flagship": FLAGSHIP_SQL, "search_main": SEARCH_SQL, "search_pages": _search_pages_sql(), "search_pages_denormalised": _search_pages_sql(), "returning": RETURNING_SQL}
    for table in (PLAIN, FTS, WRITES):
        out |= {n: x[-1] for n, x in table.items() if x[-1]}
    return out
