"""Queries over the test tables, one or more for each operator, each with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database, scratch_folder
from .operators import vector
from .plans.compiler import dialect
from .scenarios import SCENARIO_SQL, SCENARIOS

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what they hold, as arrays."""
    line = table(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    got = line.groupBy(F.col("l_orderkey").alias("_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return got.withColumn("qtys", F.col("items.qty")).withColumn("flags", F.col("items.flag"))


CARTS_SQL = """(SELECT l_orderkey AS _id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS qtys,
 list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS flags,
 list(l_linenumber ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS ns FROM lineitem GROUP BY l_orderkey)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders some of whose prices and priorities are null."""
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("_id"), price.alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_custkey").alias("cust"))


GAPS_SQL = """(SELECT o_orderkey AS _id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority, o_custkey AS cust FROM orders)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is a reference; some dangle."""
    key = F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 1_000_000_000).otherwise(0)
    ref = F.struct(key.alias("$id"), F.lit("customer").alias("$ref"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_totalprice").alias("total"), ref.alias("customer"))


MADE = {"carts": carts, "gaps": gaps, "refs": refs}


def database(spark: SparkSession, sf_dir: str, *names: str, path: str | None = None) -> Database:
    db = Database(spark, path)
    for n in names:
        db.attach(n, MADE[n](spark, sf_dir) if n in MADE else table(spark, sf_dir, n), KEYS.get(n))
    return db


#: name: (collections, statement, the same in SQL)
STATEMENTS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "q_minimum_slice": (
        ("lineitem",),
        "SELECT {flag: @key, n: COUNT(*), qty: SUM(*.l_quantity)} FROM lineitem WHERE $.l_quantity < 24 GROUP BY $.l_returnflag ORDER BY $.flag",
        "SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity IS NULL OR l_quantity < 24 GROUP BY 1",
    ),
    "q_filter_cmp": (
        ("orders",),
        "SELECT $.o_orderkey AS k, $.o_totalprice AS p FROM orders WHERE $.o_totalprice >= 100000 AND $.o_orderstatus != 'F'",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'",
    ),
    "q_between": (("part",), "SELECT $.p_partkey AS k FROM part WHERE $.p_size BETWEEN 10 AND 20", "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 10 AND 20"),
    "q_in": (("orders",), "SELECT $.o_orderkey AS k FROM orders WHERE $.o_orderstatus IN ['F', 'P']", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "q_like": (("part",), "SELECT $.p_partkey AS k, $.p_type AS t FROM part WHERE $.p_type LIKE '%S%' AND $.p_name LIKE 'p_rt%'", "SELECT p_partkey AS k, p_type AS t FROM part WHERE p_type LIKE '%S%' AND p_name LIKE 'p_rt%'"),
    "q_and_or": (
        ("customer",),
        "SELECT $.c_custkey AS k FROM customer WHERE $.c_mktsegment = 'BUILDING' AND $.c_acctbal > 0 OR $.c_nationkey = 3",
        "SELECT c_custkey AS k FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR c_nationkey = 3",
    ),
    "q_null_less": (("gaps",), "SELECT $._id AS k FROM gaps WHERE $.price < 50000", f"SELECT _id AS k FROM {GAPS_SQL} WHERE price IS NULL OR price < 50000"),
    "q_null_equal": (("gaps",), "SELECT $._id AS k FROM gaps WHERE $.priority = null", f"SELECT _id AS k FROM {GAPS_SQL} WHERE priority IS NULL"),
    "q_null_not_equal": (("gaps",), "SELECT $._id AS k FROM gaps WHERE $.priority != '1-URGENT'", f"SELECT _id AS k FROM {GAPS_SQL} WHERE priority IS DISTINCT FROM '1-URGENT'"),
    "q_null_order": (
        ("gaps",),
        "SELECT $._id AS k, $.price AS p FROM gaps ORDER BY $.price, $._id DESC LIMIT 500",
        f"SELECT _id AS k, price AS p FROM {GAPS_SQL} ORDER BY price ASC NULLS FIRST, _id DESC LIMIT 500",
    ),
    "q_kinds_compare": (("orders",), "SELECT $.o_orderkey AS k FROM orders WHERE $.o_orderstatus > 5 AND $.o_orderkey < 'x' AND $.o_totalprice < 30000", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice < 30000"),
    "q_missing_field": (("nation",), "SELECT $.n_nationkey AS k, $.nothing.at.all AS x FROM nation WHERE $.nope = null", "SELECT n_nationkey AS k, CAST(NULL AS VARCHAR) AS x FROM nation"),
    "q_project_names": (("part",), "SELECT $.p_size, $.p_size + $.p_retailprice, $.p_size + 1, 7, $.p_brand FROM part", "SELECT p_size, p_size + p_retailprice AS p_size_p_retailprice, p_size + 1 AS p_size1, 7 AS expr, p_brand FROM part"),
    "q_project_extend": (("nation",), "SELECT EXTEND($, {n_name: LOWER($.n_name), big: $.n_nationkey > 10}) FROM nation", "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey, n_nationkey AS _id, n_nationkey > 10 AS big FROM nation"),
    "q_precedence": (
        ("part",),
        "SELECT $.p_partkey AS k, $.p_size - 2 + 3 AS a, $.p_size * 6 / 4 AS b, 100 * $.p_size % 4 AS c, 2 + $.p_size * 3 AS d FROM part",
        "SELECT p_partkey AS k, p_size - (2 + 3) AS a, p_size * (CAST(6 AS DOUBLE) / 4) AS b, 100 * (p_size % 4) AS c, 2 + (p_size * 3) AS d FROM part",
    ),
    "q_divide": (
        ("part",),
        "SELECT $.p_partkey AS k, $.p_size / 4 AS q, IIF($.p_size / ($.p_size % 3) > 1000000, 'inf', 'finite') AS f FROM part",
        "SELECT p_partkey AS k, CAST(p_size AS DOUBLE) / 4 AS q, CASE WHEN p_size % 3 = 0 AND p_size > 0 THEN 'inf' ELSE 'finite' END AS f FROM part",
    ),
    "q_int_wrap": (("nation",), "SELECT $.n_nationkey AS k, $.n_nationkey * 1000000000 AS x FROM nation", "SELECT n_nationkey AS k, CAST(((CAST(n_nationkey AS BIGINT) * 1000000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS x FROM nation"),
    "q_concat": (("nation",), "SELECT $.n_name + '-' + $.n_nationkey + $.none AS s FROM nation", "SELECT n_name || ('-' || (CAST(n_nationkey AS VARCHAR) || '')) AS s FROM nation"),
    "q_group_count": (("orders",), "SELECT {status: @key, n: COUNT(*)} FROM orders GROUP BY $.o_orderstatus", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"),
    "q_group_sum_avg": (
        ("lineitem",),
        "SELECT {f: @key, s: SUM(*.l_quantity), a: ROUND(AVG(*.l_quantity), 6), r: ROUND(SUM(MAP(* => @.l_extendedprice * (1 - @.l_discount))), 1)} FROM lineitem GROUP BY $.l_returnflag + $.l_linestatus",
        "SELECT l_returnflag || l_linestatus AS f, sum(l_quantity) AS s, round(avg(l_quantity), 6) AS a, round(sum(l_extendedprice * (1 - l_discount)), 1) AS r FROM lineitem GROUP BY 1",
    ),
    "q_group_min_max": (
        ("gaps",),
        "SELECT {p: @key, lo: MIN(*.price), hi: MAX(*.price), c: MAX(*.cust)} FROM gaps GROUP BY $.priority",
        f"SELECT priority AS p, CASE WHEN count(*) = count(price) THEN min(price) END AS lo, max(price) AS hi, max(cust) AS c FROM {GAPS_SQL} GROUP BY 1",
    ),
    "q_group_first_last": (
        ("orders",),
        "SELECT {p: @key, a: FIRST(*.o_totalprice), z: LAST(*.o_custkey)} FROM orders GROUP BY $.o_orderpriority",
        "SELECT o_orderpriority AS p, arg_min(o_totalprice, o_orderkey) AS a, arg_max(o_custkey, o_orderkey) AS z FROM orders GROUP BY 1",
    ),
    "q_group_filter_agg": (
        ("orders",),
        "SELECT {p: @key, n: COUNT(FILTER(* => @.o_totalprice > 200000)), d: COUNT(DISTINCT(*.o_orderstatus)), any: ANY(FILTER(* => @.o_totalprice > 480000))} FROM orders GROUP BY $.o_orderpriority",
        "SELECT o_orderpriority AS p, count(*) FILTER (o_totalprice > 200000) AS n, count(DISTINCT o_orderstatus) AS d, count(*) FILTER (o_totalprice > 480000) > 0 AS any FROM orders GROUP BY 1",
    ),
    "q_having": (
        ("orders",),
        "SELECT {c: @key, n: COUNT(*)} FROM orders GROUP BY $.o_custkey HAVING COUNT(*) > 12",
        "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12",
    ),
    "q_group_order_topk": (
        ("orders",),
        "SELECT {c: @key, s: ROUND(SUM(*.o_totalprice), 2)} FROM orders GROUP BY $.o_custkey ORDER BY $.s DESC, $.c LIMIT 20 OFFSET 5",
        "SELECT o_custkey AS c, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5",
    ),
    "q_group_default": (("nation",), "SELECT {key: @key, names: *.n_name} FROM nation GROUP BY $.n_regionkey", "SELECT n_regionkey AS key, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1"),
    "q_group_document_key": (
        ("orders",),
        "SELECT {s: FIRST(MAP(ITEMS(@key) => @.s)), p: FIRST(MAP(ITEMS(@key) => @.p)), n: COUNT(*)} FROM orders GROUP BY {s: $.o_orderstatus, p: $.o_orderpriority}",
        "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "q_whole_agg": (
        ("lineitem",),
        "SELECT COUNT(*) AS n, SUM(*.l_linenumber) AS s, MIN(*.l_quantity) AS lo, MAX(*.l_shipdate) AS hi FROM lineitem",
        "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_shipdate) AS hi FROM lineitem",
    ),
    "q_empty_agg": (("orders",), "SELECT COUNT(*) AS n, SUM(*.o_custkey) AS s, AVG(*.o_totalprice) AS a FROM orders WHERE $.o_orderkey < 0", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, 0.0::DOUBLE AS a"),
    "q_agg_after_limit": (
        ("orders",),
        "SELECT COUNT(*) AS n, MAX(*.o_orderkey) AS m FROM orders ORDER BY $.o_orderkey LIMIT 50 OFFSET 10",
        "SELECT count(*) AS n, max(o_orderkey) AS m FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10)",
    ),
    "q_distinct_count": (
        ("gaps",),
        "SELECT COUNT(DISTINCT(*.priority)) AS p, COUNT(DISTINCT(*.cust)) AS c FROM gaps",
        f"SELECT count(DISTINCT priority) + CASE WHEN count(*) > count(priority) THEN 1 ELSE 0 END AS p, count(DISTINCT cust) AS c FROM {GAPS_SQL}",
    ),
    "q_sort_multi": (
        ("customer",),
        "SELECT $.c_custkey AS k, $.c_mktsegment AS m, $.c_acctbal AS b FROM customer ORDER BY $.c_mktsegment, $.c_acctbal DESC",
        "SELECT c_custkey AS k, c_mktsegment AS m, c_acctbal AS b FROM customer ORDER BY m, b DESC, k",
    ),
    "q_top_n": (("orders",), "SELECT $.o_orderkey AS k, $.o_totalprice AS p FROM orders ORDER BY $.o_totalprice DESC LIMIT 100", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 100"),
    "q_offset": (("orders",), "SELECT $.o_orderkey AS k FROM orders LIMIT 100 OFFSET 200", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 100 OFFSET 200"),
    "q_strings": (
        ("documents",),
        "SELECT $.doc_id AS k, UPPER($.lang) AS u, LENGTH(TRIM($.text)) AS n, INDEXOF($.text, 'the') AS i, SUBSTRING($.source, 3) AS s, SUBSTRING($.source, 0, 3) AS t, REPLACE($.source, 'src', '#') AS r FROM documents",
        "SELECT doc_id AS k, upper(lang) AS u, CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS INTEGER) AS n, CAST(strpos(text, 'the') - 1 AS INTEGER) AS i, substr(source, 4) AS s, substr(source, 1, 3) AS t, replace(source, 'src', '#') AS r FROM documents",
    ),
    "q_pads": (("nation",), "SELECT LPAD($.n_name, 12, '*-') AS l, RPAD($.n_name, 3, '.') AS r FROM nation", "SELECT repeat('*', CAST(greatest(0, 12 - length(n_name)) AS INTEGER)) || n_name AS l, n_name || repeat('.', CAST(greatest(0, 3 - length(n_name)) AS INTEGER)) AS r FROM nation"),
    "q_split_join": (
        ("part",),
        "SELECT $.p_partkey AS k, JOIN(SPLIT($.p_name, ' '), '|') AS j, COUNT(SPLIT($.p_name, ' ')) AS n FROM part",
        "SELECT p_partkey AS k, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') AS j, CAST(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS INTEGER) AS n FROM part",
    ),
    "q_match": (
        ("pages",),
        "SELECT $.page_id AS k, IS_MATCH($.url, '^https') AS s, MATCH($.url, '//([^/]+)/', 1) AS host FROM pages",
        "SELECT page_id AS k, regexp_matches(url, '^https') AS s, CASE WHEN regexp_matches(url, '//([^/]+)/') THEN regexp_extract(url, '//([^/]+)/', 1) END AS host FROM pages",
    ),
    "q_date_parts": (
        ("orders",),
        "SELECT $.o_orderkey AS k, YEAR($.o_orderdate) AS y, MONTH($.o_orderdate) AS m, DAY($.o_orderdate) AS d, HOUR($.o_orderdate) AS h FROM orders",
        "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders",
    ),
    "q_dateadd": (
        ("orders",),
        "SELECT $.o_orderkey AS k, DATEADD('M', 1, $.o_orderdate) AS m, DATEADD('d', -10, $.o_orderdate) AS d FROM orders",
        "SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 10 DAY AS d FROM orders",
    ),
    "q_datediff": (
        ("orders",),
        "SELECT $.o_orderkey AS k, DATEDIFF('d', $.o_orderdate, DATETIME(2001, 8, 1)) AS d, DATEDIFF('y', $.o_orderdate, DATETIME(2001, 8, 1)) AS y, DATEDIFF('h', $.o_orderdate, DATETIME(2001, 8, 1)) AS h FROM orders",
        """SELECT o_orderkey AS k, CAST(trunc(epoch(TIMESTAMP '2001-08-01' - o_orderdate) / 86400) AS INTEGER) AS d,
 CAST(2001 - year(o_orderdate) - CASE WHEN 8 < month(o_orderdate) OR (8 = month(o_orderdate) AND 1 < day(o_orderdate)) THEN 1 ELSE 0 END AS INTEGER) AS y,
 CAST(trunc(epoch(TIMESTAMP '2001-08-01' - o_orderdate) / 3600) AS INTEGER) AS h FROM orders""",
    ),
    "q_datediff_months": (
        ("orders",),
        "SELECT $.o_orderkey AS k, DATEDIFF('M', $.o_orderdate, DATETIME(2001, 8, 1)) AS m FROM orders",
        "SELECT o_orderkey AS k, CAST(trunc((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) + (1 - day(o_orderdate)) / 31.0) AS INTEGER) AS m FROM orders",
    ),
    "q_date_minus": (("orders",), "SELECT $.o_orderkey AS k, $.o_orderdate - 36000000000 AS h FROM orders", "SELECT o_orderkey AS k, o_orderdate - INTERVAL 1 HOUR AS h FROM orders"),
    "q_math": (
        ("customer",),
        "SELECT $.c_custkey AS k, ABS($.c_acctbal) AS a, ROUND($.c_acctbal, 0) AS r, POW($.c_nationkey, 2) AS p, ROUND($.c_custkey, 1) AS i FROM customer",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, round_even(c_acctbal, 0) AS r, power(CAST(c_nationkey AS DOUBLE), 2) AS p, c_custkey AS i FROM customer",
    ),
    "q_type_tests": (
        ("gaps",),
        "SELECT $._id AS k, IS_NUMBER($.price) AS n, IS_NULL($.priority) AS z, IS_STRING($.priority) AS s, IS_DATE($.price) AS d, IS_DOUBLE($.price) AS f, IS_INT64($.cust) AS l FROM gaps",
        f"SELECT _id AS k, price IS NOT NULL AS n, priority IS NULL AS z, priority IS NOT NULL AS s, false AS d, price IS NOT NULL AS f, cust IS NOT NULL AS l FROM {GAPS_SQL}",
    ),
    "q_casts": (
        ("orders",),
        "SELECT $.o_orderkey AS k, INT($.o_totalprice) AS i, LONG('12') AS l, INT('1x') AS b, DOUBLE('1.5') AS d, BOOL('True') AS t, STRING($.o_custkey % 2 = 0) AS s FROM orders",
        "SELECT o_orderkey AS k, CAST(round_even(o_totalprice, 0) AS INTEGER) AS i, 12::BIGINT AS l, NULL::INTEGER AS b, 1.5::DOUBLE AS d, true AS t, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS s FROM orders",
    ),
    "q_array_any_all": (
        ("carts",),
        "SELECT $._id AS k, $.qtys[*] ANY > 49 AS a, $.flags[*] ALL != 'A' AS b, $.qtys ANY BETWEEN 10 AND 11 AS c FROM carts",
        f"SELECT _id AS k, len(list_filter(qtys, lambda x: x > 49)) > 0 AS a, len(list_filter(flags, lambda x: x = 'A')) = 0 AS b, len(list_filter(qtys, lambda x: x >= 10 AND x <= 11)) > 0 AS c FROM {CARTS_SQL}",
    ),
    "q_array_filter_map_sort": (
        ("carts",),
        "SELECT $._id AS k, SUM(FILTER($.qtys[*] => @ > 25)) AS f, JOIN(MAP($.items[*] => @.flag + @.n), ',') AS m, FIRST(SORT($.qtys[*] => @, 'desc')) AS t, COUNT($.items[@.qty > 25]) AS c FROM carts",
        f"SELECT _id AS k, coalesce(list_sum(list_filter(qtys, lambda x: x > 25)), 0) AS f, array_to_string(list_transform(list_zip(flags, ns), lambda z: z[1] || CAST(z[2] AS VARCHAR)), ',') AS m, list_max(qtys) AS t, CAST(len(list_filter(qtys, lambda x: x > 25)) AS INTEGER) AS c FROM {CARTS_SQL}",
    ),
    "q_array_sets": (
        ("carts",),
        "SELECT $._id AS k, JOIN(UNION($.flags, ['N', 'Z']), '') AS u, JOIN(EXCEPT($.flags, ['N']), '') AS e, COUNT(DISTINCT($.flags[*])) AS d, COUNT(CONCAT($.flags, $.flags)) AS c, COUNT(TOP($.qtys, 2)) AS t FROM carts WHERE COUNT($.qtys) = 1",
        f"SELECT _id AS k, CASE WHEN flags[1] = 'N' THEN 'NZ' ELSE flags[1] || 'NZ' END AS u, CASE WHEN flags[1] = 'N' THEN '' ELSE flags[1] END AS e, CAST(1 AS INTEGER) AS d, CAST(2 AS INTEGER) AS c, CAST(1 AS INTEGER) AS t FROM {CARTS_SQL} WHERE len(qtys) = 1",
    ),
    "q_array_sets_many": (
        ("carts",),
        "SELECT $._id AS k, JOIN(SORT(UNION($.flags, ['N', 'Z']) => @), '') AS u, JOIN(SORT(EXCEPT($.flags, ['N']) => @), '') AS e, COUNT(DISTINCT($.flags[*])) AS d, COUNT(CONCAT($.flags, $.qtys)) AS c, SUM(TOP($.qtys, 2)) AS t, JOIN(CONCAT(TOP($.flags, 1), ['x']), '-') AS j FROM carts",
        f"SELECT _id AS k, array_to_string(list_sort(list_distinct(list_concat(flags, ['N', 'Z']))), '') AS u, coalesce(array_to_string(list_sort(list_distinct(list_filter(flags, lambda x: x <> 'N'))), ''), '') AS e, CAST(len(list_distinct(flags)) AS INTEGER) AS d, CAST(2 * len(flags) AS INTEGER) AS c, list_sum(qtys[1:2]) AS t, flags[1] || '-x' AS j FROM {CARTS_SQL}",
    ),
    "q_sort_full": (
        ("lineitem",),
        "SELECT $.l_orderkey AS k, $.l_linenumber AS n, $.l_extendedprice AS p FROM lineitem ORDER BY $.l_extendedprice DESC",
        "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS p FROM lineitem ORDER BY l_extendedprice DESC",
    ),
    "q_keys_values": (
        ("nation",),
        "SELECT $.n_nationkey AS k, JOIN(KEYS({a: 1, b: $.n_name}), ',') AS ks, JOIN(VALUES({a: $.n_nationkey, b: $.n_name}), ',') AS vs, JOIN(KEYS(EXTEND({a: 1}, {c: 2})), '') AS x, COUNT(ITEMS([1, 2, 3])) AS n FROM nation",
        "SELECT n_nationkey AS k, 'a,b' AS ks, n_nationkey || ',' || n_name AS vs, 'ac' AS x, 3::INTEGER AS n FROM nation",
    ),
    "q_binary": (
        ("nation",),
        "SELECT $.n_nationkey AS k, LENGTH(BINARY('aGVsbG8=')) AS n, IS_BINARY(BINARY('aGVsbG8=')) AS b, STRING(BINARY('aGVsbG8=')) AS s, IS_NULL(BINARY($.n_nationkey)) AS z FROM nation",
        """SELECT n_nationkey AS k, 5::INTEGER AS n, true AS b, '{"$binary":"aGVsbG8="}' AS s, true AS z FROM nation""",
    ),
    "q_casts": (
        ("part",),
        "SELECT $.p_partkey AS k, DOUBLE('1,234.5') AS d, DOUBLE(STRING($.p_size)) + 0.5 AS e, INT(' 42 ') AS i, IS_NULL(INT('4x')) AS bad, LONG($.p_size) * 10000000000 AS l, STRING($.p_size) AS s, BOOL('True') AS t, DAY(DATETIME('2020-02-29')) AS y, IS_NULL(DATETIME('soon')) AS never, MONTH(DATETIME_UTC(2021, 3, 4)) AS m FROM part",
        "SELECT p_partkey AS k, 1234.5::DOUBLE AS d, p_size + 0.5::DOUBLE AS e, 42::INTEGER AS i, true AS bad, p_size * 10000000000 AS l, CAST(p_size AS VARCHAR) AS s, true AS t, 29::INTEGER AS y, true AS never, 3::INTEGER AS m FROM part",
    ),
    "q_cultures": (
        ("part",),
        "SELECT $.p_partkey AS k, DOUBLE(REPLACE(STRING($.p_retailprice), '.', ','), 'de-DE') AS price, DOUBLE('1.234,5', 'de-DE') AS g, DOUBLE('(1.5)') AS minus, IS_NULL(DOUBLE('.5', 'de-DE')) AS bare, DOUBLE('-Infinity') < 0 AS endless, IS_NULL(DOUBLE('\u221e')) AS sign, DAY(DATETIME('15.01.2020', 'de-DE')) AS d, IS_NULL(DATETIME('1/15/2020', 'de-DE')) AS never, MONTH(DATETIME('3/15/2020')) AS m, HOUR(DATETIME('15/1/2020 10:30', 'en-GB')) AS h FROM part",
        "SELECT p_partkey AS k, p_retailprice AS price, 1234.5::DOUBLE AS g, -1.5::DOUBLE AS minus, true AS bare, true AS endless, true AS sign, 15::INTEGER AS d, true AS never, 3::INTEGER AS m, 10::INTEGER AS h FROM part",
    ),
    "q_decimal": (
        ("lineitem",),
        "SELECT {flag: @key, s: ROUND(DOUBLE(SUM(MAP(* => DECIMAL(@.l_quantity)))), 2), a: ROUND(DOUBLE(AVG(MAP(* => DECIMAL(@.l_quantity)))), 4)} FROM lineitem GROUP BY $.l_returnflag",
        "SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY 1",
    ),
    "q_ids": (
        ("customer",),
        "SELECT $.c_custkey AS k, OBJECTID('5F5E1000aaaaaaaaaaaaaaaa') AS o, IS_NULL(OBJECTID($.c_name)) AS bad, GUID('0F8FAD5B-D9CB-469F-A165-70867728950E') AS g, YEAR(OID_CREATIONTIME(OBJECTID('5f5e1000aaaaaaaaaaaaaaaa'))) AS y, IS_GUID($.c_name) AS n, IS_OBJECTID('5f5e1000aaaaaaaaaaaaaaaa') AS i FROM customer",
        "SELECT c_custkey AS k, '5f5e1000aaaaaaaaaaaaaaaa' AS o, true AS bad, '0f8fad5b-d9cb-469f-a165-70867728950e' AS g, 2020::INTEGER AS y, false AS n, true AS i FROM customer",
    ),
    "q_is_types": (
        ("orders",),
        "SELECT $.o_orderkey AS k, IS_INT64($.o_orderkey) AS a, IS_DOUBLE($.o_totalprice) AS b, IS_NUMBER($.o_orderstatus) AS c, IS_DATETIME($.o_orderdate) AS d, IS_ARRAY([1]) AS e, IS_DOCUMENT({x: 1}) AS f, IS_STRING($.o_orderstatus) AS g, IS_BOOL(1 = 1) AS h, IS_NULL($.nope) AS i, IS_DECIMAL(DECIMAL('1')) AS j, IS_INT32(1) AS l FROM orders",
        "SELECT o_orderkey AS k, true AS a, true AS b, false AS c, true AS d, true AS e, true AS f, true AS g, true AS h, true AS i, true AS j, true AS l FROM orders",
    ),
    "q_sentinels": (
        ("gaps",),
        "SELECT $._id AS k, IS_MINVALUE(MINVALUE()) AS a, IS_MAXVALUE(MAXVALUE()) AS b, $.price > MINVALUE() AS c, $.price < MAXVALUE() AS d, MINVALUE() < null AS e, MAXVALUE() = MAXVALUE() AS f, MAXVALUE() <= $.price AS g, IS_MINVALUE($.price) AS h, MAXVALUE() AS m FROM gaps",
        f"""SELECT _id AS k, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, false AS g, false AS h, '{{"$maxValue":"1"}}' AS m FROM {GAPS_SQL}""",
    ),
    "q_string_ranges": (
        ("customer",),
        "SELECT $.c_custkey AS k, SUBSTRING($.c_mktsegment, -2) AS a, SUBSTRING($.c_mktsegment, 100) AS b, SUBSTRING($.c_mktsegment, 2, 1000) AS c, SUBSTRING($.c_mktsegment, LENGTH($.c_mktsegment)) AS d, SUBSTRING($.c_mktsegment, 3) AS e, SUBSTRING($.c_name, $.c_custkey % 30, 2) AS f, INDEXOF($.c_name, '#', 99) AS g, LPAD($.c_name, -1, 'x') AS h, RPAD($.c_mktsegment, 12, '') AS i, REPLACE($.c_name, '', 'x') AS j FROM customer",
        "SELECT c_custkey AS k, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, '' AS d, substr(c_mktsegment, 4) AS e, CASE WHEN c_custkey % 30 + 2 <= length(c_name) THEN substr(c_name, CAST(c_custkey % 30 + 1 AS INTEGER), 2) END AS f, NULL::INTEGER AS g, NULL::VARCHAR AS h, NULL::VARCHAR AS i, NULL::VARCHAR AS j FROM customer",
    ),
    "q_split_groups": (
        ("orders",),
        "SELECT $.o_orderkey AS k, JOIN(SPLIT($.o_orderpriority, '([0-9])-', true), '|') AS a, JOIN(SPLIT('a1b22c', '([0-9])([0-9])?', true), ',') AS b, COUNT(SPLIT('a--b', '-', true)) AS c, COUNT(SPLIT('a--b', '-')) AS d, JOIN(SPLIT('x,y;z', '(?:,|;)', true), '') AS e FROM orders",
        "SELECT o_orderkey AS k, '|' || replace(o_orderpriority, '-', '|') AS a, 'a,1,b,2,2,c' AS b, 3::INTEGER AS c, 2::INTEGER AS d, 'xyz' AS e FROM orders",
    ),
    "q_json_nested": (
        ("events",),
        """SELECT $.event_id AS k, INT(FIRST(MAP(ITEMS(JSON('{a: {b: [1, {c: ' + INT($.user_id) + '}]}}')) => @.a.b[1].c))) AS u, FIRST(MAP(ITEMS(JSON('{"s": "x y", "n": null}' + SUBSTRING($.event_type, 0, 0))) => @.s)) AS s, COUNT(ITEMS(JSON('[1, 2, ' + INT($.user_id) + ']'))) AS n, FIRST(MAP(ITEMS(JSON('{a: 1, b: {c: [2, 3]}}')) => @.b.c[1])) AS l, IS_NULL(JSON($.event_type + '{')) AS bad, JOIN(KEYS(JSON($.props)), ',') AS ks, INT(FIRST(MAP(ITEMS(JSON($.props)) => @.K))) AS v FROM events""",
        "SELECT event_id AS k, CAST(user_id AS INTEGER) AS u, 'x y' AS s, 3::INTEGER AS n, 3::INTEGER AS l, true AS bad, 'k' AS ks, CAST(json_extract_string(props, '$.k') AS INTEGER) AS v FROM events",
    ),
    "q_format_more": (
        ("part",),
        "SELECT $.p_partkey AS k, FORMAT($.p_size, 'D3') AS d, FORMAT(0 - $.p_size, 'N0') AS n, FORMAT($.p_size, 'X4') AS x, FORMAT(0.25, 'P1') AS p, FORMAT(1234.5, 'C2') AS c, FORMAT(DATETIME('2020-01-15T10:30:00'), 'yyyy-MM-dd') AS t, FORMAT(1 = 1, '') AS b, FORMAT($.p_size, '000.0') AS z FROM part",
        "SELECT p_partkey AS k, printf('%03d', p_size) AS d, CAST(-p_size AS VARCHAR) AS n, printf('%04X', p_size) AS x, '25.0 %' AS p, '¤1,234.50' AS c, '2020-01-15' AS t, 'True' AS b, printf('%05.1f', CAST(p_size AS DOUBLE)) AS z FROM part",
    ),
    "q_local_utc": (
        ("orders",),
        "SELECT $.o_orderkey AS k, TO_UTC(TO_LOCAL($.o_orderdate)) = $.o_orderdate AS same, HOUR(TO_LOCAL(DATETIME('2020-01-15T10:30:00'))) AS h FROM orders",
        "SELECT o_orderkey AS k, true AS same, 10::INTEGER AS h FROM orders",
    ),
    "q_array_cast": (
        ("carts",),
        "SELECT $._id AS k, LENGTH(ARRAY($.qtys[*])) AS n, LENGTH(ARRAY(1)) AS one, FIRST(ARRAY(FILTER($.qtys[*] => @ > 40))) AS x, IS_ARRAY(ARRAY($.flags[*])) AS a FROM carts",
        f"SELECT _id AS k, CAST(len(qtys) AS INTEGER) AS n, 1::INTEGER AS one, list_filter(qtys, lambda x: x > 40)[1] AS x, true AS a FROM {CARTS_SQL}",
    ),
    "q_multikey": (
        ("carts",),
        "SELECT $._id AS k FROM carts WHERE $.flags[*] ANY = 'R' AND $.qtys[*] ANY >= 49",
        f"SELECT _id AS k FROM {CARTS_SQL} WHERE list_contains(flags, 'R') AND list_max(qtys) >= 49",
    ),
    "q_array_index": (("carts",), "SELECT $._id AS k, $.qtys[0] AS a, $.qtys[-1] AS z, $.qtys[99] AS o, $.items[0].flag AS f FROM carts", f"SELECT _id AS k, qtys[1] AS a, qtys[-1] AS z, NULL::DOUBLE AS o, flags[1] AS f FROM {CARTS_SQL}"),
    "q_json_props": (("events",), "SELECT $.event_id AS k, INT(FIRST(MAP(ITEMS(JSON($.props)) => @.k))) AS v FROM events", "SELECT event_id AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS v FROM events"),
    "q_iif_coalesce": (
        ("gaps",),
        "SELECT $._id AS k, IIF($.price > 100000, 'high', 'low') AS c, COALESCE($.priority, 'none') AS p, LENGTH($.priority) AS n FROM gaps",
        f"SELECT _id AS k, CASE WHEN price > 100000 THEN 'high' ELSE 'low' END AS c, coalesce(priority, 'none') AS p, coalesce(CAST(length(priority) AS INTEGER), 0) AS n FROM {GAPS_SQL}",
    ),
    "q_format": (("part",), "SELECT $.p_partkey AS k, FORMAT($.p_retailprice, 'F1') AS f, FORMAT($.p_size, 'D4') AS d FROM part", "SELECT p_partkey AS k, printf('%.1f', p_retailprice) AS f, printf('%04d', p_size) AS d FROM part"),
    "q_include_customer": (
        ("refs", "customer"),
        "SELECT $._id AS k, $.customer.c_name AS name, $.customer.['$missing'] AS gone FROM refs INCLUDE $.customer",
        "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 THEN c_name END AS name, CASE WHEN o_orderkey % 10 = 0 THEN true END AS gone FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    ),
    "q_include_filter": (
        ("refs", "customer"),
        "SELECT $._id AS k, $.customer.c_mktsegment AS m FROM refs INCLUDE $.customer WHERE $.customer.c_acctbal > 5000",
        "SELECT o_orderkey AS k, c_mktsegment AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0 AND c_acctbal > 5000",
    ),
    "q_query_subselect": (("orders",), "SELECT $.k AS k FROM $query('SELECT $.o_orderkey AS k, $.o_totalprice AS p FROM orders WHERE $.o_totalprice > 300000') WHERE $.p < 400000", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 300000 AND o_totalprice < 400000"),
    "q_no_from": ((), "SELECT 1 AS a, 10 - 2 + 3 AS b, 'x' + 1 AS c, 8 / 4 * 2 AS d", "SELECT 1 AS a, 5 AS b, 'x1' AS c, 4.0::DOUBLE AS d"),
    "q_cols": (("orders", "nation"), "SELECT $.name AS name FROM $cols", "SELECT unnest(['nation', 'orders']) AS name"),
    "q_vector_sim": (
        ("embeddings",),
        "SELECT $.vec_id AS k, ROUND($.embedding VECTOR_SIM [" + ", ".join(["1", "0.5"] * 32) + "], 6) AS d FROM embeddings",
        "SELECT vec_id AS k, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST([" + ", ".join(["1", "0.5"] * 32) + "] AS DOUBLE[])), 6) AS d FROM embeddings",
    ),
}


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names, text, _ = STATEMENTS[name]
        return database(spark, sf_dir, *names).execute(text)

    run.__name__ = name
    return run


TARGET = [1.0, 0.5] * 32
TARGET_SQL = "CAST([" + ", ".join(["1", "0.5"] * 32) + "] AS DOUBLE[])"


def _near(metric: str, k: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = vector.top_k_near(table(spark, sf_dir, "embeddings"), "embedding", TARGET, k, metric, "vec_id")
        return got.select("vec_id", F.round("distance", 5).alias("distance"))

    return run


def _temporary(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    return database(spark, sf_dir, *names, path=f"{scratch_folder(spark)}/folioq-db-{uuid.uuid4().hex}")


def q_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _temporary(spark, sf_dir, "orders")
    db.execute("SELECT {_id: $.o_orderkey, p: $.o_totalprice} INTO dear FROM orders WHERE $.o_totalprice > 300000")
    return db.execute("SELECT $._id AS k, $.p AS p FROM dear")


def q_insert_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _temporary(spark, sf_dir, "nation")
    db.execute("SELECT {_id: $.n_nationkey, name: $.n_name, region: $.n_regionkey} INTO n FROM nation")
    db.execute("INSERT INTO n VALUES {_id: 1000, name: 'new', region: 9}, {_id: 1001, name: 'newer', region: 9}")
    db.execute("UPDATE n SET name = UPPER($.name) + '!', seen = true WHERE $.region = @0", 9)
    db.execute("DELETE n WHERE $.region = 1")
    return db.execute("SELECT $._id AS k, $.name AS name, $.seen AS seen FROM n")


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _temporary(spark, sf_dir, "customer")
    db.execute("SELECT {_id: $.c_custkey, b: $.c_acctbal} INTO c FROM customer")
    db.upsert("c", table(spark, sf_dir, "customer").selectExpr("c_custkey * 2 AS _id", "0.0D AS b"))
    return db.execute("SELECT $._id AS k, $.b AS b FROM c")


def q_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _temporary(spark, sf_dir, "part")
    out = f"{db.storage.files.root}-file.json"
    db.execute("SELECT {k: $.p_partkey, n: $.p_name} INTO $file({filename: '" + out + "', format: 'jsonl'}) FROM part")
    return db.execute("SELECT $.k AS k, $.n AS n FROM $file({filename: '" + out + "', format: 'jsonl'})")


def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _temporary(spark, sf_dir, "supplier")
    out = f"{db.storage.files.root}-file.csv"
    db.execute("SELECT {k: $.s_suppkey, n: $.s_name} INTO $file({filename: '" + out + "', delimiter: ';'}) FROM supplier")
    return db.execute("SELECT LONG($.k) AS k, $.n AS n FROM $file({filename: '" + out + "', delimiter: ';'})")


def q_find_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vector.find_near(table(spark, sf_dir, "embeddings"), "embedding", TARGET, 0.95)
    return got.select("vec_id")


def q_fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = database(spark, sf_dir, "orders").query("orders")
    q = q.where("$.o_totalprice > @low").where("$.o_orderpriority LIKE '1%'").param("low", 250000)
    return q.select("{k: $.o_orderkey, p: $.o_totalprice}").order_by_desc("$.o_totalprice").then_by("$.o_orderkey").skip(3).limit(25).frame()


def q_volatile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that differ from call to call, by what they must be."""
    made = database(spark, sf_dir, "orders").execute("SELECT $.o_orderkey AS k, RANDOM(1, 10) AS r, RANDOM() AS p, GUID() AS g, OBJECTID() AS o, NOW() AS t, NOW_UTC() AS u, TODAY() AS d FROM orders")
    kinds = made.selectExpr(
        "k", "r >= 1 AND r < 10 AS r", "p >= 0 AS p", "g RLIKE '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$' AS g", "o RLIKE '^[0-9a-f]{24}$' AS o",
        "abs(unix_timestamp(t) - unix_timestamp()) < 3600 AND t = u AS t", "d <= t AND d > t - INTERVAL 24 HOURS AS d",
    )
    seen = made.agg(F.count_distinct("g").alias("ids"), F.count_distinct("r").alias("numbers")).selectExpr("ids", "numbers > 1 AS varied")
    return kinds.groupBy("r", "p", "g", "o", "t", "d").agg(F.count("*").alias("n")).crossJoin(seen)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _statement(n) for n in STATEMENTS} | {
    "q_vector_topk_cosine": _near("cosine", 10),
    "q_vector_topk_euclid": _near("euclidean", 10),
    "q_vector_topk_dot": _near("dot", 10),
    **{f.__name__: f for f in (q_find_near, q_into, q_insert_update_delete, q_upsert, q_file_roundtrip, q_csv_roundtrip, q_fluent, q_volatile)},
    **SCENARIOS,
}
_V = "CAST(embedding AS DOUBLE[])"
ORACLE_SQL: dict[str, str] = {n: s for n, (_, _, s) in STATEMENTS.items()} | {
    "q_vector_topk_cosine": f"SELECT vec_id, round(1 - list_cosine_similarity({_V}, {TARGET_SQL}), 5) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity({_V}, {TARGET_SQL}), vec_id LIMIT 10",
    "q_vector_topk_euclid": f"SELECT vec_id, round(list_distance({_V}, {TARGET_SQL}), 5) AS distance FROM embeddings ORDER BY list_distance({_V}, {TARGET_SQL}), vec_id LIMIT 10",
    "q_vector_topk_dot": f"SELECT vec_id, round(list_inner_product({_V}, {TARGET_SQL}), 5) AS distance FROM embeddings ORDER BY list_inner_product({_V}, {TARGET_SQL}) DESC, vec_id LIMIT 10",
    "q_find_near": f"SELECT vec_id FROM embeddings WHERE 1 - list_cosine_similarity({_V}, {TARGET_SQL}) <= 0.95",
    "q_into": "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000",
    "q_insert_update_delete": "SELECT n_nationkey AS k, n_name AS name, NULL::BOOLEAN AS seen FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 1000, 'NEW!', true UNION ALL SELECT 1001, 'NEWER!', true",
    "q_upsert": "SELECT coalesce(a.c_custkey, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN 0.0 ELSE a.c_acctbal END AS b FROM customer a FULL JOIN (SELECT c_custkey * 2 AS k FROM customer) b ON a.c_custkey = b.k",
    "q_file_roundtrip": "SELECT p_partkey AS k, p_name AS n FROM part",
    "q_csv_roundtrip": "SELECT s_suppkey AS k, s_name AS n FROM supplier",
    "q_fluent": "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 250000 AND o_orderpriority LIKE '1%' ORDER BY p DESC, k LIMIT 25 OFFSET 3",
    "q_volatile": "SELECT true AS r, true AS p, true AS g, true AS o, true AS t, true AS d, count(*) AS n, count(*) AS ids, true AS varied FROM orders",
    **SCENARIO_SQL,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    with dialect(spark):
        return QUERIES["q_group_sum_avg"](spark, sf_dir)
