"""Queries whose results come about by several steps: writes, transactions, definitions, files, feeds. Each with the same in SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database, scratch_folder
from .errors import BindFault, ConflictFault, FolioError
from .sources import blobs
from .streaming import ttl

Scenario = Callable[[SparkSession, str], DataFrame]
SCENARIOS: dict[str, Scenario] = {}
SCENARIO_SQL: dict[str, str] = {}


def scenario(sql: str) -> Callable[[Scenario], Scenario]:
    def add(f: Scenario) -> Scenario:
        SCENARIOS[f.__name__], SCENARIO_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, **options: str) -> Database:
    return Database(spark, f"{scratch_folder(spark)}/folioq-db-{uuid.uuid4().hex}", **options)


def of_customers(spark: SparkSession, sf_dir: str) -> Database:
    """A database whose collection c holds the customers, in four segments."""
    db = fresh(spark)
    src = table(spark, sf_dir, "customer").selectExpr("c_custkey AS _id", "c_name AS name", "c_acctbal AS b", "c_mktsegment AS m")
    with db.transaction():
        for k in range(4):
            db.insert("c", src.where(F.col("_id") % 4 == k))
    return db


def refused(fault: type[Exception], act: Callable[[], object]) -> bool:
    try:
        act()
    except fault:
        return True
    return False


def facts(spark: SparkSession, **values: object) -> DataFrame:
    """One row of results."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# Files


@scenario("SELECT p_partkey AS k, p_name AS n, p_retailprice AS p, p_size AS s FROM part")
def q_json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = fresh(spark).attach("part", table(spark, sf_dir, "part"), "p_partkey")
    out = f"{db.storage.files.root}-file.json"
    db.execute("SELECT {k: $.p_partkey, n: $.p_name, price: {p: $.p_retailprice, sizes: [$.p_size, 0]}} INTO $file('" + out + "') FROM part")
    return db.execute("SELECT $.k AS k, $.n AS n, $.price.p AS p, INT($.price.sizes[0]) AS s FROM $file('" + out + "')")


@scenario("SELECT s_suppkey AS k, s_name AS n, s_acctbal AS b FROM supplier")
def q_json_pretty_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = fresh(spark).attach("supplier", table(spark, sf_dir, "supplier"), "s_suppkey")
    at = "{filename: '" + f"{db.storage.files.root}-file.json" + "', pretty: true, indent: 4}"
    db.execute("SELECT {k: $.s_suppkey, in: {n: $.s_name, b: [$.s_acctbal]}} INTO $file(" + at + ") FROM supplier")
    return db.execute("SELECT $.k AS k, $.in.n AS n, $.in.b[0] AS b FROM $file(" + at + ")")


@scenario("SELECT n_nationkey AS k, n_name AS n FROM nation")
def q_json_lines_by_another_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents line by line in a .json file, as other programs write them."""
    db = fresh(spark).attach("nation", table(spark, sf_dir, "nation"), "n_nationkey")
    out = f"{db.storage.files.root}-file.json"
    db.execute("SELECT {k: $.n_nationkey, n: $.n_name} INTO $file({filename: '" + out + "', format: 'jsonl'}) FROM nation")
    return db.execute("SELECT $.k AS k, $.n AS n FROM $file('" + out + "')")


def pages_as_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("page"), "page_id", F.lit(".html"))
    return blobs.stored(pages.select(F.col("page_id").alias("_id"), name.alias("filename"), F.encode("html", "UTF-8").alias("content")), 1000)


@scenario("""SELECT page_id AS id, 'page' || page_id || '.html' AS filename, 'text/html' AS mime, octet_length(encode(html)) AS length,
  CAST(ceil(octet_length(encode(html)) / 1000.0) AS INTEGER) AS chunks, md5(html) AS sum FROM pages""")
def q_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file in chunks of 1000 bytes: its facts, and a sum over what is read back."""
    files, chunks = pages_as_files(spark, sf_dir)
    read = blobs.contents(files, chunks, chunk=1000).select("_id", F.md5("content").alias("sum"))
    return files.join(read, "_id").select(F.col("_id").alias("id"), "filename", F.col("mimeType").alias("mime"), "length", "chunks", "sum")


@scenario("SELECT page_id AS id, substr(hex(encode(html)), 1801, 2400) AS part FROM pages")
def q_blobs_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 900 to 2099 of every page, out of the chunks that hold them."""
    files, chunks = pages_as_files(spark, sf_dir)
    return blobs.contents(files, chunks, 900, 1200, chunk=1000).select(F.col("_id").alias("id"), F.hex("content").alias("part"))


@scenario("""SELECT page_id AS id, CASE WHEN octet_length(encode(html)) > 2000 THEN '{"long":true}' END AS metadata,
  CAST(ceil(octet_length(encode(html)) / 1000.0) AS BIGINT) AS chunks FROM pages WHERE octet_length(encode(html)) >= 1000""")
def q_blobs_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short files go with their chunks; long ones get metadata."""
    files, chunks = pages_as_files(spark, sf_dir)
    files, chunks = blobs.deleted(blobs.with_metadata(files, F.col("length") > 2000, '{"long":true}'), chunks, F.col("length") < 1000)
    left = chunks.groupBy(F.col("_id.f").alias("f")).agg(F.count("*").alias("n"))
    out = files.join(left, F.col("_id") == F.col("f"), "full")
    return out.select(F.coalesce("_id", "f").alias("id"), "metadata", F.coalesce("n", F.lit(0)).cast("long").alias("chunks"))


# Transactions and writes


@scenario("SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 1000000001, 1.0 UNION ALL SELECT 1000000002, 2.0")
def q_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fault in the middle undoes its own statement only; what is rolled back leaves nothing."""
    db = of_customers(spark, sf_dir)
    db.execute("BEGIN")
    db.execute("INSERT INTO c VALUES {_id: 1000000001, b: 1.0}")
    if not refused(ConflictFault, lambda: db.execute("INSERT INTO c VALUES {_id: 1000000009, b: 9.0}, {_id: 1000000001, b: 5.0}")):
        raise FolioError("a key was given twice")
    db.execute("DELETE c WHERE $._id % 3 = 0 AND $._id < 1000000000")
    db.execute("INSERT INTO c VALUES {_id: 1000000002, b: 2.0}")
    db.execute("COMMIT")
    db.execute("BEGIN TRANS")
    db.execute("UPDATE c SET b = 0.0")
    db.execute("ROLLBACK")
    return Database(spark, db.storage.files.root).execute("SELECT $._id AS k, $.b AS b FROM c")


@scenario("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 2.0 ELSE c_acctbal END AS b FROM customer")
def q_update_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by _id; of several of one _id the last counts, and unknown ones are passed over."""
    db = of_customers(spark, sf_dir)
    ids = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0")
    new = lambda b: ids.selectExpr("c_custkey AS _id", "'new' AS name", f"{b} AS b")
    stranger = spark.createDataFrame([(-1, "none", 0.0)], "_id long, name string, b double")
    db.update("c", new("1.0D").unionAll(stranger).unionAll(new("2.0D")))
    return db.execute("SELECT $._id AS k, $.name AS name, $.b AS b FROM c")


@scenario("SELECT 25 AS old, 3 AS inserted, 4 AS updated, 28 AS total, 'c' AS last")
def q_upsert_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = fresh(spark).attach("nation", table(spark, sf_dir, "nation"), "n_nationkey")
    old = db.execute("SELECT {_id: INT($.n_nationkey), name: $.n_name} INTO n FROM nation")
    rows = [(1, "x"), (2, "y"), (100, "a"), (100, "b"), (100, "c"), (101, "d"), (102, "e")]
    inserted, updated = db.upsert("n", [{"_id": i, "name": n} for i, n in rows])
    last = db.collection("n").find_by_id(100).name
    return facts(spark, old=old, inserted=inserted, updated=updated, total=db.query("n").count(), last=last)


@scenario("SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT -1")
def q_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint deletes what no version names, but not what another writer has not committed yet."""
    db = of_customers(spark, sf_dir)
    db.execute("DELETE c WHERE $._id % 2 = 1")
    other = Database(spark, db.storage.files.root)
    other.begin()
    other.insert("c", [{"_id": -1}])
    db.execute("CHECKPOINT")
    other.commit()
    db.execute("CHECKPOINT")
    return db.execute("SELECT LONG($._id) AS k FROM c")


@scenario("SELECT 4 AS before, 1 AS after, 3 AS saved, count(*) AS n, sum(c_custkey) AS ids FROM customer")
def q_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = of_customers(spark, sf_dir)
    before = db.execute("SELECT $ FROM $dump").count()
    saved = db.execute("REBUILD {collation: '/Ordinal'}")
    r = db.execute("SELECT COUNT(*) AS n, SUM(*._id) AS s FROM c").first()
    return facts(spark, before=before, after=db.execute("SELECT $ FROM $page_list").count(), saved=saved, n=r.n, ids=r.s)


@scenario("SELECT true AS made, false AS again, true AS taken, true AS dropped, false AS gone, count(*) + 2 AS n FROM customer")
def q_unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = of_customers(spark, sf_dir)
    made, again = (db.execute("CREATE UNIQUE INDEX by_name ON c ($.name)") for _ in range(2))
    twice = "INSERT INTO c VALUES {_id: -1, name: 'same'}, {_id: -2, name: 'same'}"
    taken = refused(ConflictFault, lambda: db.execute(twice))
    dropped, gone = (db.execute("DROP INDEX c.by_name") for _ in range(2))
    db.execute(twice)
    return facts(spark, made=made, again=again, taken=taken, dropped=dropped, gone=gone, n=db.query("c").count())


@scenario("SELECT c_custkey AS k, c_name AS name FROM customer")
def q_rename_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = of_customers(spark, sf_dir)
    db.execute("RENAME COLLECTION c TO d")
    if db.exists("c"):
        raise FolioError("the old name is there")
    return db.execute("SELECT $._id AS k, $.name AS name FROM d")


@scenario("SELECT count(*) AS n, true AS dropped, false AS again, 0 AS after FROM customer")
def q_drop_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = of_customers(spark, sf_dir)
    n = db.query("c").count()
    dropped, again = (db.execute("DROP COLLECTION c") for _ in range(2))
    return facts(spark, n=n, dropped=dropped, again=again, after=db.query("c").count())


@scenario("SELECT 0 AS before, true AS changed, false AS again, 7 AS stored, true AS full")
def q_pragma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings are stored with the database, and a limit on its size is kept."""
    db = of_customers(spark, sf_dir)
    before = db.execute("PRAGMA USER_VERSION")
    changed, again = (db.execute("PRAGMA USER_VERSION = 7") for _ in range(2))
    db.execute("PRAGMA LIMIT_SIZE = 1000")
    stored = Database(spark, db.storage.files.root).execute("PRAGMA USER_VERSION")
    full = refused(FolioError, lambda: db.execute("INSERT INTO c VALUES {_id: -5}"))
    return facts(spark, before=before, changed=changed, again=again, stored=stored, full=full)


@scenario("SELECT c_custkey AS k FROM customer WHERE c_custkey % 100 <> 0 AND c_custkey > 10")
def q_delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = of_customers(spark, sf_dir)
    db.collection("c").delete(list(range(-5, 11)))
    db.collection("c").delete_many("$._id % @n = 0", n=100)
    return db.execute("SELECT $._id AS k FROM c")


@scenario("SELECT 101 + n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 100, 'given'")
def q_auto_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers go on from the greatest that was given."""
    db = fresh(spark).attach("nation", table(spark, sf_dir, "nation"), "n_nationkey")
    db.execute("INSERT INTO n:LONG VALUES {_id: 100, name: 'given'}")
    db.execute("SELECT {name: $.n_name} INTO n:LONG FROM nation")
    if db.execute("SELECT COUNT(DISTINCT(*._id)) AS x FROM n").first().x != 26:
        raise FolioError("a number was given twice")
    rows = db.execute("SELECT $._id AS k, $.name AS name FROM n")
    names = table(spark, sf_dir, "nation").selectExpr("n_name AS name", "n_nationkey + 101 AS at")
    return rows.join(names, "name", "left").selectExpr("CASE WHEN at IS NULL THEN k ELSE cast(at AS long) END AS k", "name")


@scenario("SELECT event_id AS k FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def q_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has expired by an instant goes; a field that is no instant never expires."""
    db = fresh(spark).attach("events", table(spark, sf_dir, "events"), "event_id")
    db.execute("SELECT {_id: $.event_id, at: $.ts, kind: $.event_type} INTO e FROM events")
    ttl.sweep(db, "e", "$.at", dt.datetime(2024, 1, 10))
    ttl.sweep(db, "e", "$.kind", dt.datetime(2124, 1, 1))
    return db.execute("SELECT $._id AS k FROM e")


@scenario("SELECT 'c' AS collection, op, n FROM (SELECT 'Insert' AS op, count(*) + 1 AS n FROM customer UNION ALL SELECT 'Update', count(*) FROM customer WHERE c_custkey > 0 AND c_custkey <= 10 UNION ALL SELECT 'Delete', count(*) FROM customer WHERE c_custkey = 7)")
def q_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of what was committed; a rolled-back change is not in it."""
    db = fresh(spark, change_log=f"{scratch_folder(spark)}/folioq-log-{uuid.uuid4().hex}")
    db.insert("c", table(spark, sf_dir, "customer").selectExpr("c_custkey AS _id", "c_acctbal AS b"))
    db.execute("INSERT INTO c VALUES {_id: -1, b: 0.0}")
    db.execute("UPDATE c SET b = 1.0 WHERE $._id > 0 AND $._id <= 10")
    db.execute("DELETE c WHERE $._id = 7")
    db.begin()
    db.execute("DELETE c")
    db.rollback()
    return spark.read.parquet(db.feed.log).groupBy("collection", "op").agg(F.count("*").alias("n"))


# Facts about the database and about queries


@scenario("SELECT 'index' AS what, 'by_b' AS name, '$.b' AS detail UNION ALL SELECT 'sequence', 'c', CAST(max(c_custkey) AS VARCHAR) FROM customer UNION ALL SELECT 'collection', 'c', 'user' UNION ALL SELECT 'collection', 'nation', 'attached' UNION ALL SELECT 'snapshot', 'c', 'read' UNION ALL SELECT 'snapshot', 'nation', 'read'")
def q_system_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = of_customers(spark, sf_dir).attach("nation", table(spark, sf_dir, "nation"), "n_nationkey")
    db.execute("CREATE INDEX by_b ON c ($.b)")
    parts = {
        "SELECT 'index' AS what, $.name AS name, $.expr AS detail FROM $indexes", "SELECT 'sequence' AS what, $.collection AS name, '' + INT($.value) AS detail FROM $sequences",
        "SELECT 'collection' AS what, $.name AS name, $.type AS detail FROM $cols", "SELECT 'snapshot' AS what, $.collection AS name, $.mode AS detail FROM $snapshots",
    }
    out = None
    for p in sorted(parts):
        out = db.execute(p) if out is None else out.unionByName(db.execute(p))
    return out


@scenario("SELECT count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, true AS some, false AS none, arg_min(c_name, c_custkey) AS first, true AS many FROM customer")
def q_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Database(spark).attach("c", table(spark, sf_dir, "customer"), "c_custkey").query("c")
    first = q.order_by("$.c_custkey").first().c_name
    if q.where("$.c_custkey = 1").single().c_name != q.where("$.c_custkey = 1").first_or_default().c_name:
        raise FolioError("single and first differ")
    return facts(
        spark, n=q.count(), low=q.min("$.c_acctbal"), high=q.max("$.c_acctbal"), some=q.where("$.c_custkey > 1").exists(), none=q.where("$.c_custkey < 0").exists(),
        first=first, many=refused(BindFault, q.single),
    )


@scenario('''SELECT 'INDEX SEEK(_id)' AS mode, 1 AS cost, '$._id=5' AS filter, 'queryPipe' AS pipe, 3 AS lim, 'groupByPipe' AS grouped, '{"expr":1}' AS alone''')
def q_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = of_customers(spark, sf_dir)
    plan = db.execute("EXPLAIN SELECT $.name FROM c WHERE $._id = 5 LIMIT 3")
    group = db.execute("EXPLAIN SELECT {k: @key, n: COUNT(*)} FROM c GROUP BY $.m")
    return facts(
        spark, mode=plan["index"]["mode"], cost=plan["index"]["cost"], filter=plan["filters"][0], pipe=plan["pipe"], lim=plan["limit"], grouped=group["pipe"],
        alone=db.execute("EXPLAIN SELECT 1")["select"]["expr"],
    )


@scenario("SELECT 0 AS n, true AS refused, 1 AS into_cost, true AS locked FROM region LIMIT 1")
def q_missing_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection that is not there is empty; a condition that is no predicate, and INCLUDE with GROUP BY, are refused."""
    db = of_customers(spark, sf_dir)
    wrong = refused(BindFault, lambda: db.execute("SELECT $ FROM c WHERE $.b + 1")) and refused(BindFault, lambda: db.execute("SELECT {k: @key} FROM c INCLUDE $.x GROUP BY $.m"))
    locked = db.query("c").for_update().where("$._id = 1").count() == 1
    return facts(spark, n=db.execute("SELECT $ FROM nowhere").count(), refused=wrong, into_cost=db.execute("SELECT {_id: $._id} INTO d FROM c WHERE $._id = 2"), locked=locked)


@scenario("SELECT count(*) AS n, true AS gone FROM customer")
def q_memory_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, other = Database.memory(spark), Database.memory(spark)
    db.insert("c", table(spark, sf_dir, "customer").selectExpr("c_custkey AS _id"))
    return facts(spark, n=db.query("c").count(), gone=not other.exists("c"))


@scenario("SELECT count(*) AS n, 0 AS wrong, 4 AS parts FROM customer")
def q_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = of_customers(spark, sf_dir)
    parts = db.execute("SELECT $ FROM $dump").count()
    path = f"{scratch_folder(spark)}/folioq-db-{uuid.uuid4().hex}"
    db.backup(path)
    copy = Database(spark, path)
    return facts(spark, n=copy.query("c").count(), wrong=len(copy.verify()) + len(db.verify()), parts=parts)


# References in arrays, and indexes of vectors


@scenario("""SELECT o.o_orderkey AS k, c.c_name AS name, s.s_name AS other, true AS gone FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
 JOIN supplier s ON s.s_suppkey = o.o_orderkey % (SELECT count(*) FROM supplier)""")
def q_include_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of references to two collections, with one that dangles."""
    n = table(spark, sf_dir, "supplier").count()
    o, ref = table(spark, sf_dir, "orders"), lambda k, t: F.struct(k.cast("long").alias("$id"), F.lit(t).alias("$ref"))
    refs = o.select(F.col("o_orderkey").alias("_id"), F.array(ref(F.col("o_custkey"), "customer"), ref(F.col("o_orderkey") % n, "supplier"), ref(F.lit(-1), "customer")).alias("r"))
    db = Database(spark).attach("o", refs).attach("customer", table(spark, sf_dir, "customer"), "c_custkey").attach("supplier", table(spark, sf_dir, "supplier"), "s_suppkey")
    return db.execute("SELECT $._id AS k, $.r[0].c_name AS name, $.r[1].s_name AS other, $.r[2].['$missing'] AS gone FROM o INCLUDE $.r")


@scenario("SELECT vec_id FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda x: 0.1)), vec_id LIMIT 15")
def q_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over a nested field; vectors of other lengths are left out."""
    db = fresh(spark)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.struct(F.col("embedding").cast("array<double>").alias("v")).alias("in"))
    short = e.limit(3).select((-F.col("_id") - 1).alias("_id"), F.struct(F.slice("in.v", 1, 5).alias("v")).alias("in"))
    db.insert("e", e.unionByName(short))
    db.collection("e").ensure_vector_index("near", "$.in.v", 64, "euclidean")
    return db.collection("e").top_k_near("near", [0.1] * 64, 15).select(F.col("_id").alias("vec_id"))
