"""Databases: attached tables, durable collections, statements and transactions."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .collection import Collection
from .errors import BindFault, ConflictFault, FolioError
from .functions import values as V
from .functions.library import VOLATILE
from .operators import vector
from .plans import statements as st
from .plans.ast import Call, Doc, Node, Param, root_fields
from .plans.compiler import Scope, compile_node, dialect, row_of
from .plans.parser import is_sequence, parse
from .plans.query import Query
from .sources.documents import frame_of, stored_type, union
from .sources.files import FileRoot, read_file, write_file
from .sources.storage import Storage, Stored, Version
from .streaming.feed import Feed

PRAGMAS = {"USER_VERSION": 0, "COLLATION": "/Ordinal", "TIMEOUT": 60, "LIMIT_SIZE": 2**63 - 1, "UTC_DATE": True, "CHECKPOINT": 1000}


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. A local one only on a local master: on a cluster each executor would keep its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise FolioError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.gettempdir()).rstrip("/")


@dataclass(frozen=True)
class Table:
    """A source of a query."""

    database: Database
    name: str
    order: tuple[str, ...]
    make: Callable[[], DataFrame]
    indexes: dict[str, dict[str, Any]] = field(default_factory=dict)

    def frame(self) -> DataFrame:
        df = self.make()
        return collated(df, self.database.collation) if self.database.collation else df

    def lookup(self, name: str) -> DataFrame | None:
        return self.database.find(name)


def collation_of(text: str) -> str | None:
    """Spark's collation for `locale/options`; None for the ordinal one. Options are Ordinal, OrdinalIgnoreCase, IgnoreCase and IgnoreNonSpace."""
    locale, _, rest = text.partition("/")
    options = {o.strip().lower() for o in rest.split(",") if o.strip()} - {"none"}
    if unknown := options - {"ordinal", "ordinalignorecase", "ignorecase", "ignorenonspace"}:
        raise BindFault(f"no collation option {sorted(unknown)}")
    if "ordinalignorecase" in options:
        return "UTF8_LCASE"
    if "ordinal" in options or not locale and not options:
        return None
    base = locale.split("-")[0].lower() if locale and locale.lower() != "invariant" else "UNICODE"
    return base + ("_CI" if "ignorecase" in options else "") + ("_AI" if "ignorenonspace" in options else "")


def collated(df: DataFrame, name: str) -> DataFrame:
    """The table with its text columns under a collation: comparisons, groups and orders follow it."""
    cols = [F.collate(F.col(f"`{f.name}`"), name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*cols)


class Database:
    """Attached tables are read only; collections under `path` can be written.

    Each write reads a version and commits the next one by an atomic rename; whoever comes second gets a ConflictFault and can try again.
    Readers keep the version they began with. An insert adds segments; updates and deletes rewrite only segments that hold a matching row.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, files: FileRoot = FileRoot(), change_log: str | None = None, collation: str = "/Ordinal") -> None:
        self.spark, self.files = spark, files
        self.collation = collation_of(collation)
        self.storage = Storage(spark, path) if path else None
        self.attached: dict[str, tuple[str, DataFrame, tuple[str, ...]]] = {}
        self.staged: Version | None = None
        self.feed = Feed(spark, change_log)
        self._collation = collation
        self._making: list[str] = []

    @staticmethod
    def memory(spark: SparkSession) -> Database:
        """A database that nobody else knows of, in the cluster's scratch folder."""
        return Database(spark, f"{scratch_folder(spark)}/folioq-memory-{uuid.uuid4().hex}")

    @property
    def pragmas(self) -> dict[str, Any]:
        """Settings: those that were stored, over the ones that a database begins with."""
        return PRAGMAS | self.version.pragmas | {"COLLATION": self._collation}

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    # Sources

    def attach(self, name: str, df: DataFrame, key: str | list[str] | None = None) -> Database:
        """A table as a collection. One key column is its _id too; without a key, order goes by all columns that can be ordered."""
        order = (key,) if isinstance(key, str) else tuple(key or ())
        if len(order) == 1 and "_id" not in df.columns:
            df = df.withColumn("_id", F.col(order[0]))
            order = ("_id",)
        if not order:
            order = ("_id",) if "_id" in df.columns else tuple(f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType))
        self.attached[name.lower()] = (name, df, order)
        return self

    @property
    def version(self) -> Version:
        if self.staged is not None:
            return self.staged
        return self.storage.latest() if self.storage else Version()

    def find(self, name: str) -> DataFrame | None:
        """The collection's documents, or None if there is no such collection."""
        low = name.lower()
        if low in self.attached:
            return self.attached[low][1]
        got = self._stored(self.version, name)
        return None if got is None else self._read(got[1])

    def _stored(self, version: Version, name: str) -> tuple[str, Stored] | None:
        return next(((k, c) for k, c in version.collections.items() if k.lower() == name.lower()), None)

    def _read(self, c: Stored) -> DataFrame:
        if not c.segments:
            return self.spark.createDataFrame([], "_id string")
        return union(list(self._by_schema(c)))

    def _by_schema(self, c: Stored, segments: list[str] | None = None) -> Iterator[DataFrame]:
        """The segments, those of one schema as one scan: a plan has as many branches as there are schemas, not as there are segments."""
        paths: dict[str, list[str]] = {}
        for s in c.segments if segments is None else segments:
            paths.setdefault(c.schemas.get(s, s), []).append(f"{self.storage.files.root}/{s}")
        for schema, some in paths.items():
            reader = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))) if schema.startswith("{") else self.spark.read
            yield reader.parquet(*some)

    def names(self) -> list[str]:
        return sorted([n for n, _, _ in self.attached.values()] + list(self.version.collections))

    def exists(self, name: str) -> bool:
        return name.lower() in self.attached or self._stored(self.version, name) is not None

    def query(self, name: str) -> Query:
        return Query(self.spark, self._table(st.Target(name)), into_hook=self._into)

    def _table(self, target: st.Target) -> Table:
        low = target.name.lower()
        if low.startswith("$"):
            return Table(self, target.name, (), lambda: self._virtual(low, target.args))
        if low in self.attached:
            name, df, order = self.attached[low]
            return Table(self, name, order, lambda: df)
        version = self.version
        found = self._stored(version, target.name)
        empty = lambda: self.spark.createDataFrame([], "_id string")
        return Table(self, target.name, ("_id",), (lambda: self._read(found[1])) if found else empty, found[1].indexes if found else {})

    def _virtual(self, name: str, args: list[Any]) -> DataFrame:
        """$file, $query, and facts about the database."""
        version = self.version
        if name == "$file":
            return read_file(self.spark, args[0] if isinstance(args[0], dict) else {"filename": args[0]}, self.files)
        if name == "$query":
            inner = st.parse_statement(args[0])
            if not isinstance(inner, st.Select) or inner.into:
                raise BindFault("$query takes a SELECT without INTO")
            return self._select(inner, {}).frame()
        if name == "$database":
            rows = [{"version": version.number, "collections": len(self.names()), **{k.lower(): str(v) for k, v in self.pragmas.items()}}]
            return frame_of(self.spark, rows)
        if name == "$cols":
            return frame_of(self.spark, [{"name": n, "type": "attached" if n.lower() in self.attached else "user"} for n in self.names()])
        if name == "$indexes":
            rows = [{"collection": k, "name": i, "expr": x["expr"], "unique": x["unique"]} for k, c in version.collections.items() for i, x in c.indexes.items()]
            return self.spark.createDataFrame([tuple(r.values()) for r in rows], "collection string, name string, expr string, unique boolean")
        if name == "$sequences":
            rows = [(k, c.last_id) for k, c in version.collections.items()]
            return self.spark.createDataFrame(rows, "collection string, value long")
        if name == "$transactions":
            return self.spark.createDataFrame([(version.number, "write")] if self.staged is not None else [], "version int, mode string")
        if name == "$snapshots":
            return self.spark.createDataFrame([(n, version.number, "read") for n in self.names()], "collection string, version int, mode string")
        if name == "$open_cursors":
            return self.spark.createDataFrame([], "collection string, elapsed long")
        if name in ("$dump", "$page_list"):
            rows = [(k, s) for k, c in version.collections.items() for s in c.segments]
            return self.spark.createDataFrame(rows, "collection string, segment string")
        raise BindFault(f"no system collection {name}")

    # Statements

    def execute(self, text: str, *args: Any) -> Any:
        """A DataFrame for SELECT, a document for EXPLAIN, a number or boolean for the rest. Arguments: by place, or one dict by name."""
        named = dict(args[0]) if len(args) == 1 and isinstance(args[0], dict) else {str(i): a for i, a in enumerate(args)}
        s = st.parse_statement(text)
        if isinstance(s, st.Select):
            query = self._select(s, named)
            if s.explain:
                return query.explain()
            if not s.into:
                return query.frame()
            if s.into.name.lower() == "$file":
                options = s.into.args[0] if isinstance(s.into.args[0], dict) else {"filename": s.into.args[0]}
                return write_file(query.frame(), options, self.files)
            return self._into(query.frame(), s.into.name, s.into.auto_id)
        if isinstance(s, st.Insert):
            return self.insert(s.target.name, s.docs, s.target.auto_id or "OBJECTID")
        if isinstance(s, st.Update):
            return self.update_many(s.name, s.changes, s.where, named)
        if isinstance(s, st.Delete):
            return self.delete_many(s.name, s.where, named)
        if isinstance(s, st.CreateIndex):
            return self.ensure_index(s.collection, s.index, s.expr, s.unique)
        if isinstance(s, st.Drop):
            return self.drop_index(s.collection, s.index) if s.index else self.drop(s.collection)
        if isinstance(s, st.Rename):
            return self.rename(s.old, s.new)
        if isinstance(s, st.Pragma):
            return self.pragma(s.name, s.value) if s.write else self.pragmas[self._pragma(s.name)]
        return {"BEGIN": self.begin, "COMMIT": self.commit, "ROLLBACK": self.rollback, "CHECKPOINT": self.checkpoint, "REBUILD": self.rebuild}[s.word](*([s.options] if getattr(s, "options", None) else []))

    def _select(self, s: st.Select, params: dict[str, Any]) -> Query:
        q = Query(self.spark, self._table(s.source) if s.source else None, projection=s.projection, params=params, into_hook=self._into)
        if s.group is not None and s.includes:
            raise BindFault("INCLUDE does not go with GROUP BY")
        if s.having is not None and s.group is None:
            raise BindFault("HAVING needs GROUP BY")
        for n in s.includes:
            q = q.include(str(n))
        return replace(
            q, wheres=() if s.where is None else (s.where,), group=s.group, havings=() if s.having is None else (s.having,),
            orders=tuple(s.orders), count_limit=s.limit, offset=s.offset,
        )

    # Transactions

    @contextmanager
    def transaction(self):
        """All writes inside are committed together, or none. Inside another transaction a fault undoes what was done in here, and no more."""
        if self.staged is not None:
            before, told, making = self.staged.copy(), len(self.feed.waiting), len(self._making)
            try:
                yield self
            except BaseException:
                self.staged = before
                del self.feed.waiting[told:]
                self._give_up(self._making[making:])
                raise
            return
        self.begin()
        try:
            yield self
            self.commit()
        except BaseException:
            self.rollback()
            raise

    def begin(self) -> bool:
        if not self.storage:
            raise FolioError("a database without a path cannot be written")
        if self.staged is not None:
            return False
        self.staged = self.storage.latest()
        self.feed.publish(self.storage.files, self.staged.changes)  # if whoever committed them could not
        return True

    def commit(self) -> bool:
        if self.staged is None:
            return False
        staged, self.staged = self.staged, None
        try:
            limit = (PRAGMAS | staged.pragmas)["LIMIT_SIZE"]
            if self._making and limit < PRAGMAS["LIMIT_SIZE"] and (size := self.storage.files.size()) > limit:
                raise FolioError(f"the database has {size} bytes, and its limit is {limit}")
            staged.changes = self.feed.written(self.storage.files)
            self.storage.commit(staged)
        except BaseException:
            self.feed.forget()
            self._give_up(self._making)
            raise
        self.storage.made(self._making)
        self._making = []
        told = self.feed.take()
        self.feed.publish(self.storage.files, staged.changes)
        self.feed.tell(told)
        return True

    def _give_up(self, segments: list[str]) -> None:
        """Segments that will not be committed go at once."""
        gone = list(segments)
        for s in gone:
            self.storage.files.delete(s)
        self.storage.made(gone)
        self._making = [s for s in self._making if s not in gone]

    def rollback(self) -> bool:
        if self.staged is None:
            return False
        self.staged = None
        self.feed.forget()
        self._give_up(self._making)
        return True

    def checkpoint(self) -> int:
        """Delete what the latest version does not name and no writer is making; segments are complete when they are committed, so there is nothing to move."""
        self._no_transaction()
        return self.storage.vacuum() if self.storage else 0

    def rebuild(self, options: dict[str, Any] | None = None) -> int:
        """Each collection as one segment; the number of segments saved. Option collation: by which text is compared from now on in this database
        object; unique keys are checked under it first. A password has no use here and is refused."""
        self._no_transaction()
        options = {k.lower(): v for k, v in (options or {}).items()}
        if unknown := set(options) - {"collation"}:
            raise BindFault(f"no option {sorted(unknown)}")
        saved = 0
        with self.transaction():
            if "collation" in options:
                before = self.collation, self._collation
                self.collation, self._collation = collation_of(options["collation"]), options["collation"]
                try:
                    for c in self.staged.collections.values():
                        if c.segments:
                            self._check_keys(c, self._read(c), None)
                except BaseException:
                    self.collation, self._collation = before
                    raise
            for name, c in self.staged.collections.items():
                if len(c.segments) > 1:
                    saved += len(c.segments) - 1
                    self._replace(c, [self._write(name, c, self._read(c))])
        return saved

    def _replace(self, c: Stored, segments: list[str]) -> None:
        c.segments = segments
        c.schemas = {s: x for s, x in c.schemas.items() if s in segments}

    def _no_transaction(self) -> None:
        if self.staged is not None:
            raise FolioError("not inside a transaction")

    def _pragma(self, name: str) -> str:
        if name.upper() not in PRAGMAS:
            raise BindFault(f"no setting {name}")
        return name.upper()

    def pragma(self, name: str, value: Any) -> bool:
        name = self._pragma(name)
        self._no_transaction()
        if name == "COLLATION":
            raise BindFault("the collation is fixed when a database is made")
        changed = self.pragmas[name] != value
        if changed and not self.storage:
            raise FolioError("a database without a path cannot be written")
        if changed:
            with self.transaction():
                self.staged.pragmas[name] = value
        return changed

    # Writes

    def _open(self, name: str) -> Stored:
        if name.lower() in self.attached:
            raise BindFault(f"{name} is attached: it can only be read")
        found = self._stored(self.staged, name)
        return found[1] if found else self.staged.collections.setdefault(name, Stored())

    def _write(self, name: str, c: Stored, df: DataFrame) -> str:
        """A new segment; its schema is kept with the collection, so that reading needs no look at files."""
        segment = self.storage.new_segment(name)
        self._making.append(segment)
        out = df.select(*[F.col(f"`{f.name}`").cast(stored_type(f.dataType)).alias(f.name) for f in df.schema.fields])
        out.write.parquet(f"{self.storage.files.root}/{segment}")
        c.schemas[segment] = json.dumps(_nullable(out.schema).jsonValue(), separators=(",", ":"))
        return segment

    def _into(self, df: DataFrame, name: str, auto_id: str | None) -> int:
        return self.insert(name, df, auto_id or "OBJECTID")

    def insert(self, name: str, docs: DataFrame | list[dict[str, Any]], auto_id: str = "OBJECTID") -> int:
        """The number of documents inserted: all, or none if an _id or a unique key is taken."""
        df = docs if isinstance(docs, DataFrame) else frame_of(self.spark, docs)
        with self.transaction():
            c = self._open(name)
            held = self._read(c) if c.segments else None
            segment = self._write(name, c, self._with_ids(df, c, auto_id))
            new = self.spark.read.parquet(f"{self.storage.files.root}/{segment}")
            n = new.count()
            if not n:
                c.schemas.pop(segment)
                return 0
            self._check_keys(c, new, held)
            c.segments.append(segment)
            if auto_id in ("INT", "LONG", "INT32", "INT64") or isinstance(new.schema["_id"].dataType, (T.IntegerType, T.LongType)):
                top = new.agg(F.max("_id")).first()[0]
                c.last_id = max(c.last_id, top) if isinstance(top, int) else c.last_id
            self.feed.note(name, "Insert", new.select("_id"))
            return n

    def _with_ids(self, df: DataFrame, c: Stored, auto_id: str) -> DataFrame:
        kinds = {"INT": "int", "LONG": "long", "INT32": "int", "INT64": "long"}
        has = next((f for f in df.schema.fields if f.name.lower() == "_id"), None)
        if auto_id in kinds:
            rows = df if has else df.withColumn("_id", F.lit(None).cast(kinds[auto_id]))
            missing = rows.where("_id IS NULL")
            given = rows.where("_id IS NOT NULL") if has else None
            numbered = self._numbered(missing, c.last_id + 1).withColumn("_id", F.col("_id").cast(kinds[auto_id]))
            return numbered if given is None else union([given, numbered])
        fresh = F.uuid() if auto_id == "GUID" else F.substring(F.sha2(F.uuid(), 256), 1, 24)
        if not has:
            return df.select(fresh.alias("_id"), "*")
        kind = has.dataType
        return df.withColumn("_id", F.coalesce("_id", fresh)) if isinstance(kind, (T.StringType, T.NullType)) else df

    def _numbered(self, df: DataFrame, start: int) -> DataFrame:
        """`df` with _id from `start` on, in no order: each partition is numbered by itself and shifted by those before it. The partitions are
        written first, so that a lost executor cannot change them between counting and numbering."""
        path = f"{self.storage.files.root}/_numbering/{uuid.uuid4().hex}"
        df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
        kept = self.spark.read.parquet(path)
        counts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
        local = F.row_number().over(W.partitionBy("__part").orderBy("__at")) - 1
        out = kept.withColumn("__row", local).join(before, "__part")
        return out.withColumn("_id", F.col("__row") + F.col("__before") + start).drop("__part", "__at", "__row", "__before")

    def _check_keys(self, c: Stored, new: DataFrame, held: DataFrame | None) -> None:
        uniques = {"_id": "$._id"} | {i: x["expr"] for i, x in c.indexes.items() if x["unique"]}
        for index, text in uniques.items():
            expr = parse(text)
            keys = lambda df: self._collated(df).select(compile_node(expr, Scope(row_of(self._collated(df)))).col.alias("k"))
            fresh = keys(new)
            again = fresh.groupBy("k").count().where("count > 1")
            if not again.isEmpty():
                raise ConflictFault(f"duplicate key in {index}")
            if held is not None and any(f.name.lower() == "_id" for f in held.schema.fields):
                if not keys(held).join(fresh, "k", "left_semi").isEmpty():
                    raise ConflictFault(f"duplicate key in {index}")

    def _collated(self, df: DataFrame) -> DataFrame:
        return collated(df, self.collation) if self.collation else df

    def _rewrite(self, name: str, c: Stored, touched: Callable[[DataFrame], Column], new: Callable[[DataFrame, Column], DataFrame]) -> tuple[int, DataFrame | None]:
        """Replace segments that hold a touched row by what `new` makes of them; the number of rows touched, and their ids.

        One count for each schema finds the segments; those of one schema that hold such rows become one new segment.
        """
        hit: dict[str, int] = {}
        for df in self._by_schema(c):
            found = df.where(F.coalesce(touched(df), F.lit(False))).groupBy(_segment().alias("s")).count()
            hit |= {r.s: r["count"] for r in found.collect()}  # a row for each segment at most
        some = [s for s in c.segments if s in hit]
        kept, ids = [s for s in c.segments if s not in hit], None
        for df in self._by_schema(c, some) if some else ():
            test = F.coalesce(touched(df), F.lit(False))
            got = df.where(test).select("_id")
            ids = got if ids is None else union([ids, got])
            kept.append(self._write(name, c, new(df, test)))
        self._replace(c, kept)
        return sum(hit.values()), ids

    def _where(self, n: Node | str | None, params: dict[str, Any]) -> Callable[[DataFrame], Column]:
        node = parse(n) if isinstance(n, str) else n
        return lambda df: F.lit(True) if node is None else compile_node(node, Scope(row_of(df), params)).col

    def update_many(self, name: str, changes: Doc | str, where: Node | str | None = None, params: dict[str, Any] | None = None) -> int:
        """Merge the changes into matching documents: what they name is replaced, the rest stays."""
        doc, params = parse(changes) if isinstance(changes, str) else changes, params or {}
        if any(k.lower() == "_id" for k, _ in doc.items):
            raise BindFault("_id cannot be changed")

        def new(df: DataFrame, test: Column) -> DataFrame:
            v = compile_node(doc, Scope(row_of(df), params))
            out, low = df, {f.name.lower(): f for f in df.schema.fields}
            made = {}
            for f in v.type.fields:
                own = V.field(v, f.name)
                old = low.get(f.name.lower())
                t = V.common([own.type, old.dataType]) if old else own.type
                before = V.fitted(V.Val(F.col(f"`{old.name}`"), old.dataType), t) if old else F.lit(None)
                made[old.name if old else f.name] = F.when(test, V.fitted(own, t)).otherwise(before)
            return out.withColumns(made)

        with self.transaction(), dialect(self.spark):
            c = self._open(name)
            n, ids = self._rewrite(name, c, self._where(where, params), new)
            if n:
                if any(x["unique"] for x in c.indexes.values()):
                    self._check_keys(c, self._read(c), None)
                self.feed.note(name, "Update", ids)
            return n

    def delete_many(self, name: str, where: Node | str | None = None, params: dict[str, Any] | None = None) -> int:
        with self.transaction(), dialect(self.spark):
            n, ids = self._rewrite(name, self._open(name), self._where(where, params or {}), lambda df, test: df.where(~test))
            if n:
                self.feed.note(name, "DeleteAll" if where is None else "Delete", ids)
            return n

    def update(self, name: str, docs: DataFrame | list[dict[str, Any]]) -> int:
        """Replace whole documents by _id; ids that are not there are skipped. Of several documents of one _id the last counts; all are
        part of the number told. Only segments that hold such an _id are written again."""
        return self._update(name, self._last(docs))

    def _last(self, docs: DataFrame | list[dict[str, Any]]) -> DataFrame:
        """The last document of each _id, and how many there are of it (`__n`); documents without an _id as they are. Written, so that places do not change."""
        df = docs if isinstance(docs, DataFrame) else frame_of(self.spark, docs)
        if not any(f.name.lower() == "_id" for f in df.schema.fields):
            return df.withColumn("__n", F.lit(1).cast("long"))
        row = F.struct(*[F.col(f"`{f.name}`") for f in df.schema.fields])
        placed = df.select(F.col("_id").alias("__id"), row.alias("__row"), F.monotonically_increasing_id().alias("__at"))
        one = placed.where("__id IS NOT NULL").groupBy("__id").agg(F.max_by("__row", "__at").alias("__row"), F.count(F.lit(1)).alias("__n"))
        none = placed.where("__id IS NULL").select("__id", "__row", F.lit(1).cast("long").alias("__n"))
        return one.unionByName(none).select("__row.*", "__n")

    def _update(self, name: str, df: DataFrame) -> int:
        with self.transaction():
            c = self._open(name)
            if not c.segments or "_id" not in df.columns:
                return 0
            ids = df.select("_id")
            told = df.join(self._read(c).select("_id"), "_id", "left_semi")
            n = told.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
            if n:
                hits, some = told.drop("__n"), set()
                for part in self._by_schema(c):
                    here = part.select("_id", _segment().alias("s")).join(ids, "_id", "left_semi").select("s").distinct()
                    some |= {r.s for r in here.collect()}  # a row for each segment at most
                kept = [s for s in c.segments if s not in some]
                rest = union([part.join(ids, "_id", "left_anti") for part in self._by_schema(c, [s for s in c.segments if s in some])])
                kept.append(self._write(name, c, union([rest, hits])))
                self._replace(c, kept)
                if any(x["unique"] for x in c.indexes.values()):
                    self._check_keys(c, self._read(c), None)
                self.feed.note(name, "Update", hits.select("_id"))
            return n

    def upsert(self, name: str, docs: DataFrame | list[dict[str, Any]]) -> tuple[int, int]:
        """(inserted, updated). Of several documents of one new _id the first is an insert and each further one an update of it."""
        df = self._last(docs)
        with self.transaction():
            updated = self._update(name, df)
            c = self._open(name)
            fresh = df.join(self._read(c).select("_id"), "_id", "left_anti") if c.segments and "_id" in df.columns else df
            again = fresh.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]
            return self.insert(name, fresh.drop("__n")), updated + again

    def delete(self, name: str, ids: list[Any]) -> int:
        return self.delete_many(name, parse("$._id IN @ids"), {"ids": list(ids)})

    # Definitions

    def ensure_index(self, collection: str, index: str, expr: Node | str, unique: bool = False) -> bool:
        """Whether it is new. Uniqueness is checked now and at every write; access needs no index, as scans skip by statistics."""
        n = parse(expr) if isinstance(expr, str) else expr
        if not root_fields(n) or any(isinstance(x, Param) or isinstance(x, Call) and x.name in VOLATILE for x in n.walk()):
            raise BindFault(f"cannot be indexed: {n}")
        if unique and is_sequence(n):
            raise BindFault("a unique index needs one value a document")
        with self.transaction():
            c = self._open(collection)
            old = c.indexes.get(index)
            if old:
                if old != {"expr": str(n), "unique": unique}:
                    raise BindFault(f"index {index} is there with another expression")
                return False
            c.indexes[index] = {"expr": str(n), "unique": unique}
            if unique and c.segments:
                self._check_keys(c, self._read(c), None)
            return True

    def drop_index(self, collection: str, index: str) -> bool:
        with self.transaction():
            return self._open(collection).indexes.pop(index, None) is not None

    def drop(self, name: str) -> bool:
        self._no_transaction()
        with self.transaction():
            found = self._stored(self.staged, name)
            if not found:
                return False
            del self.staged.collections[found[0]]
            self.feed.note(found[0], "Drop", None)
            return True

    def rename(self, old: str, new: str) -> bool:
        self._no_transaction()
        with self.transaction():
            found = self._stored(self.staged, old)
            if not found:
                return False
            if self._stored(self.staged, new):
                raise ConflictFault(f"{new} exists")
            self.staged.collections[new] = self.staged.collections.pop(found[0])
            self.feed.note(new, "Rename", None)
            return True

    # Vectors: a field's name or any expression that gives a vector

    def _vectors(self, name: str, field: str, dims: int | None = None) -> tuple[DataFrame, str]:
        df = self.query(name).frame()
        if not field.startswith("$") and "(" not in field:
            field_name = next((f.name for f in df.schema.fields if f.name.lower() == field.lower()), None)
            if field_name and dims is None:
                return df, field_name
            field = f"$.['{field}']"
        with dialect(self.spark):
            v = compile_node(parse(field), Scope(row_of(df)))
        if v.kind != "array":
            raise BindFault(f"{field} gives no vector")
        df = df.withColumn("__vector", v.col)
        return (df if dims is None else df.where(F.size("__vector") == dims)), "__vector"

    def top_k_near(self, name: str, field: str, target: list[float], k: int, metric: str = "cosine", dims: int | None = None) -> DataFrame:
        df, column = self._vectors(name, field, dims)
        return vector.top_k_near(df, column, target, k, metric, self._table(st.Target(name)).order[0]).drop("__vector")

    def find_near(self, name: str, field: str, target: list[float], most: float, metric: str = "cosine", dims: int | None = None) -> DataFrame:
        df, column = self._vectors(name, field, dims)
        return vector.find_near(df, column, target, most, metric).drop("__vector")

    def ensure_vector_index(self, collection: str, index: str, field: str, dims: int, metric: str = "cosine") -> bool:
        """Facts for searches by name, over a field or an expression: vectors of other lengths are left out. Searches are exact."""
        if metric not in vector.METRICS:
            raise BindFault(f"no metric {metric!r}")
        with self.transaction():
            c = self._open(collection)
            new = {"expr": field, "unique": False, "dims": dims, "metric": metric}
            if index in c.indexes and c.indexes[index] != new:
                raise BindFault(f"index {index} is there with other facts")
            added = index not in c.indexes
            c.indexes[index] = new
            return added

    def search_index(self, collection: str, index: str, target: list[float], k: int | None = None, most: float | None = None) -> DataFrame:
        found = self._stored(self.version, collection)
        facts = found[1].indexes.get(index) if found else None
        if not facts or "dims" not in facts:
            raise BindFault(f"no vector index {index}")
        if len(target) != facts["dims"]:
            raise BindFault(f"the index has {facts['dims']} dimensions")
        if k is not None:
            return self.top_k_near(collection, facts["expr"], target, k, facts["metric"], facts["dims"])
        return self.find_near(collection, facts["expr"], target, most, facts["metric"], facts["dims"])

    # Checks

    def verify(self) -> list[str]:
        """What is wrong: keys that repeat, and segments that cannot be read."""
        wrong = []
        for name, c in self.version.collections.items():
            try:
                self._check_keys(c, self._read(c), None)
            except ConflictFault as e:
                wrong.append(f"{name}: {e}")
            except Exception as e:  # any fault of a segment is a finding
                wrong.append(f"{name}: {type(e).__name__}")
        return wrong

    def backup(self, path: str) -> int:
        """All collections of the current version into another folder; the number of collections."""
        to = Database(self.spark, path)
        version = self.version
        for name, c in version.collections.items():
            with to.transaction():
                to._open(name).indexes = c.indexes
                to._open(name).last_id = c.last_id
                if c.segments:
                    to._open(name).segments = [to._write(name, to._open(name), self._read(c))]
        return len(version.collections)


def _segment() -> Column:
    """The segment that a row was read from."""
    return F.array_join(F.slice(F.split(F.regexp_replace(F.input_file_name(), "/[^/]*$", ""), "/"), -2, 2), "/")


def _nullable(t: T.DataType) -> T.DataType:
    """The type with every part nullable, as Parquet gives it back."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType))
    return T.MapType(_nullable(t.keyType), _nullable(t.valueType)) if isinstance(t, T.MapType) else t
