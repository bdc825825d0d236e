"""Reference expansion: { $id, $ref } becomes the document that it names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindFault
from ..functions.values import Val, common, field, fitted

#: References are counted by this many buckets of their ids' hashes; a bucket of more than CROWD of them is dealt over several partitions of the join.
BUCKETS, CROWD = 1 << 16, 1 << 18
#: Types that a row can be dealt by.
PLAIN = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def include(df: DataFrame, name: str, lookup: Callable[[str], DataFrame | None], refs: list[str] | None = None, key: str = "_id") -> DataFrame:
    """`df` with the references in column `name` (one, or an array of them) expanded.

    Found: $id and the target's fields but its _id. Not found: $id, $ref and $missing. A reference to a collection that does not exist stays as it is. Each
    collection is a left join by equality, so it is broadcast or shuffled as its size asks. `refs` names the collections; without it, the distinct $ref values
    are looked up first. Ids that many references name, found or not, do not meet in one task: see `_crowds`.
    """
    at = next((f for f in df.schema.fields if f.name.lower() == name.lower()), None)
    if at is None:
        return df
    if isinstance(at.dataType, T.ArrayType) and isinstance(at.dataType.elementType, T.StructType):
        return _in_array(df, at.name, lookup, refs, key)
    if not isinstance(at.dataType, T.StructType):
        return df
    ref = Val(F.col(f"`{at.name}`"), at.dataType)
    if field(ref, "$id").kind == "null" or field(ref, "$ref").kind == "null":
        return df
    many = True
    if refs is None:
        names = df.select(field(ref, "$ref").col.alias("r")).where("r IS NOT NULL").groupBy("r").count()
        counts = {r[0]: r[1] for r in names.toLocalIterator() if lookup(r[0]) is not None}  # all names are asked for, only real ones are held
        refs, many = list(counts), sum(counts.values()) > CROWD
    targets = [(k, target, found) for k, target in enumerate(refs) if (found := lookup(target)) is not None]
    if not targets:
        return df
    # what a row is dealt by: its key (and place), or all of its plain fields
    own = [c for c in (key, "__pos") if c in df.columns] if key in df.columns else [f.name for f in df.schema.fields if isinstance(f.dataType, PLAIN)]
    deal = F.xxhash64(*[F.col(f"`{c}`") for c in own]) if own else F.lit(0).cast("long")
    crowds = _crowds(df, ref, targets) if many else {}
    out, made = df, []
    for k, target, found in targets:
        t = found.schema
        got = found.select(F.col("_id").alias(f"__id{k}"), F.struct("*").alias(f"__doc{k}"))
        here, want, hashed = _wanted(ref, target, t)
        # rows that want nothing here would meet in one partition: a second key spreads them
        side = out.withColumns({f"__want{k}": want, f"__spread{k}": F.when(want.isNotNull(), hashed).otherwise(deal)})
        got = got.withColumn(f"__hash{k}", F.xxhash64(f"__id{k}"))
        on = (F.col(f"__want{k}") == F.col(f"__id{k}")) & (F.col(f"__spread{k}") == F.col(f"__hash{k}"))
        if crowd := crowds.get(target.lower()):
            # a crowd's rows are dealt over its parts, and each part has the documents
            dealt = F.broadcast(df.sparkSession.createDataFrame(crowd, "__bucket int, __parts int"))
            some = F.coalesce("__parts", F.lit(1))
            side = side.join(dealt, _bucket(F.col(f"__spread{k}")) == F.col("__bucket"), "left").withColumn(f"__part{k}", F.pmod(deal, some).cast("int"))
            got = got.join(dealt, _bucket(F.col(f"__hash{k}")) == F.col("__bucket"), "left").withColumn(f"__copy{k}", F.explode(F.sequence(F.lit(0), some - 1)))
            side, got = side.drop("__bucket", "__parts"), got.drop("__bucket", "__parts")
            on &= F.col(f"__part{k}") == F.col(f"__copy{k}")
        out = side.join(got, on, "left")
        doc, hit = Val(F.col(f"__doc{k}"), t), F.col(f"__id{k}").isNotNull()
        parts = [field(ref, "$id").col.alias("$id"), F.when(~hit, field(ref, "$ref").col).alias("$ref"), F.when(~hit, F.lit(True)).alias("$missing")]
        parts += [field(doc, f.name).col.alias(f.name) for f in t.fields if f.name.lower() != "_id"]
        kind = T.StructType(
            [T.StructField("$id", field(ref, "$id").type), T.StructField("$ref", T.StringType()), T.StructField("$missing", T.BooleanType())]
            + [f for f in t.fields if f.name.lower() != "_id"]
        )
        made.append((here, Val(F.struct(*parts), kind)))
    whole = common([v.type for _, v in made] + [at.dataType])
    value: Column = fitted(ref, whole)
    for here, v in made:
        value = F.when(here, fitted(v, whole)).otherwise(value)
    value = F.when(ref.col.isNotNull(), value)
    return out.select(*[value.alias(at.name) if c == at.name else F.col(f"`{c}`") for c in df.columns])


def _wanted(ref: Val, target: str, t: T.StructType) -> tuple[Column, Column, Column]:
    """Whether a reference names the collection `target`, the id that it wants there, and that id's hash as the collection's own ids have it."""
    here = F.lower(field(ref, "$ref").col) == target.lower()
    want = F.when(here, field(ref, "$id").col)
    return here, want, F.xxhash64(want.cast(t["_id"].dataType))


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def _crowds(df: DataFrame, ref: Val, targets: list[tuple[int, str, DataFrame]]) -> dict[str, list[tuple[int, int]]]:
    """By collection, the buckets of ids that more than CROWD references want, and into how many parts each is dealt.

    One id that many rows name would otherwise be sorted by one task, and grow with the input. The counts decide on the dealing only, not on what is found.
    The driver holds BUCKETS counts of a collection at most. Parts of a bucket are at least 8 times the mean bucket of crowds, so the documents that all parts
    together repeat stay a part of the collection, however many references there are.
    """
    kinds = {}
    for _, target, found in targets:
        kinds.setdefault(target.lower(), found.schema)
    at = []
    for i, (target, t) in enumerate(kinds.items()):
        _, want, hashed = _wanted(ref, target, t)
        at.append(F.when(want.isNotNull(), F.struct(F.lit(i).alias("k"), _bucket(hashed).alias("b"))))
    counts = df.select(F.coalesce(*at).alias("at")).where("at IS NOT NULL").select("at.*").groupBy("k", "b").count().where(F.col("count") > CROWD).collect()
    out = {}
    for i, target in enumerate(kinds):
        mine = [(r[1], r[2]) for r in counts if r[0] == i]
        part = max(CROWD, 8 * sum(n for _, n in mine) // BUCKETS)
        out[target] = [(b, -(-n // part)) for b, n in mine if n > part]
    return out


def _in_array(df: DataFrame, name: str, lookup: Callable, refs: list[str] | None, key: str) -> DataFrame:
    if key not in df.columns:
        raise BindFault(f"references in an array need the key {key}")
    flat = df.select(F.col(key), F.posexplode(F.col(f"`{name}`")).alias("__pos", name))
    flat = include(flat, name, lookup, refs, key)
    back = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__pos", F.col(f"`{name}`").alias("__v")))).alias("__items"))
    back = back.select(F.col(key).alias("__key"), F.transform("__items", lambda x: x.getField("__v")).alias("__new"))
    kind = back.schema["__new"].dataType
    out = df.join(back, F.col(key).eqNullSafe(F.col("__key")), "left")
    empty = F.when(F.col(f"`{name}`").isNotNull(), F.array().cast(kind))
    return out.select(*[F.coalesce("__new", empty).alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])
