"""What the operators of this package share: scratch tables, checked broadcasts, spare column names, global numbering."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word, as every operator here counts words: a run without ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that may be broadcast once they have been counted.
BROADCAST_ROWS = 100_000
#: Only where spark.checkpoint.dir is unset, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/folioq"


#: Paths that `materialize` has written within the innermost `stage_tables`.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A local folder only on a local master: on a cluster each executor would keep its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


#: Texts, and bytes of them, that pass between the JVM and Python at once, where a table of these is written: a batch exists in both, and grows with
#: the texts. A single longer text is a batch of its own.
TEXTS, TEXT_BYTES = 1000, 4 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize_texts(df: DataFrame) -> DataFrame:
    """`materialize` for a frame that passes whole texts, or sets made of them, through Python: few of them at a time."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name) for name in (_BATCH, _BYTES)}
    conf.set(_BATCH, min(TEXTS, int(before[_BATCH]) if int(before[_BATCH]) > 0 else TEXTS))
    conf.set(_BYTES, str(TEXT_BYTES))
    try:
        return materialize(df)
    finally:
        for name, value in before.items():
            conf.set(name, value)


def materialize(df: DataFrame) -> DataFrame:
    """`df` written to the shared scratch folder and read again.

    This cuts the lineage (a lost executor costs no recomputation of what came before), keeps the
    columnar format, and gives later plans true sizes. Tables stay until `clear_scratch`, or the end of `stage_tables`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/folioq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what `materialize` has written within it, but for the paths taken out of the list that it gives."""
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield written
    finally:
        _WRITTEN.reset(token)
        for path in written:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables; call it when no result that reads them is needed any longer."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "folioq-*")) or []:
        fs.delete(status.getPath(), True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """For each of `names` one that no column of `df` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast only if a count proves that it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def rows_in_arrow(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """`df` with its batches passed through `run`, which keeps the columns' order and types; names may hold any character."""
    names = df.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(run(b).columns, names)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(each, df.schema)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pair_tasks(df: DataFrame, group: Column, member: Column, most: int, weight: Column | None = None) -> DataFrame:
    """`df` with `pair`, so that any two rows of one group have a (group, pair) in common, and none of these has many more than 2 * `most` rows.

    A group of `most` rows (of weight 1, or as `weight` says) or fewer has the one pair 0. The rows of a larger one are dealt into blocks of about `most` by a hash of `member`, and each goes
    to every pair of blocks that its own block is part of: one task for each, where otherwise the whole group would be one task.
    """
    name, blocks, mine, other, pair = spare(df, "__group", "__blocks", "__mine", "__other", "pair")
    sizes = df.groupBy(group.alias(name)).agg(F.ceil(F.sum(F.lit(1) if weight is None else weight) / most).alias(blocks)).where(F.col(blocks) > 1)
    out = df.join(broadcast_if_small(materialize(sizes)), group == F.col(name), "left")
    n = F.coalesce(F.col(blocks), F.lit(1))
    out = out.withColumn(mine, F.pmod(F.xxhash64(member, F.lit(0)), n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    out = out.where((F.col(mine) != F.col(other)) | (n == 1))
    code = F.when(n > 1, 1 + F.least(mine, other) * n + F.greatest(mine, other)).otherwise(0)
    return out.withColumn(pair, code.cast("long")).drop(name, blocks, mine, other)


def numbered(df: DataFrame, keys: list[Column], name: str, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """`df` with `name`: 0, 1, 2, ... in the order of `keys`, without a window over all rows.

    Rows are dealt by range into chunks; each chunk is numbered by itself and shifted by the size of
    the chunks before it. Only one count for each chunk is ever brought together.
    """
    n = df.count()
    chunks = max(1, -(-n // rows_per_chunk))
    dealt = df.repartitionByRange(chunks, *keys).withColumn("__chunk", F.spark_partition_id())
    dealt = materialize(dealt)
    local = dealt.withColumn("__local", F.row_number().over(W.partitionBy("__chunk").orderBy(*keys)) - 1)
    before = dealt.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(W.orderBy("__chunk")) - F.col("__n"))
    out = local.join(broadcast_if_small(before.drop("__n")), "__chunk")
    return out.withColumn(name, (F.col("__local") + F.col("__before")).cast("long")).drop("__chunk", "__local", "__before")
