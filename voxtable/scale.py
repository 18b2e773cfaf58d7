"""Helpers that keep plans safe when tables, groups or lookups get large."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A lookup is only broadcast when its measured bytes stay under this.
BROADCAST_BYTES = 32 << 20
# Salts used to split one group over many tasks before the final pass per group.
GROUP_SALTS = 256


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="voxtable-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/voxtable/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder; later stages survive executor loss."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_shuffles(context: SparkContext) -> None:
    """Have Spark remove the files of shuffles that nothing refers to, which it does when the driver collects its garbage."""
    context._jvm.System.gc()


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet, which takes less room than a checkpoint, and read back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    # Also before: a job's shuffles are referred to for a moment after its end.
    drop_shuffles(spark.sparkContext)
    df.write.parquet(path)
    drop_shuffles(spark.sparkContext)
    return spark.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: text as it is, 16 for any other value, and the row's own overhead."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    return sum(texts, F.lit(32 + 16 * len(df.columns)).cast("long"))


@dataclass(frozen=True)
class Lookup:
    """A fitted lookup table: materialised once, with its counted rows and measured bytes."""

    table: DataFrame
    rows: int
    size_bytes: int

    @classmethod
    def settle(cls, df: DataFrame) -> "Lookup":
        return cls.measured(checkpointed(df))

    @classmethod
    def measured(cls, table: DataFrame) -> "Lookup":
        """A table that is cheap to read, such as rows made in the session."""
        rows, size_bytes = table.agg(F.count("*"), F.coalesce(F.sum(_row_bytes(table)), F.lit(0))).first()
        return cls(table, rows, size_bytes)

    def part(self, table: DataFrame) -> "Lookup":
        """Columns or rows of this lookup, which are no larger than it."""
        return Lookup(table, self.rows, self.size_bytes)

    @property
    def small(self) -> bool:
        return self.size_bytes <= BROADCAST_BYTES

    def join(self, rows: DataFrame, on, how: str = "left") -> DataFrame:
        """Broadcast when the measured size allows it, otherwise a shuffle join under AQE."""
        side = F.broadcast(self.table) if self.small else self.table
        return rows.join(side, on, how)


def work_partitions(df: DataFrame) -> int:
    """Partitions for work that grows each input byte: the session's shuffle partitions.

    Size them to the data; given as a fixed number they also keep AQE from merging small
    inputs into one task before they are expanded.
    """
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def top_k_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str],
    rank_col: str | None = None,
    salts: int = GROUP_SALTS,
) -> DataFrame:
    """Exact first ``k`` rows of each group without putting a group into one task.

    Every group is first cut down to ``k`` rows per salt (salt = hash of ``spread``), so the
    last pass sees at most ``salts * k`` rows of it. ``order`` must be a total order.
    """
    rank, salt = "__rank", "__salt"
    first = Window.partitionBy(*groups, salt).orderBy(*order)
    last = Window.partitionBy(*groups).orderBy(*order)
    cut = (
        df.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)))
        .withColumn(rank, F.row_number().over(first))
        .filter(F.col(rank) <= k)
        .drop(rank, salt)
        .withColumn(rank, F.row_number().over(last))
        .filter(F.col(rank) <= k)
    )
    if rank_col is None:
        return cut.drop(rank)
    return cut.withColumn(rank_col, F.col(rank).cast("long")).drop(rank)


def hashed_rank(
    df: DataFrame,
    group: str,
    id_col: str,
    seed: int | str,
    rank_col: str = "rank",
    size_col: str | None = None,
    hex_digits: int = 3,
) -> DataFrame:
    """Exact 1-based rank inside ``group`` by ``md5(id-seed)``, without one task per group.

    The digest is uniform, so its leading ``hex_digits`` cut any group, however large, into
    ``16**hex_digits`` even buckets. Rows are ranked inside (group, bucket) and shifted by
    the rows in earlier buckets, a table of at most groups * 16**hex_digits counts.
    """
    keyed = df.withColumns({
        "__md5": F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed)))),
        "__g": F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null")),
    }).withColumn("__b", F.substring("__md5", 1, hex_digits))
    counts = keyed.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "__g", "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"),
        F.sum("__n").over(Window.partitionBy("__g")).alias("__size"),
    )
    within = Window.partitionBy("__g", "__b").orderBy("__md5", id_col)
    ranked = keyed.withColumn("__r", F.row_number().over(within)).join(shifts, ["__g", "__b"])
    cols = [*df.columns, (F.col("__r") + F.col("__shift")).cast("long").alias(rank_col)]
    if size_col:
        cols.append(F.col("__size").cast("long").alias(size_col))
    return ranked.select(*cols)


def dense_ranks(values: DataFrame, order: Sequence[str], rank_col: str) -> DataFrame:
    """Distinct rows numbered from 0 in the order of ``order``, without sorting them in one task.

    Rows are dealt to ranges of that order; each range is numbered by itself and shifted by the
    rows of the ranges before, a table of one row per partition.
    """
    ranged = values.repartitionByRange(work_partitions(values), *[F.asc(c) for c in order]).withColumn("__range", F.spark_partition_id())
    kept = checkpointed(ranged)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = kept.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return kept.withColumn("__own", own).join(F.broadcast(shifts), "__range").select(*values.columns, (F.col("__own") + F.col("__shift")).alias(rank_col))


def text_digest(col: Column) -> Column:
    """16-byte stand-in for a whole text, so grouping never shuffles the text itself."""
    return F.unhex(F.md5(col))
