"""Readers and writers for feedback tables, reports and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtable.lexicon import CSV_ENCODINGS
from voxtable.scale import Lookup

# Byte values that the Windows-1252 code page leaves undefined (fixed values).
_UNDEFINED_1252 = ("81", "8D", "8F", "90", "9D")


def require_path(spark: SparkSession, path: str) -> None:
    """Fail early and clearly when an input path does not exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(f"missing input: {path}")


def has_open_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> bool:
    """Whether a quoted field goes on over the end of a line: a line with an odd number of quotes."""
    lines = spark.read.option("encoding", encoding).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", multi_line: bool | None = None) -> DataFrame:
    """CSV with a header, every column as text.

    A file with line breaks inside quoted fields (``multi_line``) is read by one task, others are
    split. By default one pass over the lines, which stops at the first such field, decides.
    """
    require_path(spark, path)
    if multi_line is None:
        multi_line = has_open_lines(spark, path, encoding)
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
    df = reader.option("multiLine", multi_line).option("encoding", encoding).csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def numbered_rows(df: DataFrame, position: str = "position") -> DataFrame:
    """A table as read from files, with each row's place in them: files by path, then rows in order, from 1.

    ``df`` is a reader's result without joins, filters or shuffles. Rows are counted per split of a
    file and shifted by the splits before; no row moves to another task.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    marked = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], split.alias("__split"), F.monotonically_increasing_id().alias("__row"))
    splits = marked.groupBy("__split").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split of the files.
    shifts = Lookup.settle(splits.select("__split", F.col("__first") - F.coalesce(F.sum("__n").over(before), F.lit(0)) - 1).toDF("__split", "__shift"))
    placed = shifts.join(marked, "__split", "inner")
    return placed.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)], (F.col("__row") - F.col("__shift")).alias(position))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding of utf-8, utf-8-sig, cp1252, latin-1 that decodes every byte.

    The text source keeps raw bytes, so validity is a distributed filter that stops at the
    first bad line. Latin-1 decodes anything and ends the chain.
    """
    lines = spark.read.text(path)
    first, _, ansi, last = CSV_ENCODINGS
    if lines.filter(~F.is_valid_utf8("value")).isEmpty():
        return first
    undefined = "^(..)*(" + "|".join(_UNDEFINED_1252) + ")"
    if lines.filter(F.hex(F.col("value").cast("binary")).rlike(undefined)).isEmpty():
        return ansi
    return last


def _ansi_pairs() -> tuple[str, str]:
    """Characters that Latin-1 and Windows-1252 decode differently, from the codec itself."""
    codes = [b for b in range(0x80, 0xA0) if f"{b:02X}" not in _UNDEFINED_1252]
    return "".join(map(chr, codes)), "".join(bytes([b]).decode("cp1252") for b in codes)


def read_csv_robust(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """CSV in the first encoding that fits. Windows-1252 is Latin-1 with 27 characters moved."""
    require_path(spark, path)
    encoding = detect_encoding(spark, path)
    if encoding == "utf-8":
        return read_csv(spark, path, encoding, multi_line)
    df = read_csv(spark, path, "iso-8859-1", multi_line)
    if encoding == "latin-1":
        return df
    moved, meant = _ansi_pairs()
    names = str.maketrans(moved, meant)
    return df.select(*[F.translate(F.col(f"`{c}`"), moved, meant).alias(c.translate(names)) for c in df.columns])


def read_table(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """Parquet or CSV table with its id as text, so ids compare the same across files."""
    df = read_csv(spark, path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return df.withColumn(id_col, F.col(id_col).cast("string"))


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a cleaned table; executors write their own parts."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """Tidy report table as JSON lines, NULLs kept."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


SCORE_SCHEMA = "model string, row_id bigint, label bigint, label_pos int, score double"


class ScoreShapeError(ValueError):
    """A score table lacks cells, rows or labels it should have."""


def save_scores(scores: DataFrame, path: str) -> None:
    scores.select("model", "row_id", "label", "label_pos", "score").write.mode("overwrite").parquet(path)


def score_shape(scores: DataFrame) -> DataFrame:
    """Per model: rows, labels, cells and whether the matrix is complete."""
    per_row = scores.groupBy("model", "row_id").agg(F.count("*").alias("cells"), F.max("label_pos").alias("top"))
    return per_row.groupBy("model").agg(
        F.count("*").alias("n_rows"),
        F.max("cells").alias("n_labels"),
        F.sum("cells").alias("n_cells"),
        ((F.min("cells") == F.max("cells")) & (F.max("top") + 1 == F.max("cells"))).alias("complete"),
    )


def load_scores(spark: SparkSession, path: str, rows: int | None = None, labels: int | None = None) -> DataFrame:
    """Read a score table back and check its shape."""
    require_path(spark, path)
    scores = spark.read.schema(SCORE_SCHEMA).parquet(path)
    for s in score_shape(scores).collect():
        if not s.complete:
            raise ScoreShapeError(f"model {s.model}: incomplete score matrix")
        if rows is not None and s.n_rows != rows:
            raise ScoreShapeError(f"model {s.model}: {s.n_rows} rows, expected {rows}")
        if labels is not None and s.n_labels != labels:
            raise ScoreShapeError(f"model {s.model}: {s.n_labels} labels, expected {labels}")
    return scores
