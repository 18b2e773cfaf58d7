"""Data-quality checks. Each returns rows ``(check, status, n, examples)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.config import CommentConfig
from voxtable.functions.phones import has_phone
from voxtable.functions.values import is_number, to_long
from voxtable.regexes import java
from voxtable.scale import top_k_per_group

EXAMPLES = 10
# Labels that a report lists; a column with more is no label column.
MAX_LISTED = 10_000


class CheckError(ValueError):
    """A table failed a data-quality check."""


def _row(check: str, n: Column, examples: Column) -> list[Column]:
    return [
        F.lit(check).alias("check"),
        F.when(n > 0, F.lit("fail")).otherwise(F.lit("ok")).alias("status"),
        n.cast("long").alias("n"),
        F.coalesce(examples, F.lit("")).alias("examples"),
    ]


def _found(bad: DataFrame, check: str, value: Column, order: list[Column] | None = None) -> DataFrame:
    """Count bad rows and show the first examples; neither gathers more than a few rows.

    Bad rows are counted per example value first, so the top-k keeps its groups tiny.
    """
    counted = bad.groupBy(value.cast("string").alias("v"), *[o.alias(f"o{i}") for i, o in enumerate(order or [])])
    counted = counted.agg(F.count("*").alias("c")).withColumn("g", F.lit(check))
    keys = [F.col(f"o{i}").asc_nulls_last() for i in range(len(order or []))] + [F.col("v").asc_nulls_last()]
    first = top_k_per_group(counted, ["g"], keys, EXAMPLES, ["v"], "r")
    shown = first.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]), ",", "NULL").alias("e")
    )
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return total.select(*_row(check, F.col("n"), shown.scalar()))


def null_ids(df: DataFrame, id_col: str, show: str, check: str = "null_id") -> DataFrame:
    return _found(df.filter(F.col(id_col).isNull()), check, F.col(show), [F.col(show)])


def duplicate_ids(df: DataFrame, id_col: str, check: str = "duplicate_id") -> DataFrame:
    """Surplus rows of ids that occur more than once (NULL counts as one id)."""
    again = df.groupBy(id_col).agg(F.count("*").alias("c")).filter("c > 1")
    first = top_k_per_group(again.withColumn("g", F.lit(1)), ["g"], [F.col(id_col).asc_nulls_last()], EXAMPLES, [id_col], "r")
    shown = first.agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("r", F.col(id_col).cast("string").alias("v")))), lambda s: s["v"]),
            ",", "NULL",
        )
    )
    return again.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(*_row(check, F.col("n"), shown.scalar()))


def id_flags(df: DataFrame, id_col: str) -> DataFrame:
    """Rows, distinct ids (NULL counted) and whether there are duplicates."""
    per_id = df.groupBy(id_col).agg(F.count("*").alias("c"))
    return per_id.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count("*").alias("id_unique")
    ).withColumn("has_duplicates", F.col("rows") != F.col("id_unique"))


def same_ids(left: DataFrame, right: DataFrame, id_col: str, names=("left", "right")) -> DataFrame:
    """Row counts agree and neither side has ids the other lacks."""
    a = left.groupBy(F.col(id_col).alias("v")).agg(F.count("*").alias("a"))
    b = right.groupBy(F.col(id_col).alias("v")).agg(F.count("*").alias("b"))
    both = a.join(b, "v", "full_outer")
    counts = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("b"), F.lit(0)).alias("nb"))
    row_check = counts.select(
        *_row("row_count", F.abs(F.col("na") - F.col("nb")), F.concat_ws("<>", F.col("na").cast("string"), F.col("nb").cast("string")))
    )
    return row_check.unionByName(
        _found(both.filter("b is null"), f"extra_in_{names[0]}", F.col("v"), [F.col("v")])
    ).unionByName(_found(both.filter("a is null"), f"extra_in_{names[1]}", F.col("v"), [F.col("v")]))


def same_order(left: DataFrame, right: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """Ids agree position by position; shows the first position where they do not."""
    a = left.select(F.col(pos_col).alias("p"), F.col(id_col).cast("string").alias("a"))
    b = right.select(F.col(pos_col).alias("p"), F.col(id_col).cast("string").alias("b"))
    wrong = a.join(b, "p", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    first = F.min(F.struct("p", "a", "b"))
    return wrong.agg(F.count("*").alias("n"), first.alias("f")).select(
        *_row(
            "id_order", F.col("n"),
            F.when(
                F.col("f").isNotNull(),
                F.concat(
                    F.col("f.p").cast("string"), F.lit(":"), F.coalesce("f.a", F.lit("-")), F.lit("<>"), F.coalesce("f.b", F.lit("-"))
                ),
            ),
        )
    )


def numeric_target(df: DataFrame, target: str, id_col: str) -> DataFrame:
    bad = df.filter(~is_number(F.col(target).cast("string")) | F.col(target).isNull())
    return _found(bad, "target_numeric", F.concat_ws(":", F.col(id_col).cast("string"), F.coalesce(F.col(target).cast("string"), F.lit("NULL"))), [F.col(id_col)])


def label_sanity(df: DataFrame, target: str) -> DataFrame:
    """Missing labels, number of classes and the sorted class list, from per-label counts."""
    counts = df.groupBy(to_long(F.col(target)).alias("l")).agg(F.count("*").alias("c"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("l").isNull(), F.col("c"))), F.lit(0)).alias("label_missing"),
        F.count("l").alias("n_classes"),
        F.array_join(F.transform(F.sort_array(F.collect_set("l")), lambda x: x.cast("string")), ",").alias("labels_sorted"),
    )


def run_all(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def require(report: DataFrame) -> None:
    """Raise when any check failed. The report holds one row per check."""
    bad = report.filter("status <> 'ok'").collect()
    if bad:
        raise CheckError("; ".join(f"{r.check}: {r.n} ({r.examples})" for r in bad))


def quality_report(df: DataFrame, cfg: CommentConfig, is_train: bool) -> DataFrame:
    """Leak and completeness counts of a cleaned comment table, its ids and its label list.

    The texts are read in one pass; ids and labels are grouped on their own columns alone.
    """
    text = F.coalesce(F.col(cfg.text_col), F.lit(""))
    counts = {
        "rows": F.count("*"),
        "id_missing": F.count_if(F.col(cfg.id_col).isNull()),
        "platform_empty": F.count_if(F.trim(F.coalesce(F.col(cfg.platform_col), F.lit(""))) == ""),
        "text_missing": F.count_if(F.col(cfg.text_col).isNull()),
        "text_empty": F.count_if(F.trim(text) == ""),
        "url_leaks": F.count_if(text.rlike(java(lx.URL, ignore_case=True))),
        "email_leaks": F.count_if(text.contains("@") & text.rlike(java(lx.EMAIL, ignore_case=True, word_inside=False))),
        "long_digit_leaks_ge6": F.count_if(text.rlike(java(lx.LONG_DIGITS))),
        "phone_leaks": F.count_if(has_phone(text)),
    }
    if is_train:
        counts["label_missing"] = F.count_if(F.col(cfg.target_col).isNull())
        counts["n_classes"] = F.count_distinct(cfg.target_col)
    unique = id_flags(df, cfg.id_col).select("id_unique").scalar()
    report = df.agg(*[c.alias(n) for n, c in counts.items()]).withColumn("id_unique", unique).withColumn("id_dupes", F.col("rows") - F.col("id_unique"))
    if not is_train:
        return report
    labels = df.filter(F.col(cfg.target_col).isNotNull()).groupBy(F.col(cfg.target_col).cast("string").alias("l")).agg(F.count("*").alias("c"))
    listed = F.array_join(F.sort_array(F.collect_set(F.when(F.col("r") <= MAX_LISTED, F.col("l")))), ",")
    ranked = top_k_per_group(labels.withColumn("g", F.lit(0)), ["g"], [F.asc("l")], MAX_LISTED + 1, ["l"], "r")
    many = F.raise_error(F.lit(f"more than {MAX_LISTED} labels")).cast("string")
    return report.withColumn("labels_sorted", ranked.agg(F.when(F.count("*") > MAX_LISTED, many).otherwise(listed)).scalar())


def require_clean(report: DataFrame) -> None:
    """Hard assertions on a quality report: ids present and unique, nothing leaks."""
    row = report.first().asDict()
    hard = ("id_missing", "id_dupes", "url_leaks", "email_leaks", "phone_leaks")
    bad = {k: row[k] for k in hard if row[k]}
    if bad:
        raise CheckError(f"cleaned table fails: {bad}")
