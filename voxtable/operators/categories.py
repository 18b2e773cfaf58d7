"""Fitted category operators: rare grouping, evidence-gated imputation, label encoding, weights.

Each has a fit step that makes a small table from one aggregation and settles it in the
shared folder, and an apply step that joins it to any number of tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.config import UNK
from voxtable.functions.features import unknown_flag
from voxtable.functions.values import to_long
from voxtable.scale import Lookup, dense_ranks


@dataclass(frozen=True)
class RareGrouping:
    """Categories kept because they are frequent enough in the training table."""

    kept: Lookup | None
    columns: tuple
    rare_token: str
    unk: str = UNK

    @classmethod
    def fit(cls, train: DataFrame, columns, min_count: int = 20, rare_token: str = "RARE", unk: str = UNK):
        columns = tuple(c for c in columns if c in train.columns)
        if min_count <= 1 or not columns:
            return cls(None, columns, rare_token, unk)
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(unk)).alias("value")) for c in columns
        ])).alias("p")
        counts = train.select(pairs).groupBy("p.col", "p.value").agg(F.count("*").alias("n"))
        return cls(Lookup.settle(counts.filter(F.col("n") >= min_count)), columns, rare_token, unk)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.kept is None:
            return df
        for c in self.columns:
            if c not in df.columns:
                continue
            names = self.kept.table.filter(F.col("col") == c).select(F.col("value").alias(c), F.lit(True).alias("__kept"))
            filled = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(self.unk)))
            stays = F.col("__kept").isNotNull() | (F.col(c) == self.unk)
            joined = self.kept.part(names).join(filled, c)
            df = joined.select(*[
                F.when(stays, F.col(c)).otherwise(F.lit(self.rare_token)).alias(c) if n == c else F.col(n) for n in df.columns
            ])
        return df

    def report(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """Distinct values before and after, and rows grouped as rare, per column."""
        if not self.columns:
            return train.sparkSession.createDataFrame([], "col string, train_unique_before bigint, train_unique_after bigint, n_rare_train bigint, n_rare_test bigint")

        def values(df: DataFrame, side: str) -> DataFrame:
            cells = F.explode(F.array(*[
                F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(self.unk)).alias("value"))
                for c in self.columns
            ])).alias("p")
            return df.select(cells).groupBy("p.col", "p.value").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))

        counts = values(train, "train").unionByName(values(test, "test"))
        seen = counts.groupBy("col", "value").agg(
            F.sum(F.when(F.col("side") == "train", F.col("n"))).alias("train"),
            F.sum(F.when(F.col("side") == "test", F.col("n"))).alias("test"),
        )
        if self.kept is None:
            # Nothing is grouped: every value stays.
            marked, stays = seen, F.lit(True)
        else:
            kept = self.kept.table.select("col", "value", F.lit(True).alias("__kept"))
            marked = self.kept.part(kept).join(seen, ["col", "value"])
            stays = F.col("__kept").isNotNull() | (F.col("value") == self.unk)
        shown = F.when(stays, F.col("value")).otherwise(F.lit(self.rare_token))
        rare = shown == self.rare_token
        return (
            marked.groupBy("col", shown.alias("shown"))
            .agg(
                F.count("train").alias("before"),
                F.max(F.col("train").isNotNull().cast("int")).alias("in_train"),
                F.sum(F.when(rare, F.col("train"))).alias("rare_train"),
                F.sum(F.when(rare, F.col("test"))).alias("rare_test"),
            )
            .groupBy("col")
            .agg(
                F.sum("before").alias("train_unique_before"),
                F.sum("in_train").cast("long").alias("train_unique_after"),
                F.coalesce(F.sum("rare_train"), F.lit(0)).alias("n_rare_train"),
                F.coalesce(F.sum("rare_test"), F.lit(0)).alias("n_rare_test"),
            )
        )


@dataclass(frozen=True)
class EvidenceImputer:
    """Fill missing values with one label where the group's evidence is strong enough."""

    evidence: Lookup
    group_col: str
    value_col: str
    label: str
    threshold: float
    min_support: int
    unk: str = UNK

    @classmethod
    def fit(
        cls, train: DataFrame, group_col: str, value_col: str, label: str = "postpaid",
        threshold: float = 0.95, min_support: int = 100, unk: str = UNK,
    ):
        missing = F.col(value_col).isNull() | (F.col(value_col) == unk)
        counts = train.groupBy(group_col).agg(
            F.count_if(~missing).alias("support"),
            F.count_if(~missing & (F.col(value_col) == label)).alias("hits"),
            F.count_if(missing).alias("missing"),
        )
        rate = F.when(F.col("support") > 0, F.col("hits") / F.col("support"))
        eligible = F.coalesce((F.col("support") >= min_support) & (rate >= threshold), F.lit(False))
        table = counts.withColumns({"rate": rate, "eligible": eligible})
        return cls(Lookup.settle(table), group_col, value_col, label, threshold, min_support, unk)

    def decision(self) -> DataFrame:
        """One row: expected rate over missing rows, coverage, and whether to impute."""
        total = F.sum("missing")
        weighted = F.coalesce(F.sum(F.col("missing") * F.coalesce("rate", F.lit(0.0))) / F.nullif(total, F.lit(0)), F.lit(0.0))
        covered = F.coalesce(
            F.sum(F.when(F.col("eligible"), F.col("missing")).otherwise(F.lit(0))) / F.nullif(total, F.lit(0)), F.lit(0.0)
        )
        return self.evidence.table.agg(
            F.coalesce(total, F.lit(0)).alias("missing_count"),
            weighted.alias("expected_rate"),
            covered.alias("coverage"),
            F.count_if("eligible").alias("n_eligible"),
        ).withColumn("impute", (F.col("n_eligible") > 0) & (F.col("expected_rate") >= self.threshold))

    def transform(self, df: DataFrame, indicator: str | None = None) -> DataFrame:
        """Impute eligible missing rows and refresh the missing indicator."""
        marks = self.evidence.table.filter("eligible").select(F.col(self.group_col), F.lit(True).alias("__ok"))
        joined = self.evidence.part(marks).join(df, self.group_col)
        missing = F.col(self.value_col).isNull() | (F.col(self.value_col) == self.unk)
        fill = missing & F.col("__ok").isNotNull() & self.decision().select("impute").scalar()
        value = F.when(fill, F.lit(self.label)).otherwise(F.col(self.value_col))
        out = joined.select(*[value.alias(c) if c == self.value_col else F.col(c) for c in df.columns])
        return out.withColumn(indicator, unknown_flag(F.col(self.value_col))) if indicator else out


@dataclass(frozen=True)
class LabelEncoder:
    """Labels to dense ids 0..k-1 in label order, and back."""

    mapping: Lookup

    @classmethod
    def fit(cls, df: DataFrame, label_col: str):
        labels = df.select(to_long(F.col(label_col)).alias("label")).filter("label is not null").distinct()
        return cls(Lookup.settle(dense_ranks(labels, ["label"], "label_id").withColumn("label_id", F.col("label_id").cast("int"))))

    @classmethod
    def load(cls, spark, saved: dict):
        """From ``{"label2id": {...}}`` or ``{"id2label": {...}}``; labels must be numeric."""
        if saved.get("label2id"):
            pairs = [(int(k), int(v)) for k, v in saved["label2id"].items()]
        elif saved.get("id2label"):
            pairs = [(int(v), int(k)) for k, v in saved["id2label"].items()]
        else:
            raise ValueError("the saved mapping has no label2id and no id2label")
        return cls(Lookup.measured(spark.createDataFrame(sorted(pairs), "label bigint, label_id int")))

    def order(self) -> list[int]:
        """The labels by id, as a model's class positions follow them."""
        return [r.label for r in self.mapping.table.orderBy("label_id").collect()]

    def encode(self, df: DataFrame, label_col: str, id_col: str = "label_id") -> DataFrame:
        table = self.mapping.table.select(F.col("label").alias("__label"), F.col("label_id").alias(id_col))
        keyed = df.withColumn("__label", to_long(F.col(label_col)))
        return self.mapping.part(table).join(keyed, "__label").drop("__label")

    def decode(self, df: DataFrame, id_col: str, label_col: str = "label") -> DataFrame:
        table = self.mapping.table.select(F.col("label_id").alias(id_col), F.col("label").alias(label_col))
        return self.mapping.part(table).join(df, id_col)


def class_weights(df: DataFrame, label_col: str, mean_one: bool = False) -> DataFrame:
    """Inverse-frequency weights ``n/(k*n_c)``, or ``n/n_c`` scaled to mean 1."""
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"), F.sum(1 / F.col("n")).alias("inv"))).scalar()
    balanced = totals["rows"] / (totals["classes"] * F.col("n"))
    scaled = (1 / F.col("n")) / (totals["inv"] / totals["classes"])
    return counts.select(label_col, "n", (scaled if mean_one else balanced).alias("weight"))


def with_class_weights(df: DataFrame, label_col: str, mean_one: bool = False, weight_col: str = "weight") -> DataFrame:
    table = class_weights(df, label_col, mean_one).select(label_col, F.col("weight").alias(weight_col))
    return Lookup.settle(table).join(df, label_col)

