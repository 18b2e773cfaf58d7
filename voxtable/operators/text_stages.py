"""Feature vectors of text tables as an MLlib stage that is fitted once, saved and loaded.

``TextTable`` fits what ``plans.text_models.TextFeatures`` fits: word and character TF-IDF, one-hot
categories and scaled numbers. Its model makes the vector of a row from that row and broadcast
vocabularies alone, without a shuffle, so one plan leads from raw text to scores on batches and on
streams. The vocabularies are bounded by ``max_features``; categories are joined, broadcast only
up to the bytes measured when they were fitted or loaded. Everything fitted is saved as Parquet.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from voxtable.config import UNK
from voxtable.operators import cuts
from voxtable.operators import learning as ln
from voxtable.operators import ngrams as ng
from voxtable.operators.linear import TextRows
from voxtable.scale import Lookup, settled

_CELL = "array<struct<feature:int,value:double>>"


def as_vectors(df: DataFrame, column: str) -> DataFrame:
    """A struct (type, size, indices, values) as a vector; batches pass through unchanged."""
    schema = StructType([StructField(f.name, VectorUDT(), True) if f.name == column else f for f in df.schema.fields])
    return df.mapInArrow(lambda batches: batches, schema)


class _TextParams(Params):
    textCol = Param(Params._dummy(), "textCol", "text", TypeConverters.toString)
    catCols = Param(Params._dummy(), "catCols", "categorical columns", TypeConverters.toListString)
    numCols = Param(Params._dummy(), "numCols", "numeric columns", TypeConverters.toListString)
    wordFeatures = Param(Params._dummy(), "wordFeatures", "largest word vocabulary", TypeConverters.toInt)
    charFeatures = Param(Params._dummy(), "charFeatures", "largest character vocabulary", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "least documents of a term", TypeConverters.toInt)
    sublinear = Param(Params._dummy(), "sublinear", "1 + log of term counts", TypeConverters.toBoolean)
    withinWords = Param(Params._dummy(), "withinWords", "character n-grams inside words", TypeConverters.toBoolean)
    outputCol = Param(Params._dummy(), "outputCol", "vector", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            textCol="text", catCols=[], numCols=[], wordFeatures=50_000, charFeatures=100_000, minDF=2, sublinear=False, withinWords=True, outputCol="features",
        )

    def _cut(self, block: str) -> cuts.Cut:
        if block == "word":
            return cuts.WORDS
        return cuts.CHARS_WB if self.getOrDefault("withinWords") else cuts.CHARS


class TextTable(Estimator, _TextParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, **options):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "TextTableModel":
        get = self.getOrDefault
        blocks = ("word", "char")
        # One pass over the texts counts both; terms that are too rare are gone before anything is stored.
        counted = cuts.stats_by_cut(df, get("textCol"), [self._cut(b) for b in blocks]).filter(F.col("df") >= get("minDF"))
        stats, n, fitted = settled(counted, "terms"), ng.doc_count(df), {}
        for k, block in enumerate(blocks):
            own = stats.filter(F.col("cut") == k).drop("cut")
            fitted[block] = ng.Tfidf.from_stats(own, "", n, get("minDF"), get(f"{block}Features"), get("sublinear"), stored=True).vocabulary.table
        spark = df.sparkSession
        fitted["categories"] = ln.OneHot.fit(df, get("catCols")).categories.table if get("catCols") else spark.createDataFrame([], "col string, value string, feature int")
        scales = ln.MaxAbs.fit(df, get("numCols")).scales.first() if get("numCols") else ()
        fitted["scales"] = spark.createDataFrame([(i, c, float(x)) for i, (c, x) in enumerate(zip(get("numCols"), scales))], "position int, col string, peak double")
        return self._copyValues(TextTableModel(fitted))


class TextTableModel(Model, _TextParams, MLWritable, MLReadable):
    """``tables``: the vocabularies of words and characters, the categories, and the numbers' peaks."""

    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__()
        self.tables, self._ready = tables, None

    def _prepared(self):
        if self._ready is None:
            vectorizers = {}
            for block in ("word", "char"):
                rows = self.tables[block].select("term_id", "term", "idf").orderBy("term_id").toArrow()  # at most max_features rows
                vectorizers[block] = (rows["term"].to_pylist(), rows["idf"].to_pylist())
            scales = {r["col"]: r["peak"] for r in self.tables["scales"].orderBy("position").collect()}
            self._ready = vectorizers, Lookup.settle(self.tables["categories"]), scales
        return self._ready

    @property
    def size(self) -> int:
        vectorizers, categories, scales = self._prepared()
        return sum(len(terms) for terms, _ in vectorizers.values()) + categories.rows + len(scales)

    def _with_few(self, df: DataFrame, offset: int) -> tuple[DataFrame, bool, int]:
        """``df`` with the cells of categories and numbers in ``__few``, whether there are any, and the first feature after them."""
        _, categories, scales = self._prepared()
        few, out = [], df
        for k, c in enumerate(self.getOrDefault("catCols")):
            own = categories.table.filter(F.col("col") == c).select(F.col("value").alias(f"__v{k}"), F.col("feature").alias(f"__f{k}"))
            out = categories.part(own).join(out.withColumn(f"__v{k}", F.coalesce(F.col(c).cast("string"), F.lit(UNK))), f"__v{k}")
            few.append(F.struct((F.col(f"__f{k}") + offset).cast("int").alias("feature"), F.lit(1.0).alias("value")))
        if few:
            offset += categories.rows
        for c, peak in scales.items():
            few.append(F.struct(F.lit(offset).alias("feature"), (F.col(c).cast("double") / F.lit(peak)).alias("value")))
            offset += 1
        if few:
            there = F.filter(F.array(*few).cast(_CELL), lambda e: e["feature"].isNotNull() & e["value"].isNotNull() & (e["value"] != 0))
            out = out.withColumn("__few", F.array_sort(there))
        return out, bool(few), offset

    def rows(self, df: DataFrame, keep) -> TextRows:
        """``keep`` columns and the texts, whose vectors learners and models make where they need them."""
        (vectorizers, _, _), vocabularies, offset = self._prepared(), [], 0
        for block, (terms, idf) in vectorizers.items():
            vocabularies.append(cuts.Vocabulary.of(self._cut(block), terms, idf, self.getOrDefault("sublinear"), offset))
            offset += len(terms)
        out, any_, offset = self._with_few(df, offset)
        few = F.struct(F.col("__few.feature").alias("i"), F.col("__few.value").alias("v")) if any_ else None
        return TextRows.of(out, F.col(self.getOrDefault("textCol")), keep, vocabularies, offset, few)

    def sparse(self, df: DataFrame) -> DataFrame:
        """``df`` with the vectors as structs (type, size, indices, values).

        The blocks lie side by side, so their features in a row are in order without sorting; only the few
        categories are sorted, as their columns may be named in any order.
        """
        vectorizers, _, _ = self._prepared()
        indices, values, offset, out = [], [], 0, df
        for block, (terms, idf) in vectorizers.items():
            cells = cuts.vectors(df, self._cut(block), terms, idf, self.getOrDefault("sublinear"), offset)
            out = out.withColumn(f"__{block}", cells(F.col(self.getOrDefault("textCol"))))
            indices.append(F.col(f"__{block}.indices"))
            values.append(F.col(f"__{block}.values"))
            offset += len(terms)
        out, any_, offset = self._with_few(out, offset)
        if any_:
            indices.append(F.col("__few.feature"))
            values.append(F.col("__few.value"))
        vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(offset).alias("size"), F.concat(*indices).alias("indices"), F.concat(*values).alias("values"))
        return out.select(*df.columns, vector.alias(self.getOrDefault("outputCol")))

    def _transform(self, df: DataFrame) -> DataFrame:
        return as_vectors(self.sparse(df), self.getOrDefault("outputCol"))

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _TableWriter(MLWriter):
    def __init__(self, instance: TextTableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path}/{name}")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TextTableModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls({name: spark.read.parquet(f"{path}/{name}") for name in ("word", "char", "categories", "scales")})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
