"""Rows that every operator has to stand: nulls, empties, ties, repeats and clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "plain words stand here"), (4, "plain words stand here"), (None, "a row without an id"), (5, LONG)]


def odd_docs(spark, *clashing):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for name in clashing:
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
