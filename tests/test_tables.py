"""Row numbers of files, splittable CSV, ranks without one task, and profiles that add up."""

import pytest
from pyspark.sql import functions as F

from given_tables import DATA
from voxtable.catalog.cleaning import raw_tickets
from voxtable.operators import profile_states as ps
from voxtable.operators.checks import CheckError
from voxtable.plans import datasets
from voxtable.scale import dense_ranks
from voxtable.sources import tables as src


def test_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    spark.range(0, 5000, 1, 7).selectExpr("id", "repeat('x', 20) as pad").write.option("header", True).csv(f"{tmp_path}/in")
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several splits a file
        for part in (f"{tmp_path}/in", ):
            got = [(r["position"], int(r["id"])) for r in src.numbered_rows(src.read_csv(spark, part)).collect()]
            assert sorted(got) == [(i + 1, i) for i in range(5000)]
        assert src.numbered_rows(src.read_csv(spark, f"{tmp_path}/in")).rdd.getNumPartitions() > 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    places = src.numbered_rows(documents).select("position", "doc_id").sort("position").collect()
    assert [r["doc_id"] for r in places] == [r["doc_id"] for r in documents.collect()] and places[0]["position"] == 1
    assert src.numbered_rows(documents.filter("false")).count() == 0


def test_only_files_with_open_lines_are_read_whole(spark, tmp_path):
    plain, broken = f"{tmp_path}/plain", f"{tmp_path}/broken"
    spark.createDataFrame([(1, 'say ""hi""'), (2, "b")], "id int, t string").write.option("header", True).option("escape", '"').csv(plain)
    spark.createDataFrame([(1, "two\nlines"), (2, "b")], "id int, t string").write.option("header", True).option("escape", '"').csv(broken)
    assert not src.has_open_lines(spark, plain) and src.has_open_lines(spark, broken)
    assert {r["t"] for r in src.read_csv(spark, broken).collect()} == {"two\nlines", "b"}
    assert {r["t"] for r in src.read_csv(spark, plain).collect()} == {'say ""hi""', "b"}
    assert "multiLine" not in src.read_csv(spark, plain)._jdf.queryExecution().toString()


def test_tickets_from_files_must_keep_the_test_order(spark, tmp_path):
    raw = raw_tickets(spark, DATA).limit(60).cache()
    test = raw.drop("class_int")
    template = test.select("id", F.lit(0).alias("class_int"))
    paths = {n: f"{tmp_path}/{n}" for n in ("train", "test", "same", "shuffled")}
    for name, df in (("train", raw), ("test", test.sort("id")), ("same", template.sort("id")), ("shuffled", template.sort(F.desc("id")))):
        src.write_clean(df.coalesce(1), paths[name], "csv")
    pair = datasets.clean_ticket_files(spark, paths["train"], paths["test"], paths["same"])
    assert pair.test.count() == 60 and "__position" not in pair.test.columns + pair.train.columns
    with pytest.raises(CheckError, match="id_order"):
        datasets.clean_ticket_files(spark, paths["train"], paths["test"], paths["shuffled"])


def test_ranks_follow_the_order(spark):
    rows = [(f"c{i % 3}", f"v{i * 7919 % 1000:04d}") for i in range(900)]
    got = dense_ranks(spark.createDataFrame(rows, "a string, b string").distinct(), ["a", "b"], "r").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.r)] == sorted(set(rows)) and sorted(r.r for r in got) == list(range(len(set(rows))))
    assert dense_ranks(spark.createDataFrame([], "a string"), ["a"], "r").count() == 0


def test_states_add_up_in_any_order(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    parts = [ps.profile_state(df.filter(F.col("doc_id") % 4 == i), ["lang", "source", "doc_id"], "text") for i in range(4)]
    parts[0].write.parquet(f"{tmp_path}/day0")
    stored = spark.read.parquet(f"{tmp_path}/day0")
    left = ps.merged([ps.merged([stored, parts[1]]), ps.merged([parts[2], parts[3]])])
    for state in (left, ps.merged([parts[3], ps.merged([parts[1], parts[2]]), stored]), ps.profile_state(df, ["lang", "source", "doc_id"], "text")):
        rows = {r["column"]: r for r in ps.column_report(state).collect()}
        assert {c: (r["rows"], r["missing"]) for c, r in rows.items()} == {"lang": (200, 0), "source": (200, df.filter("source is null").count()), "doc_id": (200, 0)}
        assert rows["lang"]["unique"] == 4 and rows["source"]["unique"] == 21 and abs(rows["doc_id"]["unique"] - 200) <= 10
        length = ps.length_report(state).first()
        exact = df.agg(F.min(F.length("text")), F.max(F.length("text")), F.avg(F.length("text"))).first()
        assert (length["min"], length["max"]) == (exact[0], exact[1]) and abs(length["mean"] - exact[2]) < 1e-9
        below = df.filter(F.length("text") <= length["q50"]).count() / 200
        assert abs(below - 0.5) < 0.04
    assert ps.length_report(ps.profile_state(df.limit(0), ["lang"], "text")).count() == 0
