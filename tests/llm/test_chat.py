from pyspark.sql import functions as F

from voxtable.llm import chat as q

SCHEMA = "conv_id long, turn long, role string, text string"


def rendered(spark, rows, **options):
    got = q.rotate(spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash")), **options).collect()
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",") if s]
        assert all(r["rendered"][a:b].endswith(q.END) for a, b in spans) and sum(b - a for a, b in spans) == r["n_masked_in"]
    return got


def test_every_speaker_is_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi Ünal 😀"), (1, 2, "bob", "yes"), (1, 3, "ann", None), (1, 4, None, "who")]
    got = {r["perspective"]: r for r in rendered(spark, rows)}
    assert set(got) == {"ann", "bob", "unknown"}
    assert got["bob"]["rendered"] == (
        "<|system|>\nbe kind<|end|>\n<|user|>ann\nhi Ünal 😀<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>ann\n<|end|>\n<|user|>unknown\nwho<|end|>\n"
    )
    spans = [tuple(map(int, s.split(":"))) for s in got["ann"]["mask"].split(",")]
    assert [got["ann"]["rendered"][a:b] for a, b in spans] == ["hi Ünal 😀<|end|>", "<|end|>"]


def test_blocks_in_order_are_the_dialogue(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(23)]
    whole = {r["perspective"]: r["rendered"] for r in rendered(spark, rows)}
    cut = sorted(rendered(spark, rows, block_turns=5), key=lambda r: r["block"])
    assert len(cut) == 10
    assert {p: "".join(r["rendered"] for r in cut if r["perspective"] == p) for p in whole} == whole


def test_defined_results(spark):
    rows = [(None, 0, "a", "x"), (None, 0, "b", "y"), (2, 0, "system", "s"), (3, None, "a", "first"), (3, 0, "a", "z"), (3, 0, "a", "z"), (3, 0, "a", "b")]
    got = sorted(((r["conv_id"] or 0, r["perspective"] or "", r["n_turns"], r["block"]) for r in rendered(spark, rows)))
    assert got == [(0, "a", 1, 0), (0, "b", 1, 0), (2, "", 1, 0), (3, "a", 1, -1), (3, "a", 2, 0)]
    assert rendered(spark, [(9, 0, "a", "x" * 300_000)])[0]["n_masked_in"] == 300_000 + len(q.END)
    assert q.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = q.rotate(spark.createDataFrame([(1, 0, "a", "x")], SCHEMA).limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
