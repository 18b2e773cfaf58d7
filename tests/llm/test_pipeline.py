import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import corpus_pipeline as p
from helpers import odd_docs
from test_decontam import brute as plain_hits
from test_linededup import brute as plain_lines
from test_neardup import brute as plain_components
from test_quality import base
from voxtable.llm import linededup, quality

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_the_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert [name for name, _ in p.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = out.select("doc_id").distinct()
        if name == "quality_rules":
            good = labels.filter("quality = 1").join(docs, "doc_id").filter(F.size(F.split("text", r"\s+")) > 300)
            assert good.join(kept, "doc_id", "left_anti").count() <= 2
        elif name == "line_dedup":
            assert out.count() == docs.count() and out.filter("n_chars <> length(text)").count() == 0
        else:
            assert 0.5 * docs.count() < out.count() < docs.count(), name


def test_run_gives_one_row_of_ids_per_document_kept(spark):
    rows = p.run(spark, DATA)
    assert rows.filter("not round_trip").count() == 0
    assert 100 < rows.count() == rows.select("doc_id").distinct().count() <= 200


def test_stages_stand_odd_rows(spark):
    docs = odd_docs(spark, "lang", "source", "kept", "row").withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in p.STAGES:
        assert stage(spark, docs, DATA).count() <= 7
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_every_stage_equals_a_plain_chain(spark, tmp_path):
    """Ids and texts after each stage, against the plain versions of the five rules; the CRF's weights are taken as given."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 5000")
    for name, df in (("documents", docs), ("labels", spark.read.parquet(f"{DATA}/labels.parquet")), ("benchmark", spark.read.parquet(f"{DATA}/benchmark.parquet"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    docs, labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    verdicts = {r["doc_id"]: r for r in quality.quality(docs, quality.train(docs, labels)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    chain = [[(i, t) for i, t in rows if not base(t)[-1] and verdicts[i]["content_share"] >= quality.MIN_CONTENT_SHARE]]
    short = plain_lines(chain[0], linededup.MIN_WORDS)
    chain.append([(i, short[i, t][0]) for i, t in chain[0]])
    label = plain_components(chain[1], 5, 80)
    chain.append([(i, t) for i, t in chain[1] if label[i] == i])
    bad = {r[0] for r in plain_hits(chain[2], [(r["item_id"], r["text"]) for r in items.collect()]) if r[-1]}
    chain.append([(i, t) for i, t in chain[2] if i not in bad])
    assert len(rows) > len(chain[0]) > len(chain[2]) > len(chain[3]) > 50
    out = docs
    for (name, stage), want in zip(p.STAGES[:-1], chain):
        out = stage(spark, out, folder)
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(want), name
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["ids"] for r in p.run(spark, folder).collect()}
    assert got == {i: library.encode(t) for i, t in chain[-1]}
