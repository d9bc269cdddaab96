"""The corpus pipeline stage by stage, and the registered queries against their SQL."""

import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarrylens.llm import decontaminate, queries, token_shards
from tests.llm.test_documents import slow_sets
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_decisions(spark, stages):
    before, after = stages["language_id"]
    assert after.count() == before.count()
    before, after = stages["near_dedup"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert {r.doc_id for r in after.collect()} == {rows[root][0] for root in slow_sets([t for _, t in rows])}
    before, after = stages["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.overlap_report(before, bench).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = stages["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = stages["token_output"]
    assert {i for r in after.collect() for i in r.doc_ids} == {r.doc_id for r in before.collect()}


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("slot", "sequence", "n_tokens").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert len(rows) == stages["token_output"][1].count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note


def test_memory_of_workers(spark, monkeypatch):
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(batch), []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda spark, docs, _: seen.append(spark.conf.get(batch)) or docs)])
    corpus_pipeline.run(spark, SF)
    assert seen == [str(corpus_pipeline.BATCH_BYTES)] and spark.conf.get(batch) == before
    rows = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["word " * 20_000] * 60)], names=["doc_id", "text"])
    assert max(len(ids) for ids, _, _ in token_shards._encoded([rows], token_shards.Tokenizer)) <= 21
    monkeypatch.setattr(token_shards, "REMEMBERED", 4)
    made = []
    known = token_shards._Known(lambda w: made.append(w) or w.encode())
    assert [known[w] for w in "abacadaeafa"] == [w.encode() for w in "abacadaeafa"]
    assert made.count("a") == 1 and len(known) + len(known._older) <= 4


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def run_on(spark, folder, rows):
    """The pipeline on some rows of documents and the benchmark of the smallest tables."""
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_unusual_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, null ids: what is kept comes out once or as often as it is taken."""
    known = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(25).collect()]
    rows = [tuple(r) for r in known] + [tuple(known[0])] * 3 + [
        (None, known[1].text + " other words at the end of it", None, None, None), (None, None, None, None, None), (900, "", "en", "x", 0),
        (901, "12345 !!", "en", "x", 8), (902, known[2].text * 40, "en", None, None)]
    found = run_on(spark, tmp_path, rows)
    ids = {i for r in found for i in r.doc_ids}
    assert ids <= {r[0] for r in rows} and not {900, 901} & ids and len(ids) > 5
    assert sorted(r.slot for r in found) == list(range(len(found)))


def test_no_rows(spark, tmp_path):
    assert run_on(spark, tmp_path, []) == []
