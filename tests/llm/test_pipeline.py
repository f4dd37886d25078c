"""The pipeline, stage by stage, and its queries against their SQL."""

import zlib

import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from oracle import differences, duck
from tablewarden.llm import langid, quality
from tablewarden.llm.common import BATCH_BYTES, BATCH_LIMIT, stored, table
from tablewarden.llm.queries import ORACLE, QUERIES

from .test_texts import brute_near, brute_passages

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLE[name]) == []


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    out = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
    before, after = out["quality"]
    scored = quality.classify(before, quality.train(before, table(spark, SF, "labels")))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in scored.where("score >= 0.7").select("doc_id").collect()}
    clean = table(spark, SF, "labels").where("quality = 1").select("doc_id").join(before, "doc_id", "left_semi")
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.01 * clean.count()
    before, after = out["language"]
    found = langid.identify(before, langid.train(before)).where("accepted").select("doc_id").collect()
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in found} and after.count() >= 0.97 * before.count()
    before, after = out["near_copies"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {i for i, (c, _) in brute_near(rows).items() if c == i}
    before, after = out["repeated_passages"]
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    want = brute_passages(rows.items(), 50)
    for r in after.collect():
        _, gone, kept = want[r["doc_id"]]
        assert r["text"] == (kept if gone else rows[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    before, after = out["packing"]
    t = Tokenizer.from_file(P.path(pipeline.TOKENIZER))
    sums = {}
    for r in before.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            data = b"".join(i.to_bytes(4, "little") for i in ids[k:k + 4096])
            sums[r["doc_id"], k // 4096] = (k, len(data) // 4, zlib.crc32(data))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in after.collect()} == sums


def test_edge_rows_go_through(spark, edge_docs, no_docs):
    for docs in (edge_docs.withColumn("row", edge_docs.score), no_docs):
        for name, stage in pipeline.STAGES:
            after = stored(stage(spark, docs, SF), f"test-{name}")
            if name != "packing":
                assert after.columns == docs.columns
            if name in ("near_copies", "repeated_passages") and docs.count():
                ids = [r["doc_id"] for r in after.collect()]
                assert None in ids and (ids.count(7) <= 1 if name == "near_copies" else True)


def test_stages_send_whole_texts_to_python_in_bounded_batches(spark):
    """A batch of 10,000 such rows has 30 MB, which an executor holds several times over for each task."""
    before = spark.conf.get(BATCH_LIMIT)
    docs = stored(spark.range(10_000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 500) AS text", "'en' AS lang").coalesce(1), "test-batches")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    try:
        for stage in (pipeline.known_language, pipeline.without_near_copies, pipeline.without_repeated_passages, pipeline.packed):
            spark.conf.unset(BATCH_LIMIT)
            stage(spark, docs.limit(3), SF)
            seen = docs.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in seen) == 10_000 and max(r["bytes"] for r in seen) <= 2 * BATCH_BYTES, stage.__name__
    finally:
        spark.conf.set(BATCH_LIMIT, before)
