"""The registered queries over the small tables, and the pipeline against plain versions of its decisions."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from momentspark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"], 2: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], 3: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    4: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], 5: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], 6: ["doc_id", "start", "n_tokens", "ids_crc32"],
    7: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], 8: ["page_id", "url", "text", "n_chars"], 9: ["doc_id", "fingerprint", "component_id"], 10: ["vec_id", "n_links", "component_id", "kept"],
    11: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], 12: ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    13: ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    want = COLUMNS[int(name[2:].split("_")[0])]
    assert rows.columns[: len(want)] == want
    source = {"op8": "pages", "op10": "embeddings", "op12": "conversations", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    whole = spark.read.parquet(f"{SF}/{source}.parquet")
    assert rows.count() >= (whole.select("conv_id").distinct() if source == "conversations" else whole).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    with duckdb.connect() as c:
        for t in ("documents", "pages", "embeddings", "labels", "conversations"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "simhash":
            shingles = {}
            for r in before.collect():
                w = r["text"].lower().split()
                shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            like = lambda x, y: len(shingles[x] & shingles[y]) / len(shingles[x] | shingles[y])  # noqa: B023, E731
            kept = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
            missed = sum(like(a, b) >= 0.8 for i, a in enumerate(kept) for b in kept[i + 1 :])
            gone = set(shingles) - set(kept)
            assert missed == 0 and all(max(like(d, e) for e in shingles if e != d) >= 0.8 for d in gone)
        if name == "secrets":
            assert docs.count() == before.count() and docs.where("text rlike '[0-9a-f]{16}'").count() == 0
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
