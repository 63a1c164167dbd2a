"""The pipeline's stages, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from .helpers import documents, write_tables  # noqa: E402
from .test_others import language_rows  # noqa: E402
from .test_tokens import check_packing  # noqa: E402


def test_stages_and_run(spark, tmp_path):
    rows = language_rows(120)
    copies = [(1000 + i, rows[i][1], rows[i][2], "s", 1, None) for i in range(20)]
    secret = [(2000, rows[0][1].split("\n")[0][:40] + " different password=abcdefghijklmnop text at the end", "en", "s", 1, None)]
    df = documents(spark, rows + copies + secret).unionByName(documents(spark).filter("doc_id <> 6").withColumn("doc_id", F.col("doc_id") + 5000))
    folder = write_tables(spark, tmp_path, documents=df)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert out.columns == df.columns
        path = str(tmp_path / f"{name}.parquet")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    assert not {5001, 5002, 5003} & {r.doc_id for r in seen["language_id"]}  # no language there
    assert {r.doc_id for r in seen["language_id"]} >= set(range(120)) | set(range(1000, 1020))
    assert not set(range(1000, 1020)) & {r.doc_id for r in seen["line_dedup"]}  # copies of earlier lines
    assert {r.doc_id for r in seen["secret_scan"]} == {r.doc_id for r in seen["near_dedup"]}
    text = next(r.text for r in seen["secret_scan"] if r.doc_id == 2000)
    assert "abcdefghijklmnop" not in text and "different" in text
    check_packing(seen["best_fit_packing"], 2048)
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in again) == sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in seen["best_fit_packing"])
