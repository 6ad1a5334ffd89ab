"""Sources, sinks and the streaming ingest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators.ingest import chunk_pages
from lorekeep import ingest
from lorekeep.sources import files
from lorekeep.sources.files import json_lines, text_documents, vector_rows, write_table, write_vectors
from lorekeep.sources.library import Library, catalogue, hint_rows, hints_json
from lorekeep.streaming.ingest import start_ingest


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Core Rules v1.md").write_text("# T\nBody é")
    (tmp_path / "x.bin").write_bytes(b"1")
    r = text_documents(spark, str(tmp_path)).collect()
    assert [(x.doc_id, x.content, x.page_number) for x in r] == [("core-rules-v1", "# T\nBody é", 1)]
    (tmp_path / "l.jsonl").write_text('{"a":1}\nbad\n')
    assert [x.a for x in json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, None]
    v = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "v.bin").write_bytes(v.tobytes())
    assert [x.embedding for x in vector_rows(spark, str(tmp_path / "v.bin"), 4).orderBy("corpus_pos").collect()] == v.tolist()
    write_table(spark.range(3), str(tmp_path / "t"))
    write_table(spark.range(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_vectors_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "VECTOR_ROWS", 4)
    df = spark.range(10).select(F.col("id").alias("corpus_pos"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"))
    write_vectors(df, str(tmp_path / "v"), 2)
    got = vector_rows(spark, str(tmp_path / "v"), 2).orderBy("corpus_pos").collect()
    assert [(r.corpus_pos, r.embedding[0]) for r in got] == [(i, float(i)) for i in range(10)]
    (tmp_path / "v" / "other.f32").write_bytes(b"12345678")
    with pytest.raises(ValueError):
        vector_rows(spark, str(tmp_path / "v"), 2)


def test_library_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = "".join(f"word{i} " for i in range(150))
    (tmp_path / "in" / "Core.md").write_text(f"# Combat\n{body}\n# Magic\nMana costs are paid at once by all.\n")
    lib = Library(spark, str(tmp_path / "data"), "eval-lib")
    assert lib.manifest() is None and lib.graph() == {}
    with pytest.raises(FileNotFoundError):
        lib.load("chunks")
    with pytest.raises(ValueError):
        Library(spark, "x", "../y")
    assert ingest.build(spark, lib, str(tmp_path / "in"))
    assert not ingest.build(spark, lib, str(tmp_path / "in"))
    chunks = lib.load("chunks").orderBy("corpus_pos").collect()
    assert [(c.chunk_id, c.section_heading, c.corpus_pos, len(c.embedding)) for c in chunks] == [("core#0", "Combat", 0, 64), ("core#1", "Combat", 1, 64), ("core#2", "Magic", 2, 64)]
    assert set(lib.graph()) == {"sections", "edges"} and lib.load("edges").count() == 2
    m = lib.manifest().first()
    assert m.documents[0].chunkEnd == 2 and m.chunkParams.targetTokens == 300
    assert [tuple(r) for r in catalogue(spark, str(tmp_path / "data")).collect()] == [("eval-lib", "eval-lib", m.embeddingModel)]
    (tmp_path / "in" / "More.md").write_text("# New\nSome more words in a new file.\n")
    assert ingest.build(spark, lib, str(tmp_path / "in"), index=False)
    assert not lib.has("hints") and lib.load("notes") is None


def test_hint_files(spark):
    hints = spark.createDataFrame([("d", "Fire", "fire", [1, 2]), ("d", "Gate", "gate", [3])], "doc_id string, topic string, topic_norm string, pages array<int>")
    back = hint_rows(hints_json(hints))
    assert sorted((r.topic, r.pages) for r in back.collect()) == [("Fire", [1, 2]), ("Gate", [3])]


def test_stream_gives_the_windows_of_the_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("doc_id", "page_number", "content").dropDuplicates(["doc_id", "page_number"])
    pages.write.parquet(str(tmp_path / "in"))
    q = start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "doc_id string, page_number int, content string")
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = chunk_pages(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in want.collect())
