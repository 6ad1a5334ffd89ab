"""Building a library from files: ``python -m lorekeep.ingest --library ID --path FOLDER [--data DIR] [--rebuild] [--no-index]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graph as gr
from lorekeep.operators import ingest as ing
from lorekeep.params import Params, load_params
from lorekeep.providers import DocumentParser, Embedder, HashEmbedder, MarkdownParser, embedded
from lorekeep.sources.files import discovered
from lorekeep.sources.library import Library


def build(
    spark: SparkSession,
    library: Library,
    path: str,
    params: Params | None = None,
    parser: DocumentParser | None = None,
    embedder: Embedder | None = None,
    rebuild: bool = False,
    index: bool = True,
) -> bool:
    """Writes chunks, sections, edges and hints of all files under ``path``, and the manifest; whether anything was done.

    Nothing is done where every file has the digest that the manifest names, unless ``rebuild``; files that are gone do not count.
    Concept lists are left empty: they come from model outputs, see ``operators.enrich``.
    """
    p = params or Params()
    parser, embedder = parser or MarkdownParser(), embedder or HashEmbedder()
    files = discovered(spark, path)
    before = library.manifest()
    if before is not None and not rebuild:
        known = before.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("doc_id"), F.col("d.sha256").alias("sha256"))
        if ing.changed_documents(files.select("doc_id", "sha256"), known).isEmpty():
            return False
    pages = parser.pages(spark, path)
    chunks = ing.chunk_pages(pages, target=p.target_tokens, overlap=p.overlap_tokens).withColumns(
        {"library_id": F.lit(library.id), "page_start": F.col("page_number"), "page_end": F.col("page_number")}
    )
    placed = _placed(chunks.drop("page_number"))
    library.save("chunks", embedded(placed, "text", embedder))
    stored = library.load("chunks")
    sections = ing.section_islands(stored).join(ing.section_synopses(stored, budget=p.section_tokens), ["doc_id", "section_index"])
    none = F.array().cast("array<string>")
    library.save("sections", embedded(sections.withColumns({c: none for c in ("concepts", "defines", "refs", "see_also")}), "synopsis", embedder))
    library.save("edges", gr.order_edges(library.load("sections")))
    library.remove("hints")
    if index:
        library.save("hints", ing.index_entries(pages))
    library.save_manifest(_manifest(library.id, files, pages, stored, p, embedder))
    return True


def _placed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``corpus_pos``: documents by id, chunks in order, numbered from 0."""
    sizes = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # one row for each document
    from pyspark.sql import Window

    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return chunks.join(starts.drop("n"), "doc_id").withColumn("corpus_pos", F.col("start") + F.col("chunk_index")).drop("start")


def _manifest(library_id: str, files: DataFrame, pages: DataFrame, chunks: DataFrame, p: Params, embedder: Embedder) -> DataFrame:
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    ranges = ing.chunk_ranges(chunks)
    docs = files.join(counted, "doc_id", "left").join(ranges, "doc_id", "left")
    row = F.struct(
        F.col("doc_id").alias("id"), "label", "sha256", F.col("n_pages").alias("pageCount"), F.col("chunk_start").alias("chunkStart"), F.col("chunk_end").alias("chunkEnd")
    )
    # a row for each file
    listed = docs.agg(F.array_sort(F.collect_list(row)).alias("documents"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return listed.select(
        F.lit(library_id).alias("id"),
        F.lit(library_id).alias("label"),
        F.lit(p.embed_model).alias("embeddingModel"),
        F.lit(embedder.width).alias("embeddingDimensions"),
        now.alias("createdAt"),
        now.alias("updatedAt"),
        F.struct(F.lit(p.target_tokens).alias("targetTokens"), F.lit(p.overlap_tokens).alias("overlapTokens")).alias("chunkParams"),
        "documents",
    )


def main(argv: list[str] | None = None) -> None:
    """The command line."""
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--library", required=True)
    args.add_argument("--path", required=True)
    args.add_argument("--data", default=None)
    args.add_argument("--config", default=None)
    args.add_argument("--rebuild", action="store_true")
    args.add_argument("--no-index", action="store_true")
    a = args.parse_args(argv)
    p = load_params(a.config)
    spark = SparkSession.builder.appName("lorekeep-ingest").getOrCreate()
    done = build(spark, Library(spark, a.data or p.data_dir, a.library), a.path, p, rebuild=a.rebuild, index=not a.no_index)
    print("written" if done else "nothing has changed")


if __name__ == "__main__":
    main()
