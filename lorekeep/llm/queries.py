"""The problems' queries over this project's tables, with production parameters over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.concepts import normalize_concept
from lorekeep.functions.whitespace import collapse_ws, trim_ws
from lorekeep.llm.cooccurrence import cooccurrence
from lorekeep.llm.frequency import marked, term_frequency
from lorekeep.llm.furniture import repeated_lines, without_lines, without_phrases
from lorekeep.llm.items import current_sections, long_items
from lorekeep.llm.language import fit_languages, fit_words, label_defects, language_runs
from lorekeep.llm.neighbors import mutual_pairs, nearest_vectors
from lorekeep.llm.packing import pack_texts
from lorekeep.llm.pairs import pair_defects
from lorekeep.llm.splitting import split_oversized
from lorekeep.llm.tokens import encode_corpus
from lorekeep.operators.current import current_rows
from lorekeep.sources.tables import table

LIMIT, OVERLAP = 2000, 200
MIN_PAIR, MIN_LIFT = 12, 8.0
RARE_BELOW, COMMON_ABOVE = 3, 0.2
NEIGHBORS, LIKE = 10, 0.90
MIN_PAGES, MIN_SHARE = 5, 0.15
CAPACITY = 2048


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(long_items(spark, sf_dir, LIMIT), ["item_kind", "item_id"], "item", LIMIT, OVERLAP)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current items of more than 2,000 code points and how they were cut."""
    return _pieces(spark, sf_dir).select("item_kind", "item_id", "cut")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves."""
    return _pieces(spark, sf_dir).select("item_kind", "item_id", F.explode("pieces").alias("p")).select(
        "item_kind", "item_id", "p.*"
    )


def _names(*columns: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.transform(F.concat(*(F.coalesce(F.col(c), empty) for c in columns)), normalize_concept)


def _section_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of current sections, which is that of distinct ids."""
    return table(spark, sf_dir, "sections").select("section_id").distinct().agg(F.count(F.lit(1)).alias("n"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept pairs named together by at least 12 sections and at least 8 times as often as by chance."""
    sections = current_sections(spark, sf_dir, "concepts", "refs").select(
        "section_id", _names("concepts", "refs").alias("names")
    )
    found = cooccurrence(sections, "section_id", "names", _section_total(spark, sf_dir), MIN_PAIR, MIN_LIFT)
    return found.select(
        F.col("item_a").alias("concept_a"),
        F.col("item_b").alias("concept_b"),
        "n_ab",
        "n_a",
        "n_b",
        F.round("lift", 6).alias("lift"),
        F.round("pmi", 6).alias("pmi"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs alone."""
    return p2_pairs(spark, sf_dir).select("concept_a", "concept_b")


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors of every usable chunk vector and of every usable section vector."""
    parts = []
    for name, key in (("chunks", "chunk_id"), ("sections", "section_id")):
        df = table(spark, sf_dir, name).select(key, "embedding", "ingested_at")
        near = nearest_vectors(df, key, "embedding", NEIGHBORS, "ingested_at")
        parts.append(near.select(F.lit(name).alias("item_kind"), "id", "rank", "other", "cosine"))
    return parts[0].unionAll(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual neighbours with a cosine of at least 0.90."""
    parts = []
    for name, key in (("chunks", "chunk_id"), ("sections", "section_id")):
        df = table(spark, sf_dir, name).select(key, "embedding", "ingested_at")
        parts.append(mutual_pairs(nearest_vectors(df, key, "embedding", NEIGHBORS, "ingested_at", LIKE)))
    return parts[0].unionAll(parts[1])


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and sections of every concept, marked where too rare or too common."""
    sections = current_sections(spark, sf_dir, "concepts", "defines", "refs").select(
        _names("concepts", "defines", "refs").alias("names")
    )
    found = marked(term_frequency(sections, "names"), _section_total(spark, sf_dir), RARE_BELOW, COMMON_ABOVE)
    return found.select(F.col("term").alias("concept"), "occurrences", F.col("records").alias("sections"), "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked concepts."""
    return p4_terms(spark, sf_dir).where("mark is not null").select("concept", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and summaries that do not answer their question, with the kind of defect."""
    results = current_rows(
        table(spark, sf_dir, "query_results").select("result_id", "question_id", "answer", "spoken_summary", "answered_at"),
        ["result_id"],
        "answered_at",
    )
    questions = table(spark, sf_dir, "questions").groupBy("question_id").agg(F.min("question").alias("prompt"))
    samples = table(spark, sf_dir, "lang_samples")
    found = pair_defects(
        results.join(questions, "question_id", "left"),
        {"answer": True, "spoken_summary": False},
        table(spark, sf_dir, "documents"),
        "text",
        fit_languages(samples),
        fit_words(samples),
        "result_id",
    )
    return found.select("result_id", "field", "defect")


def _current_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("doc_id", "page_number", "content", "ingested_at")
    return current_rows(df, ["doc_id", "page_number"]).drop("ingested_at")


def _repeated(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    return repeated_lines(pages, "doc_id", "page_number", "content", MIN_PAGES, MIN_SHARE)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence of a line that stands on far too many pages of its book."""
    return _repeated(_current_pages(spark, sf_dir))[0].select(
        F.col("source").alias("doc_id"), F.col("page").alias("page_number"), "line_no"
    )


def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of such lines that follow each other down the pages of a book."""
    return _repeated(_current_pages(spark, sf_dir))[1].withColumnRenamed("source", "doc_id")


def p6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current page without its repeated lines."""
    pages = _current_pages(spark, sf_dir)
    return without_lines(pages, _repeated(pages)[0], "doc_id", "page_number", "content")


def p6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current chunk without the repeated lines of the pages it stands on."""
    pages = _current_pages(spark, sf_dir)
    at = ["doc_id", "page_number"]
    gone = _repeated(pages)[0].select(F.col("source").alias("doc_id"), F.col("page").alias("page_number"), "line_no")
    # a line with the words around it, as they follow each other in a chunk
    flat = F.transform(F.split("content", "\n"), lambda x: trim_ws(collapse_ws(x)))
    words = F.transform("all", lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))
    before = lambda i: F.element_at(F.flatten(F.slice("ws", 1, i)), -1)
    after = lambda i: F.get(F.flatten(F.slice("ws", i + 2, F.size("ws"))), F.lit(0))
    lines = (
        pages.join(gone.groupBy(*at).agg(F.sort_array(F.collect_set("line_no")).alias("nos")), at)
        .select(*at, "nos", flat.alias("all"))
        .withColumn("ws", words)
        .select(
            *at,
            F.transform(
                "nos",
                lambda i: F.struct(
                    F.when(F.size(F.flatten(F.slice("ws", 1, i))) > 0, before(i)).alias("before"),
                    F.get("all", i).alias("line"),
                    after(i).alias("after"),
                ),
            ).alias("lines"),
        )
    )
    chunks = current_rows(
        table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "page_start", "page_end", "text", "ingested_at"),
        ["chunk_id"],
    ).select(
        "chunk_id", "doc_id", "text", F.explode_outer(F.when(F.col("page_start") <= F.col("page_end"), F.sequence("page_start", "page_end"))).alias("page_number")
    )
    found = without_phrases(chunks, "chunk_id", "text", lines, at)
    return found.select("chunk_id", F.col("after").alias("text"), (~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document, or which part of one longer than a container, lies in which container of 2,048 tokens."""
    return pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY).select(
        "container", F.col("item").cast("long").alias("doc_id"), "piece_no", "start", "size"
    )


def _language_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_languages(table(spark, sf_dir, "lang_samples"))
    return language_runs(table(spark, sf_dir, "documents"), model, "doc_id", "text", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and wrong labels, and the runs of texts in several languages."""
    return label_defects(_language_runs(spark, sf_dir), "doc_id", "lang").select("doc_id", "defect", "seg_start", "lang")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language and confidence of every document, and its runs."""
    return _language_runs(spark, sf_dir).select("doc_id", F.col("main").alias("lang"), "confidence", "runs")
