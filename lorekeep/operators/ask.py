"""Asking a batch of questions from request to result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import estimated_tokens, reconciled_confidence, reconciled_summary
from lorekeep.functions.whitespace import is_blank, trim_ws
from lorekeep.operators.citations import formatted, parsed_output
from lorekeep.operators.lexical import lexical_of
from lorekeep.operators.prompt import blended, within_budget
from lorekeep.operators.retrieve import hybrid, with_neighbors
from lorekeep.params import Params
from lorekeep.session import cut

MAX_QUESTION = 32_768


def request_errors(requests: DataFrame, libraries: DataFrame, model: str | Column) -> DataFrame:
    """question_id, error: the first reason for which a request (question_id, library_id, question, history) cannot be answered.

    In this order: no library, no question, a question of more than 32,768 characters, a history turn that is null, has a role
    other than user or assistant or no content, a library that is not there (library_id, embedding_model), one built with
    another embedding model. ``model`` is the model in use; requests without error are not in the result.
    """
    model = F.lit(model) if isinstance(model, str) else model
    known = libraries.select("library_id", F.col("embedding_model").alias("__model")).dropDuplicates(["library_id"])
    bad_turn = F.exists(
        F.coalesce("history", F.array().cast(requests.schema["history"].dataType)),
        lambda h: h.isNull() | ~F.coalesce(h["role"].isin("user", "assistant"), F.lit(False)) | h["content"].isNull(),
    )
    q = trim_ws(F.coalesce("question", F.lit("")))
    error = (
        F.when(is_blank(F.col("library_id")), "missing library")
        .when(q == "", "missing question")
        .when(F.length(q) > MAX_QUESTION, "question too long")
        .when(bad_turn, "invalid history")
        .when(F.col("__model").isNull(), "library not found")
        .when(F.col("__model") != model, "embedding model mismatch")
    )
    joined = requests.join(known.withColumnRenamed("library_id", "__library"), trim_ws(F.col("library_id")) == F.col("__library"), "left")
    return joined.select("question_id", error.alias("error")).where("error is not null")


def excerpts(corpus: DataFrame, questions: DataFrame, p: Params, sections: DataFrame | None = None, hints: DataFrame | None = None, doc_vectors: DataFrame | None = None) -> DataFrame:
    """question_id, place, chunk_id, doc_id, page_start, page_end, text, tokens, total_tokens: what enters each prompt.

    The fused ranking with its neighbours, reordered by a blend of lexical score and retrieval order, up to the token
    budget. ``corpus`` is that of one library, as for ``hybrid``.
    """
    picked = hybrid(corpus, questions, p, sections, hints, doc_vectors)
    more = ("corpus_pos", "chunk_id", "page_start", "page_end", "text")
    whole = cut(with_neighbors(picked, corpus, p.neighbor_window, p.neighbor_expand_top, more=more).withColumnRenamed("place", "rank"))
    lex = lexical_of(whole, questions)
    placed = blended(whole.join(lex.select("question_id", "corpus_pos", "lex"), ["question_id", "corpus_pos"], "left").fillna(0.0, ["lex"]), p.reorder_blend)
    body = F.concat(F.lit("[CHUNK_ID: "), F.col("chunk_id"), F.lit("]\n"), F.col("text"), F.lit("\n"))
    counted = placed.withColumn("excerpt", body).withColumn("tokens", estimated_tokens(F.col("excerpt")))
    return within_budget(counted, "tokens", p.excerpt_budget)


def generated(raw: DataFrame, prompt: DataFrame, key: str = "result_id") -> DataFrame:
    """key, question_id, question, answer, spoken_summary, confidence, cited: model outputs, parsed and reconciled.

    ``raw``: key, question_id, question, raw (a model's JSON). ``prompt``: question_id and a row for each excerpt it saw.
    """
    seen = prompt.groupBy("question_id").agg(F.count(F.lit(1)).alias("__seen"))
    out = raw.join(seen, "question_id", "left").withColumn("o", parsed_output(F.col("raw")))
    confidence = reconciled_confidence(F.col("o.confidence"), F.col("o.answer"), F.size("o.cited"), F.coalesce("__seen", F.lit(0)))
    return out.select(
        key,
        "question_id",
        "question",
        F.col("o.answer").alias("answer"),
        reconciled_summary(F.col("o.spoken_summary"), F.col("o.answer")).alias("spoken_summary"),
        confidence.alias("confidence"),
        F.col("o.cited").alias("cited"),
    )


def answered(corpus: DataFrame, questions: DataFrame, raw: DataFrame, p: Params, sections: DataFrame | None = None, hints: DataFrame | None = None, doc_vectors: DataFrame | None = None, key: str = "result_id") -> DataFrame:
    """One formatted result for each row of ``raw`` (key, question_id, question, raw): retrieval, prompt, output, citations."""
    prompt = cut(excerpts(corpus, questions, p, sections, hints, doc_vectors))
    outputs = cut(generated(raw, prompt, key))
    seen = outputs.select(key, "question_id").join(prompt, "question_id").select(key, "place", "chunk_id", "doc_id", "page_start", "page_end", "text")
    return formatted(outputs, seen, corpus.select("chunk_id", "doc_id", "page_start", "page_end", "text"), p.provenance_per_document, key)
