"""Queries on the engine's operators over whole tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import parsing as ps
from lorekeep.functions import text as tx
from lorekeep.functions.concepts import normalize_concept
from lorekeep.functions.snippets import focused
from lorekeep.operators import ask as ak
from lorekeep.operators import citations as ci
from lorekeep.operators import enrich as en
from lorekeep.operators import graph as gr
from lorekeep.operators import ingest as ing
from lorekeep.operators import lexical as lx
from lorekeep.operators import prompt as pr
from lorekeep.operators import retrieve as rt
from lorekeep.operators.current import current_apart, current_rows
from lorekeep.params import Params
from lorekeep.session import cut, together
from lorekeep.sources.tables import table

P = Params()
# with every lane on
ALL_LANES = dataclasses.replace(P, graph_weight=0.1, define_weight=0.05, doc_router_weight=0.1)
# a search that says so takes every hundredth question as its stated set of queries, against all rows; the others take all of them
EVERY = 100
SYSTEM = "Answer from the excerpts only. Cite the CHUNK_ID of every excerpt you use. Say so if they do not answer."


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "chunks").select("chunk_id", *columns, "ingested_at"), ["chunk_id"]).drop("ingested_at")


def _sections(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "sections").select("section_id", *columns, "ingested_at"), ["section_id"]).drop("ingested_at")


def _pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = table(spark, d, "pages").select("doc_id", "page_number", *columns, "ingested_at")
    return current_rows(df, ["doc_id", "page_number"]).drop("ingested_at")


def _questions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "questions").select("question_id", *columns).dropDuplicates(["question_id"])


def _asked(spark: SparkSession, d: str, every: int | None, *more: str) -> DataFrame:
    asked = _questions(spark, d, "question", "query_vec", *more)
    return asked if every is None else asked.where(F.col("question_id") % every == 0)


def _results(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = table(spark, d, "query_results").select("result_id", *columns, "answered_at")
    return current_rows(df, ["result_id"], "answered_at").drop("answered_at")


def _corpus(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _surfaced(_chunks(spark, d, "corpus_pos", "section_heading", "text", *columns))


def _surfaced(df: DataFrame) -> DataFrame:
    return df.withColumn("text", tx.surface(F.col("section_heading"), F.coalesce("text", F.lit("")))).drop("section_heading")


def _full_corpus(spark: SparkSession, d: str) -> DataFrame:
    # every lane reads some columns of it
    columns = ("corpus_pos", "section_heading", "text", "doc_id", "chunk_index", "page_start", "page_end", "embedding")
    return _surfaced(current_apart(table(spark, d, "chunks").select("chunk_id", *columns, "ingested_at"), ["chunk_id"]).drop("ingested_at"))


def _graph_sections(spark: SparkSession, d: str) -> DataFrame:
    # read by each step of an expansion
    return cut(_sections(spark, d, "doc_id", "section_index", "title", "see_also", "defines", "refs", "chunk_ids"))


def _doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, embedding: the mean of a document's usable section vectors."""
    usable = _sections(spark, d, "doc_id", "embedding").where("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x))")
    sums = usable.groupBy("doc_id").agg(*(F.avg(F.get("embedding", F.lit(i))).alias(f"x{i}") for i in range(64)))
    return sums.select("doc_id", F.array(*(F.col(f"x{i}") for i in range(64))).alias("embedding"))


def _hints(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("doc_id", "page_number", "content", "ingested_at")
    return cut(ing.index_entries(current_apart(pages, ["doc_id", "page_number"]).drop("ingested_at")))


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Slug and digest of document labels."""
    df = table(spark, d, "library_docs").select("doc_id", "label").distinct()
    return df.select("doc_id", "label", tx.slug(F.col("label")).alias("slug"), F.sha2("label", 256).alias("label_hash"))


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Normalised section titles."""
    return _sections(spark, d, "title").select("section_id", normalize_concept(F.col("title")).alias("title_key"))


def question_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of every question."""
    q = _questions(spark, d, "question")
    return q.select("question_id", F.array_join(tx.question_terms(F.col("question")), " ").alias("terms"), tx.about_stacking(F.col("question")).alias("stacking"))


def concept_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of every question that may name a concept."""
    q = _questions(spark, d, "question")
    return q.select("question_id", F.array_join(F.array_sort(tx.concept_phrases(F.col("question"))), "|").alias("phrases"))


def dense_topk(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """The chunks of greatest cosine for the stated questions."""
    corpus = _chunks(spark, d, "corpus_pos", "embedding")
    found = rt.dense_scores(corpus, _asked(spark, d, every), P.top_k)
    return found.select("question_id", "corpus_pos", F.round("dense", 5).alias("dense"), "rank")


def lexical_topk(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """The lexical lane for the stated questions."""
    found = rt.ranked(lx.lexical_best(_corpus(spark, d), _asked(spark, d, every), P.lexical_top), "lex", P.lexical_top)
    return found.select("question_id", "corpus_pos", F.round("lex", 6).alias("lex"), "rank")


def _shown(picked: DataFrame) -> DataFrame:
    return picked.select("question_id", "corpus_pos", "doc_id", "chunk_index", F.round("score", 5).alias("score"), "rank", "pick")


def hybrid_retrieve(spark: SparkSession, d: str, every: int | None = None) -> DataFrame:
    """The picks of the fused ranking for all questions, with the default weights: dense, lexical and index hints."""
    return _shown(rt.hybrid(_full_corpus(spark, d), _asked(spark, d, every), P, hints=_hints(spark, d)))


def hybrid_all_lanes(spark: SparkSession, d: str, every: int | None = None) -> DataFrame:
    """The picks of the fused ranking for all questions with the lanes of graph, concepts and document router too."""
    found = rt.hybrid(_full_corpus(spark, d), _asked(spark, d, every), ALL_LANES, _graph_sections(spark, d), _hints(spark, d), _doc_vectors(spark, d))
    return _shown(found)


def neighbor_expand(spark: SparkSession, d: str, every: int | None = None) -> DataFrame:
    """The picks of the fused ranking for all questions with the chunks around the first ones."""
    corpus = _full_corpus(spark, d)
    picked = rt.hybrid(corpus, _asked(spark, d, every), P, hints=_hints(spark, d))
    return rt.with_neighbors(picked, corpus, P.neighbor_window, P.neighbor_expand_top)


def router_boosts(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """Document boosts from mean section vectors."""
    found = rt.router_boosts(_doc_vectors(spark, d), _asked(spark, d, every), ALL_LANES.doc_router_weight)
    return found.select("question_id", "doc_id", F.round("boost", 5).alias("boost"))


def define_lane(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of sections that define a concept a question may name."""
    sections = _sections(spark, d, "defines", "chunk_ids")
    found = rt.define_lane(_questions(spark, d, "question"), sections, P.define_top, 0.05)
    return found.select("question_id", "chunk_id", "hits", F.round("boost", 6).alias("boost"))


def define_debug(spark: SparkSession, d: str) -> DataFrame:
    """What the concept lane looked for and found."""
    sections = _sections(spark, d, "defines", "chunk_ids")
    q = _questions(spark, d, "question")
    phrases = rt.question_phrases(q)
    met = cut(rt.met_concepts(phrases.select(F.explode("phrases").alias("phrase")), rt.define_keys(sections)))
    lane = rt.define_lane(q, sections, P.define_top, 0.05, phrases=phrases, met=met)
    found = rt.define_debug(q, sections, lane, phrases=phrases, met=met)
    return found.select("question_id", "phrase_count", "chunks_seeded", F.array_join("matched_pairs", "|").alias("matched_pairs"))


def page_segments(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut at headings."""
    return ing.page_segments(_pages(spark, d, "content"), ["doc_id", "page_number"])


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as one segment each, cut into overlapping windows."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = ing.token_windows(docs, ["doc_id"], "text", P.target_tokens, P.overlap_tokens)
    return found.select("doc_id", "window_no", "token_count", F.md5("text").alias("text_md5"))


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Current pages as heading-aware, overlapping chunks."""
    return ing.chunk_pages(_pages(spark, d, "content"))


def section_islands(spark: SparkSession, d: str) -> DataFrame:
    """Sections as runs of chunks under one heading."""
    chunks = _chunks(spark, d, "doc_id", "chunk_index", "section_heading", "page_start", "page_end")
    return ing.section_islands(chunks).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


def section_edges(spark: SparkSession, d: str) -> DataFrame:
    """Next and previous section."""
    return gr.order_edges(_sections(spark, d, "doc_id", "section_index")).select("src", "dst", "type", "weight")


def concept_edges(spark: SparkSession, d: str) -> DataFrame:
    """How many edges over concepts leave each section, as a reference or as a definition, and over how many concepts."""
    return gr.concept_links(_sections(spark, d, "defines", "refs"))


def see_also_edges(spark: SparkSession, d: str) -> DataFrame:
    """Sections that name others of their document."""
    return gr.see_also_edges(_sections(spark, d, "doc_id", "title", "see_also")).select("src", "dst", "type", "weight")


def graph_boosts(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """Chunks next to the best chunks of the stated questions in the section graph."""
    chunks = _chunks(spark, d, "corpus_pos", "embedding")
    seeds = rt.dense_scores(chunks, _asked(spark, d, every), P.graph_seeds)
    named = seeds.join(_chunks(spark, d, "corpus_pos"), "corpus_pos").select("question_id", "chunk_id")
    found = gr.neighbor_boosts(named, _graph_sections(spark, d), P.graph_edge_types, P.graph_per_hit, 0.1)
    return found.select("question_id", "chunk_id", F.round("boost", 6).alias("boost"))


def doc_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Most named and defined concepts of every document."""
    found = gr.document_summaries(_sections(spark, d, "doc_id", "section_index", "concepts", "defines"))
    return found.select("doc_id", F.array_join("top_concepts", "|").alias("top_concepts"), F.array_join("authoritative_for", "|").alias("authoritative_for"))


def document_notes(spark: SparkSession, d: str) -> DataFrame:
    """The map of contents of every document."""
    s = _sections(spark, d, "doc_id", "section_index", "title", "concepts", "defines", "refs")
    labels = current_rows(table(spark, d, "library_docs").select("doc_id", "label", "sha256", "created_at").distinct(), ["doc_id"], "created_at").select("doc_id", "label")
    found = gr.document_notes(gr.document_summaries(s), gr.rollups(s), labels)
    return found.select("doc_id", "scope_summary", F.md5("rollup").alias("rollup_md5"), F.length("rollup").alias("rollup_chars"))


def section_synopses(spark: SparkSession, d: str) -> DataFrame:
    """Title and text of every section of the current chunks, cut to 700 tokens."""
    chunks = _chunks(spark, d, "doc_id", "chunk_index", "section_heading", "page_start", "text")
    found = ing.section_synopses(chunks)
    return found.select("doc_id", "section_index", F.md5("synopsis").alias("synopsis_md5"))


def enrich_sections(spark: SparkSession, d: str) -> DataFrame:
    """Concept lists of the sections' synopses, from outputs that are kept under a digest of the synopsis.

    The outputs are those lists of the table that a model would have written, for every section whose synopsis is there.
    """
    s = _sections(spark, d, "synopsis", "concepts", "defines", "refs", "see_also")
    raw = F.to_json(
        F.struct("concepts", F.col("defines").alias("definesConcepts"), F.col("refs").alias("referencesConcepts"), F.col("see_also").alias("seeAlsoTitles"))
    )
    keyed = s.select(ps.enrichment_key(F.coalesce("synopsis", F.lit(""))).alias("cache_key"), "section_id", raw.alias("raw"))
    outputs = keyed.groupBy("cache_key").agg(F.min_by("raw", "section_id").alias("raw"))
    found = en.enriched(s.select("section_id", "synopsis"), outputs)
    return found.select("section_id", "cache_key", *(F.array_join(c, "|").alias(c) for c in ("concepts", "defines", "refs")), "enriched")


def index_entries(spark: SparkSession, d: str) -> DataFrame:
    """Back-of-book indexes."""
    found = ing.index_entries(_pages(spark, d, "content"))
    return found.select("doc_id", "topic", "topic_norm", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def index_hint_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks on the pages that an index names for a question's terms."""
    chunks = _chunks(spark, d, "doc_id", "page_start", "page_end")
    return rt.hint_boosts(_hints(spark, d), _questions(spark, d, "question"), chunks, P.index_hint_boost)


def history_budget(spark: SparkSession, d: str) -> DataFrame:
    """The newest turns of every history that fit 120 tokens."""
    turns = pr.history_turns(_questions(spark, d, "history"))
    return pr.history_within(turns, 120).select("question_id", "turn", "role", "tokens", "total_tokens")


def history_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Turns that no history may hold."""
    turns = _questions(spark, d, "history").select("question_id", F.posexplode("history").alias("turn", "h"))
    bad = "role is null or role not in ('user', 'assistant') or content is null"
    return turns.select("question_id", "turn", "h.role", "h.content").where(bad).select("question_id", "turn", "role")


def thread_depth(spark: SparkSession, d: str) -> DataFrame:
    """How many user turns there are up to each turn."""
    return pr.thread_depth(pr.history_turns(_questions(spark, d, "history"))).select("question_id", "turn", "role", "depth")


def _in_prompt(spark: SparkSession, d: str, every: int | None) -> DataFrame:
    corpus, hints = together(lambda: _full_corpus(spark, d), lambda: _hints(spark, d))
    return ak.excerpts(corpus, _asked(spark, d, every), P, hints=hints)


def prompt_budget(spark: SparkSession, d: str, every: int | None = None) -> DataFrame:
    """Which excerpts enter the prompt of each question."""
    return _in_prompt(spark, d, every).select("question_id", "chunk_id", "place", "tokens", "total_tokens")


def prompt_text(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """The prompts of the stated questions."""
    asked = _questions(spark, d, "question", "history").where(F.col("question_id") % every == 0)
    history = pr.history_within(pr.history_turns(asked), P.history_budget)
    found = pr.prompts(_in_prompt(spark, d, every), asked, SYSTEM, history)
    return found.select("question_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def request_errors(spark: SparkSession, d: str) -> DataFrame:
    """Questions that cannot be answered as they stand, with the first reason; the model in use is that of most libraries."""
    libraries = table(spark, d, "libraries").select("library_id", "embedding_model").distinct()
    w = Window.orderBy(F.col("n").desc(), "embedding_model")
    # at most a row for each library
    model = libraries.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("embedding_model").alias("model"))
    asked = _questions(spark, d, "library_id", "question", "history").crossJoin(F.broadcast(model))  # one row
    return ak.request_errors(asked, libraries, F.col("model"))


def _raw_outputs(spark: SparkSession, d: str, every: int | None) -> DataFrame:
    """Results of the asked questions as a model's JSON."""
    r = _results(spark, d, "question_id", "answer", "spoken_summary", "confidence", "citations")
    r = r if every is None else r.where(F.col("question_id") % every == 0)
    raw = F.to_json(
        F.struct("answer", F.col("spoken_summary").alias("spokenSummary"), "confidence", F.transform("citations", lambda c: F.concat(F.lit("CHUNK_ID: "), c["chunk_id"])).alias("citedChunkIds"))
    )
    return r.select("result_id", "question_id", raw.alias("raw")).join(_questions(spark, d, "question"), "question_id")


def ask_results(spark: SparkSession, d: str, every: int | None = None) -> DataFrame:
    """Results of all questions from retrieval to checked citations, the models' outputs being those of the table."""
    found = ak.answered(_full_corpus(spark, d), _asked(spark, d, every), _raw_outputs(spark, d, every), P, hints=_hints(spark, d))
    return _result_row(found)


def _result_row(found: DataFrame) -> DataFrame:
    lists = ("resolved_ids", "unresolved_ids", "dropped_ids", "replaced_ids", "fallback_ids", "supplement_ids", "pruned_ids", "weak_ids")
    return found.select(
        "result_id",
        "confidence",
        F.array_join(F.transform("citations", lambda c: c["chunk_id"]), ",").alias("final_ids"),
        F.array_join(F.transform("citations", lambda c: c["page_hint"]), ",").alias("page_hints"),
        *(F.array_join(c, ",").alias(c) for c in lists),
        "used_fallback",
    )


def format_results(spark: SparkSession, d: str) -> DataFrame:
    """The citations of every result after all checks, its prompt being the first six chunks it cites and those after them."""
    r = _results(spark, d, "question_id", "answer", "spoken_summary", "confidence", "citations")
    outputs = r.join(_questions(spark, d, "question"), "question_id", "left").select(
        "result_id", "question", "answer", "spoken_summary", "confidence", F.transform("citations", lambda c: c["chunk_id"]).alias("cited")
    )
    corpus = cut(_corpus(spark, d, "doc_id", "chunk_index", "page_start", "page_end").drop("corpus_pos"))
    cited = ci.cited_ids(r.select("result_id", "citations")).groupBy("result_id", "chunk_id").agg(F.min("ord").alias("ord"))
    places = corpus.select("chunk_id", "doc_id", "chunk_index")
    near = cited.join(places, "chunk_id").select("result_id", "ord", "doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("add"), "chunk_index")
    wanted = near.select("result_id", "doc_id", (F.col("chunk_index") + F.col("add")).alias("chunk_index"), (F.col("ord") * 2 + F.col("add")).alias("o"))
    first = wanted.groupBy("result_id", "doc_id", "chunk_index").agg(F.min("o").alias("o"))
    # the chunk after each cited one, and the one after that: neighbours that a prompt may hold without the cited one
    w = Window.partitionBy("result_id").orderBy("o", "doc_id", "chunk_index")
    prompt = first.join(corpus, ["doc_id", "chunk_index"]).withColumn("place", F.row_number().over(w)).where("place <= 6")
    return _result_row(ci.formatted(outputs, prompt, corpus, P.provenance_per_document))


def citation_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Which citations name a current chunk."""
    cited = ci.cited_ids(_results(spark, d, "citations"))
    known = _chunks(spark, d, "doc_id", "page_start", "page_end").withColumn("found", F.lit(True))
    hint = tx.page_hint(F.col("page_start"), F.col("page_end"))
    return cited.join(known, "chunk_id", "left").select("result_id", "ord", "chunk_id", F.coalesce("found", F.lit(False)).alias("resolved"), "doc_id", hint.alias("page_hint"))


def near_ids(spark: SparkSession, d: str) -> DataFrame:
    """For cited ids with a letter missing that name no chunk: the chunk of the same result's citations they are nearest to.

    Each citation of the table is misspelt as a model would, by its document's second letter; ids that are chunks all the same
    are left out, as they resolve exactly.
    """
    cited = ci.cited_ids(_results(spark, d, "citations"))
    spelt = F.concat(F.substring("chunk_id", 1, 1), F.substring("chunk_id", 3, 1 << 20))
    chunks = _chunks(spark, d)
    wanted = cited.select("result_id", spelt.alias("chunk_id")).join(chunks, "chunk_id", "left_anti")
    known = cited.join(chunks, "chunk_id", "left_semi").select("result_id", "chunk_id", F.col("ord").alias("place"))
    return ci.near_ids(wanted, known, ["result_id"], 4, "place")


def provenance_pick(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """Sources for the stated questions where an answer cites none."""
    scores = lx.lexical_best(_corpus(spark, d, "doc_id"), _asked(spark, d, every), 5, doc="doc_id", per_document=P.provenance_per_document)
    return ci.provenance(scores, 5, P.provenance_per_document).select("question_id", "corpus_pos", F.round("value", 6).alias("value"), "hits", "pick")


def _cited_texts(spark: SparkSession, d: str) -> DataFrame:
    results = _results(spark, d, "question_id", "answer", "citations").where("trim(answer) <> ''")
    texts = _chunks(spark, d, "section_heading", "text").select("chunk_id", tx.surface(F.col("section_heading"), F.col("text")).alias("snippet"))
    cited = ci.cited_ids(results).join(results.drop("citations"), "result_id").join(_questions(spark, d, "question"), "question_id")
    return cited.join(texts, "chunk_id")


def citation_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Support of every citation, and which stay."""
    return ci.aligned(_cited_texts(spark, d)).select("result_id", "ord", "chunk_id", F.round("support", 6).alias("support"), "kept", "place")


def snippet_focus(spark: SparkSession, d: str) -> DataFrame:
    """The part of every cited chunk to show beside the answer."""
    return _cited_texts(spark, d).select("result_id", "ord", "chunk_id", focused(F.col("snippet"), F.col("answer")).alias("snippet"))


def answer_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Confidence and summary of every result after the checks against its answer; a prompt has as many excerpts as chunks are cited and current."""
    r = _results(spark, d, "answer", "spoken_summary", "confidence", "citations")
    seen = ci.cited_ids(r.select("result_id", "citations")).join(_chunks(spark, d), "chunk_id", "left_semi").groupBy("result_id").agg(F.count(F.lit(1)).alias("seen"))
    answer = F.coalesce("answer", F.lit(""))
    return r.join(seen, "result_id", "left").select(
        "result_id",
        tx.reconciled_confidence(F.col("confidence"), answer, F.greatest(F.size("citations"), F.lit(0)), F.coalesce("seen", F.lit(0))).alias("confidence"),
        tx.reconciled_summary(F.col("spoken_summary"), answer).alias("spoken_summary"),
    )


def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Results written as a model's JSON and read again."""
    r = _results(spark, d, "answer", "spoken_summary", "confidence", "citations")
    raw = F.to_json(
        F.struct("answer", F.col("spoken_summary").alias("spokenSummary"), "confidence", F.transform("citations", lambda c: F.concat(F.lit("CHUNK_ID: "), c["chunk_id"])).alias("cited_from"))
    )
    out = r.select("result_id", ci.parsed_output(raw).alias("o")).select("result_id", "o.*")
    return out.withColumn("cited", F.array_join("cited", ","))


def eval_score(spark: SparkSession, d: str) -> DataFrame:
    """The newest result of every question that was asked again, held against the first: confidence, and the first 12 letters of its answer."""
    r = _results(spark, d, "question_id", "answer", "confidence").join(
        current_rows(table(spark, d, "query_results").select("result_id", "answered_at"), ["result_id"], "answered_at"), "result_id"
    )
    at = F.struct("answered_at", "result_id")
    row = F.struct("answer", "confidence")
    both = r.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(row, at).alias("a"), F.max_by(row, at).alias("b")).where("n > 1")
    cases = both.select("question_id", F.col("a.confidence").alias("expected_confidence"), F.substring("a.answer", 1, 12).alias("expected_snippet"))
    outputs = both.select("question_id", "b.answer", "b.confidence")
    return ci.eval_scores(outputs, cases).select("question_id", "passed")


def grounded_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of each library by confidence, and how many cite a current chunk."""
    cited = citation_resolve(spark, d).groupBy("result_id").agg(F.max(F.col("resolved").cast("int")).alias("ok"))
    r = _results(spark, d, "library_id", "confidence").join(cited, "result_id", "left")
    level = F.when(F.col("confidence").isin(*ci.CONFIDENCES), F.col("confidence")).otherwise("not_in_book")
    return r.groupBy("library_id", level.alias("confidence")).agg(F.count(F.lit(1)).alias("results"), F.sum(F.coalesce("ok", F.lit(0))).alias("grounded"))


def change_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose newest digest differs from the one before."""
    df = table(spark, d, "library_docs").select("doc_id", "sha256", "created_at").distinct()
    newest = current_rows(df, ["doc_id"], "created_at").select("doc_id", "sha256")
    older = df.join(newest.withColumnRenamed("sha256", "now"), "doc_id").where("not (sha256 <=> now)")
    known = newest.join(older.select("doc_id").distinct(), "doc_id", "left_anti")
    return ing.changed_documents(newest, known).select("doc_id", "sha256")


def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    """First and last corpus position of every document."""
    return ing.chunk_ranges(_chunks(spark, d, "doc_id", "corpus_pos"))


def scanned_only(spark: SparkSession, d: str) -> DataFrame:
    """Pages and characters of every document, and whether it looks scanned."""
    pages = _pages(spark, d, "content")
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars"))
    flagged = ing.scanned_only(pages).select("doc_id", F.lit(True).alias("scanned"))
    return sizes.join(flagged, "doc_id", "left").withColumn("scanned", F.coalesce("scanned", F.lit(False)))


def library_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Libraries with their documents and chunks."""
    docs = table(spark, d, "library_docs").groupBy("library_id").agg(F.countDistinct("doc_id").alias("documents"))
    chunks = _chunks(spark, d, "library_id").groupBy("library_id").agg(F.count(F.lit(1)).alias("chunks"))
    libs = table(spark, d, "libraries").select("library_id", "label").distinct()
    out = libs.join(docs, "library_id", "left").join(chunks, "library_id", "left")
    return out.select("library_id", "label", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
