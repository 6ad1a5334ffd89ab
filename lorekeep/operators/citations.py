"""Citations of model answers: parsing, resolving, pruning, filling in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.snippets import focused, supported
from lorekeep.functions.text import (
    about_instances,
    about_stacking,
    chunk_id_of,
    glossary_boost,
    has_rule_text,
    match_ratio,
    page_hint,
    question_terms,
    rule_weight,
    term_hits,
    truncated_snippet,
)
from lorekeep.functions.whitespace import is_blank
from lorekeep.session import cut

# fixed values: the confidences a model may give
CONFIDENCES = ("high", "mixed", "not_in_book", "speculative")
# fixed values: shares of the best score below which a citation is dropped, and the best scores from which that applies
SUPPORT_FROM, SUPPORT_KEEP = 1.35, 0.42
LEXICAL_FROM, LEXICAL_KEEP = 0.12, 0.38


def parsed_output(raw: Column) -> Column:
    """(answer, spoken_summary, confidence, cited) of a model's JSON; each field has its own fallback.

    A field of the wrong JSON type falls back as if it were missing. The cited ids are those of ``citedChunkIds``, or of
    ``cited_from``, a list or a string, where that is missing or empty.
    """
    v = F.try_parse_json(raw)

    def text(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    def texts(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(v, path, "array<string>"))

    none = F.array().cast("array<string>")
    own = F.coalesce(texts("$.citedChunkIds"), none)
    single = text("$.cited_from")
    other = F.coalesce(
        F.try_variant_get(v, "$.cited_from", "array<string>"), F.when(single.isNotNull(), F.array(single)), none
    )
    ids = F.filter(F.transform(F.when(F.size(own) > 0, own).otherwise(other), chunk_id_of), lambda i: i != "")
    confidence = text("$.confidence")
    return F.struct(
        F.coalesce(text("$.answer"), F.lit("Unable to generate an answer.")).alias("answer"),
        F.coalesce(text("$.spokenSummary"), F.lit("")).alias("spoken_summary"),
        F.when(confidence.isin(*CONFIDENCES), confidence).otherwise("not_in_book").alias("confidence"),
        F.coalesce(ids, none).alias("cited"),
    )


def cited_ids(results: DataFrame, key: str = "result_id", citations: str = "citations") -> DataFrame:
    """key, ord, chunk_id: the citations of each result in order, ids cleaned, blanks left out."""
    return (
        results.select(key, F.posexplode(citations).alias("ord", "c"))
        .select(key, "ord", chunk_id_of(F.col("c.chunk_id")).alias("chunk_id"))
        .where("chunk_id <> ''")
    )


def near_ids(wanted: DataFrame, candidates: DataFrame, on: list[str], most: int = 4, order: str = "near_id") -> DataFrame:
    """``wanted`` (chunk_id, ``on``) with ``near_id``: the candidate of the same number whose document name is 1 to ``most`` edits off.

    The fewest edits win, ties go by ``order``, a column of ``candidates``, or by name. Numbers and ``on`` are the join
    key, the edits only a residual; ``candidates`` are the few chunks of a prompt, and ``wanted`` the ids that nothing
    else resolves.
    """

    def parts(df: DataFrame, name: str) -> DataFrame:
        return (
            df.withColumn(f"{name}_doc", F.lower(F.regexp_extract("chunk_id", r"(?s)^(.+)#(\d+)$", 1)))
            .withColumn("number", F.regexp_extract("chunk_id", r"(?s)^(.+)#(\d+)$", 2))
            .where("number <> ''")
        )

    more = [] if order == "near_id" else [order]
    a = parts(wanted.select(*on, "chunk_id").distinct(), "w")
    b = parts(candidates.select(*on, "chunk_id", *more).distinct(), "c").withColumnRenamed("chunk_id", "near_id")
    d = F.levenshtein("w_doc", "c_doc", most)
    w = Window.partitionBy(*on, "chunk_id").orderBy("edits", order, "near_id")
    return (
        a.join(b, [*on, "number"])
        .withColumn("edits", d)
        .where(F.col("edits").between(1, most))
        .withColumn("r", F.row_number().over(w))
        .where("r = 1")
        .select(*on, "chunk_id", "near_id", "edits")
    )


def aligned(cited: DataFrame, key: str = "result_id") -> DataFrame:
    """``cited`` (key, ord, answer, question, snippet) with support, kept and place.

    A citation far below the best support is dropped, then one far below the best overlap with the question unless that is about
    stacking. A single citation always stays. ``place`` orders the kept ones by support, then as cited.
    """
    w = Window.partitionBy(key)
    terms = question_terms(F.col("question"))
    scored = cited.withColumn("support", supported(F.col("answer"), F.col("snippet"))).withColumn(
        "lexical", match_ratio(F.col("snippet"), terms)
    )
    many = F.count(F.lit(1)).over(w) > 1
    best = F.max("support").over(w)
    first = ~many | (best < SUPPORT_FROM) | (F.col("support") >= best * SUPPORT_KEEP)
    scored = scored.withColumn("k1", first)
    left = F.sum(F.col("k1").cast("int")).over(w)
    top = F.max(F.when(F.col("k1"), F.col("lexical"))).over(w)
    applies = (left > 1) & ~about_stacking(F.col("question")) & (F.size(terms) >= 2) & (top >= LEXICAL_FROM)
    kept = F.col("k1") & F.when(F.coalesce(applies, F.lit(False)), F.col("lexical") >= top * LEXICAL_KEEP).otherwise(True)
    scored = scored.withColumn("kept", kept).drop("k1", "lexical")
    order = w.orderBy(F.col("kept").desc(), F.round("support", 9).desc(), "ord")
    return scored.withColumn("place", F.row_number().over(order))


def provenance(scores: DataFrame, most: int, per_document: int, doc: str = "doc_id", order: str = "corpus_pos") -> DataFrame:
    """``scores`` (question_id, doc, ratio, boost, hits) cut to the ``most`` best sources, few of one document first."""
    value = F.col("ratio") * 2 + F.col("boost")
    viable = scores.withColumn("value", value).where("hits > 0 or value > 0")
    by = [F.round("value", 9).desc(), F.col("hits").desc(), F.col(order)]
    w = Window.partitionBy("question_id")
    ranked = viable.withColumn("rank", F.row_number().over(w.orderBy(*by)))
    over = (F.row_number().over(Window.partitionBy("question_id", doc).orderBy("rank")) > per_document).cast("int")
    return ranked.withColumn("o", over).withColumn("pick", F.row_number().over(w.orderBy("o", "rank"))).where(F.col("pick") <= most).drop("o")


def provenance_of_prompts(prompt: DataFrame, asked: DataFrame, limit: str, per_document: int, key: str = "result_id") -> DataFrame:
    """The best sources among the chunks of each prompt, few of one document first, up to the column ``limit`` of ``asked``.

    ``prompt``: key, place, chunk_id, doc_id, text. ``asked``: key, question, ``limit``. A question without terms has none.
    """
    terms = question_terms(F.col("question"))
    boost = F.when(about_stacking(F.col("question")), rule_weight(F.col("text"))).otherwise(0.0) + glossary_boost(F.col("text"), F.col("terms"))
    scored = (
        prompt.join(asked.withColumn("terms", terms).where("size(terms) > 0"), key)
        .withColumn("hits", term_hits(F.col("text"), F.col("terms")))
        .withColumn("value", match_ratio(F.col("text"), F.col("terms")) * 2 + boost)
        .where("hits > 0 or value > 0")
    )
    w = Window.partitionBy(key)
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.round("value", 9).desc(), F.col("hits").desc(), "place")))
    over = (F.row_number().over(Window.partitionBy(key, "doc_id").orderBy("rank")) > per_document).cast("int")
    picked = ranked.withColumn("o", over).withColumn("pick", F.row_number().over(w.orderBy("o", "rank")))
    return picked.where(F.col("pick") <= F.col(limit)).drop("o", "rank", "terms")


def supports_stacking(question: Column, snippet: Column) -> Column:
    """Whether a snippet may stay beside a question about stacking; true for any other question."""
    terms = question_terms(question)
    return ~about_stacking(question) | has_rule_text(snippet) | (F.size(terms) == 0) | (term_hits(snippet, terms) > 0)


def formatted(outputs: DataFrame, prompt: DataFrame, corpus: DataFrame, per_document: int = 2, key: str = "result_id") -> DataFrame:
    """One row for each row of ``outputs``: answer, spoken_summary, confidence, citations, and what became of each cited id.

    ``outputs``: key, question, answer, spoken_summary, confidence, cited (array). ``prompt``: key, place, chunk_id, doc_id,
    page_start, page_end, text: the excerpts the model saw, few for each key. ``corpus``: chunk_id, doc_id, page_start,
    page_end, text. In this order: cited ids are resolved in the corpus, else by a near id in the prompt; those outside
    the prompt are dropped; if none of the rest shares a term with the question, sources of the prompt that do replace
    them; if none is left, the prompt's best sources stand in; for a question about stacking a source with the rule
    is added and those without support are pruned; the rest is aligned with the answer and narrowed to the part that
    supports it. Confidence falls from high to mixed where ids were dropped or replaced. Keys are those of ``outputs``,
    once each; null texts count as empty.
    """
    o = outputs.select(
        key,
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        "spoken_summary",
        "confidence",
        F.coalesce("cited", F.array().cast("array<string>")).alias("cited"),
    )
    source = ["chunk_id", "doc_id", "page_start", "page_end", "text"]
    seen = prompt.select(key, "place", *source)
    asked = ~is_blank(F.col("question"))
    wanted = (
        o.select(key, F.posexplode("cited").alias("ord", "raw"))
        .select(key, "ord", chunk_id_of(F.col("raw")).alias("wanted"))
        .where("wanted <> ''")
    )
    exact = wanted.join(corpus.select(*source).withColumnRenamed("chunk_id", "wanted"), "wanted", "left").withColumn("chunk_id", F.when(F.col("doc_id").isNotNull(), F.col("wanted")))
    missing = exact.where("chunk_id is null").select(key, "ord", "wanted")
    near = near_ids(missing.select(key, F.col("wanted").alias("chunk_id")), seen, [key], 4, "place").select(key, F.col("chunk_id").alias("wanted"), F.col("near_id").alias("chunk_id"))
    by_near = missing.join(near, [key, "wanted"]).join(seen.drop("place"), [key, "chunk_id"])
    resolved = cut(exact.where("chunk_id is not null").select(key, "ord", "wanted", *source).unionByName(by_near.select(key, "ord", "wanted", *source)))
    sized = seen.groupBy(key).agg(F.count(F.lit(1)).alias("n_prompt"))
    placed = resolved.join(seen.select(key, "chunk_id", F.lit(True).alias("inside")).distinct(), [key, "chunk_id"], "left").join(sized, key, "left")
    dropped = F.col("n_prompt").isNotNull() & F.col("inside").isNull()
    held = placed.where(~dropped).join(o.select(key, "question"), key).withColumn("hits", term_hits(F.col("text"), question_terms(F.col("question"))))
    counts = o.select(key, "question").join(sized, key, "left").join(held.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("hits").alias("best")), key, "left")
    few = F.size(question_terms(F.col("question"))) >= 3
    replace = F.coalesce(asked & (F.col("n") > 0) & (F.col("n_prompt") > 0) & few & (F.col("best") == 0), F.lit(False))
    fall = asked & F.col("n").isNull() & (F.col("n_prompt") > 0)
    need = counts.select(key, "question", F.when(replace, F.greatest("n", F.lit(3))).when(fall, F.lit(5)).alias("most"), replace.alias("replaces")).where("most is not null")
    picks = provenance_of_prompts(seen, need, "most", per_document, key)
    overlap = F.max("hits").over(Window.partitionBy(key)) > 0
    picks = cut(picks.withColumn("fits", ~F.col("replaces") | overlap).where("fits").select(key, F.col("pick").alias("ord"), *source, "replaces"))
    instead = picks.select(key).distinct()
    cites = (
        held.select(key, "ord", *source).join(instead, key, "left_anti")
        .unionByName(picks.select(key, "ord", "chunk_id", "doc_id", "page_start", "page_end", truncated_snippet(F.col("text")).alias("text")))
    )
    cites = cut(cites)
    # questions about stacking: a source with the rule where none has it
    ruled = cites.groupBy(key).agg(F.max(has_rule_text(F.col("text")).cast("int")).alias("has_rule"))
    lacking = o.where(about_stacking(F.col("question")) & about_instances(F.col("answer"))).join(ruled.where("has_rule = 0"), key).select(key)
    first = Window.partitionBy(key).orderBy("place")
    supplement = (
        seen.join(lacking, key, "left_semi").where(has_rule_text(F.col("text"))).join(cites.select(key, "chunk_id"), [key, "chunk_id"], "left_anti")
        .withColumn("r", F.row_number().over(first)).where("r = 1").select(key, F.lit(1 << 30).alias("ord"), *source)
    )
    cites = cites.unionByName(supplement).join(o.select(key, "question", "answer"), key)
    supported = cites.withColumn("ok", supports_stacking(F.col("question"), F.col("text")))
    any_ok = F.max(F.col("ok").cast("int")).over(Window.partitionBy(key)) == 1
    supported = supported.withColumn("pruned", any_ok & ~F.col("ok")).drop("ok")
    # answers: support, and only the part that supports them
    spoken = ~is_blank(F.col("answer"))
    stay = supported.where("not pruned").withColumnRenamed("text", "snippet")
    lined = aligned(stay.where(spoken), key).withColumn("snippet", focused(F.col("snippet"), F.col("answer")))
    plain = stay.where(~spoken).withColumn("support", F.lit(None).cast("double")).withColumn("kept", F.lit(True)).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ord")))
    shape = [key, "ord", "chunk_id", "doc_id", "page_start", "page_end", "snippet", "support", "kept", "place"]
    final = cut(lined.select(*shape).unionByName(plain.select(*shape)))

    def ids(df: DataFrame, name: str, order: str = "ord", column: str = "chunk_id") -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(order, column)))
        return df.groupBy(key).agg(F.transform(listed, lambda x: x[column]).alias(name))

    kept = final.where("kept")
    hint = page_hint(F.col("page_start"), F.col("page_end"))
    shown = kept.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "chunk_id", F.col("doc_id").alias("document_label"), hint.alias("page_hint"), "snippet"))),
            lambda x: x.dropFields("place"),
        ).alias("citations"),
        F.count(F.lit(1)).alias("__n"),
        F.first("snippet").alias("__only"),
    )
    still = kept.select(key, "chunk_id").distinct()
    debug = {
        "resolved_ids": ids(resolved, "resolved_ids", "ord", "wanted"),
        "unresolved_ids": ids(missing.join(near, [key, "wanted"], "left_anti"), "unresolved_ids", "ord", "wanted"),
        "dropped_ids": ids(placed.where(dropped), "dropped_ids"),
        "replaced_ids": ids(held.join(picks.where("replaces").select(key).distinct(), key, "left_semi"), "replaced_ids"),
        "fallback_ids": ids(picks.where("not replaces"), "fallback_ids"),
        "supplement_ids": ids(supplement, "supplement_ids"),
        "pruned_ids": ids(supported.where("pruned"), "pruned_ids"),
        "weak_ids": ids(final.where("not kept").join(still, [key, "chunk_id"], "left_anti"), "weak_ids"),
    }
    out = o.drop("cited").join(shown, key, "left")
    none = F.array().cast("array<string>")
    for name, df in debug.items():
        out = out.join(df, key, "left").withColumn(name, F.coalesce(F.array_distinct(name) if name in ("resolved_ids", "unresolved_ids") else F.col(name), none))
    terms = question_terms(F.col("question"))
    single = asked & (F.col("__n") == 1)
    scores = final.where("support is not null").groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("chunk_id", F.round("support", 6))))).alias("support_scores"))
    fell = counts.where(fall).select(key, F.lit(True).alias("__fell"))
    lower = (F.col("confidence") == "high") & ((F.size("dropped_ids") > 0) | (F.size("replaced_ids") > 0))
    return out.join(scores, key, "left").join(fell, key, "left").select(
        key,
        "answer",
        "spoken_summary",
        F.when(lower, "mixed").otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("citations", F.array().cast("array<struct<chunk_id:string,document_label:string,page_hint:string,snippet:string>>")).alias("citations"),
        *debug,
        F.coalesce("__fell", F.lit(False)).alias("used_fallback"),
        "support_scores",
        F.when(single, match_ratio(F.col("__only"), terms)).alias("single_ratio"),
        F.when(single, term_hits(F.col("__only"), terms)).alias("single_hits"),
    )


def eval_scores(outputs: DataFrame, cases: DataFrame, on: str = "question_id") -> DataFrame:
    """``cases`` (on, expected_confidence, expected_snippet) with ``passed`` for the output (on, answer, confidence) of each.

    A case passes if the confidence is the expected one and the answer contains the snippet, if there is one, in any case of
    letters. A case without an expected confidence or without an output fails.
    """
    both = cases.join(outputs.select(on, "answer", "confidence"), on, "left")
    said = F.col("expected_snippet").isNull() | (F.col("expected_snippet") == "") | F.contains(F.lower("answer"), F.lower("expected_snippet"))
    return both.withColumn("passed", F.coalesce((F.col("confidence") == F.col("expected_confidence")) & said, F.lit(False)))
