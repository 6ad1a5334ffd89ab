"""Links between sections and what they add to retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.concepts import normalize_concept
from lorekeep.functions.grams import lookup_key, offered_keys
from lorekeep.functions.text import first_words
from lorekeep.functions.whitespace import trim_ws
from lorekeep.operators.blocks import with_previous
from lorekeep.session import cut, if_small


def _none() -> Column:
    return F.lit(None).cast("string")


def order_edges(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """src, dst, type, concept, weight: each section and the next one, both ways; documents of any size, see ``blocks``."""
    pairs = with_previous(sections.select(doc, "section_index", "section_id"), doc, "section_index", ["section_id"]).where("prev_exists")
    one = F.lit(1.0)
    forth = pairs.select(F.col("prev_section_id").alias("src"), F.col("section_id").alias("dst"), F.lit("next_section").alias("type"), _none().alias("concept"), one.alias("weight"))
    back = pairs.select(F.col("section_id").alias("src"), F.col("prev_section_id").alias("dst"), F.lit("prev_section").alias("type"), _none().alias("concept"), one.alias("weight"))
    return forth.unionAll(back)


def _concepts(sections: DataFrame, column: str, name: str) -> DataFrame:
    return (
        sections.select(F.col("section_id").alias(name), F.explode(column).alias("c"))
        .select(name, normalize_concept(F.col("c")).alias("concept"))
        .where("concept <> ''")
        .distinct()
    )


CONCEPT_WEIGHT, HINT_WEIGHT = 0.85, 0.5


def concept_edges(sections: DataFrame) -> DataFrame:
    """src, dst, type, concept, weight: sections that refer to a concept and those that define it, once each way.

    An equi-join on the concept, one edge for each pair of sections and concept. The edges of a collection are a list of
    pairs, as long as the concepts are common: ask for those of some sections (``neighbor_boosts``), or count them
    (``concept_links``).
    """
    pairs = (
        _concepts(sections, "refs", "ref")
        .join(_concepts(sections, "defines", "def"), "concept")
        .where("ref <> def")
    )
    weight = F.lit(CONCEPT_WEIGHT).alias("weight")
    forth = pairs.select(F.col("ref").alias("src"), F.col("def").alias("dst"), F.lit("references").alias("type"), "concept", weight)
    back = pairs.select(F.col("def").alias("src"), F.col("ref").alias("dst"), F.lit("defines").alias("type"), "concept", weight)
    return forth.unionAll(back)


def concept_links(sections: DataFrame) -> DataFrame:
    """src, type, edges, concepts: how many concept edges leave each section, and over how many concepts, without the pairs.

    A concept is a class of the sections that refer to it and those that define it; a section's edges over it are the
    size of the other side, less itself where it is on both.
    """
    refs = _concepts(sections, "refs", "src").withColumn("r", F.lit(1)).withColumn("d", F.lit(0))
    defs = _concepts(sections, "defines", "src").withColumn("r", F.lit(0)).withColumn("d", F.lit(1))
    held = refs.unionAll(defs).groupBy("src", "concept").agg(F.max("r").alias("r"), F.max("d").alias("d"))
    sizes = held.groupBy("concept").agg(F.sum("r").alias("n_refs"), F.sum("d").alias("n_defs"))
    known = held.join(sizes.where("n_refs > 0 and n_defs > 0"), "concept")
    both = F.col("r") * F.col("d")
    shape = F.array(
        F.struct(F.lit("references").alias("type"), F.when(F.col("r") == 1, F.col("n_defs") - both).otherwise(0).alias("n")),
        F.struct(F.lit("defines").alias("type"), F.when(F.col("d") == 1, F.col("n_refs") - both).otherwise(0).alias("n")),
    )
    each = known.select("src", F.explode(shape).alias("x")).select("src", "x.type", "x.n").where("n > 0")
    return each.groupBy("src", "type").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("concepts"))


def _see_also_pairs(hints: DataFrame, titles: DataFrame) -> DataFrame:
    """src, dst: hints (d, src, own, hint) and titles (d, dst, title) of one document of which one contains the other."""
    named = titles.select("d", "title").distinct()
    said = hints.select("d", "hint").distinct()
    full = named.where("title <> ''")
    looked = said.withColumn("g", lookup_key(F.col("hint"))).join(full.withColumn("g", F.explode(offered_keys(F.col("title")))), ["d", "g"])
    offered = said.withColumn("g", F.explode(offered_keys(F.col("hint")))).join(full.withColumn("g", lookup_key(F.col("title"))), ["d", "g"])
    near = (
        looked.where(F.contains("title", "hint")).select("d", "hint", "title")
        .unionAll(offered.where(F.contains("hint", "title")).select("d", "hint", "title"))
        # an empty title is contained in every hint
        .unionAll(said.join(named.where("title = ''"), "d"))
        .distinct()
    )
    return near.join(hints, ["d", "hint"]).join(titles, ["d", "title"]).where("src <> dst").select("src", "dst").distinct()


def _see_also_asked(hints: DataFrame, titles: DataFrame, few: str) -> DataFrame:
    """The same where the side ``few`` is a stated set: small enough to be broadcast, it meets the other rows of its documents."""
    width = F.length("d") + F.length("hint" if few == "hints" else "title") + 60
    side = if_small(hints if few == "hints" else titles, width)
    if side is hints or side is titles:
        return _see_also_pairs(hints, titles)
    both = side.join(titles, "d") if few == "hints" else hints.join(side, "d")
    near = F.contains("title", "hint") | F.contains("hint", "title")
    return both.where((F.col("src") != F.col("dst")) & near).select("src", "dst").distinct()


def _hints(sections: DataFrame, doc: str) -> DataFrame:
    return (
        sections.select(F.col(doc).alias("d"), F.col("section_id").alias("src"), F.col("title").alias("own"), F.explode("see_also").alias("hint"))
        .select("d", "src", normalize_concept(F.col("own")).alias("own"), normalize_concept(F.col("hint")).alias("hint"))
        .where("hint <> '' and hint <> own")
        .select("d", "src", "hint")
    )


def _titles(sections: DataFrame, doc: str) -> DataFrame:
    return sections.select(F.col(doc).alias("d"), F.col("section_id").alias("dst"), normalize_concept(F.col("title")).alias("title"))


def see_also_edges(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """src, dst, type, concept, weight: hints that contain a title of the same document or are contained in one.

    Distinct hints meet distinct titles over runs of characters, so a large document is not every hint with every title.
    """
    pairs = _see_also_pairs(_hints(sections, doc), _titles(sections, doc))
    return pairs.select("src", "dst", F.lit("see_also").alias("type"), _none().alias("concept"), F.lit(HINT_WEIGHT).alias("weight"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each source, target, type and concept: that of the greatest weight."""
    key = [F.col("src"), F.col("dst"), F.col("type"), F.coalesce("concept", F.lit("")).alias("concept")]
    return edges.groupBy(*key).agg(F.max("weight").alias("weight")).select("src", "dst", "type", F.nullif("concept", F.lit("")).alias("concept"), "weight")


def chunk_sections(sections: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """chunk_id, section_id: the section of each chunk, or of ``chunks`` only; of several the last one."""
    member = sections.select("section_id", "section_index", F.explode("chunk_ids").alias("chunk_id"))
    if chunks is not None:
        member = member.join(chunks, "chunk_id", "left_semi")
    return member.groupBy("chunk_id").agg(F.max_by("section_id", F.struct("section_index", "section_id")).alias("section_id"))


def neighbor_boosts(seeds: DataFrame, sections: DataFrame, types: tuple[str, ...], per_hit: int, base: float) -> DataFrame:
    """question_id, chunk_id, boost: chunks of the sections next to a question's seeds.

    ``seeds`` has question_id and chunk_id. A section with s seeds passes on to its ``per_hit * s`` heaviest neighbours over
    edges of ``types`` taken both ways, ties by id; every chunk of a neighbour gets the greatest base times weight that
    reaches it. Edges are made for the seeds' sections only. Neighbours over one concept all weigh the same, so of a
    concept's sections no more are needed than the largest number passed on, and one.
    """
    wanted = cut(seeds.select("question_id", "chunk_id"))
    of = chunk_sections(sections, if_small(wanted.select("chunk_id").distinct(), F.length("chunk_id") + 24))
    hits = cut(wanted.join(of, "chunk_id").groupBy("question_id", "section_id").agg(F.count(F.lit(1)).alias("n")))
    asked = if_small(hits.select("section_id").distinct(), F.length("section_id") + 24)
    most = (hits.agg(F.max("n").alias("n")).collect()[0]["n"] or 0) * per_hit
    mine = cut(sections.join(asked, "section_id", "left_semi"))
    parts = []
    if {"references", "defines"} & set(types):
        for here, there in (("refs", "defines"), ("defines", "refs")):
            held = _concepts(mine, here, "section_id")
            named = if_small(held.select("concept").distinct(), F.length("concept") + 24)
            others = (
                sections.select(F.col("section_id").alias("peer"), F.explode(there).alias("c"))
                .select("peer", normalize_concept(F.col("c")).alias("concept"))
                .join(named, "concept", "left_semi")
                .distinct()
                .withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy("peer")))
                .where(F.col("r") <= most + 1)
            )
            parts.append(held.join(others, "concept").where("section_id <> peer").select("section_id", "peer", F.lit(CONCEPT_WEIGHT).alias("weight")))
    if "see_also" in types:
        docs = mine.select("doc_id").distinct()
        beside = sections.join(docs, "doc_id", "left_semi")
        out = _see_also_asked(_hints(mine, "doc_id"), _titles(beside, "doc_id"), "hints")
        back = _see_also_asked(_hints(beside, "doc_id"), _titles(mine, "doc_id"), "titles")
        weight = F.lit(HINT_WEIGHT).alias("weight")
        parts += [out.select(F.col("src").alias("section_id"), F.col("dst").alias("peer"), weight), back.select(F.col("dst").alias("section_id"), F.col("src").alias("peer"), weight)]
    if {"next_section", "prev_section"} & set(types):
        order = order_edges(sections.join(mine.select("doc_id").distinct(), "doc_id", "left_semi"))
        parts.append(order.join(asked, F.col("src") == F.col("section_id"), "left_semi").select(F.col("src").alias("section_id"), F.col("dst").alias("peer"), "weight"))
    if not parts:
        return seeds.select("question_id", "chunk_id", F.lit(0.0).alias("boost")).where(F.lit(False))
    peers = parts[0]
    for more in parts[1:]:
        peers = peers.unionAll(more)
    peers = peers.groupBy("section_id", "peer").agg(F.max("weight").alias("weight"))
    ranked = peers.withColumn("r", F.row_number().over(Window.partitionBy("section_id").orderBy(F.col("weight").desc(), "peer"))).where(F.col("r") <= most)
    reached = cut(
        hits.join(ranked, "section_id").where(F.col("r") <= F.col("n") * per_hit).groupBy("question_id", F.col("peer").alias("section_id")).agg(F.max("weight").alias("weight"))
    )
    theirs = sections.select("section_id", "chunk_ids").join(if_small(reached.select("section_id").distinct(), F.length("section_id") + 24), "section_id", "left_semi")
    return (
        reached.join(theirs.select("section_id", F.explode("chunk_ids").alias("chunk_id")), "section_id")
        .groupBy("question_id", "chunk_id")
        .agg((F.max("weight") * F.lit(base)).alias("boost"))
    )


def document_summaries(sections: DataFrame, doc: str = "doc_id", top: int = 40) -> DataFrame:
    """doc, top_concepts, authoritative_for: the concepts a document names most, and all that it defines, sorted."""
    named = (
        sections.select(doc, "section_index", F.posexplode("concepts").alias("at", "c"))
        .select(doc, "section_index", "at", normalize_concept(F.col("c")).alias("concept"))
        .where("concept <> ''")
    )
    counted = named.groupBy(doc, "concept").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("section_index", "at")).alias("first"))
    w = Window.partitionBy(doc).orderBy(F.col("n").desc(), "first", "concept")
    tops = (
        counted.withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= top)
        .groupBy(doc)
        .agg(F.array_sort(F.collect_list(F.struct("r", "concept"))).alias("t"))
        .select(doc, F.col("t.concept").alias("top_concepts"))
    )
    defined = (
        sections.select(doc, F.explode("defines").alias("c"))
        .select(doc, normalize_concept(F.col("c")).alias("c"))
        .where("c <> ''")
        .groupBy(doc)
        .agg(F.array_sort(F.collect_set("c")).alias("authoritative_for"))
    )
    none = F.array().cast("array<string>")
    return (
        sections.select(doc).distinct().join(tops, doc, "left").join(defined, doc, "left")
        .select(doc, F.coalesce("top_concepts", none).alias("top_concepts"), F.coalesce("authoritative_for", none).alias("authoritative_for"))
    )


def enriched_names(c: Column) -> Column:
    """Normalised names of a list, each once, in order, without empty ones; an empty list for null."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.filter(F.transform(c, normalize_concept), lambda x: x.isNotNull() & (x != ""))), none)


def rollups(sections: DataFrame, doc: str = "doc_id", budget: int = 3500, per_word: int = 3) -> DataFrame:
    """doc, rollup: a text of titles, topics, defined and cited concepts of a document's sections, cut to a token budget.

    A section has four words at least, so only as many sections as can fit the budget are gathered.
    """
    words = budget // per_word
    w = Window.partitionBy(doc).orderBy("section_index", "section_id")
    few = sections.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= -(-words // 4))
    part = F.concat(
        F.lit("## "), F.coalesce("title", F.lit("")),
        F.lit("\ntopics: "), F.array_join(F.slice(enriched_names(F.col("concepts")), 1, 12), ", "),
        F.lit("\ndefines: "), F.array_join(enriched_names(F.col("defines")), ", "),
        F.lit("\nrefs: "), F.array_join(F.slice(enriched_names(F.col("refs")), 1, 8), ", "),
    )
    parts = few.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("__r", part.alias("part")))).alias("xs"))
    return parts.select(doc, first_words(F.array_join(F.col("xs.part"), "\n\n"), words).alias("rollup"))


def document_notes(summaries: DataFrame, rollup: DataFrame, labels: DataFrame, written: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """doc, label, scope_summary, top_concepts, authoritative_for, rollup: the map of contents of each document.

    ``labels`` (doc, label); a document without one goes by its id. ``written`` (doc, raw): a model's JSON with scopeSummary; where
    there is none, or none that parses, a fixed sentence stands in.
    """
    out = summaries.join(rollup, doc, "left").join(labels, doc, "left").withColumn("label", F.coalesce("label", F.col(doc)))
    stand_in = F.concat("label", F.lit(": rules reference (MOC generation failed; using concept roll-up)."))
    said = _none()
    if written is not None:
        out = out.join(written.select(doc, scope_summary(F.col("raw")).alias("__said")), doc, "left")
        said = F.col("__said")
    return out.withColumn("scope_summary", F.coalesce(said, stand_in)).select(doc, "label", "scope_summary", "top_concepts", "authoritative_for", "rollup")


def scope_summary(raw: Column) -> Column:
    """The trimmed text of ``scopeSummary`` in a model's JSON; null if there is none or it is no text."""
    v = F.try_variant_get(F.try_parse_json(raw), "$.scopeSummary", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", trim_ws(F.try_variant_get(v, "$", "string")))
