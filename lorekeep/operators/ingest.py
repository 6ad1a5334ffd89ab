"""From pages to segments, chunks, sections and index entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import heading_of, index_entry, index_key, truncated_to_tokens
from lorekeep.functions.whitespace import WS, trim_ws
from lorekeep.operators.blocks import running_total, with_previous
from lorekeep.session import cut, if_small


def page_segments(pages: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, seg_no, section_heading, content: each page cut at its heading lines.

    A heading line ends the segment before it and heads the next; of several in a row the last holds. A page without any body
    line is one segment without heading. Each page is one row of higher-order functions: nothing is shuffled. A body line
    belongs to the last heading before it, so segments are the stretches between headings that hold a line.
    """
    lines = F.split(F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n"), "\n")
    marked = F.filter(F.transform(lines, trim_ws), lambda x: x != "")
    found = pages.select(*keys, F.col(content).alias("__text"), marked.alias("__lines"))
    found = found.withColumn("__heads", F.transform("__lines", heading_of))
    # where the headings stand, with one before the first line
    at = F.filter(F.transform("__heads", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull())
    found = found.withColumn("__at", F.concat(F.array(F.lit(-1)), at))
    ends = F.concat(F.slice("__at", 2, F.size("__at")), F.array(F.size("__lines")))
    parts = F.filter(
        F.zip_with("__at", ends, lambda a, b: F.struct(a.alias("a"), (b - a - 1).alias("n"))), lambda x: x["n"] > 0
    )
    found = found.withColumn("__parts", parts)
    segments = F.transform(
        "__parts",
        lambda x: F.struct(
            F.get("__heads", x["a"]).alias("heading"), F.array_join(F.slice("__lines", x["a"] + 2, x["n"]), " ").alias("body")
        ),
    )
    whole = F.array(
        F.struct(F.lit(None).cast("string").alias("heading"), trim_ws(F.coalesce("__text", F.lit(""))).alias("body"))
    )
    return (
        found.select(*keys, F.posexplode(F.when(F.size("__parts") > 0, segments).otherwise(whole)).alias("seg_no", "s"))
        .select(*keys, "seg_no", F.col("s.heading").alias("section_heading"), F.col("s.body").alias("content"))
        .where("content <> ''")
    )


def token_windows(segments: DataFrame, keys: list[str], text: str, target: int = 300, overlap: int = 40, per_word: int = 3) -> DataFrame:
    """keys, window_no, text, token_count: windows of ``target`` estimated tokens that overlap by ``overlap``.

    With a fixed number of tokens a word the windows have a closed form: full ones every ``size - back`` words, and the rest if
    it has more than 10 tokens. ``overlap`` must be at least one word.
    """
    size, back = -(-target // per_word), overlap // per_word
    if not 0 < back < size:
        raise ValueError("overlap must be at least one word and less than the target")
    words = F.filter(F.split(text, rf"[{WS}]+"), lambda w: w != "")
    full = F.greatest(F.lit(0), F.floor((F.size("__w") - size) / F.lit(size - back)).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), full), lambda i: i * (size - back))
    return (
        segments.withColumn("__w", words)
        .select(*keys, "__w", F.posexplode(starts).alias("window_no", "__at"))
        .withColumn("__p", F.slice("__w", F.col("__at") + 1, F.lit(size)))
        .where((F.size("__p") == size) | (F.size("__p") * per_word > 10))
        .select(*keys, "window_no", F.array_join("__p", " ").alias("text"), (F.size("__p") * per_word).alias("token_count"))
    )


def chunk_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", target: int = 300, overlap: int = 40) -> DataFrame:
    """doc, chunk_index, chunk_id, page, section_heading, text, token_count: the chunks of every document in order.

    Pages must come once. Their windows are counted, running totals of the counts number the first window of each page, and
    texts stay where they are but for the join with those totals; no task holds a document.
    """
    segments = page_segments(pages, [doc, page])
    cut_up = token_windows(segments, [doc, page, "seg_no", "section_heading"], "content", target, overlap)
    w = Window.partitionBy(doc, page).orderBy("seg_no", "window_no")
    numbered = cut(cut_up.withColumn("__n", F.row_number().over(w) - 1))
    sizes = numbered.groupBy(doc, page).agg(F.count(F.lit(1)).alias("__size"))
    starts = running_total(sizes, doc, page, "__size", "__start").select(doc, page, "__start")
    placed = numbered.join(if_small(starts, F.length(F.col(doc).cast("string")) + 40), [doc, page])
    return placed.withColumn("chunk_index", (F.col("__start") + F.col("__n")).cast("int")).select(
        doc,
        "chunk_index",
        F.concat(F.col(doc), F.lit("#"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        page,
        "section_heading",
        "text",
        "token_count",
    )


def with_islands(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index", heading: str = "section_heading") -> DataFrame:
    """``chunks`` with ``section_index``: the run of equal headings, compared null-safe, that each chunk belongs to."""
    near = with_previous(chunks, doc, order, [heading])
    fresh = (F.col("prev_exists") & ~F.col(heading).eqNullSafe(F.col(f"prev_{heading}"))).cast("int")
    marked = near.withColumn("__new", fresh).drop("prev_exists", f"prev_{heading}")
    counted = running_total(marked, doc, order, "__new", "__before")
    return counted.withColumn("section_index", (F.col("__before") + F.col("__new")).cast("int")).drop("__before", "__new")


def section_islands(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index", heading: str = "section_heading") -> DataFrame:
    """doc, section_index, section_id, title, page_start, page_end, chunk_ids: runs of chunks under one heading.

    Headings compare null-safe; a run without heading is named after its first page. Documents may be of any size.
    """
    return (
        with_islands(chunks, doc, order, heading).groupBy(doc, "section_index")
        .agg(
            F.min_by(heading, order).alias("h"),
            F.min_by("page_start", order).alias("page_start"),
            F.max_by("page_end", order).alias("page_end"),
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("chunk_id").alias("c")))).alias("cs"),
        )
        .select(
            doc,
            "section_index",
            F.concat(F.col(doc), F.lit("#sec:"), F.col("section_index").cast("string")).alias("section_id"),
            F.coalesce("h", F.concat(F.lit("Untitled (p. "), F.col("page_start").cast("string"), F.lit(")"))).alias("title"),
            "page_start",
            "page_end",
            F.col("cs.c").alias("chunk_ids"),
        )
    )


def section_synopses(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_index", heading: str = "section_heading", budget: int = 700, per_word: int = 3) -> DataFrame:
    """doc, section_index, synopsis: title, blank line and the texts of each section, cut to a token budget.

    A chunk has a word at least, so no more chunks of a section are gathered than the budget has words.
    """
    words = budget // per_word
    inside = with_islands(chunks, doc, order, heading)
    w = Window.partitionBy(doc, "section_index").orderBy(order)
    few = inside.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= words)
    parts = few.groupBy(doc, "section_index").agg(
        F.min_by(heading, order).alias("h"),
        F.min_by("page_start", order).alias("p"),
        F.array_sort(F.collect_list(F.struct("__r", F.coalesce("text", F.lit("")).alias("text")))).alias("xs"),
    )
    title = F.coalesce("h", F.concat(F.lit("Untitled (p. "), F.col("p").cast("string"), F.lit(")")))
    whole = F.concat(title, F.lit("\n\n"), F.array_join(F.col("xs.text"), "\n\n"))
    return parts.select(doc, "section_index", truncated_to_tokens(whole, budget, per_word).alias("synopsis"))


def index_entries(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page_number",
    content: str = "content",
    tail_share: float = 0.22,
    least: int = 14,
    most: int = 95,
    with_heading: int = 6,
    without: int = 22,
) -> DataFrame:
    """doc, topic, topic_norm, pages: the back-of-book index, looked for in the last pages of each document.

    From the first page headed Index, else over the whole tail; entries of one normalised topic merge under the first
    spelling. A document's entries stay if there are enough of them, fewer being enough under a heading.
    """
    w = Window.partitionBy(doc)
    last = F.least(F.greatest(F.lit(least), F.floor(F.col("__n") * tail_share)), F.lit(most))
    headed = F.contains(F.lower(content), F.lit("index")) & F.col(content).rlike(r"(?im)^[ \t]*(#{1,6}\s+)?index[ \t\r]*$")
    # an entry ends in a page number, or in dots or white space after it: few lines do, and only those are trimmed
    ends = rf"[0-9](?:\.{{3,}}+|[…{WS}])*+\z"
    by_line, by_gap = (F.filter(F.split(content, cut_at), lambda x: x.rlike(ends)) for cut_at in (r"\r?\n", r"\s{2,}"))
    many = F.regexp_count(content, F.lit(rf"[^{WS}][^\n]*")) >= 5
    # a line is at most one entry, so a document with too few of them has no index
    least_lines = F.when(F.col("__first").isNotNull(), with_heading).otherwise(without)

    def tail_of(rows: DataFrame, *columns: str) -> DataFrame:
        sizes = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("__n"))
        # no more than ``most`` pages of a document leave their task
        tail = (
            rows.withColumn("__r", F.row_number().over(w.orderBy(F.col(page).desc())))
            .where(F.col("__r") <= most)
            .join(sizes, doc)
            .where(F.col("__r") <= last)
        )
        tail = tail.withColumn("__first", F.min(F.when(F.col("__headed"), F.col(page))).over(w)).where(
            F.col("__first").isNull() | (F.col(page) >= F.col("__first"))
        )
        return tail.select(doc, page, "__first", *columns)

    # numbers before the end of a line or a wide gap are no fewer than the lines that end so, however a page is cut:
    # documents with too few are left out before texts move
    numbers = F.regexp_count(content, F.lit(rf"[0-9](?:\.{{3,}}+|[…{WS}])*?(?:\n|\s\s|\z)"))
    light = tail_of(pages.select(doc, page, headed.alias("__headed"), F.coalesce(numbers, F.lit(0)).alias("__k")), "__k")
    some = cut(light.groupBy(doc).agg(F.sum("__k").alias("__k"), F.min("__first").alias("__first")).where(F.col("__k") >= least_lines).select(F.col(doc).alias("__doc")))
    pages = pages.join(if_small(some, F.coalesce(F.length("__doc"), F.lit(0)) + 24), F.col(doc) == F.col("__doc"), "left_semi")
    tail = tail_of(pages.select(doc, page, content, headed.alias("__headed")), content)
    held = tail.select(doc, page, "__first", F.when(many, by_line).otherwise(by_gap).alias("__lines"))
    held = held.withColumn("__n", F.sum(F.greatest(F.size("__lines"), F.lit(0))).over(w)).where(F.col("__n") >= least_lines)
    # an outer one, else the lines are parsed a second time to see whether there are any
    entries = F.transform("__lines", lambda x: index_entry(trim_ws(x)))
    found = (
        held.select(doc, page, "__first", F.posexplode_outer(entries).alias("at", "e"))
        .where("e is not null")
        .withColumn("topic_norm", index_key(F.col("e.topic")))
        .where("topic_norm <> ''")
    )
    merged = found.groupBy(doc, "topic_norm").agg(
        F.min_by("e.topic", F.struct(page, "at")).alias("topic"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("e.pages")))).alias("pages"),
        F.max("__first").alias("__first"),
    )
    counted = merged.withColumn("__k", F.count(F.lit(1)).over(w))
    enough = F.when(F.col("__first").isNotNull(), F.col("__k") >= with_heading).otherwise(F.col("__k") >= without)
    return counted.where(enough).select(doc, "topic", "topic_norm", "pages")


def changed_documents(present: DataFrame, known: DataFrame, key: str = "doc_id", digest: str = "sha256") -> DataFrame:
    """Documents of ``present`` that are new or whose digest differs; removed ones do not count."""
    old = known.select(key, F.col(digest).alias("__old"))
    return present.join(old, key, "left").where(~F.col(digest).eqNullSafe(F.col("__old"))).drop("__old")


def scanned_only(pages: DataFrame, doc: str = "doc_id", content: str = "content") -> DataFrame:
    """Documents of more than one page with hardly any text."""
    total = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(F.coalesce(content, F.lit("")))).alias("n_chars")
    )
    return total.where("n_pages > 1 and n_chars < 50")


def chunk_ranges(chunks: DataFrame, doc: str = "doc_id", position: str = "corpus_pos") -> DataFrame:
    """First and last corpus position of each document."""
    return chunks.groupBy(doc).agg(F.min(position).alias("chunk_start"), F.max(position).alias("chunk_end"))
