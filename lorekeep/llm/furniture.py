"""Lines repeated across one source's documents, found by growing frequent line sequences per source.

The lines of a page are a sequence of line identifiers, the pages of a source its sequence database. PrefixSpan starts with
the lines that alone have enough support and grows them down the pages until no sequence is frequent; what is deleted
are the occurrences of the lines of frequent sequences, single lines included.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import cut, if_small


def page_keys(content: Column) -> Column:
    """One key for each line between line feeds: its letters, without letter case, white space, digits, punctuation, signs."""
    return F.split(F.regexp_replace(F.lower(content), r"[^\p{L}\n]+", ""), "\n")


def keyed_pages(pages: DataFrame, source: str, page: str, content: str) -> DataFrame:
    """source, page, keys: the keys of every page's lines in order, empty where a line has no letter."""
    return pages.select(F.col(source).alias("source"), F.col(page).alias("page"), page_keys(F.col(content)).alias("keys"))


def _halves(source: Column, key: Column) -> Column:
    """Hashes of the halves that two keys of a source share if one letter differs, is missing or is added.

    For lengths m and m or m + 1 either the first or the last m // 2 letters agree; a key offers the halves of its own
    length and of a length one less. Two keys of one or two letters may share nothing but an empty half.
    """
    n = F.length(key)
    own, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")

    def side(h: Column) -> list[Column]:
        return [
            F.xxhash64(source, F.lit(0), h, F.substring(key, F.lit(1), h)),
            F.xxhash64(source, F.lit(1), h, F.substring(key, n - h + 1, h)),
        ]

    return F.array_distinct(F.array(*side(own), *side(less)))


def _need(pages_of: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """source, need: the pages on which a line or sequence must stand; ``pages_of`` has source and n_pages."""
    floor = F.greatest(F.lit(min_pages), F.ceil(F.col("n_pages") * F.lit(min_share) - F.lit(1e-9))).cast("long")
    return pages_of.select("source", floor.alias("need"))


def line_members(keyed: DataFrame, need: DataFrame) -> DataFrame:
    """source, key, line, need: keys with each repeated line they may stand for, only lines that may have the support.

    A key on two pages or more is a line; it stands for itself and for every line on as many pages or more from which one
    letter tells it apart. A key on one page is at most a misprint. Keys are compared only where they share a half, and
    lines are left out whose support cannot reach ``need`` even if every such key adds to it.
    """
    each = keyed.select("source", F.explode(F.array_distinct("keys")).alias("key")).where("key <> ''")
    lines = cut(each.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    heads = lines.select("source", F.col("key").alias("line"), F.col("n").alias("n_line"), F.explode(_halves(F.col("source"), F.col("key"))).alias("half"))
    near = if_small(heads.drop("source"), F.length("line") + 40)
    one_off = (F.col("key") != F.col("line")) & (F.abs(F.length("key") - F.length("line")) <= 1)

    def close_to(keys: DataFrame) -> DataFrame:
        halved = keys.select("source", "key", "n", F.explode(_halves(F.col("source"), F.col("key"))).alias("half"))
        near_keys = halved.join(near, "half").where((F.col("n") <= F.col("n_line")) & one_off & (F.levenshtein("key", "line", 1) >= 0))
        return near_keys.select("source", "key", "line", "n").distinct()

    # lines among each other, and keys on one page only, which are the many
    lone = each.join(if_small(lines.select("source", "key"), F.length("key") + 40), ["source", "key"], "left_anti")
    others = close_to(lines).unionAll(close_to(lone.withColumn("n", F.lit(1).cast("long"))))
    members = cut(lines.select("source", "key", F.col("key").alias("line"), "n").unionAll(others))
    hopeful = members.groupBy("source", "line").agg(F.sum("n").alias("most")).join(need, "source").where("most >= need")
    return cut(members.join(hopeful.select("source", "line", "need"), ["source", "line"]).select("source", "key", "line", "need"))


def repeated_lines(
    pages: DataFrame, source: str, page: str, content: str, min_pages: int = 5, min_share: float = 0.15
) -> tuple[DataFrame, DataFrame]:
    """Occurrences and frequent sequences of the lines that are repeated excessively in their source.

    Occurrences: source, page, line_no, line, for each line of a frequent sequence, single lines included. Sequences: source,
    lines (array), support. A line is the same as another if one letter was changed, lost or added; a key near several
    frequent lines stands for the one with the most support. One row of ``pages`` is one page; null and empty contents
    have no lines but count as pages; a null source never matches. A line must stand on at least ``min_pages`` pages and
    at least ``min_share`` of its source's. The pages are keyed once; counts are combined on the map side, and nothing
    is collected per source.
    """
    keyed = cut(keyed_pages(pages, source, page, content))
    counted = keyed.groupBy("source").agg(F.count_distinct("page").alias("n_pages"))
    need = cut(_need(counted, min_pages, min_share))
    members = line_members(keyed, need)
    narrow = if_small(members, F.length("key") + F.length("line") + 40)
    found = keyed.select("source", "page", F.posexplode("keys").alias("line_no", "key")).where("key <> ''").join(narrow, ["source", "key"])
    support = (
        found.select("source", "line", "need", "page").distinct()
        .groupBy("source", "line", "need").agg(F.count(F.lit(1)).alias("support"))
        .where("support >= need")
    )
    ids = Window.partitionBy("source").orderBy("line")
    frequent = cut(support.withColumn("item", F.row_number().over(ids)).select("source", "line", "support", "item"))
    best = Window.partitionBy("source", "key").orderBy(F.col("support").desc(), "line")
    chosen = cut(
        members.join(frequent, ["source", "line"]).withColumn("r", F.row_number().over(best)).where("r = 1").select("source", "key", "line", "item")
    )
    small = if_small(chosen, F.length("key") + F.length("line") + 40)
    occurrences = (
        keyed.select("source", "page", F.posexplode("keys").alias("line_no", "key"))
        .where("key <> ''")
        .join(small, ["source", "key"])
        .select("source", "page", "line_no", "line", "item")
    )
    sequences = line_sequences(occurrences, need)
    # what is frequent alone or in company is deleted
    items = sequences.select("source", F.explode("items").alias("item")).distinct()
    gone = occurrences.join(if_small(cut(items), F.lit(60)), ["source", "item"], "left_semi").select("source", "page", "line_no", "line")
    named = (
        sequences.select("source", "support", F.col("items").alias("of"), F.posexplode("items").alias("at", "item"))
        .join(frequent.select("source", "item", "line"), ["source", "item"])
        .groupBy("source", "of", "support")
        .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("xs"))
        .select("source", F.col("xs.line").alias("lines"), "support")
    )
    return gone, named


def line_sequences(occurrences: DataFrame, need: DataFrame) -> DataFrame:
    """source, items (array), support: the frequent sequences of line identifiers, of any length.

    ``occurrences``: source, page, line_no, item. ``need``: source, need. Pages of a source with the same sequence become one
    row with a weight, so a book of a thousand like pages is one row. PrefixSpan then keeps, for each such row and
    frequent prefix, where the prefix first ends (the projected database), and grows it by every item further on; the
    growth ends with the first length that has no frequent sequence.
    """
    by_page = occurrences.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "item"))).alias("xs"))
    base = (
        by_page.select("source", F.col("xs.item").alias("seq")).groupBy("source", "seq").agg(F.count(F.lit(1)).alias("weight"))
    )
    grown = base.select("source", "seq", "weight", F.array().cast("array<int>").alias("items"), F.lit(0).alias("end"))
    found = None
    for _ in itertools.count():
        rest = F.slice("seq", F.col("end") + 1, F.size("seq"))
        step = grown.select("source", "seq", "weight", "items", "end", rest.alias("rest")).select(
            "source", "seq", "weight", "items", "end", "rest", F.explode(F.array_distinct("rest")).alias("next")
        )
        step = cut(
            step.select(
                "source",
                "seq",
                "weight",
                F.concat("items", F.array("next")).alias("items"),
                (F.col("end") + F.array_position("rest", F.col("next")).cast("int")).alias("end"),
            )
        )
        level = cut(
            step.groupBy("source", "items").agg(F.sum("weight").alias("support")).join(need, "source").where("support >= need").select("source", "items", "support")
        )
        found = level if found is None else found.unionAll(level)
        if level.isEmpty():
            return found
        grown = step.join(if_small(level, 8 * F.size("items") + 60).select("source", "items"), ["source", "items"], "left_semi")


def without_lines(pages: DataFrame, occurrences: DataFrame, source: str, page: str, content: str) -> DataFrame:
    """``pages`` with the repeated lines taken out of ``content``; other lines keep their exact text and order."""
    gone = occurrences.groupBy(F.col("source").alias(source), F.col("page").alias(page)).agg(
        F.collect_set("line_no").alias("__gone")
    )
    kept = F.array_join(
        F.filter(F.split(content, "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n"
    )
    return (
        pages.join(gone, [source, page], "left")
        .withColumn(content, F.when(F.col("__gone").isNull(), F.col(content)).otherwise(kept))
        .drop("__gone")
    )


def without_aligned(text: str | None, gone: list[dict] | None) -> str | None:
    """``text`` without the lines ``gone`` (before, line, after), where they stand as whole words next to what they stand next to.

    ``before`` and ``after`` are the words around the line on its page, null at its edges. The same words inside a
    sentence of the body have other neighbours and stay.
    """
    if text is None or gone is None or not len(gone):
        return text
    words = text.split()
    drop = [False] * len(words)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    for g in gone:
        line = (g["line"] or "").split()
        for i in places.get(line[0], []) if line else []:
            j = i + len(line)
            if words[i:j] != line:
                continue
            left = i == 0 or g["before"] is None or drop[i - 1] or words[i - 1] == g["before"]
            right = j == len(words) or g["after"] is None or drop[j] or words[j] == g["after"]
            # a heading beside the line may have left the chunk, so one side is enough inside it
            if (left and right) if i == 0 or j == len(words) else (left or right):
                drop[i:j] = [True] * len(line)
    return " ".join(w for w, d in zip(words, drop, strict=True) if not d) if any(drop) else text


def without_phrases(chunks: DataFrame, key: str, text: str, page_lines: DataFrame, on: list[str]) -> DataFrame:
    """key, before, after: the text of each chunk, and the text without the repeated lines of its pages.

    ``page_lines``: the columns ``on`` and ``lines``, an array of (before, line, after). ``chunks`` has one row for each page a
    chunk stands on. A chunk is joined words, so lines are found as words in their place; nulls stay null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cleaned = [without_aligned(t, g) for t, g in zip(frame["before"], frame["gone"], strict=True)]
            yield pd.DataFrame({key: frame[key], "before": frame["before"], "after": pd.Series(cleaned, dtype=object)})

    kind = chunks.schema[key].dataType.simpleString()
    gathered = chunks.join(page_lines, on, "left").groupBy(key).agg(
        F.first(text).alias("before"), F.array_sort(F.flatten(F.collect_list("lines"))).alias("gone")
    )
    return gathered.mapInPandas(run, f"`{key}` {kind}, before string, after string")
