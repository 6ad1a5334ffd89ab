"""Hybrid retrieval for a batch of questions: lanes, fusion, diversity and neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.concepts import normalize_concept
from lorekeep.functions.grams import offered_keys
from lorekeep.functions.text import (
    GLOSSARY_CAP,
    GLOSSARY_WEIGHT,
    about_stacking,
    concept_phrases,
    concepts_overlap,
    question_terms,
    rule_weight,
)
from lorekeep.functions.vectors import cosine
from lorekeep.operators.graph import neighbor_boosts
from lorekeep.operators.lexical import back_references, lexical_best, lexical_of
from lorekeep.params import Params
from lorekeep.session import SMALL_BYTES, cut, if_small, together

# query vectors go to the executors in blocks of at most so many bytes, and for so many best rows, which a task holds twice over
BLOCK_BYTES, BLOCK_BEST = 32 << 20, 1 << 20
# questions that are worth a scan of their own, where that leaves fewer parts of the vectors, each of which gives its own best
SCAN = 1000
# scores of a block of vectors that a task makes at once, and candidates it holds before it picks the best of them
CELLS, HELD = 2 << 20, 1 << 19
# what each number may add to the error of a cosine in single precision; pairs whose cosine is made in double at once
NEAR, PAIRS = 1.2e-7, 1 << 16


def dense_scores(corpus: DataFrame, queries: DataFrame, k: int, key: str = "corpus_pos", vector: str = "embedding") -> DataFrame:
    """question_id, key, dense, rank: the ``k`` vectors of greatest cosine for each query, ties by ``key``.

    Exact: every vector is compared with the blocks of query vectors, in single precision, and in double where that is not
    below the query's k best so far by more than its error. A partition keeps its k best for each query, and the ranking
    goes on per question over those only. Queries are a stated set; each block of them is one scan. Vectors of another length are compared over the shorter
    length; one without length, or with a value that is no number, has the cosine 0, null vectors take no part.
    """
    rows = queries.where("query_vec is not null").select("question_id", "query_vec").orderBy("question_id").toArrow()
    spark = corpus.sparkSession
    kind = corpus.schema[key].dataType.simpleString()
    if not rows.num_rows:
        return spark.createDataFrame([], f"question_id long, {key} {kind}, dense double, rank int")
    every, lists = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    starts, width = np.cumsum(sizes) - sizes, int(sizes.max())
    flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    most, wanted = max(1, min(BLOCK_BYTES // (8 * max(1, width)), BLOCK_BEST // k)), 2 * spark.sparkContext.defaultParallelism
    blocks = max(-(-len(every) // most), min(wanted, len(every) // SCAN))
    size, tasks = -(-len(every) // blocks), -(-wanted // blocks)
    found = None
    for a in range(0, len(every), size):
        inside = np.arange(width) < sizes[a : a + size, None]
        q = np.zeros(inside.shape)
        q[inside] = flat[starts[a] : starts[a] + int(inside.sum())]
        shipped = spark.sparkContext.broadcast((every[a : a + size], q))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q = shipped.value
            lengths = np.sqrt((q * q).cumsum(1))
            with np.errstate(all="ignore"):
                units = np.nan_to_num(q / lengths[:, -1:], nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)
            cols, off = np.arange(q.shape[1]), NEAR * (q.shape[1] + 16)
            # the best so far and what came since: query, key, score; what each query's next one must reach at least
            held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
            rows, least = 0, np.full(len(q), -np.inf)
            for whole in batches:
                for at in range(0, whole.num_rows, max(1, CELLS // len(q))):
                    batch = whole.slice(at, max(1, CELLS // len(q)))
                    lists, keys = batch.column(1), batch.column(0)
                    n = len(lists)
                    sizes = np.asarray(lists.value_lengths().fill_null(0))
                    flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                    if (sizes == q.shape[1]).all():
                        x = flat.reshape(n, q.shape[1]).copy()
                    else:
                        inside = cols[None, :] < sizes[:, None]
                        x = np.zeros((n, q.shape[1]))
                        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                        places = np.where(inside, starts[:, None] + cols, 0)
                        if len(flat):
                            x[inside] = flat[places][inside]
                    bad = ~np.isfinite(x).all(1)
                    x[bad] = 0
                    norm = np.sqrt((x * x).sum(1))
                    near = _near(x, norm, sizes, q, units, lengths)
                    # ties at the edge go by key: all of the least kept score stay until the final ranking
                    edge = least
                    if n > k and not np.isfinite(least).all():
                        edge = np.maximum(least, np.partition(near, n - k, axis=1)[:, n - k] - off)
                    r, c = np.divmod(np.flatnonzero(near >= (edge - off).astype(np.float32)[:, None]), n)
                    s = _cosines(x, norm, sizes, q, lengths, r, c)
                    keep = s >= edge[r] - 1e-9
                    r, c, s = r[keep], c[keep], s[keep]
                    held.append((r, keys.take(pa.array(c)), s))
                    rows += len(r)
                    if rows > max(HELD, 2 * k * len(q)) or not np.isfinite(least).all():
                        held = [_best(held, k)]
                        rows = 0
                        counts = np.bincount(held[0][0], minlength=len(q))
                        low = np.full(len(q), np.inf)
                        np.minimum.at(low, held[0][0], held[0][2])
                        least = np.where(counts >= k, low, -np.inf)
            if held:
                found_q, found_k, found_s = _best(held, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found_q], pa.int64()), found_k, pa.array(found_s)], names=["question_id", key, "dense"])

        # few tasks: each gives its best for every query, so their number makes the result long
        read = corpus.where(F.col(vector).isNotNull()).select(key, vector).coalesce(tasks)
        block = read.mapInArrow(run, f"question_id long, {key} {kind}, dense double")
        found = block if found is None else found.unionAll(block)
    w = Window.partitionBy("question_id").orderBy(F.round("dense", 9).desc(), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _near(x: np.ndarray, norm: np.ndarray, sizes: np.ndarray, q: np.ndarray, units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The cosines of all queries and vectors, each off by less than ``NEAR`` for every number: in single precision where lengths are alike."""
    with np.errstate(all="ignore"):
        near = units @ np.nan_to_num(x / norm[:, None], nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32).T
    other = np.flatnonzero((sizes < q.shape[1]) | ~np.isfinite(near).all(0))
    if len(other):
        near[:, other] = _whole(x[other], norm[other], sizes[other], q, lengths)
    return near


def _whole(x: np.ndarray, norm: np.ndarray, sizes: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The cosines of all queries and vectors."""
    with np.errstate(all="ignore"):
        s = (q @ x.T) / (lengths[:, np.clip(sizes, 1, q.shape[1]) - 1] * norm[None, :])
    s[~np.isfinite(s)] = 0.0
    return s


def _cosines(x: np.ndarray, norm: np.ndarray, sizes: np.ndarray, q: np.ndarray, lengths: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The cosines of queries ``r`` and vectors ``c``."""
    if len(r) * 8 > len(q) * len(x):
        return _whole(x, norm, sizes, q, lengths)[r, c]
    out = np.zeros(len(r))
    for a in range(0, len(r), PAIRS):
        i, j = r[a : a + PAIRS], c[a : a + PAIRS]
        with np.errstate(all="ignore"):
            out[a : a + PAIRS] = np.einsum("ij,ij->i", q[i], x[j]) / (lengths[i, np.clip(sizes[j], 1, q.shape[1]) - 1] * norm[j])
    out[~np.isfinite(out)] = 0.0
    return out


def pair_cosines(pairs: DataFrame, key: str = "corpus_pos") -> DataFrame:
    """question_id, key, dense: ``cosine`` of the query_vec and the embedding of each pair."""

    def one(a: list | None, b: list | None) -> float | None:
        n = min(len(a or ()), len(b or ()))
        if a is None or b is None or None in a[:n] or None in b[:n]:
            return None
        x, y = np.array(a[:n], dtype=np.float64), np.array(b[:n], dtype=np.float64)
        norm = np.sqrt(x @ x) * np.sqrt(y @ y)
        return float(x @ y / norm) if norm else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = (batch.column(2), batch.column(3)), batch.num_rows
            sizes = [np.asarray(c.value_lengths().fill_null(-1)) for c in lists]
            flat = [c.flatten() for c in lists]
            with np.errstate(all="ignore"):
                if n and (sizes[0] == sizes[0][0]).all() and (sizes[1] == sizes[0][0]).all() and sizes[0][0] > 0 and not any(f.null_count for f in flat):
                    x, y = (f.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1) for f in flat)
                    norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
                    found = pa.array(np.where(norm == 0, 0.0, np.einsum("ij,ij->i", x, y) / norm))
                else:
                    found = pa.array([one(a, b) for a, b in zip(*(c.to_pylist() for c in lists), strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["question_id", key, "dense"])

    return pairs.select("question_id", F.col(key).cast("long").alias(key), "query_vec", "embedding").mapInArrow(run, f"question_id long, {key} long, dense double")


def _best(held: list[tuple], k: int) -> tuple:
    """The k best of each query among lists of (query, key, score), ties at the edge included."""
    q = np.concatenate([h[0] for h in held])
    keys = pa.concat_arrays([h[1].combine_chunks() if isinstance(h[1], pa.ChunkedArray) else h[1] for h in held])
    s = np.concatenate([h[2] for h in held])
    if not len(q):
        return q, keys, s
    order = np.lexsort((-s, q))
    q, s = q[order], s[order]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    sizes = np.diff(np.append(starts, len(q)))
    edge = s[np.minimum(starts + k, starts + sizes) - 1]
    keep = s >= np.repeat(edge, sizes) - 1e-9
    return q[keep], keys.take(pa.array(order[keep])), s[keep]


def token_counts(corpus: DataFrame, key: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """key, token, hits: how often each word, or run of words around apostrophes, stands in a text.

    With ``asked`` (token) only those; where they are few they are broadcast, so other words never leave their task.
    """
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), F.lit(1))
    size, joined = 0, True
    if asked is not None:
        r = asked.agg(F.sum(F.length("token") + 24).alias("n"), F.max(F.contains("token", F.lit("'"))).alias("joined")).collect()[0]
        size, joined = r["n"] or 0, bool(r["joined"])
    if joined:
        # runs of words that apostrophes join, from each word on to each later one
        chains = F.regexp_extract_all(low, F.lit("([a-z0-9_]+(?:'+[a-z0-9_]+)+)"), F.lit(1))
        found = F.concat(found, F.flatten(F.transform(chains, _joined_runs)))
    each = corpus.select(key, F.explode(found).alias("token"))
    if asked is not None:
        each = each.join(F.broadcast(asked) if size <= SMALL_BYTES else asked, "token", "left_semi")
    return each.groupBy(key, "token").agg(F.count(F.lit(1)).alias("hits"))


def _joined_runs(chain: Column) -> Column:
    """Every run of two words or more of a chain like rock'n'roll."""
    parts = F.regexp_extract_all(chain, F.lit("([a-z0-9_]+|'+)"), F.lit(1))
    n = F.size(parts)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 2, F.lit(2)),
            lambda i: F.transform(F.sequence(i + 2, n, F.lit(2)), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "")),
        )
    )


def question_words(questions: DataFrame) -> DataFrame:
    """question_id, n_terms, term: the terms of each question."""
    t = questions.select("question_id", question_terms(F.col("question")).alias("terms"))
    return t.select("question_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def lexical_scores(corpus: DataFrame, questions: DataFrame, key: str = "corpus_pos", text: str = "text") -> DataFrame:
    """question_id, key, ratio, hits, boost, lex: lexical scores of all texts with any term or rule phrase of a question.

    Terms meet texts in an equi-join on the word, as in an inverted index, so no text is compared with a question it
    shares nothing with. A text that introduces a term like a glossary is found by its own back-reference.
    """
    terms = question_words(questions)
    asked = terms.select(F.col("term").alias("token")).distinct()
    matched = (
        terms.join(token_counts(corpus, key, text, asked), F.col("term") == F.col("token"))
        .groupBy("question_id", key, "n_terms")
        .agg(F.count(F.lit(1)).alias("k"), F.sum("hits").alias("hits"))
    )
    glossary = (
        corpus.select(key, F.explode(back_references(F.col(text))).alias("term"))
        .join(terms.select("question_id", "term"), "term")
        .groupBy("question_id", key)
        .agg(F.least(F.count(F.lit(1)) * F.lit(GLOSSARY_WEIGHT), F.lit(GLOSSARY_CAP)).alias("glossary"))
    )
    # rule phrases count for questions about stacking only: both sides are few
    stacking = questions.where(about_stacking(F.col("question"))).select("question_id", F.lit(1).alias("__one"))
    ruled = corpus.select(key, rule_weight(F.col(text)).alias("rule"), F.lit(1).alias("__one")).where("rule > 0")
    rules = stacking.join(ruled, "__one").drop("__one")
    on = ["question_id", key]
    both = matched.join(rules, on, "full").join(glossary, on, "left")
    ratio = F.coalesce(F.col("k") / F.col("n_terms"), F.lit(0.0))
    hits = F.coalesce("hits", F.lit(0))
    boost = F.coalesce("rule", F.lit(0.0)) + F.coalesce("glossary", F.lit(0.0))
    lex = ratio * 2 + F.least(hits * F.lit(0.04), F.lit(0.45)) + boost
    return both.select(*on, ratio.alias("ratio"), hits.alias("hits"), boost.alias("boost"), lex.alias("lex")).where("lex > 0")


def ranked(scores: DataFrame, by: str, k: int, key: str = "corpus_pos", name: str = "rank") -> DataFrame:
    """The ``k`` best rows of each question, ties by ``key``."""
    w = Window.partitionBy("question_id").orderBy(F.round(by, 9).desc(), key)
    return scores.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def question_phrases(questions: DataFrame) -> DataFrame:
    """question_id, phrases: the phrases of each question that may name a concept, written once.

    They are made once for each text, spread over all cores: questions repeat, and their phrases cost more than anything else
    here.
    """
    spread = 2 * questions.sparkSession.sparkContext.defaultParallelism
    texts = cut(questions.select("question").repartition(spread, "question").distinct().withColumn("phrases", concept_phrases(F.col("question"))))
    same = questions["question"].eqNullSafe(texts["question"])
    return cut(questions.select("question_id", "question").join(texts.hint("shuffle_merge"), same).select("question_id", "phrases"))


def met_concepts(phrases: DataFrame, keys: DataFrame) -> DataFrame:
    """phrase, define: phrases (phrase) and defined concepts (define), each once, that overlap loosely.

    One contains the other, so the shorter one's first characters are a key that the longer one offers too: containment is an
    equi-join both ways. Strings of four characters overlap as whole words at an end, those of three only in full. Only keys that
    the other side looks up are kept: a side of few keys is broadcast as a filter, so the rest never leave their task.
    """
    tiers = (8, 5)

    def short_key(c: str) -> Column:
        return F.when(F.length(c) >= 8, F.substring(c, 1, 8)).when(F.length(c) >= 5, F.substring(c, 1, 5))

    def at_ends(c: str) -> Column:
        # whole words of four characters at the ends
        return F.array_compact(
            F.array(F.regexp_extract(c, r"^(.{4}) ", 1), F.regexp_extract(c, r" (.{4})$", 1))
        )

    def offers(df: DataFrame, c: str) -> DataFrame:
        keys_of = F.array_union(F.array_union(offered_keys(F.col(c), tiers), at_ends(c)), F.array(c))
        return df.withColumn("g", F.explode(F.filter(keys_of, lambda x: x != "")))

    def looks(df: DataFrame, c: str) -> DataFrame:
        return df.withColumn("g", F.coalesce(short_key(c), F.col(c)))

    def meet(short: DataFrame, long: DataFrame) -> DataFrame:
        wanted = if_small(short.select("g").distinct(), F.length("g") + 24)
        # never by an estimate, which does not see how many keys a string offers
        return short.hint("shuffle_merge").join(long.join(wanted, "g", "left_semi"), "g").select("phrase", "define")

    said = cut(phrases.select("phrase").where("phrase <> ''").distinct())
    defines = cut(keys.select("define").where("define <> ''").distinct())
    pairs = meet(looks(said, "phrase"), offers(defines, "define")).unionAll(meet(looks(defines, "define"), offers(said, "phrase")))
    return pairs.where(concepts_overlap(F.col("define"), F.col("phrase"))).distinct()


def concept_matches(questions: DataFrame, keys: DataFrame, phrases: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """question_id, phrase, define: phrases of questions and defined concepts (define) that overlap loosely.

    Each phrase is looked up once, however many questions have it. ``phrases``: ``question_phrases``, ``met``:
    ``met_concepts``, if they are there already.
    """
    phrases = question_phrases(questions) if phrases is None else phrases
    said = phrases.select("question_id", F.explode("phrases").alias("phrase"))
    met = cut(met_concepts(said, keys)) if met is None else met
    few = if_small(met, F.length("phrase") + F.length("define") + 48)
    return said.join(few, "phrase").select("question_id", "phrase", "define").distinct()


def define_keys(sections: DataFrame, *more: str) -> DataFrame:
    """define, more: the normalised names that sections define, of three letters or more."""
    return sections.select(F.explode("defines").alias("c"), *more).select(normalize_concept(F.col("c")).alias("define"), *more).where("length(define) >= 3")


def define_lane(questions: DataFrame, sections: DataFrame, top: int, weight: float, places: DataFrame | None = None, phrases: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """question_id, chunk_id, hits, boost: chunks of sections that define a concept a question may name, the ``top`` best.

    Hits count pairs of phrase and concept; the boost grows with up to four. ``places`` (chunk_id, corpus_pos) leaves out
    chunks that are not there and settles ties by position, else by id. Questions with the same known phrases have the same
    chunks, so these are counted and ranked once for each set of phrases. ``phrases`` and ``met`` as for ``concept_matches``.
    """
    keys = define_keys(sections, "chunk_ids")
    phrases = question_phrases(questions) if phrases is None else phrases
    said = phrases.select("question_id", F.explode("phrases").alias("phrase"))
    met = cut(met_concepts(said, keys)) if met is None else met
    known = if_small(met.select("phrase").distinct(), F.length("phrase") + 24)
    kinds = cut(said.join(known, "phrase", "left_semi").groupBy("question_id").agg(F.array_sort(F.collect_set("phrase")).alias("kind")))
    each = kinds.select("kind").distinct().select("kind", F.explode("kind").alias("phrase"))
    pairs = cut(each.join(met, "phrase").groupBy("kind", "define").agg(F.count(F.lit(1)).alias("n")))
    few = if_small(pairs, F.length("define") + F.length(F.array_join("kind", " ")) + 16 * F.size("kind") + 64)
    chunks = keys.select("define", F.explode("chunk_ids").alias("chunk_id")).distinct()
    order = "chunk_id"
    if places is not None:
        chunks, order = chunks.join(places.select("chunk_id", "corpus_pos"), "chunk_id"), "corpus_pos"
    named = list(dict.fromkeys(["kind", "chunk_id", order]))
    hits = few.join(chunks, "define").groupBy(*named).agg(F.sum("n").alias("hits"))
    w = Window.partitionBy("kind").orderBy(F.col("hits").desc(), order)
    best = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return kinds.join(best, "kind").select("question_id", "chunk_id", "hits", (F.least("hits", F.lit(4)) * F.lit(weight)).alias("boost"))


def define_debug(questions: DataFrame, sections: DataFrame, lane: DataFrame, most: int = 48, phrases: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """question_id, phrase_count, chunks_seeded, matched_pairs: what the define lane looked for and found."""
    phrases = question_phrases(questions) if phrases is None else phrases
    w = Window.partitionBy("question_id").orderBy("phrase", "define")
    pairs = (
        concept_matches(questions, define_keys(sections), phrases, met)
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= most)
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.concat("phrase", F.lit("↔"), "define"))).alias("matched_pairs"))
    )
    seeded = lane.groupBy("question_id").agg(F.count(F.lit(1)).alias("chunks_seeded"))
    asked = phrases.select("question_id", F.size("phrases").alias("phrase_count"))
    none = F.array().cast("array<string>")
    return (
        asked.join(seeded, "question_id", "left").join(pairs, "question_id", "left")
        .select("question_id", "phrase_count", F.coalesce("chunks_seeded", F.lit(0)).alias("chunks_seeded"), F.coalesce("matched_pairs", none).alias("matched_pairs"))
    )


def diverse(ranked_rows: DataFrame, k: int, cap: int, doc: str = "doc_id", rank: str = "rank") -> DataFrame:
    """``k`` rows of each question with at most ``cap`` of a document, then the best of the rest; ``pick`` is the place."""
    by_doc = Window.partitionBy("question_id", doc).orderBy(rank)
    over = ranked_rows.withColumn("__over", (F.row_number().over(by_doc) > cap).cast("int"))
    w = Window.partitionBy("question_id").orderBy("__over", rank)
    return over.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).drop("__over")


def with_neighbors(picked: DataFrame, corpus: DataFrame, window: int, top: int, doc: str = "doc_id", index: str = "chunk_index", more: tuple[str, ...] = ()) -> DataFrame:
    """question_id, doc, index, place: the picks, the first ``top`` of them with the chunks before and after.

    With ``more`` those columns of ``corpus`` too, a row for each of its chunks there.
    """
    near = F.sequence(F.lit(-window), F.lit(window)) if window > 0 else F.array(F.lit(0))
    offsets = F.when(F.col("pick") <= top, near).otherwise(F.array(F.lit(0)))
    spread = picked.select("question_id", doc, "pick", F.col(index).alias("__i"), F.explode(offsets).alias("d"))
    # the pick itself, then those before it, then those after it
    turn = F.when(F.col("d") == 0, 0).when(F.col("d") < 0, F.col("d") + window + 1).otherwise(F.col("d") + window)
    wanted = spread.select("question_id", doc, (F.col("__i") + F.col("d")).alias(index), F.struct("pick", turn.alias("turn")).alias("o"))
    # some dozen rows a question, so the corpus need not move for them
    first = cut(wanted.groupBy("question_id", doc, index).agg(F.min("o").alias("o")))
    held = corpus.select(doc, index, *more).join(if_small(first, F.length(doc) + 56), [doc, index])
    if not more:
        held = held.distinct()
    # every turn of a pick is one place of a document, so equal places are chunks at the same one
    w = Window.partitionBy("question_id").orderBy("o")
    return held.withColumn("place", F.dense_rank().over(w)).select("question_id", doc, index, "place", *more)


def router_boosts(doc_vectors: DataFrame, queries: DataFrame, weight: float, doc: str = "doc_id", pool: DataFrame | None = None) -> DataFrame:
    """question_id, doc, boost: cosine of question and document summary over the greatest of the question, times weight.

    The greatest is an exact top-1 over all documents. With ``pool`` (question_id, doc) only the boosts of its pairs are
    computed, else those of every pair of question and document.
    """
    best = dense_scores(doc_vectors, queries, 1, doc, "embedding").select("question_id", F.greatest("dense", F.lit(1e-12)).alias("most"))
    if pool is None:
        scores = dense_scores(doc_vectors, queries, max(1, doc_vectors.count()), doc, "embedding").select("question_id", doc, "dense")
    else:
        scores = (
            pool.select("question_id", doc).distinct()
            .join(doc_vectors.select(doc, "embedding"), doc)
            .join(queries.where("query_vec is not null").select("question_id", "query_vec"), "question_id")
            .select("question_id", doc, cosine(F.col("query_vec"), F.col("embedding")).alias("dense"))
        )
    return scores.join(best, "question_id").select("question_id", doc, (F.col("dense") / F.col("most") * weight).alias("boost"))


def hint_boosts(entries: DataFrame, questions: DataFrame, chunks: DataFrame, weight: float, doc: str = "doc_id") -> DataFrame:
    """question_id, chunk_id, boost: chunks on a page that the index names for a term of the question.

    An index key matches a term if it is the term or begins with it as a word: its leading words are the join key.
    """
    words = F.split("topic_norm", " ")
    lead = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))
    keyed = entries.select(doc, F.explode(lead).alias("term"), "pages").where("length(term) >= 2")
    pages = keyed.join(question_words(questions).select("question_id", "term"), "term").select("question_id", doc, F.explode("pages").alias("page")).distinct()
    on = chunks.select(doc, "chunk_id", F.explode(F.when(F.col("page_start") <= F.col("page_end"), F.sequence("page_start", "page_end"))).alias("page"))
    return pages.join(on, [doc, "page"]).select("question_id", "chunk_id").distinct().withColumn("boost", F.lit(weight))


def settled(corpus: DataFrame) -> DataFrame:
    """``corpus`` written once, so that its lanes do not each settle the current rows anew."""
    return cut(corpus)


def hybrid(corpus: DataFrame, questions: DataFrame, p: Params, sections: DataFrame | None = None, hints: DataFrame | None = None, doc_vectors: DataFrame | None = None) -> DataFrame:
    """question_id, corpus_pos, chunk_id, doc_id, chunk_index, score, rank, pick: the fused ranking with its picks.

    ``corpus``: corpus_pos, chunk_id, doc_id, chunk_index, page_start, page_end, text, embedding; cheap to read, see
    ``settled`` and ``current_apart``. ``sections``: section_id, doc_id, title, see_also, defines, refs, chunk_ids, for the lanes of graph and
    concepts. ``hints``: doc_id, topic_norm, pages. ``doc_vectors``: doc_id, embedding. The pool joins the lanes in the
    order dense, lexical, graph, concepts; document router and index hints only add to scores. A lane of weight 0, or one
    without its table, is not built.
    """
    # read by several lanes
    questions = cut(questions)
    wide = max(p.candidate_pool, p.top_k, p.graph_seeds if p.graph_weight > 0 else 0)
    steps = [lambda: cut(dense_scores(corpus, questions, wide))]
    if p.lexical_top > 0:
        steps.append(lambda: cut(ranked(lexical_best(corpus, questions, p.lexical_top).select("question_id", "corpus_pos", "lex"), "lex", p.lexical_top)))
    dense, *lexical = together(*steps)
    on = ["question_id", "corpus_pos"]
    place = corpus.select("corpus_pos", "chunk_id", "doc_id", "chunk_index", "page_start", "page_end")
    if sections is not None and max(p.graph_weight, p.define_weight) > 0:
        # these lanes look it up again and again, which should not read texts and vectors
        place = cut(place)

    def lane(df: DataFrame, no: int, rank: Column) -> DataFrame:
        return df.select(*on, F.struct(F.lit(no).alias("lane"), rank.cast("int").alias("r")).alias("o"))

    lanes = [lane(dense.where(F.col("rank") <= max(p.candidate_pool, p.top_k)), 0, F.col("rank"))]
    lanes += [lane(found, 1, F.col("rank")) for found in lexical]
    added: list[DataFrame] = []

    def adds(df: DataFrame) -> None:
        added.append(df.select(*on, "boost"))

    if p.graph_weight > 0 and sections is not None:
        named = dense.where(F.col("rank") <= p.graph_seeds).join(place, "corpus_pos").select("question_id", "chunk_id")
        found = neighbor_boosts(named, sections, p.graph_edge_types, p.graph_per_hit, p.graph_weight).join(place, "chunk_id")
        by_place = Window.partitionBy("question_id").orderBy("corpus_pos")
        lanes.append(lane(found, 2, F.row_number().over(by_place)))
        adds(found)
    if p.define_weight > 0 and sections is not None:
        found = define_lane(questions, sections, p.define_top, p.define_weight, place).join(place, "chunk_id")
        by_hits = Window.partitionBy("question_id").orderBy(F.col("hits").desc(), "corpus_pos")
        lanes.append(lane(found, 3, F.row_number().over(by_hits)))
        adds(found)
    pool = lanes[0]
    for more in lanes[1:]:
        pool = pool.unionAll(more)
    # a few hundred rows a question, read by every lane that only adds; a position is 16 bytes as a row
    pool = cut(pool.groupBy(*on).agg(F.min("o").alias("o")))
    held = if_small(pool.select("corpus_pos").distinct(), F.lit(16))
    # of the corpus the rest reads the pool's chunks only
    corpus = cut(corpus.select("corpus_pos", "chunk_id", "doc_id", "chunk_index", "page_start", "page_end", "text", "embedding").join(held, "corpus_pos", "left_semi"))
    pool = cut(pool.join(corpus.select("corpus_pos", "doc_id"), "corpus_pos"))
    if p.index_hint_boost > 0 and hints is not None:
        found = hint_boosts(hints, questions, corpus.select("chunk_id", "doc_id", "page_start", "page_end"), p.index_hint_boost).join(corpus.select("chunk_id", "corpus_pos"), "chunk_id")
        adds(found.join(pool.select(*on), on, "left_semi"))
    if p.doc_router_weight > 0 and doc_vectors is not None:
        adds(router_boosts(doc_vectors, questions, p.doc_router_weight, "doc_id", pool).join(pool.select(*on, "doc_id"), ["question_id", "doc_id"]))
    # of the texts those of the pool are scored again, of the vectors those that the dense lane does not have
    lex = lexical_of(pool.select(*on).join(corpus.select("corpus_pos", "text"), "corpus_pos"), questions)
    rest = cut(pool.select(*on).join(dense.select(*on), on, "left_anti"))
    apart = if_small(rest.select("corpus_pos").distinct(), F.lit(16))
    vectors = corpus.select("corpus_pos", "embedding").join(apart, "corpus_pos", "left_semi")
    more_dense = pair_cosines(rest.join(vectors, "corpus_pos").join(questions.select("question_id", "query_vec"), "question_id"))
    scored = (
        pool.join(dense.select(*on, "dense").unionAll(more_dense), on, "left")
        # as in the dense lane, a cosine that is no number is 0; it would rank above all others
        .withColumn("dense", F.when(F.abs("dense") < float("inf"), F.col("dense")).otherwise(0.0))
        .join(lex.select(*on, "ratio", "boost"), on, "left")
    )
    score = F.col("dense") + F.coalesce("ratio", F.lit(0.0)) * p.lexical_weight + F.coalesce("boost", F.lit(0.0))
    if added:
        total = added[0]
        for more in added[1:]:
            total = total.unionAll(more)
        scored = scored.join(total.groupBy(*on).agg(F.sum("boost").alias("added")), on, "left")
        score = score + F.coalesce("added", F.lit(0.0))
    w = Window.partitionBy("question_id").orderBy(F.round("score", 9).desc(), "o", "corpus_pos")
    fused = scored.withColumn("score", score).withColumn("rank", F.row_number().over(w))
    picked = diverse(fused.select(*on, "doc_id", "score", "rank"), p.top_k, p.max_per_document)
    # the pool is long, the picks are few
    return picked.join(corpus.select("corpus_pos", "chunk_id", "chunk_index"), "corpus_pos").select(*on, "chunk_id", "doc_id", "chunk_index", "score", "rank", "pick")
