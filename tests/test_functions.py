"""Scalar functions against hand-derived values and plain Python restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import snippets, text
from lorekeep.functions.concepts import normalize_concept
from lorekeep.functions.vectors import cosine
from lorekeep.operators.ingest import chunk_pages, page_segments, section_islands, token_windows
from lorekeep.operators.retrieve import dense_scores, diverse, lexical_scores, with_neighbors


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_concepts_and_slugs(spark):
    names = ["Impaired (affliction)", "(x)", " The  Guard’s Oath. ", None, ""]
    assert values(spark, normalize_concept, names) == ["impaired", "", "the guard's oath", None, ""]
    assert values(spark, text.slug, ["SRD_CC_v5.2.1.pdf", "--a", ""]) == ["srd-cc-v5-2-1-pdf", "a", ""]


def test_headings(spark):
    lines = ["COMBAT RULES", "Spell Appendix", "Order of the Hand", "## X1", "Spells:", "end.", "abc", "## x", None]
    want = ["COMBAT RULES", "Spell Appendix", "Order of the Hand", "X1", None, None, None, None, None]
    assert values(spark, text.heading_of, lines) == want


def test_question_terms(spark):
    got = values(spark, text.question_terms, ["How much mana does a spell cost?", "If I gain a condition I already have, does it stack?", ""])
    assert got[0] == ["much", "mana", "spell", "cost"]
    assert got[1] == ["gain", "condition", "already", "stack", "multiple", "affliction", "afflictions", "additional"]
    assert got[2] == []


def test_index_lines(spark):
    got = values(spark, text.index_entry, ["Impaired (affliction) .... 12, 40", "see Magic 3", "12. Foo 3", "Index 4", None])
    assert (got[0]["topic"], got[0]["pages"]) == ("Impaired (affliction)", [12, 40])
    assert got[1:] == [None] * 4


def test_word_boundary_is_ascii(spark):
    df = spark.createDataFrame([("èrate rate crate Rate",)], "t string")
    assert df.select(text.hits_of(F.col("t"), F.lit("rate"))).collect()[0][0] == 3


@pytest.mark.parametrize("n", [0, 3, 4, 99, 100, 187, 188, 301])
def test_windows_equal_the_loop(spark, n):
    words = [f"w{i}" for i in range(n)]
    buffer, want = [], []
    for w in words:
        buffer.append(w)
        if len(buffer) * 3 >= 300:
            want.append(" ".join(buffer))
            buffer = buffer[-13:]
    if buffer and len(buffer) * 3 > 10:
        want.append(" ".join(buffer))
    df = spark.createDataFrame([("d", " ".join(words))], "doc string, t string")
    got = token_windows(df, ["doc"], "t").orderBy("window_no").collect()
    assert [r.text for r in got] == want


def test_markdown_page(spark):
    page = "# Title\n## Core Mechanic\nRoll a die and add it.\n\n## Combat\nA round has turns.\nEach turn is short.\n"
    df = spark.createDataFrame([("m", 1, page), ("m", 2, None), ("n", 1, "no heading here")], "doc_id string, page_number int, content string")
    got = {(r.doc_id, r.seg_no): (r.section_heading, r.content) for r in page_segments(df, ["doc_id", "page_number"]).collect()}
    assert got == {
        ("m", 0): ("Core Mechanic", "Roll a die and add it."),
        ("m", 1): ("Combat", "A round has turns. Each turn is short."),
        ("n", 0): (None, "no heading here"),
    }
    chunks = chunk_pages(df)
    assert sorted(r.chunk_id for r in chunks.collect()) == ["m#0", "m#1"]  # three words are too few for a chunk
    paged = chunks.withColumns({"page_start": F.col("page_number"), "page_end": F.col("page_number")})
    assert {r.title for r in section_islands(paged).collect()} == {"Core Mechanic", "Combat"}


def test_cosine_and_dense(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 0.0]), (6, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "corpus_pos long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "question_id long, query_vec array<float>")
    got = dense_scores(df, q, 3).orderBy("rank").collect()
    assert [(r.question_id, r.corpus_pos, round(r.dense, 6)) for r in got] == [(7, 0, 1.0), (7, 4, 1.0), (7, 5, 1.0)]
    one = df.where("corpus_pos = 4").select(cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0)))).collect()[0][0]
    assert one == 1.0
    assert dense_scores(df.limit(0), q, 3).count() == 0


def test_lexical_glossary_and_rules(spark):
    corpus = spark.createDataFrame(
        [(0, "Impaired An impaired creature has no additional effect"), (1, "nothing"), (2, None), (3, "impaired, impaired")],
        "corpus_pos long, text string",
    )
    q = spark.createDataFrame([(1, "Impaired twice?"), (2, "the")], "question_id long, question string")
    got = {r.corpus_pos: r for r in lexical_scores(corpus, q).collect()}
    assert set(got) == {0, 3}
    assert round(got[0].boost, 6) == 0.29 and got[0].hits == 3  # impaired twice, additional once
    assert round(got[3].lex, 6) == round(2 / 7 + 0.08, 6)


def test_diversity_and_neighbors(spark):
    rows = [(1, "A", i, i + 1) for i in (5, 6, 9)] + [(1, "B", 0, 4)]
    df = spark.createDataFrame(rows, "question_id long, doc_id string, chunk_index int, rank int")
    picks = diverse(df, 4, 2).orderBy("pick").collect()
    assert [(r.doc_id, r.chunk_index) for r in picks] == [("B", 0), ("A", 5), ("A", 6), ("A", 9)]
    corpus = spark.createDataFrame([("d", i) for i in range(4, 8)], "doc_id string, chunk_index int")
    two = spark.createDataFrame([(1, "d", 5, 1), (1, "d", 6, 2)], "question_id long, doc_id string, chunk_index int, pick int")
    near = with_neighbors(two, corpus, 1, 1).orderBy("place").collect()
    assert [r.chunk_index for r in near] == [5, 4, 6]


def test_snippets():
    body = "Filler sentence here. " * 40 + "Multiple Afflictions You gain it. " + "Rules text goes on and on. " * 8 + "The Environment is next."
    assert snippets.rule_block(body).startswith("Multiple Afflictions") and "Environment" not in snippets.rule_block(body)
    assert snippets.focus(None, "a") is None and snippets.focus("short", "answer") == "short"
    long = "zzz " * 200 + "the warden marks the broken seal at once " + "yyy " * 200
    assert "broken seal" in snippets.focus(long, "The warden marks the broken seal at once.")
    assert len(snippets.capped("word " * 400)) <= 961


def test_support_matches_snippet_support(spark):
    rng = random.Random(4)
    words = "warden marks broken seal roll dice no additional effect again bridge narrow".split()
    rows = [(" ".join(rng.choices(words, k=12)).capitalize() + ".", " ".join(rng.choices(words, k=25))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a string, s string")
    got = df.select("a", "s", text.best_support(F.col("a"), F.col("s")).alias("x")).collect()
    for r in got:
        want = max(c.support(r.s.lower()) for c in snippets._clauses(r.a))
        assert abs(want - r.x) < 1e-9, (r, want)


def test_estimated_tokens_counts_words(spark):
    texts = ["a b  c", "", None, " x y "]
    want = [3 * len(re.split(r"\s+", t.strip())) if t and t.strip() else (None if t is None else 0) for t in texts]
    got = values(spark, text.estimated_tokens, texts)
    assert [g if t is not None else None for g, t in zip(got, texts, strict=True)] == want
