"""Blocks, parsing, enrichment, requests, providers and parameters."""

import collections
import itertools
import json
import random
import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import parsing as ps
from lorekeep.functions import text as tx
from lorekeep.operators import ask, blocks, enrich
from lorekeep.operators import citations as ci
from lorekeep.operators import graph as gr
from lorekeep.operators import ingest as ing
from lorekeep.operators import lexical as lx
from lorekeep.operators import prompt as pr
from lorekeep.operators import retrieve as rt
from lorekeep.params import Params, load_params
from lorekeep.providers import HashEmbedder, WordEstimate, embedded
from lorekeep.session import if_small


def test_blocks_against_loops(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    rng = random.Random(1)
    rows = [(d, i, rng.randint(0, 5), rng.choice([None, "x", "y"])) for d in ("a", "b", None) for i in range(0, 30, 1 + (d == "b"))]
    df = spark.createDataFrame(rows, "doc string, i int, n int, h string").repartition(5)
    total = {(r.doc, r.i): r.t for r in blocks.running_total(df, "doc", "i", "n", "t").collect()}
    prev = {(r.doc, r.i): (r.prev_h, r.prev_exists) for r in blocks.with_previous(df, "doc", "i", ["h"]).collect()}
    for d, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        at, before = 0, None
        for r in group:
            assert total[d, r[1]] == at
            assert prev[d, r[1]] == ((before[3], True) if before else (None, False))
            at, before = at + r[2], r
    assert blocks.running_total(df.limit(0), "doc", "i", "n", "t").count() == 0


def test_islands_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    heads = [None, None, "A", "A", "A", "A", "A", "B", None, None, "A"]
    df = spark.createDataFrame([("d", i, f"d#{i}", h, i, i, f"t{i}") for i, h in enumerate(heads)], "doc_id string, chunk_index int, chunk_id string, section_heading string, page_start int, page_end int, text string")
    got = {r.section_index: r for r in ing.section_islands(df).collect()}
    assert [len(got[k].chunk_ids) for k in sorted(got)] == [2, 5, 1, 2, 1]
    assert got[0].title == "Untitled (p. 0)" and got[1].title == "A" and got[3].page_start == 8
    said = {r.section_index: r.synopsis for r in ing.section_synopses(df, budget=12).collect()}
    assert said[1] == "A\n\nt2\n\nt3\n\nt4" and said[2] == "B\n\nt7"


def test_tokens_and_inputs(spark):
    df = spark.createDataFrame([("  a  b\nc d ",), ("",), (None,), ("x\0y",)], "t string")
    got = [tuple(r) for r in df.select(tx.truncated_to_tokens(F.col("t"), 6), tx.embed_input(F.col("t")), tx.truncated_snippet(F.col("t"), 3), WordEstimate().count(F.col("t"))).collect()]
    assert got[0] == ("  a  b", "  a  b\nc d ", "  a…", 12) and got[1] == ("", "", "", 0) and got[2][:3] == (None, None, None) and got[3][1] == "xy"


def test_parsing(spark):
    raw = [
        '{"concepts":["Fire (x)","fire",""],"definesConcepts":["Gate"],"seeAlsoTitles":[" A ",""],"confidence":0.5}',
        '{"concepts":["a",1]}', '{"confidence":2}', '{}', "no", None, '{"seeAlsoTitles":null,"concepts":[]}', '{"concepts":[null]}', "[]",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r.e for r in df.orderBy("i").select(ps.parsed_enrichment(F.col("raw")).alias("e")).collect()]
    assert (got[0].concepts, got[0].defines, got[0].refs, got[0].see_also, got[0].confidence) == (["fire"], ["gate"], [], ["A"], 0.5)
    assert got[1] is None and got[2] is None and got[3].concepts == [] and got[4] is None and got[5] is None and got[7] is None and got[8] is None
    hints = [
        '{"version":1,"byDocument":{"d":{"Fire":[1,"x",2.0,3],"bad":5},"e":{},"f":[1]}}', '{"d":{"Gate":[7]},"version":{"a":[1]}}', "[1]", "x", None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(hints)], "i int, raw string")
    got = [r.h for r in df.orderBy("i").select(ps.parsed_hints(F.col("raw")).alias("h")).collect()]
    assert got[0] == {"d": {"Fire": [1, 2, 3]}} and got[1] == {"d": {"Gate": [7]}} and got[2:] == [None, None, None]
    notes = spark.createDataFrame([('{"scopeSummary":" s "}',), ('{"scopeSummary":1}',), ("x",)], "raw string")
    assert [r.s for r in notes.select(gr.scope_summary(F.col("raw")).alias("s")).collect()] == ["s", None, None]


def test_enrichment(spark):
    sections = spark.createDataFrame([("s1", "The gate is Fire."), ("s2", "The gate is Fire."), ("s3", "other"), ("s4", None)], "section_id string, synopsis string")
    keyed = sections.select(ps.enrichment_key(F.col("synopsis")).alias("k")).first().k
    out = spark.createDataFrame([(keyed, '{"concepts":["Fire"],"definesConcepts":["gate","absent"]}'), (keyed, "broken"), ("other", "{}")], "cache_key string, raw string")
    got = {r.section_id: r for r in enrich.enriched(sections, out).collect()}
    assert got["s1"].concepts == ["fire"] and got["s1"].defines == ["gate"] == got["s2"].defines and got["s1"].enriched
    assert got["s3"].concepts == [] and not got["s3"].enriched and got["s4"].defines == []
    assert sorted(r.synopsis for r in enrich.unseen(sections, out).collect()) == ["", "other"]


def test_requests(spark):
    kind = "question_id long, library_id string, question string, history array<struct<role:string,content:string>>"
    rows = [(1, "l", "q", None), (2, " ", "q", None), (3, "l", "  ", None), (4, "l", "x" * 32_769, []), (5, "l", "q", [("system", "c")]), (6, "l", "q", [("user", None)]), (7, "m", "q", None), (8, "old", "q", [("user", "c")]), (9, None, None, None), (10, " l ", "q", [("assistant", "c")])]
    libraries = spark.createDataFrame([("l", "now"), ("old", "then")], "library_id string, embedding_model string")
    got = {r.question_id: r.error for r in ask.request_errors(spark.createDataFrame(rows, kind), libraries, "now").collect()}
    assert got == {2: "missing library", 3: "missing question", 4: "question too long", 5: "invalid history", 6: "invalid history", 7: "library not found", 8: "embedding model mismatch", 9: "missing library"}


def test_concept_matches_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["fright", "frightened", "fire", "fires", "gate", "the", "gatekeeper", "of", "ward"]
    questions = [(i, " ".join(rng.choices(words, k=6))) for i in range(25)]
    defines = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)})
    q = spark.createDataFrame(questions, "question_id long, question string")
    k = spark.createDataFrame([(d,) for d in defines], "define string")
    got = {tuple(r) for r in rt.concept_matches(q, k).collect()}
    phrases = q.select("question_id", F.explode(tx.concept_phrases(F.col("question"))).alias("phrase")).distinct()
    want = {tuple(r) for r in phrases.crossJoin(k).where(tx.concepts_overlap(F.col("define"), F.col("phrase"))).collect()}
    assert got == want and want


def test_phrases_are_matched_once_for_all_questions(spark):
    texts = ["fire gate ward", "gatekeeper of the fire gate", "nothing known here", None]
    q = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)], "question_id long, question string")
    sections = spark.createDataFrame([(["Fire gate", "ward"], ["a#1", "a#2"]), (["gatekeeper"], ["a#2", "a#3"]), (["fire"], ["a#3"]), (None, ["a#4"])], "defines array<string>, chunk_ids array<string>")
    phrases = rt.question_phrases(q)
    keys = rt.define_keys(sections, "chunk_ids")
    met = rt.met_concepts(phrases.select(F.explode("phrases").alias("phrase")), keys)
    rows = [tuple(r) for r in met.collect()]
    pairs = rt.concept_matches(q, keys).cache()
    assert len(rows) == len(set(rows)) == pairs.select("phrase", "define").distinct().count() < pairs.count()
    chunks = keys.select("define", F.explode("chunk_ids").alias("chunk_id")).distinct()
    want = {tuple(r) for r in pairs.join(chunks, "define").groupBy("question_id", "chunk_id").count().collect()}
    lane = rt.define_lane(q, sections, 10, 0.05)
    assert want and {(r.question_id, r.chunk_id, r.hits) for r in lane.collect()} == want
    assert {r.question_id: r.chunks_seeded for r in rt.define_debug(q, sections, lane).collect()}.keys() == set(range(200))


def test_terms_with_apostrophes(spark):
    corpus = spark.createDataFrame([(0, "We play rock'n'roll and don't stop; rock'n it. a''b"), (1, "rocknroll")], "corpus_pos long, text string")
    got = {(r.corpus_pos, r.token): r.hits for r in rt.token_counts(corpus, "corpus_pos", "text").collect()}
    assert got[0, "rock'n'roll"] == 1 and got[0, "rock'n"] == 2 and got[0, "don't"] == 1 and got[0, "a''b"] == 1 and got[0, "n'roll"] == 1
    q = spark.createDataFrame([(1, "rock'n'roll?")], "question_id long, question string")
    assert [r.corpus_pos for r in rt.lexical_scores(corpus, q).collect()] == [0]


def test_define_lane_makes_phrases_once_a_text(spark, monkeypatch):
    # the lane counts once for each set of known phrases, not for each question
    q = spark.createDataFrame([(i, ["the fire gate", "fire gate", "ward"][i % 3]) for i in range(90)], "question_id long, question string")
    sections = spark.createDataFrame([(["fire gate"], [f"a#{i}" for i in range(40)]), (["ward"], ["a#1"])], "defines array<string>, chunk_ids array<string>")
    seen = []
    whole = rt.cut
    monkeypatch.setattr(rt, "cut", lambda df: seen.append(whole(df)) or seen[-1])
    lane = rt.define_lane(q, sections, 3, 0.05)
    pairs = [x for x in seen if {"kind", "define", "n"} <= set(x.columns)]
    assert len(pairs) == 1 and pairs[0].count() == 2
    assert lane.count() == 60 * 3 + 30


def test_best_words_are_those_of_all_scores(spark):
    rng = random.Random(11)
    words = ["impaired", "an", "impaired", "multiple", "rock'n'roll", "rock'n", "gate", "no", "additional", "effect", "don't", "seal"]
    texts = [(i, f"d{i % 3 if i % 5 else 7}", " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(2500)] + [(2500, "d1", None)]
    corpus = spark.createDataFrame(texts, "corpus_pos long, doc_id string, text string").repartition(7)
    asked = [(1, "Impaired twice, rock'n'roll?"), (2, "the"), (3, "gate seal impaired"), (4, None), (5, "rock'n gate don't"), (6, "unknown words")]
    q = spark.createDataFrame(asked, "question_id long, question string")
    # all scores as a table of every question and text with a word in common
    scores = rt.lexical_scores(corpus, q).cache()
    best = lx.lexical_best(corpus, q, 9)
    assert best.count() <= 9 * 4 * 2 * spark.sparkContext.defaultParallelism < scores.count()

    def shown(df, *names):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())

    names = ("question_id", "corpus_pos", "ratio", "hits", "boost", "lex")
    assert shown(rt.ranked(best, "lex", 9), *names, "rank") == shown(rt.ranked(scores, "lex", 9), *names, "rank")
    pairs = q.select("question_id").crossJoin(corpus.where("corpus_pos % 3 = 0"))
    assert shown(lx.lexical_of(pairs, q), *names) == shown(scores.where("corpus_pos % 3 = 0"), *names)
    for most, cap in ((5, 2), (12, 1), (3, 3)):
        few = lx.lexical_best(corpus, q, most, doc="doc_id", per_document=cap)
        want = ci.provenance(scores.join(corpus.select("corpus_pos", "doc_id"), "corpus_pos"), most, cap)
        assert shown(ci.provenance(few, most, cap), "question_id", "corpus_pos", "value", "hits", "pick") == shown(want, "question_id", "corpus_pos", "value", "hits", "pick")


def test_words_of_many_texts_are_counted_at_once(spark, monkeypatch):
    rng = random.Random(3)
    words = ["rock'n'roll", "o'neil", "don't", "armor", "stack", "armored", "a", "an", "n", "é", "Ü", "x_1", "''", "sword", "\u00a0"]
    asked = [types.SimpleNamespace(question_id=9 - i, terms=rng.sample(["rock'n'roll", "o'neil", "n'roll", "armor", "stack", "x_1", "armored"], 3), stacking=False) for i in range(9)]
    a = lx.Asked(asked)
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "'", ", ", "\n"]) for _ in range(rng.randint(0, 30))).lower() for _ in range(500)]
    want = collections.Counter(i * len(texts) + j for j, x in enumerate(texts) for i in a.found(x))
    low = pa.array(["before", *texts], pa.string()).slice(1)
    code, count = a.counts(low)
    assert dict(zip(code.tolist(), count.tolist(), strict=True)) == want
    assert dict(lx.all_back_words(low)) == {j: found for j, x in enumerate(texts) if (found := lx.back_words(x))}

    def never(*_):
        raise AssertionError("a text was taken apart by itself")

    # neither the lane nor the scores of known pairs take each text apart
    monkeypatch.setattr(lx.Asked, "found", never)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), low, pa.array([0.0] * len(texts))], names=["key", "low", "rule"])
    assert sum(b.num_rows for b in lx._tops(iter([batch]), a, 5)) == 45


def test_lines_of_documents_without_an_index_are_not_parsed(spark, monkeypatch):
    whole = ing.index_entry

    def checked(line):
        return F.when(F.contains(line, F.lit("never")), F.raise_error(F.lit("parsed")).cast(whole_type)).otherwise(whole(line))

    pages = [("few", i, f"never {i}\nnever topic {i}") for i in range(10)] + [("many", i, f"topic x{chr(97 + i)} {i + 1}\n\n\ntopic y{chr(97 + i)} 7") for i in range(11)]
    pages += [("headed", 1, "Index\n" + "\n".join(f"word{chr(97 + i)} {i + 1}" for i in range(6))), ("headed few", 1, "Index\n" + "\n".join(f"never{chr(97 + i)} {i + 1}" for i in range(5))), ("none", 1, None)]
    df = spark.createDataFrame(pages, "doc_id string, page_number int, content string")
    whole_type = df.select(whole(F.col("content")).alias("e")).schema["e"].dataType
    monkeypatch.setattr(ing, "index_entry", checked)
    got = {r.doc_id: r.n for r in ing.index_entries(df).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"many": 22, "headed": 6}


def test_dense_in_small_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(600)]
    corpus = spark.createDataFrame(rows, "corpus_pos long, embedding array<double>").repartition(9)
    asked = [(q, [float(rng.randint(-2, 2)) + 0.5 for _ in range(3)]) for q in range(5)]
    monkeypatch.setattr(rt, "CELLS", 5 * 40)
    monkeypatch.setattr(rt, "HELD", 50)
    got = {(r.question_id, r.rank): r.corpus_pos for r in rt.dense_scores(corpus, spark.createDataFrame(asked, "question_id long, query_vec array<double>"), 7).collect()}

    def cosine(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 9) if size else 0.0

    for q, v in asked:
        want = sorted(rows, key=lambda r: (-cosine(v, r[1]), r[0]))[:7]
        assert [got[q, i + 1] for i in range(7)] == [r[0] for r in want]


@pytest.mark.parametrize("name", ["hybrid_retrieve", "neighbor_expand", "ask_results", "hybrid_all_lanes", "prompt_budget", "prompt_text"])
def test_searches_make_no_table_of_all_scores(spark, sf_dir, monkeypatch, name):
    from lorekeep.plans import catalogue

    def never(*args, **more):
        raise AssertionError("scores of all questions and texts")

    monkeypatch.setattr(rt, "lexical_scores", never)
    assert catalogue.QUERIES[name](spark, sf_dir, every=4).count() > 0


def test_router(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "doc_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "question_id long, query_vec array<float>")
    got = {r.doc_id: round(r.boost, 6) for r in rt.router_boosts(docs, q, 0.1).collect()}
    assert got == {"a": 0.1, "b": 0.0, "c": round(0.1 / 2**0.5, 6)}
    pool = spark.createDataFrame([(1, "c")], "question_id long, doc_id string")
    assert [(r.doc_id, round(r.boost, 6)) for r in rt.router_boosts(docs, q, 0.1, pool=pool).collect()] == [("c", got["c"])]


def test_notes(spark):
    kind = "doc_id string, section_index int, section_id string, title string, concepts array<string>, defines array<string>, refs array<string>"
    rows = [("d", 1, "s1", "B", ["X", "x"], None, ["r"]), ("d", 0, "s0", "A", [f"c{i}" for i in range(20)], ["z"], []), ("e", 0, "t0", None, None, None, None)]
    s = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([("d", "Book D")], "doc_id string, label string")
    written = spark.createDataFrame([("e", '{"scopeSummary":"All of it."}')], "doc_id string, raw string")
    got = {r.doc_id: r for r in gr.document_notes(gr.document_summaries(s), gr.rollups(s), labels, written).collect()}
    assert got["d"].rollup == "## A\ntopics: " + ", ".join(f"c{i}" for i in range(12)) + "\ndefines: z\nrefs: \n\n## B\ntopics: x\ndefines: \nrefs: r"
    assert got["d"].scope_summary.startswith("Book D: rules reference") and got["e"].scope_summary == "All of it." and got["e"].label == "e"


def test_thread_history(spark):
    rows = [("t", 1, "user", "q", None, None), ("t", 2, "assistant", "c", "a", None), ("t", 3, "assistant", "c", "a", "loading"), ("t", 4, "system", "x", None, None), ("u", 1, "assistant", "only", None, None), ("u", 2, "user", None, "a", None)]
    df = spark.createDataFrame(rows, "thread string, seq int, role string, content string, answer string, status string")
    assert sorted(tuple(r) for r in pr.thread_history(df).collect()) == [("t", 1, "user", "q"), ("t", 2, "assistant", "a"), ("u", 1, "assistant", "only")]


def test_providers(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"text {i % 2}") for i in range(7)], "i int, t string")
    got = {r.i: r.embedding for r in embedded(df, "t", HashEmbedder(8), batch=2).collect()}
    assert got[3] is None and got[0] == got[2] != got[1] and len(got[0]) == 8


def test_params(tmp_path):
    f = tmp_path / "c.json"
    assert load_params(str(f)) == load_params() == Params()
    f.write_text(json.dumps({"retrieveTopK": 5, "retrieveGraphEdgeTypes": ["see_also"], "other": 1}))
    p = load_params(str(f))
    assert (p.top_k, p.graph_edge_types, p.lexical_top) == (5, ("see_also",), 24)
    f.write_text(json.dumps({"retrieveTopK": "5"}))
    with pytest.raises(ValueError):
        load_params(str(f))


def test_only_what_is_small_is_broadcast(spark, monkeypatch):
    df = spark.range(100)
    plan = lambda d: spark.range(10_000_000).join(d, "id")._jdf.queryExecution().toString()
    assert "ResolvedHint" in plan(if_small(df, F.lit(8))) or "broadcast" in plan(if_small(df, F.lit(8)))
    monkeypatch.setattr("lorekeep.session.SMALL_BYTES", 100)
    assert if_small(df, F.lit(8)) is df
