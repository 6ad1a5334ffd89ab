"""The searches' lanes at sizes where most texts cannot be among the best."""

import random
from collections import Counter, namedtuple

import numpy as np
import pyarrow as pa
import pytest
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions.vectors import cosine
from lorekeep.operators import lexical as lx
from lorekeep.operators import retrieve as rt
from lorekeep.params import Params
from lorekeep.plans.catalogue import QUERIES
from lorekeep.plans.sql import ORACLE_SQL, WHOLE, oracle_sql


def _text_batches(rng, words, n, sizes):
    rows = [(i, " ".join(rng.choices(words, weights=[3 ** -(j % 7) for j in range(len(words))], k=rng.randint(0, 14)))) for i in range(n)]
    rng.shuffle(rows)
    rule = [0.3 if "additional effect" in t else 0.0 for _, t in rows]
    whole = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows]), pa.array(rule)], names=["key", "low", "rule"])
    return [whole.slice(i, sizes) for i in range(0, n, sizes)]


def test_best_words_score_few_texts(monkeypatch):
    # F2, F6: of 20,000 texts only those that can reach the best so far are scored, and the best are those of all
    rng = random.Random(5)
    words = ["gate", "seal", "no", "additional", "effect", "impaired", "an", "impaired an impaired", "rock'n'roll", "don't", *(f"w{i}" for i in range(60))]
    batches = _text_batches(rng, words, 20_000, 7000)
    Row = namedtuple("Row", "question_id terms stacking")
    rows = [Row(i, rng.sample([w for w in words if " " not in w], rng.randint(1, 9)), i % 3 == 0) for i in range(40)] + [Row(99, [f"w{i}" for i in range(60)], True)]
    a, most = lx.Asked(rows), 24
    want = {}
    texts = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    counted = [(key, Counter(a.found(low)), {a.known[t] for t in ("impaired", "additional") if f" {t} an {t} " in f" {low} " and t in a.known}, rule) for key, low, rule in texts]
    for i, r in enumerate(rows):
        own = a.flat[a.starts[i] : a.starts[i + 1]].tolist()
        every = []
        for key, c, back, rule in counted:
            k, hits, rule = sum(t in c for t in own), sum(c[t] for t in own), rule if r.stacking else 0.0
            if k or rule:
                ratio, boost, lex = lx._scores(np.array([k]), np.array([hits]), np.array([len(own)]), np.array([rule]), np.array([len(back.intersection(own))]))
                every.append((-round(lex[0], 9), key, ratio[0], hits, boost[0]))
        want[r.question_id] = sorted(every)[:most]
    scored, whole = [], lx._scores
    monkeypatch.setattr(lx, "_scores", lambda k, *more: scored.append(k.size) or whole(k, *more))
    found = {}
    for b in lx._tops(iter(batches), a, most):
        for q, key, ratio, hits, boost, lex in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault(q, []).append((-round(lex, 9), key, ratio, hits, boost))
    assert {q: sorted(x) for q, x in found.items()} == {q: x for q, x in want.items() if x}
    assert sum(scored) < len(rows) * len(texts) / 4


def test_dense_in_double_for_few(spark, monkeypatch):
    # F2, F6: near vectors are told apart in double, the rest only in single precision; any lengths, nulls and no numbers
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 8))
    rows = [(i, (base[i % 3] + rng.normal(size=8) * (1e-7 if i % 2 else 0.5)).tolist()) for i in range(3000)]
    rows += [(3000, [0.0] * 8), (3001, [float("nan")] * 8), (3002, base[0][:5].tolist()), (3003, [*base[1].tolist(), 9.0]), (3004, None), (3005, [None, *base[2][1:].tolist()]), (3006, [])]
    asked = [(i, (base[i % 3] * (i + 1)).tolist()) for i in range(6)] + [(6, [0.0] * 8)]
    corpus = spark.createDataFrame(rows, "corpus_pos long, embedding array<double>").repartition(5)
    got = {(r.question_id, r.rank): (r.corpus_pos, round(r.dense, 9)) for r in rt.dense_scores(corpus, spark.createDataFrame(asked, "question_id long, query_vec array<double>"), 20).collect()}

    def cosine(a, b):
        n = min(len(a), len(b))
        x, y = np.array(a[:n]), np.array([np.nan if v is None else v for v in b[:n]], dtype=float)
        size = np.sqrt(x @ x) * np.sqrt(y @ y) if n else 0.0
        return round(float(x @ y / size), 9) if size and np.isfinite(size) else 0.0

    for q, v in asked:
        want = sorted((-cosine(v, x), i) for i, x in rows if x is not None)[:20]
        assert [got[q, i + 1] for i in range(20)] == [(i, -c) for c, i in want]
    # in a batch whose best are known, few cosines are made in double
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(50, 64))
    monkeypatch.setattr(rt, "_whole", lambda *a: 1 / 0)
    lengths, norm, sizes = np.sqrt((q * q).cumsum(1)), np.sqrt((x * x).sum(1)), np.full(4000, 64)
    near = rt._near(x, norm, sizes, q, (q / lengths[:, -1:]).astype(np.float32), lengths)
    r, c = np.nonzero(near > 0.4)
    exact = (q @ x.T) / (lengths[:, -1:] * norm)
    assert near.dtype == np.float32 and np.abs(near - exact).max() < rt.NEAR * 80
    assert len(r) and np.allclose(rt._cosines(x, norm, sizes, q, lengths, r, c), exact[r, c], atol=1e-13)


def test_back_words_are_those_of_the_expression(spark):
    rng = random.Random(8)
    parts = ["impaired", "Impaired", "an", "a", "rock'n'roll", "(impaired", "impaireds", "_impaired", "impaired,", "seal"]
    gaps = [" ", " ", "  ", "\n", "\t", "\u00a0", "\x1c", ". "]
    texts = ["".join(x for _ in range(rng.randint(2, 9)) for x in (rng.choice(parts), rng.choice(gaps))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(F.lower("t").alias("low"), lx.back_references(F.col("t")).alias("back")).collect()
    assert sum(bool(r.back) for r in rows) > 50
    assert [lx.back_words(r.low) for r in rows] == [r.back for r in rows]


def test_rule_weight_sees_boundaries(spark):
    texts = ["No additional effect. Multiple afflictions", "no additional effects", "xno additional effect", "REMOVE EACH INSTANCE", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.round(tx.rule_weight(F.col("t")), 6)).collect()]
    assert got == [0.27, 0.0, 0.0, 0.1, 0.0, None] or got == [0.27, 0.0, 0.0, 0.1, 0.0, 0.0]


def test_cosines_of_pairs(spark):
    vectors = [[1.0, 2.0], [0.0, 0.0], [3.0], [], None, [None, 1.0], [float("nan"), 1.0], [2.0, -1.0, 5.0]]
    whole = [[float(i), i * i - 3.0] for i in range(1, 9)]
    for some in (vectors, whole):
        rows = [(i, j, a, b) for i, a in enumerate(some) for j, b in enumerate(some)]
        df = spark.createDataFrame(rows, "question_id long, corpus_pos long, query_vec array<double>, embedding array<double>")
        want = df.select("question_id", "corpus_pos", F.round(cosine(F.col("query_vec"), F.col("embedding")), 9).alias("dense"))
        got = rt.pair_cosines(df).withColumn("dense", F.round("dense", 9))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_only_pairs_without_cosine_are_compared_again(spark, sf_dir, monkeypatch):
    # with every lane on, vectors are joined for those pairs of the pool only that the dense lane does not have
    from lorekeep.plans import queries

    kept, pairs = {}, []
    dense, again = rt.dense_scores, rt.pair_cosines
    monkeypatch.setattr(rt, "dense_scores", lambda *a, **more: kept.setdefault(len(kept), dense(*a, **more)))
    monkeypatch.setattr(rt, "pair_cosines", lambda df, *more: pairs.append(df) or again(df, *more))
    queries.hybrid_all_lanes(spark, sf_dir, every=30)
    known = kept[0].select("question_id", "corpus_pos")
    assert len(pairs) == 1 and pairs[0].count() > 0 and pairs[0].join(known, ["question_id", "corpus_pos"]).count() == 0


def test_places_of_chunks_are_read_once_for_all_lanes(spark, sf_dir, monkeypatch):
    # the lanes of graph and concepts look places up without texts and vectors
    from lorekeep.plans import queries

    seen, whole = [], rt.cut
    monkeypatch.setattr(rt, "cut", lambda df: seen.append(set(df.columns)) or whole(df))
    queries.hybrid_all_lanes(spark, sf_dir, every=30)
    assert {"corpus_pos", "chunk_id", "doc_id", "chunk_index", "page_start", "page_end"} in seen


def test_current_rows_apart(spark, tmp_path, monkeypatch):
    # rows whose key stands once are read where they are; null keys, null times and repeats as for current_rows
    from lorekeep.operators import current as cu

    rng = random.Random(3)
    rows = [(f"d{i % 50}" if i % 17 else None, i // 60 if i % 13 else None, f"t{i}", i % 7 or None) for i in range(900)]
    rows += [(d, n, t, 9) for d, n, t, _ in rng.sample(rows, 40)]
    rows = list({r[:2] + (r[3],): r for r in rows}.values())
    df = spark.createDataFrame(rows, "doc string, n int, text string, at int")
    df.repartition(24).write.parquet(str(tmp_path / "t"))
    df = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "t"))
    want = sorted(map(str, cu.current_rows(df, ["doc", "n"], "at").collect()))
    moved, whole = [], cu.current_rows
    monkeypatch.setattr(cu, "current_rows", lambda x, *more: moved.append(x.count()) or whole(x, *more))
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        got = cu.current_apart(df, ["doc", "n"], "at")
        assert sorted(map(str, got.collect())) == want and len(moved) == 1 and 0 < moved[0] < len(rows)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # too many keys for a broadcast: all rows as before
    monkeypatch.setattr("lorekeep.session.SMALL_BYTES", 0)
    assert sorted(map(str, cu.current_apart(df, ["doc", "n"], "at").collect())) == want


def test_runs_of_words_in_many_texts():
    # runs around apostrophes, counted in many texts at once, each kind of piece once
    rng = random.Random(4)
    parts = ["rock'n'roll", "don't", "l'arme", "'tis", "x''y", "a'b'c'd", "plain", "rock'n", "don't,stop'it"]
    Row = namedtuple("Row", "question_id terms stacking")
    a = lx.Asked([Row(1, ["rock'n'roll", "don't", "n'roll", "b'c", "plain"], False), Row(2, ["arme", "l'arme", "x''y", "stop'it"], False)])
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(300)]
    seen = []
    a._runs = lambda low, runs=a._runs: seen.append(low) or runs(low)
    code, count = a.counts(pa.array(texts))
    assert len(seen) <= len(parts)
    want = Counter(t * len(texts) + j for j, x in enumerate(texts) for t in lx.Asked.found(a, x))
    assert dict(zip(code.tolist(), count.tolist(), strict=True)) == dict(want)


def test_texts_move_for_documents_that_may_hold_an_index_only(spark, monkeypatch):
    # page numbers at the ends of lines, however a page is cut, and dots without end are settled before texts move
    from lorekeep.operators import ingest as ing

    wide = "\n".join(f"topic {chr(97 + i)}{'.' * 90} {i + 1}" for i in range(24))
    gaps = "   ".join(f"thing {chr(97 + i)} {i + 1}" for i in range(24))
    pages = [("wide", 1, wide), ("gaps", 1, gaps), ("few", 1, "one 1\ntwo 2\nthree 3\nfour 4\nfive 5"), ("none", 1, None), ("dots", 1, "1" + "." * 200 + " x\na\nb\nc\nd")]
    pages += [("headed", 1, "Index\nfoo 1\nbar 2\nbaz 3\nbell 4\nseal 5\nward 6")] + [("text", i, f"Book — page {i}\nRoll 1d6 on 21 or more.") for i in range(1, 9)]
    df = spark.createDataFrame(pages, "doc_id string, page_number int, content string")
    kept, whole = [], ing.cut
    monkeypatch.setattr(ing, "cut", lambda x: kept.append(whole(x)) or kept[-1])
    got = ing.index_entries(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {"wide": 24, "gaps": 24, "headed": 6}
    assert {r[0] for r in kept[0].collect()} == {"wide", "gaps", "headed"}


@pytest.mark.parametrize("name", WHOLE)
def test_searches_ask_every_question(spark, sf_dir, name):
    # F2 to F6: without ``every`` all questions are asked, here and in the SQL
    got = spark_rows(QUERIES[name](spark, sf_dir))
    assert got == sql_rows(sf_dir, ORACLE_SQL[name])
    # of the results those of known questions
    key, of = ("result_id", "query_results JOIN questions USING (question_id)") if name == "ask_results" else ("question_id", "questions")
    every = sql_rows(sf_dir, f"SELECT DISTINCT {key} FROM {of}")[1]
    asked = got[0].index(key)
    assert sorted({(r[asked],) for r in got[1]}, key=repr) == every


def test_other_searches_keep_their_sql():
    # F2 to F6: only the SQL of the searches that ask every question lost its choice of questions
    stated, whole = oracle_sql(100), oracle_sql()
    assert {n for n in whole if whole[n] != stated[n]} == set(WHOLE)
    assert not any("% 100" in whole[n] for n in WHOLE)


def test_vectors_that_are_no_numbers_rank_as_zero(spark):
    # a chunk that only the lexical lane finds has the cosine 0 where its vector holds no number
    rows = [(i, f"c{i}", f"d{i}", 0, 1, 1, "plain words", [1.0, i / 200]) for i in range(150)]
    rows += [(150 + i, f"c{150 + i}", f"d{150 + i}", 0, 1, 1, "broken seal", [x, 1.0]) for i, x in enumerate((float("nan"), float("inf"), None, -9.0))]
    kind = "corpus_pos long, chunk_id string, doc_id string, chunk_index int, page_start int, page_end int, text string, embedding array<double>"
    asked = spark.createDataFrame([(1, "Where is the broken seal?", [1.0, 0.0])], "question_id long, question string, query_vec array<double>")
    picks = rt.hybrid(spark.createDataFrame(rows, kind), asked, Params()).orderBy("pick").collect()
    assert [r.corpus_pos for r in picks] == list(range(10)) and round(picks[0].score, 6) == 1.0


def test_dense_blocks_of_questions(spark, monkeypatch):
    # many questions go out in blocks, so that a task holds the best of few of them; the best are the same
    rng = np.random.default_rng(6)
    corpus = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "corpus_pos long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, rng.normal(size=2 + i % 5).tolist()) for i in range(40)], "question_id long, query_vec array<double>")
    want = sorted(map(str, rt.dense_scores(corpus, asked, 8).withColumn("dense", F.round("dense", 9)).collect()))
    monkeypatch.setattr(rt, "BLOCK_BEST", 8 * 7)
    found = rt.dense_scores(corpus, asked, 8)
    assert sorted(map(str, found.withColumn("dense", F.round("dense", 9)).collect())) == want and len(want) == 320
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 6
