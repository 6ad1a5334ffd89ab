"""The operators on small, awkward inputs: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lorekeep.llm")
from lorekeep.llm import bitmaps, bpe, furniture, language, neighbors, packing, pairs, splitting, tokens
from lorekeep.llm.bytecnn import ByteNet, NetParams, letters
from lorekeep.llm.cooccurrence import cooccurrence
from lorekeep.llm.frequency import marked, term_bitmaps, term_frequency


def one_row(spark, n):
    return spark.createDataFrame([(n,)], "n long")


# splitting


def test_split_keeps_text_and_limit():
    rng = random.Random(1)
    for _ in range(800):
        t = "".join(rng.choice('ab .!?\n\r"。') for _ in range(rng.randint(0, 400)))
        limit, overlap = rng.choice([20, 40, 80]), rng.choice([0, 5, 10])
        pieces, natural = splitting.split_text(t, limit, overlap)
        assert "".join(t[b:c] for _, b, c, _ in pieces) == t
        assert all(c - a <= limit and a <= b < c for a, b, c, _ in pieces)
        assert not natural or all(ok for *_, ok in pieces[:-1])


def test_split_operator(spark):
    rows = [(1, "x" * 2000), (2, "y" * 2001), (3, None), (4, ""), (5, "A b. " * 600), (5, "A b. " * 600), (None, "z. " * 900)]
    df = spark.createDataFrame(rows, "id long, text string").withColumns({"cut": F.lit(0), "pieces": F.lit("q")})
    got = splitting.split_oversized(df, ["id"], "text").collect()
    assert sorted((r.id or 0, r.cut) for r in got) == [(0, "natural"), (2, "forced"), (5, "natural"), (5, "natural")]
    for r in got:
        assert all(len(p.piece) <= 2000 for p in r.pieces)
        if r.cut == "natural":
            assert all(150 <= p.new_start - p.start <= 200 for p in r.pieces[1:])
    assert splitting.split_oversized(df.limit(0), ["id"], "text").count() == 0


# pair counts


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(2)
    baskets = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]) for i in range(300)]
    rows = [*baskets, baskets[0], (400, None), (401, ["a", None, "", "b", "b"]), (None, ["a", "b"])]
    df = spark.createDataFrame(rows, "id int, names array<string>").withColumn("item", F.lit(1))
    held = [{x for x in xs or [] if x} for _, xs in [*baskets, *rows[301:]]]
    n = Counter(x for s in held for x in s)
    both = Counter(p for s in held for p in itertools.combinations(sorted(s), 2))
    total = len(held)
    for wide in (256, 2):
        got = {(r.item_a, r.item_b): r for r in cooccurrence(df, "id", "names", one_row(spark, total), 20, 0.9, wide).collect()}
        want = {p for p, c in both.items() if c >= 20 and c * total >= 0.9 * n[p[0]] * n[p[1]]}
        assert set(got) == want and want
        for p in want:
            assert got[p].n_ab == both[p] and math.isclose(got[p].pmi, math.log(both[p] * total / (n[p[0]] * n[p[1]])))
    assert cooccurrence(df.limit(0), "id", "names", one_row(spark, 0)).count() == 0


# frequency


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs"])
def test_bitmaps_round_trip(kind):
    rng = np.random.default_rng(3)
    low = {
        "sparse": np.unique(rng.integers(0, 1 << 16, 50)),
        "dense": np.unique(rng.integers(0, 1 << 16, 60_000)),
        "runs": np.concatenate([np.arange(5, 900), np.arange(2000, 65_536)]),
    }[kind].astype(np.uint16)
    raw = bitmaps.encode(low)
    assert (bitmaps.decode(raw) == low).all() and bitmaps.cardinality(raw) == len(low) and len(raw) <= 8193
    assert bitmaps.union([raw, bitmaps.encode(low[:3])])[1] == len(low)


def test_term_frequency(spark):
    rows = [(["a", "a", "b", None, ""],), (["a"],), (["a"],), (None,), ([],)]
    df = spark.createDataFrame(rows, "names array<string>").withColumn("term", F.lit("x"))
    got = marked(term_frequency(df, "names"), one_row(spark, 5), 2, 0.2)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 4, 3, "common"), ("b", 1, 1, "rare")]
    assert term_frequency(df.limit(0), "names").count() == 0
    many = spark.range(0, 150_000, 1, 1).select(F.array(F.lit("hot"), (F.col("id") % 7).cast("string")).alias("t"))
    r = {x.term: x for x in term_frequency(many, "t").collect()}
    assert r["hot"].records == 150_000 and r["3"].records == len(range(3, 150_000, 7))
    assert term_bitmaps(many, "t").where("term = 'hot'").count() == 3


# repeated lines


def test_repeated_lines(spark):
    pages = [("d", i, f"Core Rules page {i}\nbody {'xyzuvw'[i % 6] * (i + 2)}\n\n— {i} —") for i in range(20)]
    pages += [("d", 20, "cOre rulesXpage 9"), ("d", 21, "Core Rulez page 4"), ("d", 22, None), ("d", 23, "")]
    pages += [("e", i, "Same line\r\nSame line") for i in range(4)] + [(None, 1, "x")]
    df = spark.createDataFrame(pages, "doc_id string, page_number int, content string").withColumns({"line": F.lit(1), "key": F.lit(2)})
    occ, _ = furniture.repeated_lines(df, "doc_id", "page_number", "content")
    got = occ.select("source", "page", "line_no").collect()
    assert sorted(tuple(r) for r in got) == [("d", i, 0) for i in range(22)]
    clean = {(r.doc_id, r.page_number): r.content for r in furniture.without_lines(df, occ, "doc_id", "page_number", "content").collect()}
    assert clean["d", 3] == "body uuuuu\n\n— 3 —" and clean["d", 20] == "" and clean["d", 22] is None and clean["e", 1] == "Same line\r\nSame line"
    assert furniture.repeated_lines(df.limit(0), "doc_id", "page_number", "content")[0].count() == 0


def test_misprints_of_short_lines(spark):
    texts = ["Index", "Index", "Indox", "Indexx", "Inex", "Outdo", "Ix", "Ib", "Xb"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, page_number int, content string")
    occ, seqs = furniture.repeated_lines(df, "doc_id", "page_number", "content")
    assert sorted(r.page for r in occ.collect()) == [0, 1, 2, 3, 4]
    assert [(r.lines, r.support) for r in seqs.collect()] == [(["index"], 5)]


def test_line_sequences(spark):
    pages = [("d", i, f"First line here\nbody {'abcdef'[i] * 9}\nSecond line there") for i in range(6)]
    df = spark.createDataFrame(pages, "doc_id string, page_number int, content string")
    _, seqs = furniture.repeated_lines(df, "doc_id", "page_number", "content")
    got = {tuple(r.lines): r.support for r in seqs.collect()}
    assert got == {("firstlinehere",): 6, ("secondlinethere",): 6, ("firstlinehere", "secondlinethere"): 6}


def test_line_sequences_of_any_length(spark):
    names = ["alpha line", "bravo line", "charlie line", "delta line", "echo line"]
    df = spark.createDataFrame([("d", i, "\n".join(names)) for i in range(6)], "doc_id string, page_number int, content string")
    _, seqs = furniture.repeated_lines(df, "doc_id", "page_number", "content")
    got = {tuple(r.lines) for r in seqs.collect()}
    keys = [x.replace(" ", "") for x in names]
    assert got == {c for k in range(1, 6) for c in itertools.combinations(keys, k)}


def test_lines_leave_chunks_where_they_stand():
    gone = [{"before": "end.", "line": "Core Rules 7", "after": "The"}]
    assert furniture.without_aligned("at the end. Core Rules 7 The next", gone) == "at the end. The next"
    assert furniture.without_aligned("Core Rules 7 The next", gone) == "The next"
    assert furniture.without_aligned("see Core Rules 7 for more", gone) == "see Core Rules 7 for more"
    assert furniture.without_aligned("HardCore Rules 7", gone) == "HardCore Rules 7"
    assert furniture.without_aligned(None, gone) is None and furniture.without_aligned("a  b", None) == "a  b"


# tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder("test", tokens.vocabulary_bytes())


def samples():
    rng = random.Random(5)
    alphabet = "aabcd  \n\té漢字🎲don't'll 0123.,!?​\r<|endoftext|>ЖжABC"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*texts, "", "a" * 3000, " " * 500, "<|endoftext|>" * 3, "é­﻿"]


def test_encoder_is_that_of_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = samples()
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == want.ids
        assert encoder.decode(want.ids) == text.encode()


def test_appends_and_edits(encoder):
    rng = random.Random(6)
    for text in samples()[:400]:
        i = rng.randint(0, len(text))
        j = rng.randint(i, len(text))
        new, ids = encoder.edit(text, encoder.encode(text), i, j, rng.choice(["", "x", " foo", "'ll", "\n\n"]))
        assert ids == encoder.encode(new)
    chain = bpe.PrefixChain(encoder.vocabulary)
    for k, part in enumerate([b"inter", b"nation", b"al", b"isation"]):
        chain.append(part)
        whole = bpe.PrefixChain(encoder.vocabulary).append(b"".join([b"inter", b"nation", b"al", b"isation"][: k + 1]))
        assert chain.ids() == whole.ids()
    assert chain.cut(5).ids() == bpe.PrefixChain(encoder.vocabulary).append(b"inter").ids()


def test_encode_operator(spark, encoder):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = tokens.encode_corpus(df).collect()
    assert sorted(((r.doc_id or 0), len(r.ids)) for r in got) == sorted([(1, 2), (2, 0), (3, 0), (3, 0), (0, len(encoder.encode("x" * 50_000)))])
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# packing


def test_packing(spark):
    rng = random.Random(7)
    rows = [(str(i), rng.randint(1, 900)) for i in range(3000)] + [("long", 5000), ("none", None), ("zero", 0), ("full", 2048), (None, 5), ("1", 3)]
    df = spark.createDataFrame(rows, "item string, size long").repartition(40)
    got = packing.pack(spark, df, 2048, 8, 4).collect()
    used = Counter()
    for r in got:
        used[r.container] += r["size"]
    assert max(used.values()) <= 2048
    assert sum(used.values()) == sum(s for _, s in rows if s)
    assert sorted((r.piece_no, r.start, r["size"]) for r in got if r.item == "long") == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert Counter(r.item for r in got)["1"] == 2 and not {"none", "zero"} & {r.item for r in got}
    assert sum(used.values()) / (len(used) * 2048) > 0.95
    assert packing.pack(spark, df.limit(0)).count() == 0


def test_packing_wastes_little_and_holds_its_bound(spark):
    rng = random.Random(8)
    sizes = [min(2048, int(rng.paretovariate(1.1) * 60)) for _ in range(12_000)]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(sizes)], "item string, size long").repartition(64)
    got = packing.pack(spark, df, 2048, 16, 4).groupBy("container").agg(F.sum("size").alias("used")).collect()
    assert sum(r.used for r in got) == sum(sizes) and max(r.used for r in got) <= 2048
    assert len(got) <= 1.02 * sum(sizes) / 2048 + 1
    # 64 partitions keep 16 open ones each; groups of four partitions' worth never meet in one task
    ids = spark.range(64 * 16).select(F.pmod(F.xxhash64("id"), F.lit(16)).cast("int").alias("g")).repartitionById(16, "g")
    per = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("g").alias("n")).collect()
    assert all(r.n == 1 for r in per)


def test_components(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")]
    df = spark.createDataFrame(links + [(b, a) for a, b in links], "a string, b string")
    assert sorted(tuple(r) for r in pairs.components(df).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]


def test_near_clauses_of_a_chain_count_together(spark):
    base = "i am afraid that under the rules i was given there is no way for me to say anything at all about this very matter here today"
    words = base.split()
    chain = [" ".join([f"w{i}"] * 0 + words[:-1] + [f"word{i}"]) for i in range(2)] + [" ".join(["so", *words[1:-1], "word1"])]
    df = spark.createDataFrame([(c, f"p{i}") for i, c in enumerate(chain)], "clause string, prompt string")
    got = pairs.template_clauses(df).collect()
    assert len({r.root for r in got}) == 1 and {r.prompts for r in got} == {3}


# vectors


def test_tree_gives_the_best_bins():
    rng = np.random.default_rng(8)
    x = neighbors._unit(rng.normal(size=(4000, 16))).astype(np.float32)
    p = neighbors.TreeParams(width=16, leaf_size=40, fanout=6)
    tree = neighbors.fit_tree(x, 1.0, p)
    many = tree.visited(x[:60], 12)
    one = [tree.best_bins(q, 12) for q in x[:60]]
    leaves = np.stack([tree.matrix[n] for n in tree.leaf_of])
    for q, a, b in zip(x, many, one, strict=False):
        # rows that advance together open what the queue opens, or more, so no bin they visit is worse
        assert (np.sort(leaves[a] @ q) >= np.sort(leaves[b] @ q) - 1e-6).all() and len(set(a.tolist())) == 12
    assert np.mean([len(set(a) & set(b)) for a, b in zip(many.tolist(), one, strict=True)]) > 6
    assert sorted(tree.visited(x[:2], tree.n_leaves)[0].tolist()) == list(range(tree.n_leaves))
    assert set(tree.home(x).tolist()) <= set(range(tree.n_leaves))


def test_neighbors_recall_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(9)
    centers = neighbors._unit(rng.normal(size=(12, 64)))
    x = np.repeat(centers, 250, axis=0) + rng.normal(size=(3000, 64)) * 0.09
    rows = [(f"v{i:05d}", [float(a) for a in v * (1 + i % 7)]) for i, v in enumerate(x)]
    rows += [(f"copy{i:02d}", rows[0][1]) for i in range(30)]
    rows += [("null", None), ("zero", [0.0] * 64), ("short", [1.0] * 63), ("nan", [float("nan")] * 64), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "id string, v array<float>").withColumns({"rep": F.lit(1), "packed": F.lit(2)})
    # cells of more points than fit a task, and more queries than one should serve
    p = neighbors.TreeParams(leaf_size=60, least_visits=2, cell_size=40)
    got = {}
    for r in neighbors.nearest_vectors(df, "id", "v", 10, params=p).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    assert not {"null", "zero", "short", "nan"} & set(got) and all(len(v) == 10 for v in got.values()) and len(got) == 3030
    assert {o for _, o in got["copy29"]} == {f"copy{i:02d}" for i in range(10)}
    unit = neighbors._unit(x)
    near = unit[1:400] @ unit.T
    near[np.arange(399), np.arange(1, 400)] = -2
    hit = 0
    for i in range(399):
        mine = {o for _, o in got[f"v{i + 1:05d}"]}
        want = {f"v{j:05d}" for j in np.argsort(-near[i])[:10]}
        hit += len({("v00000" if o.startswith("copy") else o) for o in mine} & want)
    assert hit / 3990 >= 0.9
    some = df.where("id like 'v0000%'")
    assert neighbors.nearest_vectors(some.limit(0), "id", "v").count() == 0
    assert neighbors.nearest_vectors(some.limit(1), "id", "v").count() == 0


# languages


@pytest.fixture(scope="module")


def test_sample_is_not_searched_by_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 64)).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>")
    sizes, whole = [], neighbors.Tree.visited
    monkeypatch.setattr(neighbors.Tree, "visited", lambda self, rows, visits: sizes.append(len(rows)) or whole(self, rows, visits))
    p = neighbors.TreeParams(leaf_size=30, probes=20, cell_size=100)
    got = neighbors.nearest_vectors(df, "id", "v", 5, params=p).collect()
    # the probes and their neighbours only
    assert sizes and max(sizes) <= 20 * 5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -9)
    true = {(f"v{i:03d}", f"v{j:03d}") for i in range(700) for j in np.argsort(-near[i])[:5]}
    assert len(got) == 700 * 5 and len(true & {(r.id, r.other) for r in got}) >= 0.9 * len(true)


def net(spark, sf_dir):
    return language.fit_languages(spark.read.parquet(f"{sf_dir}/lang_samples.parquet"))


@pytest.fixture(scope="module")
def votes(spark, sf_dir):
    return language.fit_words(spark.read.parquet(f"{sf_dir}/lang_samples.parquet"))


def test_held_out_accuracy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lang_samples.parquet").orderBy("sample_id").collect()
    train, held = [r for r in rows if r.sample_id % 5], [r for r in rows if r.sample_id % 5 == 0]
    x, y = language.training_set([r.text for r in train], [r.lang for r in train])
    model = ByteNet(sorted(set(y)), NetParams(steps=300)).fit(x, y)
    parts = [(letters(r.text[a:b]), r.lang) for r in held for a, b, _ in language.sentences(r.text)]
    got = model.scores([t for t, _ in parts]).argmax(1)
    assert np.mean([model.labels[i] == lang for i, (_, lang) in zip(got, parts, strict=True)]) >= 0.95


def test_labels():
    for label, want in {"EN": "en", "en_GB": "en", "pt-BR": "pt", "Deutsch": "de", "jpn": "ja", " fra ": "fr", "sv": "other", "und": None, "??": None, "": None, None: None, "n/a": None, "no label": None, "is unknown": None, "en (auto)": "en", "pt BR": "pt", "en_US.UTF-8": "en"}.items():
        assert language.label_code(label) == want


def test_language_runs(spark, net):
    en = "The losing side gains the broken seal when a companion falls. In front of witnesses the referee keeps an open wound."
    de = "Die aktive Seite bezahlt den vollen Preis, bevor der erste Schlag fällt. Danach trägt die Heilerin eine offene Wunde."
    rows = [(1, en, "en-GB"), (2, en, "de"), (3, f"  {en}\n{de}", None), (4, None, "en"), (5, "", None), (6, "2d6 + 4 | 19", None), (7, f"{en} «Die aktive Seite»", "en"), (8, de.upper(), "ger"), (8, de.upper(), "ger")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("main", F.lit(1)).drop("main").withColumn("confidence2", F.lit(1))
    runs = language.language_runs(df, net, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in runs.collect()}
    assert {k: r.main for k, r in got.items()} == {1: "en", 2: "en", 3: got[3].main, 4: None, 5: None, 6: None, 7: "en", 8: "de"}
    assert [(r.lang, r.start) for r in got[3].runs] == [("en", 2), ("de", 3 + len(en))]
    defects = sorted(tuple(r) for r in language.label_defects(runs, "doc_id", "lang").collect())
    assert [d for d in defects if d[0] != 3] == [(2, "wrong", 0, "en")]
    assert {(d[1], d[2]) for d in defects if d[0] == 3} == {("missing", 0), ("mixed", 2), ("mixed", 3 + len(en))}
    assert language.language_runs(df.limit(0), net, "doc_id", "text", "lang").count() == 0


# pairs


def test_pair_checks():
    q = "Who gains the broken seal when a companion falls?"
    for v in (None, "", "  ", "​", "N/A", "[no answer]", '""', "—", "...", "null", "{}", "TBD"):
        assert pairs.is_empty(v), v
    for v in ("9", "No.", "Yes", "2d6"):
        assert not pairs.is_empty(v) and not pairs.is_truncated(v), v
    assert not pairs.is_empty("No answer is in the book of hours")
    for v in (q, q.upper(), f"{q} {q}", f"You want to know: {q[0].lower()}{q[1:]}", f"**{q}**", q[:-1] + "??"):
        assert pairs.is_echo(v, q), v
    assert not pairs.is_echo(f"{q} The warden.", q) and not pairs.is_echo("The warden.", q) and not pairs.is_echo(q, None)
    whole = "The warden gains the broken seal."
    for v in (whole, f"{whole} (p. 12)", f"{whole} «Le camp actif paie»", f"{whole} 🎲", f"**{whole}**", f"{whole}\n- Pahunazi: 2d6\n- Lorupahe: d100", "1d8 + 2", "9 coins", "番人は得ます。"):
        assert not pairs.is_truncated(v), v
    for v in (whole[:-9], f"{whole} Then the warden", "The warden gains the brok…", "In Winozapi,"):
        assert pairs.is_truncated(v), v


def test_pair_defects(spark, sf_dir, net, votes):
    rows = [(i, f"Who gains the seal number {i} when a companion falls?", "I am not permitted to answer that question.", None) for i in range(4)]
    rows += [(10, "Who gains the broken seal when a companion falls?", "La guérisseuse paie le prix entier avant que le premier coup ne tombe.", "")]
    rows += [(11, None, "The warden gains the broken seal when a companion falls.", None), (12, "Who?", None, None), (12, "Who?", None, None)]
    df = spark.createDataFrame(rows, "result_id long, prompt string, answer string, spoken_summary string").withColumn("field", F.lit(1))
    sound = spark.read.parquet(f"{sf_dir}/documents.parquet")
    args = ({"answer": True, "spoken_summary": False}, sound, "text", net, votes, "result_id")
    got = sorted(tuple(r) for r in pairs.pair_defects(df, *args).collect())
    assert got == [
        *((i, "answer", "refusal") for i in range(4)),
        (10, "answer", "wrong_language"),
        (10, "spoken_summary", "empty"),
        (12, "answer", "empty"),
        (12, "answer", "empty"),
    ]
    assert pairs.pair_defects(df.limit(0), *args).count() == 0


def test_refusals_that_name_their_subject(spark, sf_dir, net, votes):
    sound = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = pairs.sound_words(sound, "text").where("capital >= 0.3 * df and lower * 20 < capital").orderBy("word").limit(4).collect()
    names = [r["word"].title() for r in words]
    texts = ["Regrettably, I must refuse to say how {} works.", "About {}: I was told not to discuss matters of this kind.", "Nothing in this book covers {}."]
    rows = [(10 * k + i, f"How does {n} work, and who gains seal {k}?", t.format(n), None) for k, t in enumerate(texts) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "result_id long, prompt string, answer string, spoken_summary string")
    got = pairs.pair_defects(df, {"answer": True, "spoken_summary": False}, sound, "text", net, votes, "result_id").collect()
    assert sorted(r.result_id for r in got if r.defect == "refusal") == [0, 1, 2, 3, 10, 11, 12, 13]


def test_refusals_in_plain_words(spark, sf_dir, net, votes):
    sound = spark.read.parquet(f"{sf_dir}/documents.parquet")
    answers = ["Regrettably, alas, I cannot help with this."] * 3 + ["I cannot help with this.", "This is the help."]
    rows = [(i, f"Who gains seal {i} when a companion falls?", a, None) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "result_id long, prompt string, answer string, spoken_summary string")
    got = pairs.pair_defects(df, {"answer": True, "spoken_summary": False}, sound, "text", net, votes, "result_id").collect()
    assert sorted(r.result_id for r in got if r.defect == "refusal") == [0, 1, 2, 3]


def test_nothing_else_imports_llm():
    import pathlib

    import lorekeep

    root = pathlib.Path(lorekeep.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) lorekeep\.llm", f.read_text(), re.MULTILINE), f
