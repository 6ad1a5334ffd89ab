"""Citation operators on small inputs."""

from pyspark.sql import functions as F

from lorekeep.operators import citations as ci
from lorekeep.operators.current import current_rows
from lorekeep.operators.graph import neighbor_boosts
from lorekeep.operators.prompt import within_budget


def test_near_ids(spark):
    kind = "lib string, chunk_id string"
    wanted = spark.createDataFrame([("l", "ocult-x#3"), ("l", "OCCULT-X#3"), ("l", "far-away-name#3"), ("l", "x"), (None, "occult-x#3")], kind)
    have = spark.createDataFrame([("l", "occult-x#3"), ("l", "occult-x#4")], kind)
    assert [(r.chunk_id, r.near_id) for r in ci.near_ids(wanted, have, ["lib"]).collect()] == [("ocult-x#3", "occult-x#3")]


def test_model_output(spark):
    raw = [
        '{"answer":"a","citedChunkIds":["CHUNK_ID: d#1"," "],"confidence":"high"}',
        '{"answer":1,"confidence":"maybe","cited_from":"chunk_id: a#1"}',
        "no json",
        None,
        '{"answer":"b","citedChunkIds":[],"cited_from":["x#1","y#2"],"spokenSummary":"s"}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [tuple(r) for r in df.orderBy("i").select(ci.parsed_output(F.col("raw")).alias("o")).select("o.*").collect()]
    none = ("Unable to generate an answer.", "", "not_in_book", [])
    assert got == [("a", "", "high", ["d#1"]), (none[0], "", "not_in_book", ["a#1"]), none, none, ("b", "s", "not_in_book", ["x#1", "y#2"])]


def test_alignment_drops_weak(spark):
    a = "The warden marks the broken seal when the torch goes out."
    rows = [(1, 0, a, "Who marks the seal?", "nothing of the kind"), (1, 1, a, "Who marks the seal?", "The warden marks the broken seal."), (2, 0, a, "q", "zzz")]
    df = spark.createDataFrame(rows, "result_id long, ord int, answer string, question string, snippet string")
    got = {(r.result_id, r.ord): (r.kept, r.place) for r in ci.aligned(df).collect()}
    assert got == {(1, 0): (False, 2), (1, 1): (True, 1), (2, 0): (True, 1)}


def test_budget_keeps_first(spark):
    df = spark.createDataFrame([(1, 1, 5000), (1, 2, 10), (2, 1, 10), (2, 2, 3790), (2, 3, 1)], "question_id long, place int, tokens int")
    assert sorted((r.question_id, r.place) for r in within_budget(df, "tokens", 3800).collect()) == [(1, 1), (2, 1), (2, 2)]


SECTIONS = "section_id string, doc_id string, section_index int, title string, see_also array<string>, defines array<string>, refs array<string>, chunk_ids array<string>"


def test_graph_budget_grows_with_seeds(spark):
    rows = [
        ("s", "d", 0, "Start", ["Peer one", "Peer two"], [], [], ["a", "b"]),
        ("p1", "d", 1, "Peer one", None, [], [], ["x"]),
        ("p2", "d", 2, "Peer two", None, [], [], ["y"]),
        ("p3", "d", 3, "Other", ["Start"], [], [], ["z"]),
    ]
    sections = spark.createDataFrame(rows, SECTIONS)
    seeds = spark.createDataFrame([(1, "a"), (1, "b")], "question_id long, chunk_id string")
    got = neighbor_boosts(seeds, sections, ("see_also",), 1, 0.1).collect()
    assert {(r.chunk_id, round(r.boost, 6)) for r in got} == {("x", 0.05), ("y", 0.05)}
    assert neighbor_boosts(seeds.limit(0), sections, ("see_also", "defines"), 1, 0.1).count() == 0


def test_neighbors_against_all_edges(spark):
    import random

    from lorekeep.operators import graph as gr

    rng = random.Random(3)
    names = [f"c{i}" for i in range(9)]
    rows = [
        (f"s{i:02d}", f"d{i % 3}", i, rng.choice(["Fire rules", "Fire", "Water rules", "Air", ""]), rng.choices(["fire", "water", "air", "rules of air"], k=2), rng.sample(names, rng.randint(0, 3)), rng.sample(names, rng.randint(0, 4)), [f"k{i}", f"m{i // 2}"])
        for i in range(40)
    ]
    sections = spark.createDataFrame(rows, SECTIONS)
    edges = gr.distinct_edges(gr.concept_edges(sections).unionAll(gr.see_also_edges(sections)).unionAll(gr.order_edges(sections))).collect()
    also = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0] for h in a[4] if h != a[3].lower() and (h in b[3].lower() or b[3].lower() in h)}
    assert {(e.src, e.dst) for e in edges if e.type == "see_also"} == also
    refs = {(a[0], b[0], c) for a in rows for b in rows if a[0] != b[0] for c in set(a[6]) & set(b[5])}
    assert {(e.src, e.dst, e.concept) for e in edges if e.type == "references"} == refs
    links = {(r.src, r.type): (r.edges, r.concepts) for r in gr.concept_links(sections).collect()}
    for sid in {r[0] for r in rows}:
        mine = [x for x in refs if x[0] == sid]
        assert links.get((sid, "references"), (0, 0)) == (len(mine), len({x[2] for x in mine}))
    seeds = [(q, f"k{rng.randrange(40)}") for q in range(5) for _ in range(4)] + [(9, "m3"), (9, "nowhere")]
    for types in (("defines", "references", "see_also"), ("next_section", "references")):
        last = {}
        for r in rows:
            for c in r[7]:
                last[c] = r[0]
        near: dict = {}
        for e in edges:
            if e.type in types:
                for x, y in ((e.src, e.dst), (e.dst, e.src)):
                    near.setdefault(x, {})[y] = max(near.get(x, {}).get(y, 0), e.weight)
        want: dict = {}
        for q in {q for q, _ in seeds}:
            hit: dict = {}
            for _, c in [s for s in seeds if s[0] == q]:
                if c in last:
                    hit[last[c]] = hit.get(last[c], 0) + 1
            for s, n in hit.items():
                for peer, w in sorted(near.get(s, {}).items(), key=lambda kv: (-kv[1], kv[0]))[: 2 * n]:
                    for c in next(r[7] for r in rows if r[0] == peer):
                        want[q, c] = max(want.get((q, c), 0), w * 0.1)
        df = spark.createDataFrame(seeds, "question_id long, chunk_id string")
        got = {(r.question_id, r.chunk_id): r.boost for r in neighbor_boosts(df, sections, types, 2, 0.1).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


OUT = "result_id long, question string, answer string, spoken_summary string, confidence string, cited array<string>"
CHUNK = "chunk_id string, doc_id string, page_start int, page_end int, text string"


def test_formatted_results(spark):
    corpus = [
        ("a#0", "a", 1, 1, "The goblin warden guards the hidden gate."),
        ("a#1", "a", 2, 3, "Spells of a condition cost mana and nothing else."),
        ("b#0", "b", 1, 1, "No additional effect applies if you gain an affliction you already have."),
        ("b#1", "b", 2, 2, "Objects are things."),
        ("c#9", "c", 9, 9, "Far away text of a goblin."),
    ]
    by_id = {c[0]: c for c in corpus}
    q = "Who guards the hidden gate, the goblin warden?"
    stack = "Does the impaired condition stack twice?"
    outputs = [
        (1, q, "The goblin warden guards the hidden gate.", "s", "high", ["CHUNK_ID: a#0", " "]),  # plain
        (2, q, "The goblin warden guards it.", "s", "high", ["c#9", "a#0"]),  # c#9 was not in the prompt
        (3, q, "The goblin warden guards it.", None, "high", ["b#1"]),  # nothing in common with the question
        (4, q, "No idea.", None, "not_in_book", ["zz", "zz"]),  # nothing resolves: sources of the prompt stand in
        (5, stack, "Each instance stacks.", None, "mixed", ["a#1", "b#1"]),  # rule text is added, what supports nothing is pruned
        (6, q, " ", None, "high", ["xa#0", "a#0"]),  # near id; a blank answer is not aligned
        (7, None, None, None, None, None),
        (8, q, "x", None, "high", ["c#9"]),  # no prompt at all
    ]
    seen = {1: ["a#0", "a#1"], 2: ["a#0", "a#1"], 3: ["a#1", "a#0", "b#1"], 4: ["a#1", "a#0"], 5: ["a#1", "b#1", "b#0"], 6: ["a#0"], 7: ["a#0"]}
    prompt = [(r, i + 1, *by_id[c]) for r, cs in seen.items() for i, c in enumerate(cs)]
    df = ci.formatted(spark.createDataFrame(outputs, OUT), spark.createDataFrame(prompt, f"result_id long, place int, {CHUNK}"), spark.createDataFrame(corpus, CHUNK))
    got = {r.result_id: r for r in df.collect()}
    ids = {k: [c.chunk_id for c in r.citations] for k, r in got.items()}
    assert ids[1] == ["a#0"] and got[1].confidence == "high" and got[1].single_hits > 0 and got[1].resolved_ids == ["a#0"]
    assert ids[2] == ["a#0"] and got[2].dropped_ids == ["c#9"] and got[2].confidence == "mixed"
    assert ids[3][0] == "a#0" and got[3].replaced_ids == ["b#1"] and got[3].confidence == "mixed"
    assert got[4].used_fallback and got[4].fallback_ids[0] == "a#0" and got[4].unresolved_ids == ["zz"]
    assert got[5].supplement_ids == ["b#0"] and got[5].pruned_ids == ["b#1"] and set(ids[5]) | set(got[5].weak_ids) == {"a#1", "b#0"}
    assert ids[6] == ["a#0", "a#0"] and got[6].resolved_ids == ["xa#0", "a#0"] and got[6].support_scores is None
    assert ids[7] == [] and got[7].answer == "" and not got[7].used_fallback
    assert ids[8] == ["c#9"] and got[8].dropped_ids == []
    assert got[2].citations[0].page_hint == "p. 1" and got[2].citations[0].document_label == "a"
    assert set(got[2].support_scores) == {"a#0"}


def test_eval_scores(spark):
    cases = spark.createDataFrame([(1, "high", "Risky"), (2, "high", None), (3, None, None), (4, "mixed", "x"), (5, "high", "")], "question_id int, expected_confidence string, expected_snippet string")
    out = spark.createDataFrame([(1, "a risky action", "high"), (2, "b", "mixed"), (3, "c", "high"), (5, None, "high")], "question_id int, answer string, confidence string")
    assert {r.question_id: r.passed for r in ci.eval_scores(out, cases).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_current_rows(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "x"), (None, 1, "n"), (None, 3, "m")]
    df = spark.createDataFrame(rows, "k string, ingested_at int, v string")
    assert sorted((r.k or "", r.v) for r in current_rows(df, ["k"]).collect()) == [("", "m"), ("a", "new"), ("b", "x")]
    assert current_rows(df.limit(0), ["k"]).count() == 0
