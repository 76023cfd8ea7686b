"""Hand-made cases and invariants of operators that SQL cannot check as a whole."""

import json
import math
import random
import re
import time
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import labels, scoring
from corpusloom.functions import text as X
from corpusloom.functions.jsonfix import repair, salvage_json
from corpusloom.operators import aliases, chunking, context, conversations, evaluation, fetching, filtering, graph, mentions, models, paths, profiling, ranking, reports, similarity, vector_index
from corpusloom.sources import readers, writers
from corpusloom.sources.parted import PartedTable
from corpusloom.streaming.sessions import fold_session
from corpusloom.tables import in_shares


def one(df):
    return df.first()[0]


# ---------------------------------------------------------------- chunks


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab. ", min_size=0, max_size=60), min_size=1, max_size=12), st.integers(20, 60), st.integers(0, 15))
def test_chunks_cover_text_within_limit(paragraphs, limit, overlap):
    text = "\n\n".join(paragraphs)
    chunks = chunking.pack_text(text, limit, overlap)
    assert all(c.strip() for c in chunks) or len(text) <= limit
    longest = max((len(s) for p in paragraphs for s in p.replace(". ", ".\n").split("\n")), default=0)
    if len(text) > limit:
        assert all(len(c) <= max(limit, longest) + overlap + 2 for c in chunks)
    # Every non-blank character of the text occurs in some chunk in order.
    left = "".join(text.split())
    joined = "".join("".join(c.split()) for c in chunks)
    at = 0
    for char in joined:
        if at < len(left) and char == left[at]:
            at += 1
    assert at == len(left)


def test_chunk_examples():
    assert chunking.pack_text("short", 10, 2) == ["short"]
    assert chunking.pack_text("aaaa\n\nbbbb\n\ncccc", 10, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert chunking.pack_text("aaaa\n\nbbbb\n\ncccc", 10, 2) == ["aaaa\n\nbbbb", "bb\n\ncccc"]
    assert chunking.pack_text("One two. Three four. Five six.", 12, 0) == ["One two.", "Three four.", "Five six."]


def test_section_groups(spark):
    df = spark.sql("""SELECT array(named_struct('title', '', 'level', 1, 'content', 'aaa'), named_struct('title', 'B', 'level', 2, 'content', 'bbb'),
      named_struct('title', 'C', 'level', 2, 'content', repeat('c', 8))) AS s""")
    groups = one(df.select(chunking.section_groups(F.col("s"), 10)))
    assert [(g.title, g.text) for g in groups] == [("B", "aaa\n\nbbb"), ("C", "c" * 8)]


def test_chunk_documents_falls_back_to_content(spark):
    df = spark.sql("SELECT 'd' AS page_key, 'T' AS canonical_name, 'x y' AS content, CAST(array() AS array<struct<title:string,level:int,content:string>>) AS sections, "
                   "'Other' AS entity_type, array('R') AS regions, array('c') AS categories, 'u' AS source_url")
    row = chunking.chunk_documents(df).first()
    assert (row.chunk_id, row.section_title, row.text, row.text_length) == ("d_c000", "", "x y", 3)


def test_chunk_ids_run_over_groups(spark, tables):
    from corpusloom.plans import all_queries

    rows = all_queries()["D02_chunk_documents"].build(tables)
    per_doc = rows.groupBy("doc_id").agg(F.max("chunk_index").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("u"))
    assert per_doc.filter("m + 1 <> n OR n <> u").count() == 0


# ---------------------------------------------------------------- text


def test_title_and_url_cases(spark):
    df = spark.createDataFrame([("https://h/wiki/A%20b/C+d",), ("https://h/x",), ("https://h/wiki/%zz",)], "url string")
    got = [r[0] for r in df.select(X.wiki_slug(F.col("url"))).collect()]
    assert got == ["A b/C+d", None, "%zz"]


def test_markdown_and_normalise(spark):
    df = spark.createDataFrame([("a\n![x](y.png)\n---\n\n\n\nb  \t c{{t|x}} \n",)], "t string")
    assert one(df.select(X.clean_markdown(F.col("t")))) == "a\n\nb  \t c{{t|x}}"
    assert one(df.select(X.normalize_text(F.col("t")))) == "a\n![x](y.png)\n---\n\nb c"


def test_topic_words_are_literal(spark):
    assert one(spark.range(1).select(X.has_any(F.lit("see A.B (c)"), ["zz", "a.b (C)"])))
    assert not one(spark.range(1).select(X.has_any(F.lit("see AxB (c)"), ["a.b (C)"])))
    assert not one(spark.range(1).select(X.has_any(F.lit(None).cast("string"), ["a"])))


def test_relevance_and_dates(spark):
    bands = [one(spark.range(1).select(labels.relevance_band(F.lit(s)))) for s in (0.95, 0.945, 0.944, 0.7, 0.69)]
    assert bands == ["95+", "95+", "90+", "70+", "below 70"]


def test_coreference_words(spark):
    rows = [(1, 0, "Who is Ada?", "a", ["Ada"]), (1, 1, "What is her role?", "a", []), (1, 2, "Is it old?", "a", ["B"]), (1, 3, "Is Ada like them?", "a", [])]
    df = spark.createDataFrame(rows, "session_id long, turn_no long, question string, answer string, entities array<string>")
    got = [r.resolved for r in conversations.resolve_coreference(df).orderBy("turn_no").collect()]
    assert got == ["Who is Ada?", "[Referring to Ada] What is her role?", "Is it old?", "Is Ada like them?"]


# ---------------------------------------------------------------- mentions and fetching


def brute_mentions(text, names):
    low, spans, found = text.lower(), [], {}
    for name in sorted(names, key=lambda n: (-len(n), n.lower())):
        start = 0
        while (i := low.find(name.lower(), start)) >= 0:
            end = i + len(name)
            free = (i == 0 or not low[i - 1].isalnum()) and (end >= len(low) or not low[end].isalnum())
            if free and all(end <= s or i >= e for s, e in spans):
                spans.append((i, end))
                found.setdefault(name, i)
            start = end
    return found


def test_mentions_equal_brute_force(spark):
    names = ["Red Fox", "fox", "Fox Hill", "Hill Top", "A", "Dr. Who", "(odd)", "NATION_1"]
    texts = ["The red fox of Fox Hill Top saw a NATION_12 and NATION_1.", "Dr. Who (odd) foxes fox", "x(odd) y (odd)", "red fox hill top", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    got = {}
    for r in mentions.find_mentions(df, spark.createDataFrame([(n,) for n in names], "name string")).collect():
        got.setdefault(r.text_id, {})[r.name] = r.start
    assert got == {i: m for i, t in enumerate(texts) if (m := brute_mentions(t, names))}


def test_mention_counts_in_slices(spark):
    docs = spark.createDataFrame([(1, "aaaa bA"), (2, "zzz")], "doc_id long, content string")
    names = spark.createDataFrame([("aa",), ("BA",), ("q",), ("z",)], "name string")
    expected = [(1, "aa", 2), (1, "ba", 1), (2, "z", 3)]
    for size in (1, 2, 100):
        got = mentions.mention_counts(docs, names, slice_names=size)
        assert sorted(map(tuple, got.collect())) == expected


@pytest.mark.parametrize("gram", [1, 3, 8])
def test_contained_in_equals_brute_force(spark, gram):
    needles, texts = ["nation_1", "on", "x", "abcdefghijk"], ["old nation_12", "on", "abcdefghijkl", "yy", "x"]
    got = fetching.contained_in(spark.createDataFrame([(n,) for n in needles], "n string"),
                                spark.createDataFrame([(t,) for t in texts], "t string"), "n", "t", gram)
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n in needles for t in texts if n in t)


def test_layer_c_skips_held_and_taken(spark):
    docs = spark.createDataFrame(
        [(1, "a b a b", "Quest", "T1", []), (2, "a b c", "Item", "T2", []), (3, "a c", "Item", "T3", []), (4, "b c b", "Item", "T4", [])],
        "doc_id long, content string, entity_type string, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame([("q", ["A", "b", "C"])], "question_id string, entities array<string>")
    held = spark.createDataFrame([("q", 1)], "question_id string, doc_id long")
    got = [r.doc_id for r in fetching.layer_comention(asked, docs, held).orderBy("place").collect()]
    # a,b: 1 is held, so 2; a,c: 2 is taken, so 3; b,c: 4 before 2.
    assert got == [2, 3, 4]


# ---------------------------------------------------------------- vectors


def test_topk_plans_agree_and_break_ties_by_id(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((60, 8)).tolist()
    vectors[7] = vectors[3]
    vectors[11] = [0.0] * 8
    items = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(vectors)], "item_id long, embedding array<double>, g int")
    asked = items.select(F.col("item_id").alias("query_id"), "embedding", "g")
    small = similarity.vector_topk(asked, items, 5, same=["g"]).collect()
    large = similarity.vector_topk(asked, items, 5, same=["g"], query_limit=10).collect()
    key = lambda r: (r.query_id, r.rank, r.item_id, round(r.score, 9))
    assert sorted(map(key, small)) == sorted(map(key, large))
    first = {r.query_id: r.item_id for r in small if r.rank == 1}
    assert first[3] == 3 and first[7] == 3
    assert all(r.score == 0 for r in small if r.query_id == 11)


def test_large_topk_shares_equal_vectors_and_copies_no_side_per_small_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 8)).tolist()
    items = spark.createDataFrame(list(enumerate(vectors)), "item_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, vectors[i % 150]) for i in range(600)], "query_id long, embedding array<double>")
    met, meet = [], similarity._meet
    monkeypatch.setattr(similarity, "_meet", lambda left, right, *more: met.append((left.count(), right.count())) or meet(left, right, *more))
    large = similarity.vector_topk(asked, items, 5, query_limit=16).collect()
    assert met == [(150, 300)]
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    order = np.argsort(-(unit[:150] @ unit.T), axis=1)[:, :5]
    assert {(r.query_id, r["rank"]): r.item_id for r in large} == {(q, n + 1): order[q % 150, n] for q in range(600) for n in range(5)}


def test_best_pairs_are_not_sorted_for_every_block_of_items(monkeypatch):
    """Few pairs pass the bar after the first blocks, so the best ones are sorted a few times and not once per 2,048 items."""
    rng = np.random.default_rng(3)
    held = similarity._unit_rows(rng.integers(-2, 3, (40_000, 8)).astype(float))
    asked = similarity._unit_rows(rng.standard_normal((40, 8)))
    sorts, first_k = [], similarity._first_k
    monkeypatch.setattr(similarity, "_first_k", lambda *a: sorts.append(len(a[0])) or first_k(*a))
    row, place, score = similarity._nearest(asked, held, 8)
    assert len(sorts) < 12  # 20 blocks of 2,048
    exact = np.round(np.array([[float(np.einsum("j,j->", a, h)) for h in held] for a in asked[:5]]), 12)
    for i in range(5):
        order = np.lexsort((np.arange(len(held)), -exact[i]))[:8]
        assert place[row == i].tolist() == order.tolist()
        assert np.allclose(score[row == i], exact[i][order], atol=1e-11)


def test_approximate_topk_recall_and_salting(spark, tables):
    asked = tables.cache_lookups.filter("query_id % 3 <> 2")
    exact = similarity.vector_topk(asked, tables.embeddings, 1, item_id="vec_id").select("query_id", "item_id")
    approx = similarity.vector_topk_approx(asked, tables.embeddings, 1, item_id="vec_id").select("query_id", "item_id")
    salted = similarity.vector_topk_approx(asked, tables.embeddings, 1, item_id="vec_id", rows_per_task=5).select("query_id", "item_id")
    n = exact.count()
    assert exact.intersect(approx).count() >= 0.9 * n
    assert sorted(map(tuple, approx.collect())) == sorted(map(tuple, salted.collect()))


def test_approximate_topk_recall_of_the_query(spark, tables):
    exact = similarity.vector_topk(tables.cache_lookups, tables.embeddings, 8, item_id="vec_id").select("query_id", "item_id")
    approx = similarity.vector_topk_approx(tables.cache_lookups, tables.embeddings, 8, item_id="vec_id").select("query_id", "item_id")
    for part in (F.lit(True), F.col("query_id") % 3 == 2):
        asked = exact.filter(part)
        assert asked.intersect(approx).count() >= 0.9 * asked.count()


def test_cache_cases(spark):
    base = [1.0, 0.0, 0.0, 0.0, 0.0]
    cache = spark.createDataFrame([(1, "en", base)], "entry_id long, lang string, embedding array<double>")
    asked = spark.createDataFrame([(1, "en", base), (2, "en", [0.99, 0.1, 0.0, 0.0, 0.0]), (3, "en", [0.0, 1.0, 0.0, 0.0, 0.0]), (4, "zh", base)],
                                  "query_id long, lang string, embedding array<double>")
    got = {r.query_id: r.entry_id for r in similarity.cache_lookup(asked, cache).collect()}
    assert got == {1: 1, 2: 1, 3: None, 4: None}


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert one(df.select(scoring.cosine(F.col("a"), F.col("b")))) == 0.0


# ---------------------------------------------------------------- graph and paths


def test_paths_equal_brute_force(spark):
    rows = [("a", "R", "b"), ("b", "R", "c"), ("c", "S", "a"), ("a", "S", "b"), ("c", "R", "d"), ("d", "L", "d")]
    edges = spark.createDataFrame([(*r, f"ev{i}" if i else None) for i, r in enumerate(rows)], "head string, relation string, tail string, evidence string")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "name string")

    def brute(start, end, hops):
        found, frontier = [], [([start], [], [])]
        for _ in range(hops):
            grown = []
            for names, rels, used in frontier:
                for h, r, t in rows:
                    for x, y in {(h, t), (t, h)}:
                        if x == names[-1] and (h, r, t) not in used:
                            grown.append((names + [y], rels + [r], used + [(h, r, t)]))
            found += [(n, r) for n, r, _ in grown if n[-1] == end]
            frontier = grown
        return sorted(found, key=lambda p: (len(p[1]), p[0], p[1]))

    pairs = spark.createDataFrame([(1, "A", "d"), (2, "a", "c"), (3, "d", "b")], "pair_id long, source string, target string")
    for hops in (1, 2, 5):
        got = {}
        for r in paths.paths(pairs, nodes, edges, hops, 4).orderBy("pair_id", "path_rank").collect():
            got.setdefault(r.pair_id, []).append((r.nodes, r.relations))
        expected = {i: p[:4] for i, (s, e) in {1: ("a", "d"), 2: ("a", "c"), 3: ("d", "b")}.items() if (p := brute(s, e, hops))}
        assert got == expected, hops


@pytest.mark.parametrize("seed, keep", [(1, 3), (2, 12), (3, 1)])
def test_paths_on_random_graphs(spark, seed, keep):
    """A hub, double edges, loops, ends that are the same node and pairs that share their ends."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    rows = {(rng.choice(names), rng.choice("RS"), rng.choice(names)) for _ in range(18)} | {("n0", "H", n) for n in names[5:]}
    edges = spark.createDataFrame([(*r, "e" + r[2]) for r in sorted(rows)], "head string, relation string, tail string, evidence string")
    wanted = [(i, rng.choice(names), rng.choice(names), rng.randrange(1, 6)) for i in range(25)] + [(90, "n1", "n1", 4), (91, "n0", "n6", 2), (92, "n0", "n6", 5)]

    def brute(start, end, hops):
        found, frontier = [], [([start], [], [], [], [])]
        for _ in range(hops):
            frontier = [
                (n + [y], rel + [r], fwd + [(h, t) == (x, y)], ev + ["e" + t], used + [(h, r, t)])
                for n, rel, fwd, ev, used in frontier for h, r, t in rows for x, y in {(h, t), (t, h)} if x == n[-1] and (h, r, t) not in used
            ]
            found += [(len(rel), n, rel, fwd, ev) for n, rel, fwd, ev, _ in frontier if n[-1] == end]
        return sorted(found)[:keep]

    got = {i: [] for i, *_ in wanted}
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = spark.createDataFrame(wanted, "pair_id long, source string, target string, hops int")
    for r in paths.paths(pairs, nodes, edges, 5, keep).orderBy("pair_id", "path_rank").collect():
        got[r.pair_id].append((r.path_length, r.nodes, r.relations, r.forward, r.evidences))
    assert got == {i: brute(s, t, h) for i, s, t, h in wanted}


@pytest.mark.parametrize("seed, keep", [(1, 3), (2, 12), (5, 2)])
def test_paths_through_hubs_on_random_graphs(spark, seed, keep):
    """As above with several nodes taken for hubs: a hub, double edges, loops, ends that are the same node and pairs that share their ends."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    rows = {(rng.choice(names), rng.choice("RS"), rng.choice(names)) for _ in range(18)} | {("n0", "H", n) for n in names[5:]}
    edges = spark.createDataFrame([(*r, "e" + r[2]) for r in sorted(rows)], "head string, relation string, tail string, evidence string")
    wanted = [(i, rng.choice(names), rng.choice(names), rng.randrange(1, 6)) for i in range(25)] + [(90, "n1", "n1", 4), (91, "n0", "n6", 2), (92, "n0", "n6", 5)]

    def brute(start, end, hops):
        found, frontier = [], [([start], [], [], [], [])]
        for _ in range(hops):
            frontier = [
                (n + [y], rel + [r], fwd + [(h, t) == (x, y)], ev + ["e" + t], used + [(h, r, t)])
                for n, rel, fwd, ev, used in frontier for h, r, t in rows for x, y in {(h, t), (t, h)} if x == n[-1] and (h, r, t) not in used
            ]
            found += [(len(rel), n, rel, fwd, ev) for n, rel, fwd, ev, _ in frontier if n[-1] == end]
        return sorted(found)[:keep]

    got = {i: [] for i, *_ in wanted}
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = spark.createDataFrame(wanted, "pair_id long, source string, target string, hops int")
    for r in paths.paths(pairs, nodes, edges, 5, keep, hub_links=3).orderBy("pair_id", "path_rank").collect():
        got[r.pair_id].append((r.path_length, r.nodes, r.relations, r.forward, r.evidences))
    assert got == {i: brute(s, t, h) for i, s, t, h in wanted}


def test_paths_do_not_open_a_hub_for_each_end(spark, monkeypatch):
    n, sizes, store = 400, [], paths.written

    def counted(df):
        out = store(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(paths, "written", counted)
    rows = [(f"s{i}", "IN", "hub", None) for i in range(n)] + [(f"s{i}", "BY", f"s{(i + 1) % n}", None) for i in range(n)]
    edges = spark.createDataFrame(rows, "head string, relation string, tail string, evidence string")
    nodes = spark.createDataFrame([(f"s{i}",) for i in range(n)] + [("hub",)], "name string")
    pairs = spark.createDataFrame([(i, f"s{i}", f"s{(i + 10) % n}") for i in range(n)], "pair_id long, source string, target string")
    found = paths.paths(pairs, nodes, edges, 4, 3).collect()
    assert sum(r.nodes == [f"s{r.pair_id}", "hub", f"s{(r.pair_id + 10) % n}"] and r.path_rank == 1 for r in found) == n and len(found) == 3 * n
    assert max(sizes) < 30 * n


def test_path_bound_per_pair(spark):
    edges = spark.createDataFrame([("a", "R", "b", "x"), ("b", "R", "c", None)], "head string, relation string, tail string, evidence string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    pairs = spark.createDataFrame([(1, "a", "c", 1), (2, "c", "a", 2)], "pair_id long, source string, target string, hops int")
    row = paths.paths(pairs, nodes, edges, 3, 3).collect()
    assert [(r.pair_id, r.path_steps, r.forward, r.evidences) for r in row] == [(2, ["c -[R]-> b", "b -[R]-> a"], [False, False], ["x"])]


def test_neighbours_limit_is_per_direction(spark):
    nodes = spark.createDataFrame([(f"n{i}", "T", "d") for i in range(8)], "name string, type string, description string")
    edges = spark.createDataFrame([("n0", "R", f"n{i}", None) for i in range(1, 8)] + [(f"n{i}", "S", "n0", None) for i in range(1, 8)],
                                  "head string, relation string, tail string, evidence string")
    seeds = spark.createDataFrame([("N0",), ("nobody",)], "name string")
    rows = graph.neighbors(seeds, nodes, edges, 3).collect()
    assert len(rows) == 6 and {r.direction for r in rows} == {"outgoing", "incoming"} and {r.entity for r in rows} == {"n0"}


def test_neighbours_of_a_hub(spark):
    """A hub with most edges: the same rows for any number of salts, and the rank limit comes before the join."""
    rng = random.Random(2)
    nodes = spark.createDataFrame([(f"n{i}", "T", "d") for i in range(200)] + [("alone", "T", "d")], "name string, type string, description string")
    rows = {("n0", rng.choice("RS"), f"n{rng.randrange(200)}") for _ in range(300)} | {(f"n{rng.randrange(200)}", "Q", f"n{rng.randrange(200)}") for _ in range(200)}
    edges = spark.createDataFrame([(*r, None) for r in rows], "head string, relation string, tail string, evidence string")
    seeds = spark.createDataFrame([("N0",), ("n7",), ("alone",)], "name string")
    want = set()
    for name in ("n0", "n7"):
        out, into = sorted((t, r) for h, r, t in rows if h == name), sorted((h, r) for h, r, t in rows if t == name)
        want |= {(name, d, o, r, k + 1) for d, some in (("outgoing", out), ("incoming", into)) for k, (o, r) in enumerate(some[:5])}
    for salts in (1, 16):
        found = graph.neighbors(seeds, nodes, edges, 5, salts)
        assert {(r.entity, r.direction, r.other, r.relation, r["rank"]) for r in found.collect()} == want | {("alone", None, None, None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join RightOuter") < plan.index("WindowGroupLimit") < plan.index("Join LeftSemi")


def test_alias_direction_is_reversed(spark):
    pairs = [("A", "B"), ("B", "x"), ("B", "y"), ("C", "x")]
    got = {r.alias: (r.canonical_name, r.alias_count) for r in aliases.resolve_alias_conflicts(
        spark.createDataFrame(pairs, "canonical string, alias string")).collect()}
    assert got == {"A": ("B", 3), "x": ("B", 3), "y": ("B", 3)}


# ---------------------------------------------------------------- ranking


def test_running_total_over_many_slots(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    got = {r.k: r.total_before for r in ranking.running_total(df, "v", "k", slots=16).collect()}
    total, expected = 0, {}
    for r in sorted(df.collect(), key=lambda r: r.k):
        expected[r.k] = total
        total += r.v
    assert got == expected


def test_rank_filter_is_pushed_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.first_per_key(df, ["k"], ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_quota_and_manifest(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"))
    rows = reports.quota_sample(df, F.col("doc_id") % 2 == 0, 3, 2).collect()
    assert [r.doc_id for r in rows] == [0, 2, 4, 1, 3]


# ---------------------------------------------------------------- evaluation


def test_summary_of_scores(spark):
    rows = [("a", 1, 0.5, 1.0, 0.7, True), ("a", 1, 0.0, 1.0, 0.4, False), ("a", 2, 0.25, 0.5, 0.35, False), ("a", 2, 0.25, 0.5, 0.35, True)]
    schema = "config string, tier int, fact_score double, trap_score double, overall_score double, min_facts_met boolean"
    row = evaluation.summarize_scores(spark.createDataFrame(rows, schema)).first()
    assert (row.overall, row.fact_score, row.trap_score, row.min_facts_pct, row.n) == (0.45, 0.25, 0.75, 50.0, 4)


def test_topk_breaks_ties_of_scaled_copies_by_id(spark):
    corpus = spark.createDataFrame([(i, [0.1 * (1 + i % 7), 0.3 * (1 + i % 7), 0.7 * (1 + i % 7)]) for i in range(3000)], "item_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [0.1, 0.3, 0.7 + q]) for q in range(3)], "query_id long, embedding array<double>")
    for limit in (10, 1):
        rows = similarity.vector_topk(asked, corpus, k=8, query_limit=limit).collect()
        assert sorted((r.query_id, r["rank"], r.item_id) for r in rows) == [(q, n + 1, n) for q in range(3) for n in range(8)]


def test_first_of_repeated_decisions_counts(spark):
    edges = spark.createDataFrame([("a", "RELATED_TO", "b", None, 1, "t")], "head string, relation string, tail string, evidence string, source_doc_id long, source_title string")
    decisions = spark.createDataFrame([("a", "b", None, "Y"), ("a", "b", None, "X")], "head string, tail string, evidence string, new_relation string")
    assert [r.relation for r in graph.retype_edges(edges, decisions).collect()] == ["X"]


def test_evicted_entities_come_back(spark):
    turns = [("s", i, [f"e{i}"], "q", "a") for i in range(31)] + [("s", 31, ["e0"], "q", "a")] + [("t", i, ["A"] if i == 0 else ["B"], "q", "a") for i in range(56)]
    df = spark.createDataFrame(turns, "session_id string, turn_no int, entities array<string>, question string, answer string")
    last = {}
    for r in conversations.accumulated_entities(df, 30).orderBy("session_id", "place").collect():
        last.setdefault(r.session_id, []).append(r.entity)
    assert last["s"][-3:] == ["e29", "e30", "e0"] and len(last["s"]) == 30 and last["t"] == ["A", "B"]
    before = {(r.session_id, r.turn_no): r.known for r in conversations.entities_before(df, 30).collect()}
    assert before["t", 55] == ["A", "B"] and before["s", 0] == []


@pytest.mark.parametrize("cap, slot_turns", [(3, 4), (3, 64), (30, 7)])
def test_sessions_fold_like_the_stream(spark, cap, slot_turns):
    """Turns that drop names and name them again, over many slots; one session has a third of all turns."""
    rng = random.Random(cap + slot_turns)
    sizes = {"long": 150, "none": 3, **{f"s{i}": rng.randrange(1, 40) for i in range(14)}}
    draw = lambda s: None if s == "none" else [f"e{rng.randrange(7 if cap == 3 else 45)}" for _ in range(rng.randrange(4))]
    turns = [(s, i, draw(s)) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(*t, "q", "a") for t in turns], "session_id string, turn_no int, entities array<string>, question string, answer string")
    known, before, last = {}, {}, {}
    for s, i, named in turns:
        before[s, i] = (known.get(s, []), last.get(s))
        known[s], last[s] = fold_session(([], known.get(s, [])), [(0, named or [])], entity_cap=cap)[1], named or []
    got = {(r.session_id, r.turn_no): (r.known, r.last_entities) for r in conversations.entities_before(df, cap, slot_turns).collect()}
    assert got == before
    ends = {}
    for r in conversations.accumulated_entities(df, cap, slot_turns).orderBy("session_id", "place").collect():
        ends.setdefault(r.session_id, []).append(r.entity)
    assert ends == {s: k for s, k in known.items() if k}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_availability_of_a_service_in_many_parts(spark, parts):
    """One service has half of all calls, with ties in time, over as many ranges as asked for."""
    rng = random.Random(parts)
    calls, now = [], 1_700_000_000
    for i in range(1200):
        now += rng.choice([0, 1, 5, 20, 59, 60, 61, 200]) if i % 3 else rng.choice([0, 1])
        calls.append((0 if rng.random() < 0.5 else rng.randrange(1, 9), i, now, rng.random() < 0.6))
    df = spark.createDataFrame([(u, i, datetime.fromtimestamp(t, timezone.utc), bad) for u, i, t, bad in calls], "user_id long, event_id long, ts timestamp, bad boolean")
    want, breakers = {}, {}
    for u, i, t, bad in calls:
        want[i] = (u, *breakers.setdefault(u, conversations.Breaker()).call(t, bad))
    got = conversations.availability(df, failed=F.col("bad"), parts=parts).collect()
    assert {r.call_id: (r.service, r.before, r.after, r.rejected) for r in got} == want and len(got) == len(want)


def test_segments_agree_with_the_calls_one_by_one():
    rng = random.Random(12)
    for _ in range(400):
        at, t = [], 0
        for _ in range(rng.randrange(1, 25)):
            t += rng.choice([0, 1, 3, 10, 30])
            at.append(t)
        bad = [rng.random() < 0.6 for _ in at]
        closed, until, ends = conversations.segment(at, bad, 3, 10)
        for start in [(f, 0, False) for f in range(3)] + [(3, t - 10, True) for t in range(-12, 12) if t - 10 <= at[0]]:
            breaker = conversations.Breaker(3, 10, *start)
            for when, fails in zip(at, bad):
                breaker.call(when, fails)
            if start[2]:
                k = next((k for k, u in enumerate(until) if u >= start[1] + 10), None)
                found = start if k is None else ends[k]
            else:
                found = closed[start[0]]
            assert found[2] == breaker.is_open and (found[1] == breaker.last_failure if found[2] else found[0] == breaker.failures)


def test_upserts_leave_other_parts_alone(spark, tmp_path):
    """Untouched parts keep their files; a part may come to be empty; a lost writer's files are not read."""
    table = PartedTable(spark, str(tmp_path / "t"), "key string, n long", ["key"], parts=8)
    rows = lambda *names, n=0: spark.createDataFrame([(k, n) for k in names], "key string, n long")
    assert table.read().count() == 0 and table.upsert(rows(), lambda old, new: new) == []
    newest = lambda old, new: ranking.first_per_key(old.unionByName(new), ["key"], [F.desc("n")])
    table.upsert(rows(*(f"k{i}" for i in range(60))), newest)
    files = lambda: {f.split("/t/")[1] for f in table.read().inputFiles()}
    before = files()
    touched = table.upsert(rows("k3", "fresh", n=5), newest)
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if not any(f"part={p}/" in f for p in touched)}
    assert kept == files() & before and len(kept) >= 6
    assert {r.key: r.n for r in table.read().collect()} == {**{f"k{i}": 0 for i in range(60)}, "k3": 5, "fresh": 5}
    (tmp_path / "t/rows/v=000009/part=0").mkdir(parents=True)
    gone = table.upsert(rows("k3"), lambda old, new: old.filter("key <> 'k3' and key <> 'fresh'"))
    left = {r.key for r in table.read().collect()}
    assert left - {"fresh"} == {f"k{i}" for i in range(60)} - {"k3"}
    assert table.read(gone).filter("key = 'k3'").count() == 0


def test_sketched_profile(spark):
    """Figures that are exact, errors of those that are not, odd column names, and one exchange only."""
    rows = [(i, f"v{i % 5000}" if i % 10 else None, "x" * (i % 101), ["a"] * (i % 3), i % 7 == 0, "c" + str(i % 30), "<b>" if i == 29_999 else "t") for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, `a.b` string, text string, tags array<string>, flag boolean, few string, late string").repartition(4)
    found = profiling.profile_sketched(df, "id")
    got = {r.field_name: r for r in found.collect()}
    exact = {r.field_name: r for r in profiling.profile(df.drop("a.b"), "id").collect()}
    same = ["primary_type", "total_count", "non_null_count", "null_count", "null_rate", "min_length", "max_length", "avg_length"]
    for name, r in exact.items():
        assert [got[name][c] for c in same] == [r[c] for c in same], name
        if r.unique_count is not None:
            assert abs(got[name].unique_count - r.unique_count) <= 0.03 * r.unique_count
        if r.unique_values is not None:
            assert got[name].unique_values == r.unique_values
    assert abs(got["a.b"].unique_count - 4500) <= 135 and got["a.b"].null_count == 3000
    assert abs(got["text"].median_length - exact["text"].median_length) <= 3
    assert got["late"].contains_html and not got["text"].contains_markdown and got["id"].contains_html is None
    assert len(set(got["few"].examples)) == 3 and len(got["late"].examples) == 2
    assert found._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 2


def test_inverted_lists(spark, tables, tmp_path):
    """Clustered vectors: at most a quarter of the pairs for a recall of 0.9, every row in one list, long lists over several tasks."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 24))
    rows = [(i, (middles[i % 30 if i % 3 else 0] + rng.normal(scale=0.35, size=24)).tolist()) for i in range(1500)] + [(1500, [0.0] * 24), (1501, None)]
    corpus = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, (np.array(rows[i][1]) + rng.normal(scale=0.1, size=24)).tolist()) for i in range(0, 1500, 20)], "query_id long, embedding array<double>")
    index = vector_index.VectorIndex(spark, str(tmp_path / "index")).build(corpus, lists=40, sample=800)
    assert spark.read.parquet(str(tmp_path / "index/lists")).count() == 1501
    exact = {(r.query_id, r.item_id) for r in similarity.vector_topk(asked, corpus.filter("embedding is not null"), 8).collect()}
    for task_rows in (20_000, 50):
        found = index.topk(asked, 8, 6, task_rows=task_rows).collect()
        assert len({(r.query_id, r.item_id) for r in found} & exact) >= 0.9 * len(exact) and len(found) == len(exact)
    assert index.share(asked, 6) <= 0.25
    everything = {(r.query_id, r.item_id, r["rank"]) for r in index.topk(asked, 8, 40).collect()}
    assert everything == {(r.query_id, r.item_id, r["rank"]) for r in similarity.vector_topk(asked, corpus.filter("embedding is not null"), 8).collect()}


def test_queries_of_a_list_are_dealt_in_blocks(spark, tmp_path):
    """Very many queries that look at one list: no task has many of them, and the rows are those of a single task; ids twice or null, vectors null."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 6)).tolist()
    corpus = spark.createDataFrame([(i % 350, v) for i, v in enumerate(vectors)], "item_id long, embedding array<double>")
    asked = [(i % 900, (rng.normal(scale=0.05, size=6) + vectors[0]).tolist()) for i in range(1000)] + [(None, vectors[1]), (None, vectors[1]), (7000, None)]
    asked = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    index = vector_index.VectorIndex(spark, str(tmp_path / "index")).build(corpus, lists=4)
    probed = index._probed(asked, 2, "query_id", "embedding")
    left, right = index._met(probed, 30, 50)
    keys = ["list", "salt", "block"]
    most = [df.groupBy(*keys).count().agg(F.max("count")).first()[0] for df in (left, right)]
    assert probed.groupBy("list").count().agg(F.max("count")).first()[0] > 900 and most[0] <= 100 and most[1] <= 60
    whole = sorted(map(str, index.topk(asked, 5, 2).collect()))
    assert whole == sorted(map(str, index.topk(asked, 5, 2, task_rows=30, task_queries=50).collect()))
    assert index.topk(asked.limit(0), 5, 2).count() == 0


def test_a_turn_may_drop_a_name_and_say_another_again(spark):
    df = spark.createDataFrame([("s", 0, ["a", "b", "c"]), ("s", 1, ["d", "a"])], "session_id string, turn_no int, entities array<string>")
    assert [r.entity for r in conversations.accumulated_entities(df, 3).orderBy("place").collect()] == ["b", "c", "d"]


@pytest.mark.parametrize("reply,expected", [
    ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
    ('{"a": [1, 2,], }', {"a": [1, 2]}),
    ('{"a": "he said "no" twice", "b": 1}', {"a": 'he said "no" twice', "b": 1}),
    ('text {"entities": [{"name": "x"}, {"name": "y"', {"entities": [{"name": "x"}]}),
    ('{"a": [1, 2], "b": "cut of', {"a": [1, 2], "b": "cut of"}),
    ('{"broken": nope, "entities": [{"name": "x"}]}', {"entities": [{"name": "x"}]}),
    ("no object here", None),
])
def test_repair(reply, expected):
    fixed = repair(reply)
    assert (json.loads(fixed) if fixed else None) == expected


def test_salvage_statuses(spark):
    rows = ['{"a": 1}', 'so: {"a": 2} end', '{"a": 3,}', "none", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, raw string")
    got = [(r.status, r.parsed.a if r.parsed else None) for r in salvage_json(df, "raw", "a int").orderBy("id").collect()]
    assert got == [("direct", 1), ("braces", 2), ("repaired", 3), ("failed", None), ("failed", None)]


def test_summary_block(spark):
    df = spark.createDataFrame([("<analysis>x</analysis>\n<summary>\n{\"a\": 1}\n</summary>",), ("plain",)], "t string")
    assert [r[0] for r in df.select(X.tagged_block(F.col("t"))).collect()] == ['{"a": 1}', "plain"]


def test_model_failures_are_rows(spark):
    def client():
        def call(rows):
            if any(r["id"] == 3 for r in rows):
                raise RuntimeError("limit")
            return [{"label": f"v{r['id']}"} for r in rows]
        return call

    df = spark.range(6).coalesce(1)
    got = {r.id: (r.label, r.error) for r in models.map_model(df, client, "label string", "id", batch=2).collect()}
    assert got[0] == ("v0", None) and got[2] == (None, "RuntimeError: limit") and got[5] == ("v5", None)


# ---------------------------------------------------------------- context


def test_passages_are_cut_noted_or_dropped(spark):
    rows = [("cut", 1, "x" * 900), ("cut", 2, "y" * 2000), ("cut", 3, "z"), ("drop", 1, "x" * 1150), ("drop", 2, "y" * 900)]
    df = spark.createDataFrame(rows, "question_id string, place int, full_text string").select(
        "*", F.lit("T").alias("title"), F.lit("").alias("section_title"), F.lit(0.5).alias("score"), F.lit("").alias("source_url"))
    got = {r.question_id: r for r in context.pack_passages(df, budget=320).collect()}
    assert got["cut"].taken == 2 and got["cut"].text_context.count("... [truncated]") == 1
    assert got["drop"].taken == 1 and "truncated" not in got["drop"].text_context
    full = spark.createDataFrame([("q", i, "x" * 400) for i in (1, 2, 3)], "question_id string, place int, full_text string").select(
        "*", F.lit("T" * 30).alias("title"), F.lit("").alias("section_title"), F.lit(0.5).alias("score"), F.lit("").alias("source_url"))
    assert "[2 more passages truncated due to token limit]" in context.pack_passages(full, budget=100).first().text_context


def test_path_block_counts_towards_the_graph_budget(spark):
    ranked = spark.createDataFrame([("q", 0, "E", "T", None, "outgoing", "R", f"o{i}", None, i) for i in range(1, 6)],
                                   "question_id string, entity_no int, entity string, entity_type string, description string, direction string, relation string, other string, evidence string, place int")
    block = spark.createDataFrame([("q", "p" * 80)], "question_id string, path_text string")
    assert context.pack_graph_context(ranked, budget=25).count() > context.pack_graph_context(ranked, block, budget=25).count() > 0
    assert context.pack_graph_context(ranked, block, budget=20).count() == 0


def test_entity_without_relations_keeps_its_header(spark):
    nodes = spark.createDataFrame([("Lone", "T", "alone"), ("A", "T", ""), ("B", "T", "")], "name string, type string, description string")
    edges = spark.createDataFrame([("A", "KNOWS", "B", None)], "head string, relation string, tail string, evidence string")
    asked = spark.createDataFrame([("q", ["lone", "A"])], "question_id string, entities array<string>")
    around = graph.neighbors_many(asked, nodes, edges)
    lines = context.pack_graph_context(graph.rank_relations(around, asked), around=around).orderBy("entity_no", "line_no").collect()
    assert [r.line for r in lines] == ["\n### Lone (T)\nalone", "\n### A (T)", "  • A —[KNOWS]→ B"]


def test_filters_read_whole_texts(spark):
    late = "x " * 3000 + "needle"
    entries = spark.createDataFrame([(1, "q", late), (2, "q", "x")], "id long, question string, answer string")
    assert [r.id for r in filtering.search_answers(entries, "Needle").collect()] == [1]
    assert filtering.search_answers(entries, "Needle", head=400).count() == 0
    docs = entries.select("id", F.array(F.lit("r")).alias("regions"), F.array(F.lit("c")).alias("categories"), F.lit("t").alias("title"), F.col("answer").alias("content"))
    assert [r.id for r in filtering.topic_filter(docs, ["needle"], "none").collect()] == [1]
    assert filtering.topic_filter(docs, ["needle"], "none", head_chars=2000).count() == 0


# ---------------------------------------------------------------- sources and sinks


def test_jsonl_modes(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n{bad\n')
    assert readers.read_jsonl(spark, str(path), "a int", "DROPMALFORMED").count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), "a int").collect()


def test_mixed_json(spark, tmp_path):
    (tmp_path / "talk_npc_EN.jsonl").write_text('{"id": 1}\n[{"t": "x"}]\n3\nbad\n')
    (tmp_path / "quest_CHS.jsonl").write_text('{"q": {"n": 2}}\n')
    rows = readers.read_mixed_json(spark, [str(tmp_path / "talk_npc_EN.jsonl"), str(tmp_path / "quest_CHS.jsonl")])
    got = sorted((r.source_type, r.language, r.j) for r in rows.select("*", F.to_json("data").alias("j")).collect())
    assert got == [("quest", "CHS", '{"q":{"n":2}}'), ("talk_npc", "EN", '{"id":1}'), ("talk_npc", "EN", '{"turns":[{"t":"x"}]}')]


def test_publish_append_and_summary(spark, tables, tmp_path):
    manifest = writers.publish(tables.nation.repartition(2), str(tmp_path / "pub"), "2024-01-01").collect()
    assert sum(r.rows for r in manifest) == 25 and all(len(r.sha256) == 64 and r.bytes > 0 for r in manifest)
    done = str(tmp_path / "done")
    writers.append_done(tables.nation.filter("n_nationkey < 3"), done)
    left = reports.pending(tables.nation, spark.read.parquet(done), ["n_nationkey"])
    writers.append_done(left, done)
    assert spark.read.parquet(done).count() == 25
    writers.write_summary_csv(spark.createDataFrame([("b", 0.5), ("a", 0.25)], "config string, overall double"), str(tmp_path / "csv"), ["config", "overall"])
    lines = [p.read_text() for p in (tmp_path / "csv").glob("part*.csv")]
    assert lines == ["config,overall\na,0.25\nb,0.5\n"]


def test_constants_hold_their_counts():
    assert len(C.TOPIC_KEYWORDS) == 61 and len(C.ENTITY_TYPE_RULES) == 21 and len(C.REGION_KEYWORDS) == 12
    assert len(C.TITLE_ALIASES) == 9 and len(C.ALIAS_PATTERNS) == 12 and len(C.VALID_RELATIONS) == 21


def test_frequent_words_meet_the_dictionary_once_per_block(spark):
    texts = spark.createDataFrame([(i, "the red fox " * 500) for i in range(200)], "text_id long, text string")
    names = spark.createDataFrame([("Red",), ("red fox",), ("The",)], "name string")
    found = mentions.find_mentions(texts, names)
    assert sorted((r.name, r.start, r.n) for r in found.groupBy("name", "start").agg(F.count(F.lit(1)).alias("n")).collect()) == [("The", 0, 200), ("red fox", 4, 200)]
    joined, join = [], texts.__class__.join

    def counted(self, other, *more):
        if {"block", "core"} <= set(self.columns):
            joined.append(self.count())
        return join(self, other, *more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(texts.__class__, "join", counted)
        mentions.find_mentions(texts, names)
    blocks = spark.sparkContext.defaultParallelism
    assert joined and joined[0] <= 3 * blocks


def test_mention_plans_agree(spark, tables):
    texts = tables.documents.select(F.col("doc_id").alias("text_id"), "text")
    words = tables.benchmark.select(F.split("text", " ").alias("w"))
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    words = words.select(F.explode(F.concat("w", pairs)).alias("name")).filter("name <> ''").distinct()
    shared = mentions.find_mentions(texts, words, share=True)
    joined = mentions.find_mentions(texts, words)
    assert shared.count() > 0
    assert shared.exceptAll(joined).count() == 0 and joined.exceptAll(shared).count() == 0
    names = {}
    for row in sorted(r[0] for r in words.collect()):
        names.setdefault(row.lower(), row)
    for row in texts.orderBy(F.length("text")).limit(25).collect():
        got = {r.name.lower(): r.start for r in shared.filter(F.col("text_id") == row.text_id).collect()}
        assert got == {k.lower(): v for k, v in brute_mentions(row.text, list(names.values())).items()}


def test_mentions_with_a_large_dictionary(spark):
    """A hundred thousand names of one to four words, many with the same first word; punctuation, other scripts and overlaps."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["the", "von", "日本", "é'a", "n-1"]
    names = {" ".join(rng.choice(["the", rng.choice(words)]) if k == 0 else rng.choice(words) for k in range(rng.randrange(1, 5))) for _ in range(100_000)}
    names |= {"(The) Red.", "O'Neil", "W1 W2"}
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)] + ["I met (the) red. and o'neil; w1 w2 w3", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    table = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = {}
    for r in mentions.find_mentions(df, table).collect():
        got.setdefault(r.text_id, {})[r.name] = r.start
    low = {}
    for n in sorted(names):
        low.setdefault(n.lower(), n)
    kept = list(low.values())
    assert got == {i: found for i, t in enumerate(texts) if t and (found := brute_mentions(t, [n for n in kept if n.lower() in t.lower()]))}


@pytest.mark.parametrize("slot", [600, 86_400, 10**9])
def test_sessions_do_not_depend_on_slots(spark, tables, slot):
    busy = tables.events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))
    key = ["user_id", "event_id", "session_no"]
    expected = conversations.sessionize(busy, slot_seconds=10**10).select(key)
    assert conversations.sessionize(busy, slot_seconds=slot).select(key).exceptAll(expected).count() == 0
    streaks = conversations.failure_streaks(busy, slot_seconds=slot)
    assert streaks.exceptAll(conversations.failure_streaks(busy, slot_seconds=10**10)).count() == 0


def test_passage_scores_from_figures_equal_the_direct_score(spark):
    texts = spark.createDataFrame([(1, "T Ada", "", "ada met Ada, an ally and enemy of Bo."), (2, "X", "On bo", "It is a tale."), (3, "X", "", "")],
                                  "item_id long, title string, section_title string, full_text string")
    asked = spark.createDataFrame([("q", ["Ada", "bo"], "RELATIONSHIP"), ("r", ["Bo"], "FACTUAL")], "question_id string, entities array<string>, query_type string")
    found = asked.select("question_id").join(texts.select("item_id"), F.lit(True)).withColumn("score", F.col("item_id") * 0.4).withColumn("rank", F.col("item_id"))
    got = context.rerank_passages(found, texts, asked).select("question_id", "item_id", "rerank_score")
    direct = found.join(texts, "item_id").join(asked, "question_id").select("question_id", "item_id", scoring.passage_score(
        F.col("score"), F.col("full_text"), F.col("title"), F.col("section_title"), F.col("entities"), F.col("query_type")).alias("rerank_score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, direct.collect()))


def test_whole_retrieval_reads_the_whole_graph(tables, monkeypatch):
    from corpusloom.plans import retrieval_queries
    from corpusloom.plans.retrieve import RetrievalConfig

    class Seen(Exception):
        pass

    def look(asked, stores, config):
        raise Seen(stores, config)

    monkeypatch.setattr(retrieval_queries, "retrieve", look)
    with pytest.raises(Seen) as seen:
        retrieval_queries.d08(tables)
    stores, config = seen.value.args
    assert config == RetrievalConfig() and stores.edges.count() == tables.kg_edges.count() > tables.core_edges.count()


def test_retrieval_of_many_questions_is_that_of_each(spark):
    """A small graph: the context of each question is the same alone and among others, and holds the shortest path and the best texts."""
    from corpusloom.plans.retrieve import Stores, retrieve

    links = [("Ada", "ALLY_OF", "Bo"), ("Bo", "LOCATED_IN", "Town"), ("Cy", "LOCATED_IN", "Town"), ("Cy", "ENEMY_OF", "Di"), ("Ada", "KNOWS_OF", "Ed"), ("Ed", "KNOWS_OF", "Di")]
    nodes = spark.createDataFrame([(n, "Character", f"{n} is told of") for n in ("Ada", "Bo", "Cy", "Di", "Ed")] + [("Town", "Location", None)], "name string, type string, description string")
    edges = spark.createDataFrame([(*e, "seen") for e in links], "head string, relation string, tail string, evidence string")
    vectors = [[1.0, 0.1 * i, 0.0] for i in range(6)]
    items = [(i, i, f"Page {i}", "", f"https://h/{i}", f"Text {i} about " + ("Ada" if i % 2 else "Town")) for i in range(6)]
    stores = Stores(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "item_id long, embedding array<double>"),
                    spark.createDataFrame(items, "item_id long, doc_id long, title string, section_title string, source_url string, full_text string"), nodes, edges)
    asked = [("q1", "What is the relationship between Ada and Di?", ["Ada", "Di"], vectors[1]), ("q2", "Who is Bo?", ["Bo"], vectors[4])]
    schema = "question_id string, question string, entities array<string>, embedding array<double>"
    together = {r.question_id: r for r in retrieve(spark.createDataFrame(asked, schema), stores).collect()}
    alone = retrieve(spark.createDataFrame(asked[:1], schema), stores).collect()
    assert set(together) == {"q1", "q2"} and together["q1"] == alone[0]
    text = together["q1"].full_context
    assert "  1. Ada -[KNOWS_OF]-> Ed\n  2. Ed -[KNOWS_OF]-> Di" in text and "## Connection Path" not in together["q2"].full_context
    assert all(f"Text {i} about" in text for i in range(6)) and "Bo —[LOCATED_IN]→ Town" in together["q2"].full_context


def test_relevance_shows_the_stored_number(spark):
    rows = [("q", i + 1, x, "T", "", "", "body") for i, x in enumerate([0.565, 0.125, 0.135, 0.375])]
    passages = spark.createDataFrame(rows, "question_id string, place int, score double, title string, section_title string, source_url string, full_text string")
    text = context.pack_passages(passages).first().text_context
    assert re.findall(r"relevance: (.*?)[)]", text) == ["0.56", "0.12", "0.14", "0.38"]


def test_ring_query_does_not_give_a_hub_to_each_question(tables, monkeypatch):
    from corpusloom.plans import graph_queries

    monkeypatch.setattr(graph, "neighbors", None)  # with a bound as large as the graph it gives each question all edges of its hub
    assert graph_queries.j14(tables).count() > 0


def test_rows_of_questions_are_never_sent_whole(spark, tmp_path):
    """A question takes a few bytes in a file, so Spark took a million of them for a side that is small enough to share."""
    from corpusloom.operators import context, graph

    asked = spark.range(50_000).selectExpr("cast(id as string) question_id", "array('a') entities", "'FACTUAL' query_type")
    asked.write.parquet(f"{tmp_path}/asked")
    asked = spark.read.parquet(f"{tmp_path}/asked")
    around = asked.selectExpr("question_id", "0 entity_no", "'a' entity", "'T' entity_type", "'d' description", "'outgoing' direction",
                              "'b' other", "'T' other_type", "'R' relation", "'e' evidence", "1 rank")
    ranked = graph.rank_relations(around, asked)
    texts = asked.selectExpr("question_id", "'x' text_context", "'y' graph_context", "'z' path_text", "1 place", "1 doc_id", "1D score", "1 path_rank", "array('s') path_steps")
    plans = [ranked, context.pack_graph_context(ranked, texts), context.hybrid_rows(texts, ranked, texts, asked), context.assemble_context(asked, texts, texts)]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_relations_worked_out_per_entity_list(spark):
    from corpusloom.operators import context, graph
    from corpusloom.tables import beside

    nodes = spark.createDataFrame([(n, "T", f"text {n}") for n in "ABCD"], "name string, type string, description string")
    edges = spark.createDataFrame([("A", "R", "B", "x"), ("B", "S", "C", None), ("C", "R", "A", "")], "head string, relation string, tail string, evidence string")
    rows = [("1", ["a", "B"]), ("2", ["a", "B"]), ("3", ["B", "a"]), ("4", ["nobody"]), ("5", ["D"]), ("6", None), ("7", [])]
    asked = spark.createDataFrame(rows, "question_id string, entities array<string>")
    around = graph.neighbors_many(asked, nodes, edges)
    lists = graph.entity_lists(asked)
    shared = graph.neighbors_many(lists, nodes, edges, key="entities")
    ranked, once = graph.rank_relations(around, asked), graph.rank_relations(shared, lists, key="entities")
    keys = ["question_id", "entity_no", "direction", "relation", "other", "score", "place"]
    assert sorted(graph.per_question(once, asked).select(keys).collect()) == sorted(ranked.select(keys).collect())
    path = spark.createDataFrame([("1", "p" * 40), ("4", "only a path")], "question_id string, path_text string")
    budget = 20
    before = context.graph_text(context.pack_graph_context(ranked, path, budget, around=around), path)
    after = context.shared_graph_text(context.pack_graph_context(once, None, budget, key="entities", around=shared), asked, path, budget)
    assert sorted(after.select("question_id", "graph_context").collect()) == sorted(before.select("question_id", "graph_context").collect())
    assert beside(asked, 7)._jdf.queryExecution().analyzed().toString().count("broadcast") == 1
    assert beside(asked, 6)._jdf.queryExecution().analyzed().toString().count("broadcast") == 0


def test_long_passages_are_cut_as_before(spark):
    from corpusloom.operators import context

    rows = [(1, i, "t", "", 0.5, "", "w" * n) for i, n in enumerate([30, 9000, 50], 1)]
    df = spark.createDataFrame(rows, "question_id int, place int, title string, section_title string, score double, source_url string, full_text string")
    got = context.pack_passages(df, budget=200).first()
    assert (got.taken, got.offered) == (2, 3) and got.text_context.endswith(context.TRUNCATED)
    whole = context.pack_passages(df, budget=5000).first()
    assert whole.taken == 3 and "w" * 9000 in whole.text_context


def test_tables_that_are_small_only_as_files_are_not_sent_whole(spark):
    from corpusloom.session import written

    rows = written(spark.range(500_000).select(F.format_string("Customer#%09d", "id").alias("name")))
    joined = rows.join(written(rows.withColumnRenamed("name", "other")), F.col("name") == F.col("other"))
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    few = written(spark.range(5).select(F.format_string("Customer#%09d", "id").alias("other")))
    assert "BroadcastHashJoin" in rows.join(few, F.col("name") == F.col("other"))._jdf.queryExecution().executedPlan().toString()


def test_tables_of_which_a_row_makes_many_are_dealt_by_rows(spark, tables):
    from corpusloom.tables import Tables

    part = Tables(spark, tables.folder, spread_out=True, rows=5).part
    assert part.rdd.getNumPartitions() >= part.count() / 5 > spark.sparkContext.defaultParallelism


def test_python_workers_are_given_texts_by_bytes(spark):
    import pyarrow as pa

    from conftest import DATA
    from corpusloom.session import BATCH_BYTES
    from corpusloom.tables import Tables

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "67108864")
    Tables(spark, DATA)
    docs = spark.range(4000).selectExpr("id", "repeat('text ', 1000) text").coalesce(1)
    sizes = [r[0] for r in docs.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * BATCH_BYTES
    spark.conf.set(name, "1000")  # a smaller bound of the session stays
    Tables(spark, DATA)
    assert spark.conf.get(name).removesuffix("b") == "1000"
    spark.conf.unset(name)


def test_scores_and_last_runs_are_dealt_by_questions(spark, tables, monkeypatch):
    from corpusloom import tables as T
    from corpusloom.plans import evaluation_queries as E

    monkeypatch.setattr(T, "DEALT_ROWS", 4)
    asked = tables.questions.count()
    wanted = -(-asked // 4)
    assert wanted > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (E.w03(tables), E._scores(tables)):
        tasks = made.select("question_id", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count_distinct("question_id").alias("n")).collect()
        assert len(tasks) > wanted // 2 and sum(r.n for r in tasks) == asked  # a question is in one task
        assert max(r.n for r in tasks) < 20


def test_tasks_of_the_sign_codes_stay_even_with_many_slots(tables, monkeypatch):
    met, meet = [], similarity._meet

    def seen(left, right, keys, *rest, **more):
        met.extend((left.groupBy(*keys).count(), right.groupBy(*keys).count()))
        return meet(left, right, keys, *rest, **more)

    monkeypatch.setattr(similarity, "_meet", seen)
    n = tables.embeddings.count()
    few, most = max(2, n // 32), max(4, n // 20)
    similarity.vector_topk_approx(tables.cache_lookups, tables.embeddings, 8, item_id="vec_id", rows_per_task=few, query_rows=most)
    asked, held = (one(sizes.agg(F.max("count"))) for sizes in met)
    assert held <= 2 * few and asked <= 2 * most


def _shuffle_files(spark):
    """Files of shuffles that this session's disk holds."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_shares_leave_no_shuffle(spark):
    """A table made in shares, of rows that each share deals, holds all keys, null too; files of shuffles go with the share that made them."""
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), "id")
    before = _shuffle_files(spark)
    out = in_shares(spark, "k", 3, lambda cut: cut(rows).groupBy("k").agg(F.sum("id").alias("n")))
    left = _shuffle_files(spark) - before
    for _ in range(50):  # Spark removes them in the background
        left = left and _shuffle_files(spark) & left
        if left:
            time.sleep(0.2)
    assert not left
    assert sorted(map(tuple, out.fillna("none").collect())) == sorted(map(tuple, rows.groupBy("k").agg(F.sum("id")).fillna("none").collect()))


def test_passages_are_packed_in_shares(spark, tables, monkeypatch):
    """Digests of all contexts are the same in one share and in many; texts are brought to no more questions at a time than fill a share."""
    from corpusloom.plans import retrieval_queries

    shares = []

    def counted(spark, key, n, make):
        shares.append(n)
        return in_shares(spark, key, n, make)

    monkeypatch.setattr(retrieval_queries, "in_shares", counted)
    whole = retrieval_queries.w08(tables).collect()
    monkeypatch.setattr(context, "SHARE_CHARS", 1)
    parts = retrieval_queries.w08(tables)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole)) and shares[0] == 1 and shares[1] > 2


def test_texts_are_counted_for_shares(spark, monkeypatch):
    """As much text as the questions are shown, with what else comes, by as much as all texts have; ids twice, unknown or null."""
    monkeypatch.setattr(context, "SHARE_CHARS", 10)
    texts = spark.createDataFrame([(1, "x" * 30), (2, "y" * 10), (2, "z" * 10), (3, None), (None, "w" * 50)], "item_id long, full_text string")
    found = spark.createDataFrame([("q", i) for i in [1] * 10 + [2] * 5 + [3, 4, None]], "question_id string, item_id long")
    assert context.text_shares(found, texts) == 4 and context.text_shares(found, texts, more=100) == 5
    assert context.text_shares(found, texts, budget=1) == math.ceil((10 * 8 + 5 * 2 * 8) / 100)
    assert context.text_shares(found.limit(0), texts) == context.text_shares(found, texts.limit(0)) == 1


def test_contexts_are_made_in_shares(spark, tables, monkeypatch):
    """Retrieval for a caller who keeps digests makes the contexts in several shares, the same as all at once."""
    from corpusloom.plans import retrieval_queries, retrieve

    shares = []

    def counted(spark, key, n, make):
        shares.append(n)
        return in_shares(spark, key, n, make)

    monkeypatch.setattr(retrieve, "in_shares", counted)
    monkeypatch.setattr(context, "SHARE_CHARS", 1 << 18)
    parts = retrieval_queries.d08(tables)
    whole = {}

    def look(asked, stores, config):
        whole["rows"] = config.keep(retrieve.retrieve(asked, stores, retrieve.RetrievalConfig()))
        return whole["rows"]

    monkeypatch.setattr(retrieval_queries, "retrieve", look)
    retrieval_queries.d08(tables)
    assert shares[0] > 1 and len(shares) == 1
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole["rows"].collect()))
