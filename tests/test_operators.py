"""Operators that SQL does not express, and the edges of those that it does."""

from __future__ import annotations

import hashlib
import json
import random
import uuid
from collections import deque
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions import text as X
from quillspark.operators import chunking, entities, graph, metadata, retrieval, subtitles, video, web
from quillspark.sources import tables
from quillspark.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


# --- text ---------------------------------------------------------------------------------------

def truncated(text, limit):
    if len(text) <= limit:
        return text
    part = text[:limit]
    words = part.rsplit(maxsplit=1)
    return (words[0] if words and words[0] else part) if part.strip() else part


def test_truncate_like_python(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab  \t\nü") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = [r.x for r in spark.createDataFrame([(x,) for x in rows], "t string").select(X.truncate_for_embedding(F.col("t"), 20).alias("x")).collect()]
    assert got == [truncated(x, 20) for x in rows]


@pytest.mark.parametrize(("raw", "want"), [('"**A** title"', "A title"), ("Title: `x` [link](http://a)", "x link"), ("### a   b", "a b"), ("", "Untitled"), (None, "Untitled"), ("snake_case_name", "snakecasename"), ("y" * 80, "y" * 60)])
def test_titles(spark, raw, want):
    assert one(spark, X.clean_title(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "reasoning", "caption"), [
    ("<think>why</think> so <answer>it is</answer>", "why", "so it is"),
    ("why</think>it", "why", "it"),
    ("it<think>why", "why", "it"),
    ("a</think>b<think>c", "c", "ab"),
    ("plain", "", None),
    ("<think>x</think>", "x", ""),
])
def test_think_blocks(spark, raw, reasoning, caption):
    got = one(spark, X.think_block(F.col("t")), t=raw)
    assert (got["reasoning"], got["caption"]) == (reasoning, caption)


def test_translations(spark):
    assert one(spark, X.clean_translation(F.col("t")), t="We need to translate this.\nTranslation: Bonjour le monde.") == "Bonjour le monde"
    assert one(spark, X.clean_translation(F.col("t"), srt=True), t="Translation:\n1\n00:00:00,000 --> 00:00:01,000\nHallo") == "1\n00:00:00,000 --> 00:00:01,000\nHallo"
    assert one(spark, X.clean_translation(F.col("t")), t="Hola") == "Hola"


def test_replies_captions_and_sentences(spark):
    assert one(spark, X.segment_replies(F.col("t")), t="[a]: one\ntwo\n[b]: three\n[a]: four") == {"a": "four", "b": "three"}
    assert one(spark, X.salvaged_caption(F.col("t")), t='{"caption": "a \\"b\\" c') == 'a "b" c'
    assert one(spark, X.drop_repeated_sentences(F.col("t")), t="A sentence of some length. No. A sentence  of some LENGTH. No.") == "A sentence of some length. No. No."
    assert one(spark, X.text_type(F.col("t")), t="Section_Header") == "header"
    assert one(spark, X.is_chat_model(F.col("t")), t="bge-large") is False
    assert one(spark, X.fill_template("to {lang} {other}", {"lang": F.lit("fr")}), t="") == "to {lang} {other}"
    assert one(spark, X.fill_template("to {lang}", {"lang": F.lit("fr")}), t="") == "to fr"
    assert one(spark, X.file_extension(F.col("t")), t="a.B.PDF") == "pdf"


# --- chunks -------------------------------------------------------------------------------------

def test_recursive_chunks_hold_all_words():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "x", ". ", "\n", "\n\n"]) for _ in range(rng.randint(0, 900)))
        parts = chunking.split_recursively(text, 100, 20)
        assert all(0 < len(p) <= 100 and p == p.strip() for p in parts)
        joined = "".join("".join(parts).split())
        assert len(joined) >= len("".join(text.split())) - 2 * len(parts)
    assert chunking.split_recursively("a" * 1001) == ["a" * 1000, "a"]
    assert chunking.split_recursively("a" * 1000) == ["a" * 1000] and chunking.split_recursively(" \n ") == []


def test_chunk_kinds(spark):
    text = spark.createDataFrame([(1, 0, "text", "t0"), (1, 1, "text", "t1")], "doc_id long, chunk_index int, content_type string, content string")
    table = spark.createDataFrame([(1, 0, "structured", "|a|")], "doc_id long, chunk_index int, content_type string, table_content string")
    rows = chunking.renumbered([text, table]).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.content_type, r.total_chunks) for r in rows] == [(0, "text", 3), (1, "text", 3), (2, "structured", 3)]
    assert chunking.kind_counts(chunking.renumbered([text, table])).first().summary == "2 text, 1 structured"


# --- numbers ------------------------------------------------------------------------------------

def test_times_hashes_and_boxes(spark):
    assert one(spark, N.srt_time(F.col("s")), s=3661.0005) in ("01:01:01,000", "01:01:01,001")
    assert one(spark, N.srt_time(F.col("s")), s=-3.0) == "00:00:00,000"
    assert one(spark, N.uuid5(F.col("s")), s="chunk-7") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "chunk-7"))
    times = one(spark, N.biased_times(F.col("a"), F.col("b"), 6), a=0.0, b=4.0)
    assert len(times) == 6 and times == sorted(times) and 0 <= times[0] and times[-1] <= 4
    assert one(spark, N.biased_times(F.col("a"), F.col("b"), 5), a=3.0, b=3.0) == []
    want = hashlib.sha256(b"v|0.000000|4.000000|biased|10|m|p").hexdigest()
    assert one(spark, N.chunk_hash(F.col("v"), F.col("a"), F.col("b"), F.lit("biased"), F.lit(10), F.lit("m"), F.lit("p")), v="v", a=0.0, b=4.0) == want
    assert one(spark, N.scaled_font(F.lit(12.0), F.col("o"), F.col("n"), "docx"), o="abcd", n="abcdefgh") == 8.0
    assert one(spark, N.scaled_font(F.lit(12.0), F.col("o"), F.col("n"), "docx"), o="abcd", n="abcde") == 12.0


# --- entities and graphs -------------------------------------------------------------------------

def test_entity_patterns(spark):
    text = "Dr. Jane Doe of Acme Corp met John Smith in Paris, TX on 12/31/2024 for $1,200.50 at NASA. john smith"
    found = {(r.name, r.entity_type) for r in entities.entities(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert {("john smith", "person"), ("acme corp", "organization"), ("paris, tx", "location"), ("12/31/2024", "date"), ("$1,200.50", "number"), ("nasa", "acronym")} <= found


def greedy(rows, same_from=0.85):
    """The rule as a plain loop over (name, type, seq) in order: the canonical name of the most similar name before."""
    out = {}
    for name, kind, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if (name, kind) in out:
            continue
        best, ratio = name, 0
        for (other, other_kind), canon in out.items():
            r = SequenceMatcher(None, name, other).ratio() if kind == other_kind else 0
            if r >= same_from and r > ratio:
                best, ratio = canon, r
        out[name, kind] = best
    return out


def names_like(rng, base, n, alphabet="abcxyz"):
    rows = []
    for i in range(n):
        name = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(name))
            name[at:at + rng.choice([0, 1, 1])] = rng.choice(alphabet)
        rows.append(("".join(name), rng.choice(["person", "place"]), i // 2))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_canonical_names_equal_a_plain_loop(spark, seed):
    """Chains of ever less similar names, ties in order, short and repeated names."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 30))) for _ in range(12)] + ["ab", "a", "supplier#000000001", "supplier#000000020"]
    rows = names_like(rng, base, 160)
    got = entities.canonical(spark.createDataFrame(rows, "name string, entity_type string, seq long")).collect()
    want = greedy(rows)
    assert len(got) == len(rows) and all(r.canonical == want[r.name, r.entity_type] for r in got)
    assert any(want[k] != k[0] for k in want)


def test_similar_names_share_pairs():
    """The bound that candidates are found by, beside the ratios of random names."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 24))) for _ in range(60)]
    names = sorted({r[0] for r in names_like(rng, base, 500, "abcd")})
    met = 0
    for a in names:
        for b in names:
            for ratio in (0.85, 0.89, 0.94):
                if a != b and SequenceMatcher(None, a, b).ratio() >= ratio:
                    common = len(set(entities._pairs_of(a)) & set(entities._pairs_of(b)))
                    assert common >= entities.shared_pairs(len(a), len(b), ratio) >= len(a) - entities.prefix_size(len(a), ratio)
                    met += 1
    assert met > 500
    with pytest.raises(ValueError):
        entities.prefix_size(5, 0.6)


@pytest.mark.parametrize("kind", ["counted", "drawn", "mixed"])
def test_names_of_nearly_the_same_characters(spark, kind):
    """Numbered names in disorder: every one has many that are nearly the same, or few, or of other lengths too."""
    rng = random.Random(kind)
    number = {"counted": lambda i: f"{i:09}", "drawn": lambda i: f"{rng.randrange(10 ** 4):09}"[::-1], "mixed": lambda i: str(rng.randrange(10 ** rng.randint(1, 9)))}[kind]
    names = list({f"supplier#{number(i)}" for i in range(300)})
    rows = [(name, "organization", rng.randrange(250)) for name in names] + [(None, "organization", 1), ("", "organization", 2)]
    got = {r.name: r.canonical for r in entities.canonical(spark.createDataFrame(rows, "name string, entity_type string, seq long")).collect()}
    want = greedy([r for r in rows if r[0] is not None])
    assert got == {n: want[n, "organization"] for n in [*names, ""]} | {None: None}


def test_ratios_fall_in_one_step_of_changes():
    """Every ratio from 0.85 on that two different names can have, by their lengths."""
    lengths = list(range(4, 40))
    steps = [entities.near_lengths(lengths, k, 0.85) for k in range(1, 4)]
    for n in lengths:
        for m in lengths:
            for size in range(1, min(n, m) + 1):
                hit = [k for k, x in enumerate(steps, 1) if m in x[n] and x[n][m][0] <= size <= x[n][m][1]]
                near = [k for k in range(1, 4) if 2 * size * n >= (n - k) * (n + m)]
                assert hit == (near[:1] if size * 2.0 / (n + m) >= 0.85 and size < max(n, m) and n > near[0] else []) if near else not hit


def test_many_numbered_names_are_not_compared_with_all_before(spark, monkeypatch):
    pairs, compared = spark.sparkContext.accumulator(0), entities._compared

    def counted(frames):
        for f in frames:
            pairs.add(len(f))
            yield from compared([f])

    monkeypatch.setattr(entities, "_compared", counted)
    n = 3000
    names = spark.range(n).select(F.format_string("supplier#%09d", "id").alias("name"), F.lit("organization").alias("entity_type"), F.col("id").alias("seq"))
    assert {r.canonical for r in entities.canonical(names).collect()} == {"supplier#000000000"}
    assert pairs.value < 20 * n


def test_greedy_names(spark):
    rows = [("acme corporation", "organization", 0), ("acme corporatio", "organization", 1), ("other", "organization", 2), ("acme corporation", "person", 3)]
    got = {(r.name, r.entity_type): r.canonical for r in entities.canonical(spark.createDataFrame(rows, "name string, entity_type string, seq long")).collect()}
    assert got == {("acme corporation", "organization"): "acme corporation", ("acme corporatio", "organization"): "acme corporation", ("other", "organization"): "other", ("acme corporation", "person"): "acme corporation"}


EDGES = [("a", "b", 3), ("b", "c", 1), ("c", "d", 2), ("a", "d", 1), ("d", "e", 5), ("x", "y", 1)]


def paths_between(edges):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, count = {}, {}
    for s in near:
        d, c, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            u = todo.popleft()
            for v in near[u]:
                if v not in d:
                    d[v], c[v] = d[u] + 1, 0
                    todo.append(v)
                if d[v] == d[u] + 1:
                    c[v] += c[u]
        dist[s], count[s] = d, c
    return near, dist, count


def path_of(spark, edges, sources, targets, **options):
    nodes = lambda x: spark.createDataFrame([(v,) for v in x], "node string")
    row = graph.shortest_path(edges, nodes(sources), nodes(targets), **options).first()
    return row and row.path


def test_graph_measures(spark, monkeypatch):
    df = spark.createDataFrame(EDGES, "src string, dst string, weight long")
    near, dist, count = paths_between(EDGES)
    assert {r.node: r.component for r in graph.components(df).collect()} == {n: min(dist[n]) for n in near}
    between = dict.fromkeys(near, 0.0)
    for s, t in combinations(sorted(near), 2):
        if t in dist[s]:
            for v in near:
                if v not in (s, t) and v in dist[s] and dist[s][v] + dist[v].get(t, 99) == dist[s][t]:
                    between[v] += count[s][v] * count[v][t] / count[s][t]
    n = len(near)
    assert {r.node: r.betweenness for r in graph.betweenness(df, normalised=False).collect()} == pytest.approx(between)
    assert {r.node: r.betweenness for r in graph.betweenness(df).collect()} == pytest.approx({v: b * 2 / (n - 1) / (n - 2) for v, b in between.items()}, abs=1e-8)
    assert {r.node: (r.degree, r.centrality) for r in graph.degrees(df).collect()} == {v: (len(w), len(w) / (n - 1)) for v, w in near.items()}
    monkeypatch.setattr(graph, "HELD_EDGES", 0)  # the way by joins
    assert {r.node: r.betweenness for r in graph.betweenness(df, normalised=False).collect()} == pytest.approx(between)
    close = {v: (len(d) - 1) ** 2 / (n - 1) / sum(d.values()) for v, d in dist.items()}
    assert {r.node: r.closeness for r in graph.closeness(df).collect()} == pytest.approx(close)
    assert path_of(spark, df, ["a"], ["e"], directed=False) == ["a", "d", "e"]
    assert path_of(spark, df, ["a"], ["a", "e"]) == ["a"] and path_of(spark, df, ["a"], ["x"]) is None
    assert path_of(spark, df, ["a", "c"], ["e", "d"]) == ["a", "d"]
    assert [(r.node, r.weight) for r in graph.related(df, "d").collect()] == [("e", 5), ("c", 2), ("a", 1)]
    assert [(r.node, r.weight) for r in graph.related(df, "d", directed=True).collect()] == [("e", 5)]
    label = {r.node: r.community for r in graph.communities(df).collect()}
    assert set(label) == set(near) and all(label[v] in dist[v] for v in near)


def betweenness_of(near, dist, count):
    """By all pairs of nodes."""
    between = dict.fromkeys(near, 0.0)
    for s, t in combinations(sorted(near), 2):
        for v in dist[s] if t in dist[s] else ():
            if v not in (s, t) and dist[s][v] + dist[v][t] == dist[s][t]:
                between[v] += count[s][v] * count[v][t] / count[s][t]
    return between


@pytest.mark.parametrize("held", [True, False])
def test_betweenness_with_trees_folded(spark, monkeypatch, held):
    """Trees on trees, hanging on rings and by themselves, a pair of nodes, a doubled edge and a loop."""
    rng = random.Random(2)
    edges = [("v0", "v1", 1), ("v1", "v2", 1), ("v2", "v3", 1), ("v3", "v0", 1), ("v2", "v0", 1), ("v1", "v0", 1), ("v1", "v1", 1), ("p", "q", 1), ("w0", "w1", 1)]
    edges += [(f"v{i}", f"v{rng.randrange(i)}", 1) for i in range(4, 30)] + [(f"w{i}", f"w{rng.randrange(i)}", 1) for i in range(2, 12)]
    edges += [(f"u{i}", f"u{(i + 1) % 5}", 1) for i in range(5)] + [("u0", "u5", 1), ("u5", "u6", 1)]
    near, dist, count = paths_between([x for x in edges if x[0] != x[1]])
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    if not held:
        monkeypatch.setattr(graph, "HELD_EDGES", 0)
    got = graph.betweenness(spark.createDataFrame(edges, "src string, dst string, weight long"), normalised=False)
    assert {r.node: r.betweenness for r in got.collect()} == pytest.approx(betweenness_of(near, dist, count))


def test_betweenness_of_a_tree_searches_from_no_node(spark, monkeypatch):
    """60,000 leaves in 20 branches: each node searched for itself would be 3,600,000,000 steps."""
    def searched(*_):
        raise AssertionError("searched from a node")

    monkeypatch.setattr(graph, "_dependencies_of", searched)
    leaves, branches = 60_000, 20
    edges = spark.range(leaves).select((F.col("id") + 100).alias("src"), (F.col("id") % branches + 1).alias("dst")).union(spark.range(branches).select(F.col("id") + 1, F.lit(0)))
    got = {r.node: r.betweenness for r in graph.betweenness(edges, normalised=False).where("betweenness > 0").collect()}
    own = leaves // branches
    assert got == {0: (own + 1) ** 2 * branches * (branches - 1) / 2, **{b: own * (own - 1) / 2 + own * (leaves + branches - own) for b in range(1, branches + 1)}}


def louvain(edges):
    """Modularity of a sequential Louvain's communities (edges: {(a, b): weight}, each once)."""
    def settle(near):
        k = {v: sum(w for w in n.values()) for v, n in near.items()}
        m2, com, moved = sum(k.values()), {v: v for v in near}, True
        tot, any_move = dict(k), False
        while moved:
            moved = False
            for v in near:
                pull = {}
                for u, w in near[v].items():
                    if u != v:
                        pull[com[u]] = pull.get(com[u], 0) + w
                own = com[v]
                tot[own] -= k[v]
                best = max([own, *pull], key=lambda c: (pull.get(c, 0) - k[v] * tot[c] / m2, c == own))
                com[v] = best
                tot[best] += k[v]
                moved |= best != own
            any_move |= moved
        return com, any_move

    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    first, member, more = near, {v: v for v in near}, True
    while True:
        com, more = settle(near)
        if not more:
            break
        member = {v: com[c] for v, c in member.items()}
        merged = {}
        for v, n in near.items():
            for u, w in n.items():
                row = merged.setdefault(com[v], {})
                row[com[u]] = row.get(com[u], 0) + w
        near = merged
    m2 = sum(w for n in first.values() for w in n.values())
    inner = sum(w for v, n in first.items() for u, w in n.items() if member[u] == member[v])
    degree = {}
    for v, n in first.items():
        degree[member[v]] = degree.get(member[v], 0) + sum(n.values())
    return inner / m2 - sum((d / m2) ** 2 for d in degree.values())


def known_graph(kind):
    rng = random.Random(8)
    if kind == "ring of cliques":
        edges = {(8 * c + i, 8 * c + j): 1 for c in range(12) for i in range(8) for j in range(i)}
        return edges | {(8 * c, 8 * ((c + 1) % 12) + 1): 1 for c in range(12)}
    if kind == "planted groups":
        return {(i, j): 1 for i in range(48) for j in range(i) if rng.random() < (0.6 if i % 4 == j % 4 else 0.03)}
    return {((x, y), n): 1 for x in range(10) for y in range(10) for n in ((x + 1, y), (x, y + 1)) if max(n) < 10}


@pytest.mark.parametrize("kind", ["ring of cliques", "planted groups", "grid"])
def test_communities_are_as_modular_as_those_of_a_sequential_search(spark, kind):
    edges = known_graph(kind)
    df = spark.createDataFrame([(str(a), str(b), w) for (a, b), w in edges.items()], "src string, dst string, weight int")
    label = graph.communities(df)
    found = graph.modularity(df, label).first()[0]
    assert found >= louvain({(str(a), str(b)): w for (a, b), w in edges.items()}) - 0.02
    assert label.groupBy("community").agg(F.min("node").alias("m")).where("m <> community").isEmpty()


@pytest.mark.parametrize("kind", ["apart", "overlapping", "hubs"])
def test_communities_of_groups_are_those_of_their_edges(spark, kind):
    """Nodes in one group or several, alone in one, and hubs in all of them."""
    rng = random.Random(3)
    if kind == "apart":
        members = [(f"v{i}", i % 7) for i in range(90)] + [("v90", 7), ("v0", 0)]
    elif kind == "overlapping":
        members = [(f"v{i}", g) for i in range(80) for g in {i % 5, *(rng.choices(range(9), k=1) if i % 4 == 0 else [])}]
    else:  # two nodes in all groups, others in one each
        members = [(f"v{g}.{i}", g) for g in range(8) for i in range(5)] + [(f"hub{i}", g) for i in range(2) for g in range(8)]
    groups, edges = {}, {}
    for v, g in members:
        groups.setdefault(g, set()).add(v)
    for g in groups.values():
        for pair in combinations(sorted(g), 2):
            edges[pair] = edges.get(pair, 0) + 1
    label = graph.communities_of_groups(spark.createDataFrame(members, "node string, group long"))
    rows = label.collect()
    assert sorted(r.node for r in rows) == sorted({v for pair in edges for v in pair})
    found = graph.modularity(spark.createDataFrame([(*pair, w) for pair, w in edges.items()], "src string, dst string, weight int"), label).first()[0]
    assert found >= louvain(edges) - 0.02
    assert label.groupBy("community").agg(F.min("node").alias("m")).where("m <> community").isEmpty()
    if kind == "apart":
        assert {r.node: r.community for r in rows} == {v: min(g) for g in groups.values() if len(g) > 1 for v in g}


def test_communities_of_large_groups_need_no_edges(spark):
    """Two groups of 100,000 would give 10,000,000,000 edges."""
    label = graph.communities_of_groups(spark.range(200_000).select(F.col("id").alias("node"), (F.col("id") % 2).alias("group")))
    assert {(r.community, r["count"]) for r in label.groupBy("community").count().collect()} == {(0, 100_000), (1, 100_000)}


# --- subtitles and video ---------------------------------------------------------------------------

def test_words_close_segments(spark):
    words = [(1, i, w, i * 2.0, i * 2.0 + 1) for i, w in enumerate("one two three four. five, six: seven".split())]
    got = subtitles.words_to_segments(spark.createDataFrame(words, "video_id long, seq long, word string, start double, end double")).orderBy("seq").collect()
    assert [r.text for r in got] == ["one two three", "four.", "five,", "six:", "seven"]


def test_retimed_sums_to_the_group(spark):
    rows = [(1, 0, 0.0, 2.0, "ab"), (1, 1, 2.0, 6.0, "cdef."), (1, 2, 6.0, 7.0, "")]
    got = subtitles.retimed(subtitles.sentence_groups(spark.createDataFrame(rows, "video_id long, seq long, start double, end double, text string"))).orderBy("seq").collect()
    assert [(r.new_start, r.new_end) for r in got] == [(0.0, 1.714), (1.714, 6.0), (6.0, 7.0)]


def test_srt_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.5, "Hallo"), (1, 1, 1.5, 3.0, "Welt")], "video_id long, seq long, start double, end double, text string")
    text = subtitles.srt(rows)
    assert [r.text for r in subtitles.parsed_srt(text, rows).orderBy("seq").collect()] == ["Hallo", "Welt"]
    broken = spark.createDataFrame([(1, "1\n00:00:00,000 --> 00:00:01,000\nBonjour\n\nnothing")], "video_id long, srt string")
    assert [r.text for r in subtitles.parsed_srt(broken, rows).orderBy("seq").collect()] == ["Bonjour", "Welt"]


def track(spark, rows):
    return spark.createDataFrame([(1, s, q, f"T{q + 1:02d}", [b]) for s, q, b in rows], "video_id long, segment_idx int, seq int, track_id string, boxes array<struct<t:double,x:int,y:int,w:int,h:int>>")


def test_fusion(spark):
    ids = lambda rows, **k: [r.global_id for r in video.fused(track(spark, rows), **k).orderBy("segment_idx", "seq").collect()]
    assert ids([(0, 0, (0.0, 10, 10, 50, 50)), (1, 0, (3.5, 12, 12, 50, 50))]) == ["G001", "G001"]
    assert ids([(0, 0, (0.0, 0, 0, 30, 30)), (1, 0, (3.5, 500, 500, 30, 30))]) == ["G001", "G002"]
    assert ids([(0, 0, (0.0, 100, 100, 60, 60)), (1, 0, (3.0, 102, 102, 60, 60)), (1, 1, (3.0, 105, 105, 60, 60))], threshold=0.3) == ["G001", "G001", "G002"]
    assert ids([(0, i, (0.0, 100 * i, 0, 30, 30)) for i in range(1001)])[-1] == "G1001"


def plain_fusion(rows, threshold=0.4):
    """Global ids by a fold over the segments of one video."""
    def iou(a, b):
        inter = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) * max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        return inter / (a[3] * a[4] + b[3] * b[4] - inter) if inter else 0.0

    ids, number = {}, 0
    for segment in sorted({s for s, _, _ in rows}):
        here, taken = sorted((q, b) for s, q, b in rows if s == segment), set()
        for q, b in here:
            found = [(-iou(b, c), o) for s, o, c in rows if s == segment - 1 and o not in taken and iou(b, c) >= threshold]
            if found:
                taken.add(min(found)[1])
                ids[segment, q] = ids[segment - 1, min(found)[1]]
        for q, _ in here:
            if (segment, q) not in ids:
                number += 1
                ids[segment, q] = f"G{number:03d}"
    return [ids[k] for k in sorted(ids)]


@pytest.mark.parametrize("seed", range(3))
def test_fusion_equals_a_fold(spark, seed):
    """Long chains, crowded segments and missing ones."""
    rng = random.Random(seed)
    rows = [(s, q, (0.0, 20 * rng.randint(0, 3 + seed), 20 * rng.randint(0, 1), rng.choice([40, 60]), 40)) for s in range(25) if s != 11 for q in range(rng.randint(0, 6))]
    rows += [(s, 9, (0.0, 900, 900, 50, 50)) for s in range(25)]
    got = video.fused(track(spark, rows)).orderBy("segment_idx", "seq").collect()
    assert [r.global_id for r in got] == plain_fusion(rows)


HIT = "array<struct<text:string,conf:double,x1:double,y1:double,x2:double,y2:double>>"


@pytest.mark.parametrize(("hits", "kept"), [
    ([("a", 0.8, 0, 0, 100, 20), ("a", 0.9, 0, 0, 100, 20)], [0.9]),
    ([("a", 0.8, 0, 0, 100, 20), ("a", 0.9, 0, 200, 100, 220)], [0.9, 0.8]),
    ([("a", 0.9, 0, 0, 100, 20), ("a", 0.8, 75, 0, 175, 20)], [0.9, 0.8]),
    ([("a", 0.9, 0, 0, 100, 20), (" ", 0.8, 75, 0, 175, 20), (None, 0.7, 0, 0, 1, 1)], [0.9]),
    ([], []),
])
def test_suppression(spark, hits, kept):
    rows = [[(t, c, *map(float, b)) for t, c, *b in hits]]
    got = spark.createDataFrame([tuple(rows)], f"h {HIT}").select(video.kept_hits(F.col("h")).alias("k")).first().k
    assert [h.conf for h in got] == kept


def test_tracks_and_frames(spark):
    d = spark.createDataFrame([(1, "T1", 0, 0.0, "cat", 20.0, 20.0, 10.0, 10.0), (1, "T1", 1, 0.0, "dog", 22.0, 20.0, 10.0, 10.0), (1, "T1", 2, 1.0, "dog", 30.0, 20.0, 10.0, 10.0)], "video_id long, track_id string, frame int, t double, label string, cx double, cy double, w double, h double")
    r = video.tracks_of(d).first()
    assert r.label == "dog" and [(b.t, b.x) for b in r.boxes] == [(0.0, 17), (1.0, 25)]
    boxes = video.tracks_of(d).select("video_id", "track_id", F.explode("boxes").alias("b")).select("video_id", "track_id", "b.*")
    frames = spark.createDataFrame([(1, 0.04), (1, 0.5), (1, 0.96)], "video_id long, frame_t double")
    assert sorted((q.frame_t, q.t) for q in video.boxes_at(frames, boxes).collect()) == [(0.04, 0.0), (0.96, 1.0)]


# --- pages ---------------------------------------------------------------------------------------

@pytest.mark.parametrize(("url", "safe"), [("http://example.com/a", True), ("ftp://example.com", False), ("http://127.0.0.1/", False), ("http://10.2.3.4", False), ("http://172.31.0.1", False), ("http://172.32.0.1", True), ("http://169.254.169.254/x", False), ("http://metadata", False), ("http://[::1]/", False), ("http://8.8.8.8:80/", True), ("nonsense", False), (None, False), ("http://localhost/", False)])
def test_safe_urls(spark, url, safe):
    assert one(spark, web.is_safe(F.col("u"), known_names=True), u=url) is safe
    assert one(spark, web.is_safe(F.col("u")), u=url) is (safe and not (url or "").startswith("http://example"))


@pytest.mark.parametrize("host", ["127.1", "2130706433", "0x7f.0.0.1", "0177.1", "[::ffff:127.0.0.1]", "[::ffff:7f00:1]", "[::]", "[fe80::1]", "[0:0:0:0:0:ffff:10.0.0.1]", "localhost.", "a.localhost", "169.254.169.254.", "0", "127.0.0.1:8080", "me@127.0.0.1"])
def test_spellings_of_unsafe_hosts(spark, host):
    assert one(spark, web.is_safe(F.col("u"), known_names=True), u=f"http://{host}/x") is False


def test_tables(spark):
    html = "<table><tr><th>a</th><th> b c </th></tr><tr><td>1</td><td><b>2</b> x</td></tr></table> <table><tr><td>only</td></tr></table>"
    rows = one(spark, F.transform(web.tables(F.col("h")), web.table_markdown), h=html)
    assert rows == ["| a | b c |\n|---|---|\n| 1 | 2x |", "| only |"]
    assert one(spark, web.markdown_rows(F.lit(rows[0])), h="") == [["a", "b c"], ["1", "2x"]]
    got = one(spark, F.array(*(web.table_records(F.col("h"), x) for x in ("raw_html", "markdown", "summary_and_html"))), h=html)
    assert [[(t["index"], t.markdown, t.needs_summary) for t in x] for x in got] == [[(0, None, False), (1, None, False)], [(0, rows[0], False), (1, rows[1], False)], [(0, rows[0], True), (1, rows[1], True)]]
    assert one(spark, web.joined(F.lit("http://a.com/x/y"), F.col("l")), l="z") == "http://a.com/x/z"


def test_crawl_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c/"), ("b", "d"), ("d", "a"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a/",)], "url string")
    assert sorted((r.url, r.depth) for r in web.crawl(seeds, edges, 2).collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert sorted(r.url for r in web.crawl(seeds, edges, 9, max_pages=3).collect()) == ["a", "b", "c"]
    assert sorted(r.url for r in web.crawl(seeds, edges, 9, exclude=["b"]).collect()) == ["a", "c"]
    assert web.crawl(seeds, edges, 9, max_pages=0).count() == 0


def plain_crawl(seeds, links, depth, max_pages, deep):
    """The queue of a crawler, page by page."""
    queue, seen = [(s, 0) for s in seeds], {}
    while queue and len(seen) < max_pages:
        url, d = queue.pop() if deep else queue.pop(0)
        if url in seen or d > depth:
            continue
        seen[url] = (d, len(seen))
        if d < depth:
            queue += [(u, d + 1) for u in links.get(url, []) if u not in seen]
    return [(u, d, i) for u, (d, i) in seen.items()]


@pytest.mark.parametrize(("deep", "max_pages"), [(False, 9), (False, 60), (True, 2), (True, 9), (True, 60)])
def test_crawls_equal_a_plain_one(spark, deep, max_pages):
    """Both orders, cut inside a level; a page has more links than pages are taken, and some twice."""
    rng = random.Random(max_pages)
    links = {f"p{i}": [f"p{rng.randint(0, 79)}" for _ in range(rng.choice([0, 2, 25, 40]))] for i in range(80)}
    links["p0"] = [f"p{i}" for i in range(1, 30)]
    edges = spark.createDataFrame([(a, b, i) for a, out in links.items() for i, b in enumerate(out)], "src string, dst string, pos int")
    if deep:
        got = web.crawl_deep(["p0"], edges, 4, max_pages)
    else:
        got = web.crawl(spark.createDataFrame([("p0",)], "url string"), edges, 4, max_pages=max_pages)
    assert [tuple(r) for r in got.select("url", "depth", "place").orderBy("place").collect()] == plain_crawl(["p0"], links, 4, max_pages, deep)


def test_safe_crawl(spark):
    edges = spark.createDataFrame([("http://a.com", "http://127.1/x"), ("http://a.com", "http://b.com"), ("http://127.1/x", "http://c.com")], "src string, dst string")
    start = lambda u: spark.createDataFrame([(u,)], "url string")
    assert sorted(r.url for r in web.crawl(start("http://a.com"), edges, 5, safe=True).collect()) == ["http://a.com", "http://b.com"]
    with pytest.raises(ValueError, match="unsafe"):
        web.crawl(start("http://10.0.0.1"), edges, 5, safe=True)


def test_deep_crawl(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("c", "d", 0), ("c", "e", 1), ("b", "f", 0), ("d", "a", 0)], "src string, dst string, pos int")
    order = lambda *x, **k: [r.url for r in web.crawl_deep(["a"], edges, *x, **k).orderBy("place").collect()]
    assert order(9, 10) == ["a", "c", "e", "d", "b", "f"] and order(1, 10) == ["a", "c", "b"] and order(9, 3) == ["a", "c", "e"]
    assert order(9, 10, exclude=["c"]) == ["a", "b", "f"]


# --- listings, sources, streams -------------------------------------------------------------------

def test_long_paths_are_not_cut(spark):
    n = 13
    df = spark.createDataFrame([(f"v{i:02}", f"v{i + 1:02}", 1) for i in range(n - 1)], "src string, dst string, weight long")
    names = [f"v{i:02}" for i in range(n)]
    assert path_of(spark, df, names[:1], names[-1:]) == names
    assert {r.node: r.betweenness for r in graph.betweenness(df, normalised=False).collect()} == pytest.approx({v: i * (n - 1 - i) for i, v in enumerate(names)})
    assert {r.node: r.closeness for r in graph.closeness(df).collect()} == pytest.approx({v: (n - 1) / sum(abs(i - j) for j in range(n)) for i, v in enumerate(names)})
    assert graph.distances(df, df.where("src = 'v00'").select(F.col("src").alias("node")), 3).count() == 4


def test_deep_threads_are_not_cut(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(53)], "id long, parent_id long").coalesce(1)
    assert sorted((r.id, r.root, r.depth) for r in metadata.threads(chain).collect()) == [(i, 0, i) for i in range(53)]
    ring = spark.createDataFrame([(1, None), (2, 1), (1, 2)], "id long, parent_id long")
    assert sorted((r.id, r.root, r.depth) for r in metadata.threads(ring).collect()) == [(1, 1, 0), (2, 1, 1)]


def test_listing_rules(spark):
    jobs_ = spark.createDataFrame([(1, "ingestion_file", "pending", '{"redis_job_id": "r1"}', None), (2, "translation", "pending", '{"redis_job_id": "r1"}', None), (3, "ingestion_web", "pending", '{"redis_job_id": "r2"}', None)], "id long, job_type string, status string, payload string, completed_at timestamp")
    live = spark.createDataFrame([("r1", "storing", "2024-01-01T00:00:00Z"), ("r2", "", "")], "redis_job_id string, status string, completed_at string")
    got = {r.id: (r.status, r.completed_at is not None) for r in metadata.with_live_status(jobs_, live).collect()}
    assert got == {1: ("storing", True), 2: ("pending", False), 3: ("pending", False)}
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, name string, x int")
    changes = spark.createDataFrame([(1, None, 7)], "id long, name string, x int")
    assert sorted(map(tuple, metadata.updated(rows, changes).collect())) == [(1, "a", 7), (2, "b", 5)]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, parent_id long")
    assert sorted((r.id, r.root, r.depth) for r in metadata.threads(tree).collect()) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"ok \xff\xfe text")
    assert tables.text_files(spark, f"file://{tmp_path}/in").first().text == "ok  text"
    doc = {"a": 1, "b": {"c": [True, None, {"d": "x"}]}, "e": []}
    rows = spark.createDataFrame([(json.dumps(doc),), ("{",), (None,)], "j string")
    assert [r.text for r in tables.json_texts(rows, "j").collect()] == ["a: 1\nb:\n  c:\n    - True\n    - None\n    [2]:\n      d: x\ne:", None, None]
    points = spark.createDataFrame([("c1", 1, [1.0, 0.0]), ("c2", 2, [0.0, 1.0])], "collection string, id long, vector array<float>")
    tables.write_collection(points, f"file://{tmp_path}/points", 2)
    assert tables.collection(spark, f"file://{tmp_path}/points", "c2").first().id == 2
    with pytest.raises(Exception, match="length 3"):
        tables.write_collection(points, f"file://{tmp_path}/other", 3)
    users, talks = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(10, 1), (11, 2)], "id long, user_id long")
    left = tables.cascade({"users": users, "talks": talks}, [("talks", "user_id", "users", "id")], {"users": users.where("id = 1")})
    assert [r.id for r in left["talks"].collect()] == [11] and [r.id for r in left["users"].collect()] == [2]


def test_null_and_zero_vectors_are_similar_to_nothing(spark):
    points = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [0.0, 0.0])], "point_id long, collection int, vector array<float>")
    queries = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, vector array<float>")
    assert [(r.query_id, r.point_id, r.score) for r in retrieval.retrieve(points, queries).collect()] == [(9, 1, 1.0)]
    assert retrieval.retrieve(points, queries.limit(0)).count() == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1.0, 30.0), ("s", 2.0, 30.0), ("s", 2.5, 1.0), ("s", 9.0, 30.0)], "stream_id string, t double, level double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    path = f"file://{tmp_path}/levels"
    rows.write.parquet(path)
    source = spark.readStream.schema(rows.schema).parquet(path)
    q = jobs.spoken_spells(source).writeStream.outputMode("complete").format("memory").queryName("spells").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("spells").collect()) == [1, 2]
    q = jobs.window_counts(source).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("windows").collect()) >= 4
    seen = []
    q = jobs.dispatched(source.withColumn("task_name", F.lit("known")), {"known": lambda d: seen.append(d.count()), "other": lambda d: seen.append(-d.count())}, f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert sum(seen) == 4
