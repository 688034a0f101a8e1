"""The entity graph, answers from it, and the rules around documents, jobs and models."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import models, numbers, text
from quillspark.operators import assembly, entities, graph, knowledge, metadata, retrieval, subtitles
from quillspark.sources import tables
from quillspark.streaming import jobs


def test_graph_of_typed_entities(spark):
    docs = spark.createDataFrame([(1, "Jane Doe joined NASA in 1999."), (2, "NASA and IBM and Jane Doe"), (3, None)], "doc_id long, text string")
    found = entities.entities(docs)
    stated = knowledge.relations(docs, found)
    assert sorted((r.doc_id, r.subject, r.predicate, r.object) for r in stated.collect()) == [(1, "Jane Doe", "joined", "NASA"), (1, "NASA", "in", "1999"), (2, "IBM", "and", "Jane Doe"), (2, "NASA", "and", "IBM")]
    nodes, edges = knowledge.build(found, stated)
    jane, nasa, ibm, year = ("jane doe", "person"), ("nasa", "acronym"), ("ibm", "acronym"), ("1999", "number")
    assert {(tuple(r.node), r.mentions) for r in nodes.collect()} == {(jane, 2), (nasa, 2), (ibm, 1), (year, 1)}
    pairs = {(tuple(r.src), tuple(r.dst)): r.weight for r in edges.where("kind = 'co_occurrence'").collect()}
    assert pairs == {(jane, nasa): 2, (year, jane): 1, (year, nasa): 1, (ibm, jane): 1, (ibm, nasa): 1}
    f = knowledge.figures(nodes, edges).first()
    assert (f.nodes, f.edges, f.unique_entities, f.relationships, f.co_occurrences, f.density) == (4, 9, 4, 4, 5, 9 * 2 / 12)
    question = spark.createDataFrame([("1999", "number"), ("unheard of", "person")], "name string, entity_type string")
    there = spark.createDataFrame([("IBM", "acronym")], "name string, entity_type string")
    path = knowledge.reasoning_path(question, there, edges.where("kind = 'co_occurrence'"))
    assert path.count() == 0  # pairs lead from the smaller node on
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    assert knowledge.reasoning_path(question, there, both).first().rendered == "1999 (number) -> jane doe (person) -> ibm (acronym)"
    assert knowledge.reasoning_path(question.where("false"), there, both).count() == 0


def test_unknown_ends_and_loops_of_relations(spark):
    found = spark.createDataFrame([(1, "ann", "person"), (1, "ann", "place")], "doc_id long, name string, entity_type string")
    stated = spark.createDataFrame([(1, "Ann", "knows", "Bob", 0.9), (1, "ANN", "is", "ann", 0.5)], "doc_id long, subject string, predicate string, object string, confidence double")
    got = [(tuple(r.src), tuple(r.dst), r.relationship, r.weight) for r in knowledge.semantic_edges(stated, found).collect()]
    assert got == [(("ann", "place"), ("bob", "unknown"), "knows", 0.9)]
    nodes, edges = knowledge.build(found, stated)
    assert {tuple(r.node) for r in nodes.collect()} == {("ann", "person"), ("ann", "place"), ("bob", "unknown")} and edges.count() == 1


def test_answers(spark):
    hits = spark.createDataFrame([(1, 1, "First line.\nmore", None, "a.txt", None, "3"), (1, 2, "other", None, None, None, None)], "query_id long, rank int, content string, text string, source_file string, filename string, page string")
    asked = spark.createDataFrame([(1, "what?"), (2, "and this?")], "query_id long, question string")
    got = {r.query_id: r for r in retrieval.answers(asked, hits, system="Be brief.").collect()}
    assert (got[1].answer, got[1].n_sources) == ("First line.", 2)
    assert (got[2].answer, got[2].context, got[2].n_sources) == (retrieval.NOTHING_FOUND, retrieval.NOTHING_FOUND, 0)

    class Echo:
        def generate(self, systems, questions):
            return [f"{q}|{s}" for s, q in zip(systems, questions, strict=True)]

    paths = spark.createDataFrame([(1, "a (x) -> b (y)")], "query_id long, rendered string")
    text = {r.query_id: r.answer for r in retrieval.answers(asked, hits, Echo(), "S", paths).collect()}[1]
    assert text.startswith("what?|S\n\n\nReasoning Path (entity connections): a (x) -> b (y)\n\nContext:\n[Source 1: a.txt, Page 3]")


def test_search_in_blocks_equals_search_at_once(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x[5], x[250] = x[4], x[4]
    points = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (901, 1, [0.0] * 8)], "point_id long, collection int, vector array<double>")
    queries = points.select(F.col("point_id").alias("query_id"), "vector").where("point_id % 2 = 0")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in range(0, 300, 2):
        s = sum(unit[q, j] * unit[:, j] for j in range(8))
        want[q] = [i for i in np.lexsort((np.arange(300), -s)) if s[i] >= 0.3][:5]
    for block in (2048, 40):
        monkeypatch.setattr(retrieval, "POINT_BLOCK", 64)
        monkeypatch.setattr(retrieval.similar, "__defaults__", (retrieval.THRESHOLD, block, None, None))
        got = {}
        for r in retrieval.retrieve(points, queries).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.point_id)
        assert got == want
        multi = retrieval.retrieve_multi(points, queries, 3).groupBy("query_id").count().agg(F.max("count")).first()[0]
        assert multi == 5


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_texts_by_kind_of_file(spark):
    pdf = b"%PDF /Author ( Ann ) /Title () 1 0 obj stream\nBT (Hello \\(you\\)) Tj (there) Tj ET\nendstream stream\nBT ET\nendstream stream\n(Two) Tj\nendstream"
    files = [("x/a.txt", "é".encode()), ("b.MD", b"# t"), ("c.docx", docx("one", "", "two")), ("d.docx", b"broken"), ("e.html", b"<p>"), ("f.txt", b"\xff"), ("noending", b""), ("g.pdf", pdf), ("h.pdf", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r.path: (r.text, r.error) for r in assembly.extracted(df).collect()}
    assert got["x/a.txt"] == ("é", None) and got["b.MD"] == ("# t", None) and got["c.docx"] == ("one\n\n\n\ntwo", None)
    assert got["d.docx"][0] is None and got["f.txt"][0] is None and got["e.html"] == (None, "Unsupported file type: html") and got["noending"] == (None, "Unsupported file type: ")
    assert got["g.pdf"] == ("Hello (you) there\n\nTwo", None) and got["h.pdf"] == ("", None)
    assert {r.path: r.information for r in assembly.pdf_information(df.where("path like '%pdf'")).collect()} == {"g.pdf": {"Author": "Ann"}, "h.pdf": {}}


def test_listing_scroll_and_clips(spark, tmp_path):
    points = spark.createDataFrame([(1, "B", 2, None, "k1"), (2, "a", None, 4.5, ""), (3, "a", 1, None, None), (4, None, None, None, "k4")], "id long, source_file string, chunk_index int, t_start double, clip_key string")
    page = tables.listing(points, 2, 1).collect()
    assert [(r.id, r.total, r.has_more) for r in page] == [(3, 4, True), (2, 4, True)]
    assert [(r.id, r.has_more) for r in tables.listing(points, 5, 3).collect()] == [(1, False)]
    assert {r.total for r in tables.listing(points, 9, cap=2).collect()} == {2}
    seen, cursor = [], None
    while True:
        rows, cursor = tables.scrolled(points, 2, cursor)
        seen.append([r.id for r in rows.collect()])
        if cursor is None:
            break
    assert seen == [[1, 2], [3, 4]]
    wanted = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    assert {r.id: (r.clip_key, r.problem) for r in tables.clip_of(points, wanted).collect()} == {1: ("k1", None), 2: (None, "No clip available for this point."), 3: (None, "No clip available for this point."), 9: (None, "Point not found.")}
    where = f"file://{tmp_path}/points"
    assert tables.create_collection(spark, where, "c", "id long") and not tables.create_collection(spark, where, "c", "id long")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [(r.chunk_idx, r.a) for r in tables.jsonl_chunks(spark, f"file://{tmp_path}/x.jsonl", "a int").orderBy("chunk_idx").collect()] == [(0, 1), (2, 2)]


def test_rules_of_rows(spark):
    agents = spark.createDataFrame([(1,), (2,), (3,)], "a long")
    bridge = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 12), (3, 99)], "a long, d long")
    domains = spark.createDataFrame([(10, "y"), (11, "x"), (12, None)], "d long, name string")
    got = {r.a: r.names for r in metadata.through(agents, bridge, domains, "a", "d", "name", "names").collect()}
    assert got == {1: ["x", "y"], 2: [], 3: []}
    rows = spark.createDataFrame([(1, "RAG", None), (2, None, 5)], "id long, kind string, x int")
    assert [(r.kind, r.x) for r in metadata.filled(metadata.lowered(rows, "kind", ["rag"]), x=7).orderBy("id").collect()] == [("rag", 7), (None, 5)]
    with pytest.raises(Exception, match="unknown value"):
        metadata.lowered(rows, "kind", ["other"]).collect()
    assert metadata.unique(rows, ["id"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        metadata.unique(rows.union(rows), ["id"]).collect()
    docs = spark.createDataFrame([(1, "done", None), (2, "done", None)], "id long, status string, error_message string")
    held = spark.createDataFrame([(5, "ingestion_file", 1), (6, "translation", 2), (7, "ingestion_web", 2)], "id long, job_type string, document_id long")
    after, left = metadata.jobs_deleted(docs, held, held.where("id < 7").select("id"))
    assert {r.id: (r.status, r.error_message) for r in after.collect()} == {1: ("failed", "Job removed by user"), 2: ("done", None)} and [r.id for r in left.collect()] == [7]
    messages = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 9, "c")], "id long, parent_id long, text string")
    assert {r.id: r.parent_text for r in metadata.parents(messages).collect()} == {1: None, 2: "a", 3: None}


def test_reindex_after_a_new_prompt(spark):
    docs = spark.createDataFrame([(1, 7, "v.mp4", "done", 3, "e", None, "MP4"), (2, 7, "t.txt", "done", 4, None, "text", "txt"), (3, 8, "w", "done", 5, None, "video", None)], "id long, data_domain_id long, filename string, status string, chunk_count long, error_message string, processing_type string, file_type string")
    domains = spark.createDataFrame([(7, None), (8, "same")], "id long, vlm_prompt string")
    given = spark.createDataFrame([(7, "new"), (8, "same")], "id long, vlm_prompt string")
    marked = metadata.prompt_changed(domains, given, docs)
    assert {r.id: r.again for r in marked.collect()} == {1: True, 2: False, 3: False}
    points = spark.createDataFrame([(1, "v.mp4"), (2, "t.txt")], "id long, source_file string")
    held = spark.createDataFrame([(9, "ingestion_file", "completed")], "document_id long, job_type string, status string")
    after, kept, queue = metadata.reindexed(marked, points, held, F.col("again"))
    assert {r.id: (r.status, r.chunk_count, r.error_message) for r in after.collect()} == {1: ("pending", 0, None), 2: ("done", 4, None), 3: ("done", 5, None)}
    assert [r.id for r in kept.collect()] == [2] and sorted((r.document_id, r.job_type, r.status) for r in queue.collect()) == [(1, "ingestion_video", "queued"), (9, "ingestion_file", "completed")]


def test_tracks_tables_and_figures(spark):
    one = spark.range(1)
    assert one.select(assembly.tracks_json(F.lit(None).cast("array<struct<a:int>>"))).first()[0] == "[]"
    assert one.select(assembly.tracks_json(F.array(F.struct(F.lit("é").alias("id"))))).first()[0] == '[{"id":"é"}]'
    assert [one.select(assembly.table_embed_text(F.lit(c).cast("string"), F.lit("|a|"))).first()[0] for c in ("Cap", " ", None)] == ["Cap\n\n|a|", "|a|", "|a|"]
    boxes = spark.createDataFrame([(1, 0.5, "T2", 1, 2, 3, 4), (1, 0.5, "T1", 5, 6, 7, 8)], "video_id long, t double, track_id string, x int, y int, w int, h int")
    assert [b["track_id"] for b in json.loads(assembly.frame_detections(boxes).first().detections)] == ["T1", "T2"]
    assert [one.select(numbers.frame_index(F.lit(t), F.lit(10.0))).first()[0] for t in (0.05, 0.15, 0.26)] == [0, 2, 3]
    runs = spark.createDataFrame([([0.1, 0.2], ["a"], "2024-01-01 00:00:00", "2024-01-01 00:00:04"), ([0.1], [], "2024-01-01 00:00:01", "2024-01-01 00:00:09.5")], "frame_times array<double>, tracks array<string>, started string, ended string").withColumns({c: F.col(c).cast("timestamp") for c in ("started", "ended")})
    r = assembly.pipeline_summary(runs).first()
    assert (r.segments, r.avg_frames, r.tracks, r.elapsed) == (2, 1.5, 1, 9.5)


def test_models_and_their_fallbacks():
    class Fails:
        def names(self):
            raise OSError

    class Server:
        def names(self):
            return ["a", "b"]

        def call(self, name, argument):
            if name == "b":
                raise ValueError("no")
            return name + argument

    tools = models.discovered([Fails(), Server()])
    assert tools["a"]("1") == "a1" and tools["b"]("1") == "error: no"
    assert isinstance(models.made("tracker", "none such", {}), models.NoTracker) and models.made("vision", "x", {"x": Server}).names() == ["a", "b"]

    class Model:
        def turn(self, messages, names):
            if messages[-1]["role"] == "user":
                return {"calls": [("a", "7"), ("zz", "")]}
            return {"content": messages[-2]["content"]}

    said = models.react(Model(), tools, "q")
    assert [m["role"] for m in said] == ["user", "assistant", "tool", "tool", "assistant"] and said[-1]["content"] == "a7"
    bound = models.bound_tools({"ingest": lambda agent, user: lambda x: f"{agent}/{user}/{x}"}, 1, 2, ["ingest", "other"])
    assert bound["ingest"]("u") == "1/2/u" and list(bound) == ["ingest"]


def test_job_states(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "queued", None), (1, "2024-01-01 00:00:01", "completed", 4), (1, "2024-01-01 00:00:02", None, None), (1, "2024-01-01 00:00:03", "storing", None), (2, "2024-01-01 00:00:00", "what", None)], "job_id long, ts string, status string, chunks int").withColumn("ts", F.col("ts").cast("timestamp"))
    last = {r.job_id: (r.status, r.chunks) for r in jobs.status_fields(rows).collect()}
    assert last == {1: ("storing", 4), 2: ("what", None)}
    steps = [(r.status, r.valid) for r in jobs.transitions(rows.where("status is not null")).orderBy("job_id", "ts").collect()]
    assert steps == [("queued", True), ("completed", True), ("storing", False), ("what", False)]
    (tmp_path / "in").mkdir()
    texts = spark.createDataFrame([(1, "NASA IBM"), (2, "NASA IBM ESA")], "doc_id long, text string")
    texts.write.mode("append").json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    jobs.growing_pairs(stream, f"file://{tmp_path}/pairs", f"file://{tmp_path}/cp").awaitTermination()
    assert {(r.src, r.dst): r.weight for r in jobs.merged_pairs(spark, f"file://{tmp_path}/pairs").collect()} == {("ibm", "nasa"): 2, ("esa", "ibm"): 1, ("esa", "nasa"): 1}


def test_subtitles_translated(spark):
    rows = [(1, 0, 0.0, 2.0, "one two"), (1, 1, 2.0, 6.0, "three four."), (1, 2, 6.0, 7.0, " "), (1, 3, 7.0, 8.0, "bad."), (1, 4, 8.0, 9.0, "five"), (1, 5, 9.0, 10.0, "six.")]
    df = spark.createDataFrame(rows, "video_id long, seq long, start double, end double, text string")

    class Model:
        def generate(self, systems, questions):
            q = questions[0]
            if "bad" in q:
                return ["no JSON"]
            if "five" in q:
                assert json.loads(q) == {"sentence": "five six.", "parts": 2, "before": ""}  # a failed sentence is no context
                return ['```json\n["a", "b", "too many"]\n```']
            return ['["only one"]']

    got = [(r.text, r.start, r.end, r.done) for r in subtitles.translated(df, "en", "de", Model()).orderBy("seq").collect()]
    assert got == [("only one", 0.0, 2.526, True), ("three four.", 2.526, 6.0, True), (" ", 6.0, 7.0, False), ("bad.", 7.0, 8.0, False), ("a", 8.0, 9.0, True), ("b", 9.0, 10.0, True)]
    assert [r.text for r in subtitles.translated(df.where("seq < 2"), "", "xx").orderBy("seq").collect()] == ["one two", "three four."]


@pytest.mark.parametrize(("reply", "strings"), [('["a", 1]', ["a", "1"]), ('```json\n[" a "]\n```', ["a"]), ('```["a"]```', ["a"]), ('"one"', ["one"]), ("none", None), ("", None)])
def test_reply_strings(reply, strings):
    assert subtitles.reply_strings(reply) == strings


def test_video_prompts(spark):
    library = {"procedure": {"template": "From {t_start}: {n}.", "id": "p1", "tracks_append": " Tracks {tracks_json}", "tracks_append_empty": " No tracks"}, "race": {"id": "r1"}}
    rows = spark.createDataFrame([("race", "[1]", "X-Cosmo-2"), ("procedure", " ", None), ("other", None, "y")], "mode string, tracks string, model string")
    out = text.video_prompt(library, F.col("mode"), {"t_start": F.lit(1.5), "n": F.lit(3)}, F.col("tracks"), F.col("model"), {"cosmo": " Stamp."})
    assert [tuple(r.p) for r in rows.select(out.alias("p")).collect()] == [("From 1.5: 3. Stamp.", "r1"), ("From 1.5: 3. No tracks", "p1"), ("From 1.5: 3. No tracks", "p1")]


def test_catalogue_of_models():
    asked = []

    def fetch(key):
        asked.append(key)
        if key:
            raise RuntimeError("HTTP 401")
        return [{"id": "m"}]

    assert models.model_catalogue(fetch, " real ") == ([{"id": "m"}], None) and asked == ["real", None]
    assert models.model_catalogue(fetch, "Dummy") == ([{"id": "m"}], None) and asked[2:] == [None]

    def down(key):
        raise RuntimeError("timed out")

    assert models.model_catalogue(down, "k") == ([], "timed out")


def test_json_files_and_collections(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"a": [1, {"b": null}]}')
    assert tables.json_files(spark, f"file://{tmp_path}/j").first().text == "a:\n  - 1\n  [1]:\n    b: None"
    (tmp_path / "j/b.json").write_bytes(b'"\xff"')
    with pytest.raises(Exception, match="not UTF-8"):
        tables.json_files(spark, f"file://{tmp_path}/j").collect()
    where = f"file://{tmp_path}/points"
    tables.create_collection(spark, where, "c", "id long")
    assert tables.drop_collection(spark, where, "c") and not tables.drop_collection(spark, where, "c")
