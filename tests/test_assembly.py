"""Replies, office documents, relations, small figures."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import languages, models
from quillspark.operators import assembly


@pytest.mark.parametrize(("text", "want"), [('x ```json\n{"a": {"b": 1}} ``` y', '{"a": {"b": 1}}'), ('so {"a": 1} and {"b": 2}', '{"a": 1}'), ("``` {open", "{open"), ("{open", None), ("", None), (None, None)])
def test_braces(text, want):
    assert assembly.braced(text) == want


def test_vision_replies(spark):
    replies = ['<think>hm</think>{"caption": "a cat", "events": [{"t": 1}], "notes": ["n"]}', "just words", '```json\n{"caption": "cut of', "", None, "<think>x</think>"]
    rows = assembly.vision_replies(spark.createDataFrame(list(enumerate(replies)), "i long, reply string")).orderBy("i").collect()
    assert [r.caption for r in rows] == ["a cat", "just words", "cut of", "", "", ""]
    assert rows[0].events == ['{"t":1}'] and rows[0].reasoning == "hm" and rows[0].notes == ["n"]
    assert rows[2].notes == ["Response truncated (max_tokens)."] and rows[5].reasoning == "x"


def test_office_runs(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> </w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    slide = f"<p:sld {ns}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    for name, inner, xml in (("a.docx", "word/document.xml", doc), ("b.pptx", "ppt/slides/slide1.xml", slide)):
        with io.BytesIO() as f:
            with zipfile.ZipFile(f, "w") as z:
                z.writestr(inner, xml)
            (tmp_path / name).write_bytes(f.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = assembly.office_runs(spark.read.format("binaryFile").load(f"file://{tmp_path}")).orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [("p0_r0", "Hello"), ("s0_sh0_p0_r0", "Title"), ("t0_r0_c0_p0_r0", "cell")]


def test_relations_and_replies(spark):
    rel = spark.createDataFrame([(1, "Acme", "in", "Paris"), (1, "Nobody", "in", "paris")], "doc_id long, subject string, predicate string, object string")
    found = spark.createDataFrame([(1, "acme", "organization", 0), (1, "paris", "person", 1), (1, "paris", "location", 2)], "doc_id long, name string, entity_type string, pos int")
    got = {(r.subject, r.subject_type, r.object_type) for r in assembly.resolved(rel, found).collect()}
    assert got == {("Acme", "organization", "location"), ("Nobody", "unknown", "location")}
    items = spark.createDataFrame([('[{"entity": "A", "type": "person"}, {"type": "x"}]',), ("no",)], "r string").select(assembly.parsed_entities(F.col("r")).alias("e")).collect()
    assert [(e.entity, e.confidence) for e in items[0].e] == [("A", 0.8)] and items[1].e == []
    segments = spark.createDataFrame([(1, 0, "a", "one"), (1, 1, "b", "two")], "doc_id long, seq int, id string, text string")
    done = assembly.translated(segments, spark.createDataFrame([(1, "a", "eins")], "doc_id long, id string, text string"))
    assert sorted(r.text for r in done.collect()) == ["eins", "two"]


def test_models_and_figures(spark):
    x = models.HashEmbedder(16).embed(["abc", "abc", "", "xyz"])
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and (x[0] == x[1]).all() and not (x[0] == x[3]).all()
    rows = spark.createDataFrame([("a",), (None,)], "t string").select(models.embedded(F.col("t")).alias("v")).collect()
    assert len(rows[0].v) == 64 and rows[1].v is None
    assert list(models.Tools({"a": F.lower}).chosen(["b", "a"])) == ["a"]
    got = spark.createDataFrame([("de", "DE", "/d/a", [1, 2, 3], [4, 5])], "w string, d string, p string, x array<int>, y array<int>").select(
        languages.needs_translation(F.col("w"), F.col("d")).alias("n"), languages.language_name(F.lit("xx")).alias("l"), assembly.path_inside(F.col("p"), "/d/").alias("i"), assembly.path_inside(F.lit("/d/../e"), "/d").alias("o"), F.size(assembly.zipped(F.col("x"), F.col("y"))).alias("z"), assembly.mean_level(F.col("x")).alias("m")).first()
    assert (got.n, got.l, got.i, got.o, got.z, got.m) == (False, "xx", True, False, 2, 2.0)
