"""The graph of typed entities: mentions, stated relations and co-occurrences, its figures,
and the path that leads from a question to what was retrieved for it.

A node is struct<name,type>.  Edges have src, dst, relationship, weight and kind
(``semantic`` from a subject to an object, ``co_occurrence`` for each unordered pair).
Co-occurrence edges are derived from pair counts, whatever order texts come in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from ..sources.tables import checkpointed
from .assembly import resolved

#: Entities and characters of a text that relations are looked for in.
MOST_ENTITIES, MOST_CHARS = 20, 2000
RULE_CONFIDENCE = 0.6


def node(name: str | Column, kind: str | Column) -> Column:
    return F.struct(F.lower(name).alias("name"), F.col(kind).alias("type") if isinstance(kind, str) else kind.alias("type"))


class RelationModel(Protocol):
    """Finds (subject, predicate, object, confidence) in a text, given names in it."""

    def relations(self, text: str, names: list[str]) -> list[tuple[str, str, str, float]]: ...


class BetweenWords:
    """Offline stand-in: one to three lower-case words between two names are what relates them."""

    def relations(self, text: str, names: list[str]) -> list[tuple[str, str, str, float]]:
        import re

        if len(names) < 2:
            return []
        any_name = "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))
        found = re.finditer(rf"\b({any_name})((?: [a-z]+){{1,3}}) (?=({any_name})\b)", text)
        return [(m[1], m[2].strip(), m[3], RULE_CONFIDENCE) for m in found if m[1].lower() != m[3].lower()]


def relations(docs: DataFrame, found: DataFrame, model: RelationModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, subject, predicate, object, confidence: what ``model`` finds in the first
    ``MOST_CHARS`` characters of each text, given its first ``MOST_ENTITIES`` entities
    (found: key, entity, name)."""
    model = model or BetweenWords()
    names = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_set("entity")), 1, MOST_ENTITIES).alias("names"))
    asked = docs.join(names, key).select(key, F.substring(text, 1, MOST_CHARS).alias("text"), "names")
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *r) for k, t, n in zip(f[key], f["text"], f["names"], strict=True) for r in model.relations(t or "", list(n))]
            yield pd.DataFrame(rows, columns=[key, "subject", "predicate", "object", "confidence"])

    return asked.mapInPandas(run, f"{key} {kind}, subject string, predicate string, object string, confidence double")


def semantic_edges(stated: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One edge for each stated relation between different names; an end that is no entity of its text has type ``unknown``."""
    placed = found if "pos" in found.columns else found.withColumn("pos", F.struct("entity_type"))
    ends = resolved(stated, placed, key).where(F.lower("subject") != F.lower("object"))
    return ends.select(node("subject", "subject_type").alias("src"), node("object", "object_type").alias("dst"), F.col("predicate").alias("relationship"), F.col("confidence").cast("double").alias("weight"), F.lit("semantic").alias("kind"))


def cooccurrence_edges(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One edge for each unordered pair of nodes of different names, weighted by the texts that hold both."""
    own = found.groupBy(key).agg(F.array_sort(F.collect_set(node("name", "entity_type"))).alias("nodes")).where(F.size("nodes") > 1)
    left = own.select(F.posexplode("nodes").alias("i", "src"), "nodes")
    pairs = left.select("src", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("dst")).where("src.name <> dst.name")
    counted = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return counted.select("src", "dst", F.lit("co_occurs_with").alias("relationship"), "weight", F.lit("co_occurrence").alias("kind"))


def build(found: DataFrame, stated: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, mentions) and edges of a collection's entities (key, name, entity_type) and
    stated relations.  Entities and edges are written once, as nodes are counted over both."""
    found = checkpointed(found, "entities")
    edges = cooccurrence_edges(found, key)
    if stated is not None:
        edges = edges.unionByName(semantic_edges(stated, found, key))
    edges = checkpointed(edges, "edges")
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).select("node", F.lit(0).cast("long").alias("mentions"))
    own = found.groupBy(node("name", "entity_type").alias("node")).agg(F.count("*").alias("mentions"))
    return own.unionByName(ends).groupBy("node").agg(F.sum("mentions").alias("mentions")), edges


def figures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, unique_entities (mentioned ones), relationships
    (different (subject, predicate, object)), co_occurrences (pairs)."""
    semantic = edges.where("kind = 'semantic'").select("src", "relationship", "dst").distinct().agg(F.count("*").alias("relationships"))
    pairs = edges.where("kind = 'co_occurrence'").agg(F.count("*").alias("co_occurrences"))
    unique = nodes.where("mentions > 0").agg(F.count("*").alias("unique_entities"))
    return graph.stats(nodes, edges).crossJoin(unique).crossJoin(semantic).crossJoin(pairs)  # rows of one


def rendered_path(path: Column) -> Column:
    """``name (type) -> name (type)``"""
    return F.array_join(F.transform(path, lambda n: F.concat(n["name"], F.lit(" ("), n["type"], F.lit(")"))), " -> ")


def reasoning_path(question: DataFrame, retrieved: DataFrame, edges: DataFrame) -> DataFrame:
    """path, rendered: the shortest way over the graph from an entity of the question to one
    of the retrieved texts (both name, entity_type); no row if either has none or none is known."""
    known = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    ends = [x.select(node("name", "entity_type").alias("node")).distinct().join(known, "node", "left_semi") for x in (question, retrieved)]
    return graph.shortest_path(edges, *ends).select("path", rendered_path(F.col("path")).alias("rendered"))
