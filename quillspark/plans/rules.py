"""Registered queries for the smaller rules: each lays a rule over a whole table of the
driver (where the tables lack a case, it is built from their columns) beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages, numbers, rules, text
from ..functions.numbers import chunk_hash
from ..operators import assembly, chunking, entities, knowledge, metadata, subtitles, video, web
from ..sources import tables
from ..streaming import jobs
from .catalogue import query


def pick(number: str, *values: str):
    """One of the values by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(number) % len(values) + 1).cast("int"))


def picked(number: str, *values: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{number} % {len(values)} + 1]"


# --- files, uploads, predicates ------------------------------------------------------------------

_NAMES = ["a.pdf", "b.DOCX", "c.v2.md", "noending", "d.html", "e.mp4", "f.exe", "g.JSON", "h."]


@query(f"""SELECT doc_id, ext, CASE WHEN ext IN ('pdf', 'json', 'docx', 'pptx', 'html') THEN ext WHEN ext IN ('doc') THEN 'docx' WHEN ext = 'ppt' THEN 'pptx' WHEN ext = 'htm' THEN 'html' WHEN ext = 'md' THEN 'markdown' WHEN ext = 'txt' THEN 'text' END AS format,
 CASE WHEN ext = 'mp4' THEN size <= 524288000 WHEN ext IN ('pdf', 'docx', 'doc', 'pptx', 'ppt', 'html', 'htm', 'md', 'txt', 'json') THEN size <= 52428800 ELSE false END AS may_upload
FROM (SELECT doc_id, n_chars * 100000 AS size, CASE WHEN contains(n, '.') THEN lower(regexp_extract(n, '\\.([^.]*)$', 1)) ELSE '' END AS ext FROM (SELECT doc_id, n_chars, {picked("doc_id", *_NAMES)} AS n FROM documents))""")
def file_formats(read):
    """SC4, ST-27, PF13: format by ending, and what may be uploaded."""
    docs = read("documents").select("doc_id", (F.col("n_chars") * 100000).alias("size"), pick("doc_id", *_NAMES).alias("n"))
    return docs.select("doc_id", text.file_extension(F.col("n")).alias("ext"), tables.file_format(F.col("n")).alias("format"), tables.may_upload(F.col("n"), F.col("size")).alias("may_upload"))


@query("""SELECT p_partkey, coalesce(p_partkey % 3 = 0, false) OR p_partkey % 4 = 0 AS is_video, p_size >= 50 AND p_partkey % 120 >= 50 AS large_enough, p_size < p_partkey % 60 AS has_clip, p_partkey || '/' || p_size || '.mp4' AS clip_key, greatest(0, least(10, p_size - 20)) AS depth,
 (p_size + 3) % 2 + 1 AS scales, round_even(least(1.0, 32.0 / greatest(p_size, p_partkey % 60 + 1)) * p_size, 0)::INTEGER AS width FROM part""")
def video_rules(read):
    """PF5, PF24, PF11, PF25, SK11, MA12, GE2, MA7: predicates, keys and sizes."""
    p = read("part").withColumns({"a": F.when(F.col("p_partkey") % 3 == 0, "video").when(F.col("p_partkey") % 3 == 1, "text"), "b": F.when(F.col("p_partkey") % 4 == 0, "MP4").otherwise("txt")})
    scales = rules.distinct_scales(F.when(F.col("p_size") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0))))
    return p.select("p_partkey", rules.is_video(F.col("a"), F.col("b")).alias("is_video"), rules.large_enough(F.col("p_size"), F.col("p_partkey") % 120).alias("large_enough"), rules.clip_range(F.col("p_size"), F.col("p_partkey") % 60).alias("has_clip"), rules.clip_key(F.col("p_partkey").cast("string"), F.col("p_size")).alias("clip_key"), assembly.bounded(F.col("p_size") - 20, 0, 10).cast("int").alias("depth"), F.size(scales).alias("scales"), rules.resized(F.col("p_size"), F.col("p_partkey") % 60 + 1, 32)["width"].alias("width"))


_MODELS = ["gpt", "Text-Embedding-3", "bge-m3", "whisper-1", "chat e5-", "my-reranker", "mistral", "TTS"]


@query(f"SELECT p_partkey, {picked('p_partkey', *_MODELS)} IN ('gpt', 'mistral') AS chat FROM part")
def chat_models(read):
    """PF12: models that are not for chat go by parts of their names."""
    return read("part").select("p_partkey", text.is_chat_model(pick("p_partkey", *_MODELS)).alias("chat"))


@query("""SELECT doc_id, lang IN ('en', 'de', 'fr', 'es') AND doc_id % 7 > 0 AS supported, CASE WHEN doc_id % 3 = 0 THEN false WHEN doc_id % 3 = 1 THEN lang <> 'en' ELSE lang <> 'de' END AS translate FROM documents""")
def language_rules(read):
    """PF16, PF23: languages that are known, and texts that need a translation."""
    d = read("documents").withColumns({"code": F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")), "wanted": F.when(F.col("doc_id") % 3 == 1, "EN").when(F.col("doc_id") % 3 == 2, "de")})
    return d.select("doc_id", languages.supported(F.col("code")).alias("supported"), F.coalesce(languages.needs_translation(F.col("wanted"), F.col("lang")), F.lit(False)).alias("translate"))


_STATES = ["pending", "failed", "completed", "cancelled", "storing"]


@query(f"SELECT o_orderkey, {picked('o_orderkey', *_STATES)} IN ('pending', 'failed') AS requeue, {picked('o_orderkey', *_STATES)} NOT IN ('completed', 'cancelled') AS cancel FROM orders")
def job_guards(read):
    """PF18: what may be queued again or cancelled."""
    s = pick("o_orderkey", *_STATES)
    return read("orders").select("o_orderkey", metadata.may_requeue(s).alias("requeue"), metadata.may_cancel(s).alias("cancel"))


_PATHS = ["/data/up/a.txt", "/data/up", "/data/upper/a", "/data/up/../x", "/data/up/..x/y", "relative"]


@query(f"SELECT p_partkey, {picked('p_partkey', *_PATHS)} IN ('/data/up/a.txt', '/data/up', '/data/up/..x/y') AS inside FROM part")
def paths_inside(read):
    """PF9."""
    return read("part").select("p_partkey", assembly.path_inside(pick("p_partkey", *_PATHS), "/data/up/").alias("inside"))


@query("""SELECT doc_id, lang AS lang, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'core' END AS source, 'yes' AS extra FROM documents""")
def payloads(read):
    """PF19, SO5: extras pass through, core keys win."""
    core = {"lang": F.col("lang"), "source": F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("core")}
    d = read("documents").withColumn("extras", F.create_map(F.lit("lang"), F.lit("??"), F.lit("extra"), F.lit("yes")))
    out = d.select("doc_id", chunking.payload(core, "extras").alias("p"))
    return out.select("doc_id", *(F.col("p")[k].alias(k) for k in ("lang", "source", "extra")))


@query("""SELECT vec_id, len(list_filter([CASE WHEN vec_id % 2 = 0 THEN 1 END, CASE WHEN vec_id % 3 = 0 THEN 2 END, 3], lambda x: x IS NOT NULL)) AS frames, round(list_avg(embedding::DOUBLE[]), 9) AS level, least(embedding[1], embedding[3], embedding[5])::DOUBLE AS x1, greatest(embedding[2], embedding[4], embedding[6])::DOUBLE AS y2 FROM embeddings""")
def arrays_of_numbers(read):
    """PF17, AG15, MA2: frames that are there, mean levels, the box around a polygon."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    points = F.array(*(F.array(v[i], v[i + 1]) for i in (0, 2, 4)))
    frames = F.array(F.when(F.col("vec_id") % 2 == 0, 1), F.when(F.col("vec_id") % 3 == 0, 2), F.lit(3))
    return read("embeddings").select("vec_id", F.size(rules.present(frames)).cast("long").alias("frames"), F.round(assembly.mean_level(v), 9).alias("level"), numbers.around(points)["x1"].alias("x1"), numbers.around(points)["y2"].alias("y2"))


@query(f"SELECT s_suppkey, {picked('s_suppkey', 'gpt', 'none such', 'mistral')} <> 'none such' AND s_suppkey % 5 > 0 AS model_available FROM supplier")
def models_available(read):
    """PF22: whether an agent's model is given and in the catalogue."""
    agents = read("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, pick("s_suppkey", "gpt", "none such", "mistral")).alias("llm_model"))
    known = read("region").select(F.when(F.col("r_regionkey") % 2 == 0, "gpt").otherwise("mistral").alias("id"))
    return metadata.with_availability(agents, known).select("s_suppkey", "model_available")


@query("SELECT p_partkey, trunc(least(1.0, 32.0 / greatest(p_size, p_partkey % 60 + 1)) * p_size)::INTEGER AS width, least(20, p_size)::BIGINT AS first_entities, p_name[1:2000] AS first_chars FROM part")
def first_of_many(read):
    """MA7 (the vision model's), TK9: sides cut off, the first of long lists and texts."""
    many = F.sequence(F.lit(1), F.greatest(F.col("p_size"), F.lit(1)))
    return read("part").select("p_partkey", rules.resized(F.col("p_size"), F.col("p_partkey") % 60 + 1, 32, truncated=True)["width"].alias("width"), F.size(F.slice(many, 1, knowledge.MOST_ENTITIES)).cast("long").alias("first_entities"), F.substring("p_name", 1, knowledge.MOST_CHARS).alias("first_chars"))


# --- joins and merges ----------------------------------------------------------------------------

@query("""SELECT doc_id, greatest(0, least(len(string_split(text, chr(10))), 3)) AS pairs FROM documents WHERE text IS NOT NULL""")
def zip_to_shorter(read):
    """JN14: pairs by position, as many as the shorter side has."""
    return read("documents").where("text is not null").select("doc_id", F.size(assembly.zipped(F.split("text", "\n"), F.array(F.lit(1), F.lit(2), F.lit(3)))).cast("long").alias("pairs"))


@query("""WITH r AS (SELECT c_nationkey AS doc_id, lower(c_mktsegment) AS n, max_by(CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END, c_custkey) AS t FROM customer GROUP BY 1, 2)
SELECT n_nationkey AS doc_id, coalesce(a.t, 'unknown') AS subject_type, coalesce(b.t, 'unknown') AS object_type FROM nation LEFT JOIN r a ON a.doc_id = n_nationkey AND a.n = 'building' LEFT JOIN r b ON b.doc_id = n_nationkey AND b.n = 'nothing of the kind'""")
def relation_ends(read):
    """JN15: types of a relation's ends, the last entity of that name in the text."""
    found = read("customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("entity_type"), F.col("c_custkey").alias("pos"))
    stated = read("nation").select(F.col("n_nationkey").alias("doc_id"), F.lit("Building").alias("subject"), F.lit("has").alias("predicate"), F.lit("Nothing of the kind").alias("object"))
    return assembly.resolved(stated, found).select("doc_id", "subject_type", "object_type")


@query("""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS owner, s_suppkey % 3 = 0 AS t FROM supplier), f AS (SELECT owner, min(id) AS id FROM a WHERE t GROUP BY owner)
SELECT c_custkey, coalesce(own.id, f.id) AS chosen_agent FROM customer LEFT JOIN a own ON own.id = c_custkey % 20 AND own.owner = c_nationkey LEFT JOIN f ON f.owner = c_nationkey""")
def fallback_agents(read):
    """JN17: the given agent of the user's, else the first for translations."""
    agents = read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("owner_id"), F.when(F.col("s_suppkey") % 3 == 0, "translation").otherwise("rag").alias("agent_type"))
    held = read("customer").select("c_custkey", F.col("c_nationkey").alias("user_id"), (F.col("c_custkey") % 20).alias("agent_id"))
    return rules.with_fallback_agent(held, agents).select("c_custkey", "chosen_agent")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'new ' || turn ELSE text END AS text FROM conversations")
def translations_applied(read):
    """JN13: the reply of a segment's id, else its own text."""
    c = read("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("id"), "turn", "text")
    replies = c.where("turn % 2 = 0").select("doc_id", "id", F.concat(F.lit("new "), "id").alias("text"))
    return assembly.translated(c, replies).select(F.col("doc_id").alias("conv_id"), "turn", "text")


@query("""SELECT doc_id, lang AS name, CASE WHEN doc_id % 3 = 2 THEN 'model' ELSE 'regex' END AS entity, CASE WHEN doc_id % 3 = 2 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM documents""")
def extractions_merged(read):
    """WN6: the more confident extraction, the patterns' on a tie."""
    d = read("documents").select("doc_id", F.col("lang").alias("name"), F.lit("t").alias("entity_type"))
    regex = d.withColumns({"entity": F.lit("regex"), "confidence": F.lit(0.7)})
    model = d.withColumns({"entity": F.lit("model"), "confidence": F.round(0.6 + F.col("doc_id") % 3 * 0.1, 1)})
    return entities.merged(regex, model).select("doc_id", "name", "entity", "confidence")


@query("SELECT c_mktsegment AS canonical, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS members FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment")
def name_clusters(read):
    """GR5: the names of each canonical one."""
    canon = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("canonical"), F.lit("x").alias("entity_type"), F.col("n_name").alias("name"))
    return entities.clusters(canon).select("canonical", F.array_join("members", "|").alias("members"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN 1.5 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer""")
def partial_updates(read):
    """DM4: only what is set changes."""
    rows = read("customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    changes = rows.where("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("c_name"), F.when(F.col("c_custkey") % 4 == 0, 1.5).alias("c_acctbal"))
    return metadata.updated(rows, changes, "c_custkey")


@query("""SELECT (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS customers, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3) + (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orders,
 (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)) AS lines""")
def cascading_delete(read):
    """SK15, DM5: a user's, then its children's and theirs."""
    rows = {"nation": read("nation"), "customer": read("customer"), "orders": read("orders"), "lineitem": read("lineitem")}
    links = [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    left = tables.cascade({**rows, "lineitem": rows["lineitem"].withColumn("id", F.concat_ws("/", "l_orderkey", "l_linenumber"))}, links, {"nation": read("nation").where("n_nationkey = 3")})
    n = [left[t].agg(F.count("*").alias(c)) for t, c in (("customer", "customers"), ("orders", "orders"), ("lineitem", "lines"))]
    return n[0].crossJoin(n[1]).crossJoin(n[2])  # rows of one


@query("""SELECT o_custkey AS id, 0 AS fresh FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0) UNION ALL SELECT o_custkey, 1 FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)""")
def backfill_missing(read):
    """SO6: new rows only where the key is not there yet."""
    have = read("orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id")).distinct().withColumn("fresh", F.lit(0))
    return metadata.backfilled(have, read("orders").select(F.col("o_custkey").alias("id"), F.lit(1).alias("fresh")), ["id"])


# --- windows, times, boxes -----------------------------------------------------------------------

@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0")
def every_third(read):
    """WN10."""
    return assembly.every_nth(read("conversations"), 3, "turn").select("conv_id", "turn")


@query("SELECT conv_id, turn, 40 + (row_number() OVER p * 30 // count(*) OVER (PARTITION BY conv_id))::INTEGER AS progress FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn)")
def page_progress(read):
    """WN12, MA10."""
    c = read("conversations")
    numbered = tables.numbered(c, ["conv_id"], ["turn"]).join(c.groupBy("conv_id").agg(F.count("*").alias("total")), "conv_id")
    return numbered.select("conv_id", "turn", numbers.progress(F.col("n"), F.col("total")).cast("int").alias("progress"))


_SHARES = [0.25 / 3, 0.5 / 3, *(0.25 + 0.5 * i / 7 for i in range(1, 7)), 0.75 + 0.25 / 3, 0.75 + 0.5 / 3]


@query("""WITH w AS (SELECT p_partkey AS video_id, i AS segment_idx, i * 3.0::DOUBLE AS a, least(i * 3.0::DOUBLE + 4, p_size)::DOUBLE AS z FROM part, range(0, 100) r(i) WHERE i < ceil(p_size / 3.0))
SELECT video_id, segment_idx, CASE WHEN z > a THEN list_transform([""" + ", ".join(f"{s!r}::DOUBLE" for s in _SHARES) + """], lambda s: round((a + (z - a) * s) * 1000)::BIGINT) ELSE [] END AS times, sha256(video_id || '|' || printf('%.6f', a) || '|' || printf('%.6f', z) || '|biased|' || CASE WHEN z > a THEN 10 ELSE 0 END || '|stub|p1') AS hash FROM w""")
def frame_times(read):
    """MA4, MA5, TK11, HA1: sampled instants (in milliseconds) and the chunk's hash."""
    videos = read("part").select(F.col("p_partkey").alias("video_id"), F.col("p_size").cast("double").alias("duration"))
    out = video.sampled(video.windows(videos))
    return out.select("video_id", F.col("segment_idx").cast("long").alias("segment_idx"), F.transform("frame_times", lambda t: F.round(t * 1000).cast("long")).alias("times"), chunk_hash(F.col("video_id").cast("string"), F.col("t_start"), F.col("t_end"), F.lit("biased"), F.size("frame_times"), F.lit("stub"), F.lit("p1")).alias("hash"))


_DETECTIONS = """WITH d AS (SELECT l_orderkey AS v, 'T' || l_linenumber % 2 AS track, l_linenumber AS f, (l_linenumber // 2)::DOUBLE AS t, l_returnflag AS label, l_quantity::DOUBLE AS cx, l_discount::DOUBLE * 1000 AS cy, l_tax::DOUBLE * 500 AS w, (l_linenumber * 7)::DOUBLE AS h FROM lineitem),
b AS (SELECT v, track, t, max({'f': f, 'x': greatest(0, trunc(cx - w / 2)::INTEGER), 'y': greatest(0, trunc(cy - h / 2)::INTEGER), 'w': greatest(1, trunc(w)::INTEGER), 'h': greatest(1, trunc(h)::INTEGER), 'label': label}) AS m FROM d GROUP BY v, track, t)"""


def _tracks(read):
    d = read("lineitem").select(F.col("l_orderkey").alias("video_id"), F.concat(F.lit("T"), F.col("l_linenumber") % 2).alias("track_id"), F.col("l_linenumber").cast("int").alias("frame"), F.floor(F.col("l_linenumber") / 2).cast("double").alias("t"), F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("double").alias("cx"), (F.col("l_discount").cast("double") * 1000).alias("cy"), (F.col("l_tax").cast("double") * 500).alias("w"), (F.col("l_linenumber") * 7).cast("double").alias("h"))
    return video.tracks_of(d)


@query(_DETECTIONS + """ SELECT v, track, max({'f': m.f, 'label': m.label}).label AS label, count(*) AS boxes, arg_min(m.x, t)::BIGINT AS first_x, arg_max(m.w, t)::BIGINT AS last_w FROM b GROUP BY v, track""")
def tracks_of_detections(read):
    """GE5, TK10, MA11, AG14: one box an instant, the last label, first and last box."""
    out = video.track_summary(_tracks(read))
    return out.select(F.col("video_id").alias("v"), F.col("track_id").alias("track"), "label", F.size("boxes").cast("long").alias("boxes"), F.col("first_box.x").cast("long").alias("first_x"), F.col("last_box.w").cast("long").alias("last_w"))


@query(_DETECTIONS + """, fr AS (SELECT DISTINCT l_orderkey AS v, l_linenumber * 0.49::DOUBLE AS ft FROM lineitem)
SELECT fr.v, round(ft * 100)::BIGINT AS ft, track, min(t)::BIGINT AS t FROM fr JOIN b ON b.v = fr.v AND abs(t - ft) <= 0.05 + 1e-9 GROUP BY fr.v, ft, track""")
def boxes_at_frames(read):
    """PF21, JN11, GE6: the first box of each track near each frame."""
    boxes = _tracks(read).select("video_id", "track_id", F.explode("boxes").alias("b")).select("video_id", "track_id", "b.*")
    frames = read("lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") * F.lit(0.49)).cast("double").alias("frame_t")).distinct()
    return video.boxes_at(frames, boxes).select(F.col("video_id").alias("v"), F.round(F.col("frame_t") * 100).cast("long").alias("ft"), F.col("track_id").alias("track"), F.col("t").cast("long").alias("t"))


@query("""WITH b AS (SELECT l_orderkey AS video_id, (l_linenumber % 3)::INTEGER AS t, (l_partkey % 20 * 5)::INTEGER AS x, (l_suppkey % 10 * 5)::INTEGER AS y, 20 + (l_quantity::BIGINT % 3)::INTEGER * 10 AS w, 20 + (l_linenumber % 4)::INTEGER * 10 AS h FROM lineitem)
SELECT video_id, t, 'T' || lpad(r::VARCHAR, 2, '0') AS track_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY w * h DESC, x, y, w, h) AS r FROM b WHERE w * h >= 500) WHERE r <= 5""")
def blob_tracks(read):
    """GE4, TK8: the largest boxes of a frame are its tracks."""
    b = read("lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") % 3).cast("int").alias("t"), (F.col("l_partkey") % 20 * 5).cast("int").alias("x"), (F.col("l_suppkey") % 10 * 5).cast("int").alias("y"), (20 + F.col("l_quantity").cast("long") % 3 * 10).cast("int").alias("w"), (20 + F.col("l_linenumber") % 4 * 10).cast("int").alias("h"))
    return video.blob_tracks(b).select("video_id", "t", "track_id", "x", "y")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(greatest(0, least(1, least(a, c) / 595.0)), 9)::DOUBLE AS left_, round(greatest(0, least(1, abs(c - a) / 595.0)), 9)::DOUBLE AS width, round(greatest(0, least(1, abs(d - b) / 842.0)), 9)::DOUBLE AS height, round_even(b * 25.0, 0)::BIGINT AS frame
FROM (SELECT *, l_quantity::DOUBLE * 20 AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE * 9000 AS c, l_linenumber * 150.0::DOUBLE AS d FROM lineitem)""")
def page_boxes(read):
    """MA8, SC14: boxes as shares of a page, and frames of instants."""
    n = read("lineitem").withColumns({"a": F.col("l_quantity").cast("double") * 20, "b": F.col("l_discount").cast("double"), "c": F.col("l_tax").cast("double") * 9000, "d": (F.col("l_linenumber") * 150).cast("double")})
    box = numbers.page_fractions(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(None).cast("double"), F.lit(0.0))
    return n.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(box["left"], 9).alias("left_"), F.round(box["width"], 9).alias("width"), F.round(box["height"], 9).alias("height"), numbers.frame_index(F.col("b"), F.lit(25.0)).alias("frame"))


@query("""SELECT doc_id, round(CASE WHEN o > 0 AND n > 1.3 * o THEN greatest(12 * least(o / greatest(n, 1)::DOUBLE, 0.85), 8) ELSE 12 END, 6)::DOUBLE AS docx, round(CASE WHEN o > 0 AND n > 1.15 * o THEN greatest(12 * least(o / greatest(n, 1)::DOUBLE, 0.75), 10) ELSE 12 END, 6)::DOUBLE AS pptx
FROM (SELECT doc_id, length(text[1:60]) AS o, length(text[1:40 + doc_id % 50]) AS n FROM documents WHERE text IS NOT NULL)""")
def fonts(read):
    """MA9: fonts shrink as texts grow."""
    d = read("documents").where("text is not null").select("doc_id", F.substring("text", 1, 60).alias("o"), F.expr("substring(text, 1, int(40 + doc_id % 50))").alias("n"))
    return d.select("doc_id", *(F.round(numbers.scaled_font(F.lit(12.0), F.col("o"), F.col("n"), k), 6).alias(k) for k in ("docx", "pptx")))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M') AS stamp FROM events")
def minute_stamps(read):
    """DT3."""
    return read("events").select("event_id", rules.minute_stamp(F.col("ts")).alias("stamp"))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('chunk-' || doc_id)) AS h FROM documents)""")
def chunk_ids(read):
    """HA2: version 5 identifiers."""
    return read("documents").select("doc_id", numbers.uuid5(F.concat(F.lit("chunk-"), "doc_id")).alias("id"))


@query("""SELECT count(*) AS segments, round(avg(doc_id % 5), 1) AS avg_frames, sum(doc_id % 3)::BIGINT AS tracks FROM documents""")
def segments_summary(read):
    """AG12, AG16."""
    fill = lambda n: F.slice(F.array(*map(F.lit, range(5))), F.lit(1), (F.col("doc_id") % n).cast("int"))
    return assembly.pipeline_summary(read("documents").select(fill(5).alias("frame_times"), fill(3).alias("tracks"))).select("segments", "avg_frames", F.col("tracks").cast("long").alias("tracks"))


# --- texts ---------------------------------------------------------------------------------------

@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
r AS (SELECT doc_id, 0 AS k, i, l[i] AS content FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM p) UNION ALL SELECT doc_id, 1, i, 'table ' || l[i] FROM (SELECT *, unnest(generate_series(1, least(len(l), 2))) AS i FROM p))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, content FROM r""")
def chunks_renumbered(read):
    """SC9, SO1: chunks of several kinds, numbered anew."""
    one = chunking.paragraph_chunks(read("documents"), "\n")
    two = one.where("chunk_index < 2").withColumn("content", F.concat(F.lit("table "), "content"))
    return chunking.renumbered([one, two]).select("doc_id", "chunk_index", "total_chunks", "content")


@query("""SELECT n_nationkey, '| Name | Key |' || chr(10) || '|---|---|' || chr(10) || '| ' || n_name || ' | ' || n_nationkey || ' |' AS markdown, 2 AS rows FROM nation""")
def tables_as_markdown(read):
    """ST-5, ST-6, ST-7: tables of a page, as lines and back."""
    html = F.concat(F.lit("<p>x</p><table><tr><th>Name</th><th> Key </th></tr><tr><td><b>"), "n_name", F.lit("</b></td><td>"), "n_nationkey", F.lit("</td></tr></table>"))
    n = read("nation").select("n_nationkey", web.table_records(html, "markdown")[0]["markdown"].alias("markdown"))
    return n.select("n_nationkey", "markdown", F.size(web.markdown_rows(F.col("markdown"))).alias("rows"))


def _titles_sql() -> str:
    """The wrapping taken off step by step, in SQL."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    bare = strip(f"""regexp_replace(regexp_replace({strip("raw")}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')""")
    marked = "u"
    for pattern in text.TITLE_MARKUP:
        marked = f"regexp_replace({marked}, '{pattern}', '\\1', 'g')"
    short = f"regexp_replace({strip(f"replace({marked}, '#', '')")}, '\\s+', ' ', 'g')[1:60]"
    return f"""WITH r AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN '' ELSE '"Title: **' || replace(text, chr(10), ' ') || '**"' END AS raw FROM conversations),
q AS (SELECT conv_id, turn, {bare} AS q FROM r), u AS (SELECT conv_id, turn, CASE WHEN starts_with(lower(q), 'title:') THEN {strip("q[7:]")} ELSE q END AS u FROM q)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'Untitled' ELSE t END AS title, turn % 5 IN (0, 1, 2) AS plain FROM (SELECT conv_id, turn, {short} AS t FROM u)"""


@query(_titles_sql())
def titles(read):
    """ST-12, ST-13, ST-34: a model's title without its wrapping; titles that stand for none."""
    c = read("conversations")
    raw = F.concat(F.lit('"Title: **'), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('**"'))
    raw = F.when(F.trim(F.col("text")) == "", F.lit("")).otherwise(raw)
    plain = F.when(F.col("turn") % 5 == 0, F.lit(None).cast("string")).when(F.col("turn") % 5 == 1, "Untitled").when(F.col("turn") % 5 == 2, "Chat with x").when(F.col("turn") % 5 == 3, "chat with x").otherwise("y")
    return c.select("conv_id", "turn", text.clean_title(raw).alias("title"), text.is_default_title(plain).alias("plain"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE text END AS caption, CASE WHEN doc_id % 3 = 0 THEN [lang, source] ELSE []::VARCHAR[] END AS events, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS n_notes FROM documents""")
def vision_payloads(read):
    """ST-21, JS2: replies that hold a document's text as an object, in a fence or bare, read as VARIANT."""
    d = read("documents")
    whole = F.to_json(F.struct(F.col("text").alias("caption"), F.array("lang", "source").alias("events")))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.col("text").alias("caption"))), F.lit("\n```"))
    noted = F.to_json(F.struct(F.array(F.lit("seen")).alias("notes"), F.struct("lang").alias("caption_of")))
    reply = F.when(F.col("doc_id") % 3 == 0, whole).when(F.col("doc_id") % 3 == 1, fenced).otherwise(noted)
    out = assembly.vision_replies(d.select("doc_id", reply.alias("reply")))
    return out.select("doc_id", "caption", "events", F.size("notes").alias("n_notes"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN '' ELSE 'why' END AS reasoning, CASE turn % 4 WHEN 0 THEN 'so' WHEN 1 THEN 'pre' WHEN 2 THEN 'after' END AS caption FROM conversations""")
def thinking(read):
    """ST-17, ST-18: a model's thinking apart from its answer."""
    raw = F.when(F.col("turn") % 4 == 0, "<think> why </think><answer> so </answer>").when(F.col("turn") % 4 == 1, "pre<think>why").when(F.col("turn") % 4 == 2, "why</think> <summary>after</summary>").otherwise("nothing of it")
    b = text.think_block(raw)
    return read("conversations").select("conv_id", "turn", b["reasoning"].alias("reasoning"), b["caption"].alias("caption"))


@query("""SELECT conv_id, turn, 'b' || turn AS one, 'x' || chr(10) || 'y' AS two, '{"a": 1}' AS fenced, CASE turn % 4 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'not_found' WHEN 2 THEN 'unauthorised' ELSE 'other' END AS kind, CASE WHEN turn % 2 = 0 THEN 'plain' ELSE 'p1p2' END AS reply, 'cut off "here" ' || turn AS caption, CASE WHEN turn % 2 = 0 THEN 'Say 7 to ' || role ELSE 'Say {what}' END AS prompt FROM conversations""")
def replies(read):
    """ST-11, ST-22, ST-33, ST-32, ST-20, ST-24, ST-25: what models and services answer, and prompts."""
    c = read("conversations").withColumn("said", F.concat(F.lit("[1]: a\n[2]: x\ny\n[1]: b"), "turn"))
    found = text.segment_replies(F.col("said"))
    error = F.when(F.col("turn") % 4 == 0, "Connection refused").when(F.col("turn") % 4 == 1, "HTTP 404").when(F.col("turn") % 4 == 2, "HTTP 401").otherwise("bad luck")
    cut = F.concat(F.lit('{"caption": "cut off \\"here\\" '), "turn")
    prompt = F.when(F.col("turn") % 2 == 0, text.fill_template("Say {n} to {who}", {"n": F.lit(7), "who": F.col("role")})).otherwise(text.fill_template("Say {what}", {"n": F.lit(7)}))
    return c.select("conv_id", "turn", found["1"].alias("one"), found["2"].alias("two"), text.strip_code_fence(F.lit('```json\n{"a": 1}\n```')).alias("fenced"), text.error_kind(error).alias("kind"), rules.reply_text(F.when(F.col("turn") % 2 == 0, "plain"), F.array(F.lit("p1"), F.lit("p2"))).alias("reply"), text.salvaged_caption(cut).alias("caption"), prompt.alias("prompt"))


_LABELS = ["Section_Header", "figure caption", "FOOTNOTE", "list-item", "table", "Picture", "paragraph", "title"]


@query(f"SELECT p_partkey, ['header', 'caption', 'footnote', 'list_item', 'table', 'picture', 'body', 'header'][p_partkey % 8 + 1] AS kind FROM part WHERE {picked('p_partkey', *_LABELS)} <> ''")
def text_types(read):
    """ST-28: kinds of text by parts of a label, the first rule that fits."""
    return read("part").select("p_partkey", text.text_type(pick("p_partkey", *_LABELS)).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cap' || chr(10) || '{"e":1}' || chr(10) || 'line' ELSE '(no content)' END AS indexed, 'Segment of ' || p_partkey || ' from 1.5s to ' || printf('%.1f', p_size::DOUBLE) || 's in 10 frames.' AS stub, CASE WHEN p_partkey % 2 = 0 THEN 'cap' || chr(10) || chr(10) || '|a|' ELSE '|a|' END AS embed, CASE WHEN p_partkey % 2 = 0 THEN '[{"id":"T1"}]' ELSE '[]' END AS tracks FROM part""")
def segment_texts(read):
    """ST-23, PF15, ST-35, ST-29, JS1: texts of segments and tables, tracks as JSON."""
    cap = F.when(F.col("p_partkey") % 2 == 0, "cap")
    indexed = video.index_text(cap, F.when(cap.isNotNull(), F.array(F.lit('{"e":1}'))), F.lit(None).cast("array<string>"), F.lit(" "), F.when(cap.isNotNull(), "(none)\nline\n(error: x)"))
    tracks = F.when(cap.isNotNull(), F.array(F.struct(F.lit("T1").alias("id"))))
    return read("part").select("p_partkey", indexed.alias("indexed"), video.stub_caption(F.col("p_partkey").cast("string"), F.lit(1.5), F.col("p_size").cast("double"), F.lit(10)).alias("stub"), assembly.table_embed_text(cap, F.lit("|a|")).alias("embed"), assembly.tracks_json(tracks).alias("tracks"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS found, CASE turn % 3 WHEN 0 THEN 0.8 WHEN 2 THEN 0.5 END::DOUBLE AS confidence, list_concat([1, 2], [3, 4][:greatest(turn % 5 - 2, 0)])[:turn % 5] AS padded FROM conversations""")
def model_lists(read):
    """JS4, GR2, JS5: entities of a model's reply, and lists made as long as the originals."""
    reply = F.when(F.col("turn") % 3 == 0, '[{"entity": "a", "type": "t"}, {"entity": "b", "type": "u", "confidence": 0.9}, {"type": "x"}]').when(F.col("turn") % 3 == 1, "no list").otherwise('[{"entity": "c", "type": "t", "confidence": 0.5}]')
    found = assembly.parsed_entities(reply)
    old = F.slice(F.array(F.lit(0), F.lit(0), F.lit(3), F.lit(4)), F.lit(1), (F.col("turn") % 5).cast("int"))
    return read("conversations").select("conv_id", "turn", F.size(found).alias("found"), F.get(found, F.lit(0))["confidence"].alias("confidence"), subtitles.reconciled(F.array(F.lit(1), F.lit(2)), old).alias("padded"))


# --- job states ----------------------------------------------------------------------------------

@query("""SELECT user_id AS job_id, max(event_id) AS ts, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_id % 3 = 0) AS done FROM events GROUP BY user_id""")
def job_states(read):
    """SK12, SM1: the last value given of every field; a null changes nothing."""
    e = read("events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ts"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("done"))
    return jobs.status_fields(e)


@query(f"""WITH e AS (SELECT user_id AS job_id, event_id AS ts, {picked('event_id', *jobs.STATES, 'what')} AS status FROM events)
SELECT job_id, ts, status, lag(status) OVER p AS before, status <> 'what' AND coalesce(lag(status) OVER p NOT IN ('completed', 'failed', 'cancelled'), true) AS valid FROM e WINDOW p AS (PARTITION BY job_id ORDER BY ts)""")
def job_transitions(read):
    """SM1: steps of jobs, and whether each may follow."""
    e = read("events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ts"), pick("event_id", *jobs.STATES, "what").alias("status"))
    return jobs.transitions(e)
