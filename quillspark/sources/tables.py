"""Reading and writing: files, collections of vectors, merges and deletes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import file_extension

#: File extensions and the format each is read as; uploads allowed and their sizes.
FORMATS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".pptx": "pptx", ".ppt": "pptx", ".html": "html", ".htm": "html", ".md": "markdown", ".txt": "text", ".json": "json"}
MAX_BYTES, MAX_VIDEO_BYTES = 50 << 20, 500 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; where unset, a local session gets a temporary
    one, and on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str = "step") -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.checkpoint_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``checkpointed`` has given and that nothing reads any more."""
    for path in {df.checkpoint_path for df in tables if hasattr(df, "checkpoint_path")}:
        spark = tables[0].sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def decoded(content: bytes | None) -> str:
    """UTF-8 with undecodable bytes dropped."""
    return (content or b"").decode("utf-8", "ignore")


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text of every file; bytes that are not UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoded(x) for x in batch.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return files.mapInArrow(run, "path string, text string")


def rendered(value: object, depth: int = 0) -> list[str]:
    """Lines of a JSON value: ``key: value``, nested ones indented by two blanks a
    level, list items as ``- item``, nested items under ``[i]:``."""
    pad, out = "  " * depth, []
    if isinstance(value, dict):
        for k, v in value.items():
            out += [f"{pad}{k}:", *rendered(v, depth + 1)] if isinstance(v, (dict, list)) else [f"{pad}{k}: {v}"]
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += [f"{pad}[{i}]:", *rendered(v, depth + 1)] if isinstance(v, (dict, list)) else [f"{pad}- {v}"]
    else:
        out.append(f"{pad}{value}")
    return out


def json_texts(df: DataFrame, column: str, out: str = "text") -> DataFrame:
    """A readable text of every JSON document; null where it is not JSON."""
    import json

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else "\n".join(rendered(json.loads(x)))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(column)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(x) for x in batch.column(at).to_pylist()], pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def json_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path, text: a readable text of every JSON file; bytes that are not UTF-8, or no JSON, are an error when read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    strict = F.when(F.expr("is_valid_utf8(decode_bytes)"), F.expr("string(decode_bytes)")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")).cast("string"))
    rows = json_texts(files.withColumn("decode_bytes", F.col("content")).select("path", strict.alias("json")), "json")
    return rows.select("path", F.coalesce("text", F.raise_error(F.concat(F.lit("no JSON: "), "path")).cast("string")).alias("text"))


def drop_collection(spark: SparkSession, path: str, name: str) -> bool:
    """Deletes a collection's files; False if there are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/collection={name}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def file_format(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in FORMATS.items() for x in (k[1:], v)))
    return F.element_at(known, file_extension(name))


def may_upload(name: Column, size: Column) -> Column:
    ext = file_extension(name)
    return F.when(ext == "mp4", size <= MAX_VIDEO_BYTES).when(file_format(name).isNotNull(), size <= MAX_BYTES).otherwise(F.lit(False))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, those of ``new`` in place of old ones with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of every key."""
    names = [c for c in rows.columns if c not in (key, version)]
    return rows.groupBy(key).agg(F.max(F.struct(version, *names)).alias("r")).select(key, "r.*").select(*rows.columns)


def without(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows where not all of the given columns have the given values (null is no match)."""
    match = F.lit(True)
    for k, v in equal.items():
        match = match & F.coalesce(F.col(k) == v, F.lit(False))
    return rows.where(~match)


def must_match(conditions: dict[str, object]) -> Column:
    out = F.lit(True)
    for k, v in conditions.items():
        out = out & (F.col(k) == v)
    return out


def write_collection(points: DataFrame, path: str, dim: int) -> None:
    """Points (collection, id, vector, …), a folder for each collection; vectors of another length are an error."""
    checked = points.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"vector is not of length {dim}"))))
    checked.write.partitionBy("collection").mode("append").parquet(path)


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("collection") == name)


def collection_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("collection").agg(F.count("*").alias("points"))


def create_collection(spark: SparkSession, path: str, name: str, schema: str) -> bool:
    """An empty collection of the given columns; False if it is there already."""
    if exists(spark, f"{path}/collection={name}"):
        return False
    spark.createDataFrame([], schema).write.parquet(f"{path}/collection={name}")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).limit(1).count()
    except AnalysisException:
        return False
    return True


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


#: Fixed value: chunks of a listing, at most.
LISTED = 10_000


def listing(points: DataFrame, limit: int = 20, offset: int = 0, cap: int = LISTED) -> DataFrame:
    """A page of a collection's chunks in document order, with total and has_more.  Points
    have id, source_file, chunk_index and t_start; of more than ``cap`` the first by id are listed."""
    some = points.orderBy("id").limit(cap)
    total = some.agg(F.count("*").alias("total"))
    order = [F.lower(F.coalesce("source_file", F.lit(""))), F.coalesce(F.col("chunk_index").cast("double"), F.col("t_start").cast("double"), F.lit(0.0)), "id"]
    shown = page(some, order, limit, offset)
    return shown.crossJoin(total).crossJoin(shown.agg(F.count("*").alias("__n"))).withColumn("has_more", F.col("total") > F.lit(offset) + F.col("__n")).drop("__n")  # rows of one


def scrolled(points: DataFrame, limit: int = 20, after: object = None, with_vectors: bool = False) -> tuple[DataFrame, object]:
    """The next points by id after a cursor (null at the start), and the cursor of the page after them (null at the end)."""
    rows = points if with_vectors else points.drop("vector")
    rows = rows if after is None else rows.where(F.col("id") > F.lit(after))
    shown = rows.orderBy("id").limit(limit)
    last = shown.agg(F.max("id"), F.count("*")).collect()[0]
    more = last[1] == limit and not rows.where(F.col("id") > F.lit(last[0])).isEmpty()
    return shown, last[0] if more else None


def clip_of(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, clip_key, problem of asked points (id): ``Point not found.`` or ``No clip available
    for this point.`` where there is none."""
    have = points.select("id", F.col("clip_key").alias("__k"), F.lit(True).alias("__there"))
    out = wanted.select("id").join(have, "id", "left")
    key = F.nullif("__k", F.lit(""))
    return out.select("id", key.alias("clip_key"), F.when(F.col("__there").isNull(), "Point not found.").when(key.isNull(), "No clip available for this point.").alias("problem"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, number (from 0, in its file) and line of every line of text files of any size.

    Files are read in blocks of bytes, a task for some of them.  The lines of every block are
    counted first; a line's number is the sum over the blocks before its own, and its place
    within it, which the task counts as it reads.
    """
    block = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    counts = checkpointed(spark.read.text(path).select(*block).groupBy("path", "block").agg(F.count("*").alias("n")), "blocks")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            place = []
            for at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = seen + 1 if at == last else 0
                last = at
                place.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=["path", "block", "line", "place"])

    lines = spark.read.text(path).select(*block, F.col("value").alias("line")).mapInArrow(run, "path string, block long, line string, place long")
    first = F.coalesce("first", F.raise_error(F.lit("a file has changed while it was read")).cast("long"))
    return lines.join(starts, ["path", "block"], "left").select("path", (first + F.col("place")).alias("number"), "line")


def jsonl_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, chunk_idx (the number of the line in its file, blank ones counted) and the
    fields of every line that is not blank."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    return lines.select("path", F.col("number").alias("chunk_idx"), F.from_json("line", schema).alias("r")).select("path", "chunk_idx", "r.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def cascade(rows: dict[str, DataFrame], links: list[tuple[str, str, str, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without deleted rows and all that hang on them.  ``links``: (child, its
    column, parent, its key) from the top down; ``gone``: keys deleted at the start."""
    out = dict(rows)
    lost = dict(gone)
    for child, column, parent, key in links:
        if parent not in lost:
            continue
        dead = lost[parent].select(F.col(key).alias(column)).distinct()
        own = rows[child].join(dead, column, "left_semi")
        lost[child] = lost[child].unionByName(own, allowMissingColumns=True) if child in lost else own
    for name, dead in lost.items():
        key = next((k for _, _, p, k in links if p == name), "id")
        out[name] = rows[name].join(dead.select(key).distinct(), key, "left_anti")
    return out


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
