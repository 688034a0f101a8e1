"""Listings and figures over users, agents, conversations, messages and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import is_video


def usage(messages: DataFrame, conversations: DataFrame, translations: DataFrame, user_id: int) -> DataFrame:
    """One row: prompts, input_tokens, output_tokens, total_tokens of a user."""
    mine = messages.join(conversations.where(F.col("user_id") == user_id).select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    spoken = mine.agg(F.count_if(F.col("role") == "user").alias("prompts"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("input_tokens"))), F.lit(0)).alias("i"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("output_tokens"))), F.lit(0)).alias("o"))
    jobs = translations.where(F.col("user_id") == user_id).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("ti"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("to"))
    both = spoken.crossJoin(jobs)  # one row by one row
    return both.select("prompts", (F.col("i") + F.col("ti")).alias("input_tokens"), (F.col("o") + F.col("to")).alias("output_tokens"), (F.col("i") + F.col("ti") + F.col("o") + F.col("to")).alias("total_tokens"))


def with_count(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """Parents with how many children each has."""
    n = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").na.fill(0, [name])


def looked_up(rows: DataFrame, other: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """Rows with ``value`` of their match in ``other`` (key, value), or the default."""
    return rows.join(other.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def with_availability(agents: DataFrame, models: DataFrame) -> DataFrame:
    """Agents with model_available: whether their llm_model is given and in the catalogue (id)."""
    known = models.select(F.col("id").alias("llm_model")).distinct().withColumn("__there", F.lit(True))
    return agents.join(known, "llm_model", "left").withColumn("model_available", F.coalesce("__there", F.lit(False))).drop("__there")


def visible(owner: Column, public: Column, user_id: int) -> Column:
    return F.coalesce(owner == user_id, F.lit(False)) | F.coalesce(public, F.lit(False))


def optional(rows: DataFrame, **equal: object) -> DataFrame:
    """Filters only by what is given (0 and '' are not)."""
    for k, v in equal.items():
        if v:
            rows = rows.where(F.col(k) == v)
    return rows


def with_live_status(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """Jobs with the live status of their queue entry (payload's redis_job_id) where one
    exists: only of ingestion jobs, and only where it is not empty."""
    entry = F.when(F.col("job_type").startswith("ingestion_"), F.get_json_object("payload", "$.redis_job_id"))
    now = live.select(F.col("redis_job_id").alias("__id"), F.col("status").alias("__status"), F.col("completed_at").alias("__done"))
    out = jobs.withColumn("__entry", entry).join(now, F.col("__entry") == F.col("__id"), "left")
    done = F.coalesce(F.try_to_timestamp(F.nullif("__done", F.lit(""))), F.col("completed_at"))
    return out.withColumns({"status": F.coalesce(F.nullif("__status", F.lit("")), "status"), "completed_at": done}).drop("__entry", "__id", "__status", "__done")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (what a unique constraint would refuse)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans_removed(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is null or has a parent."""
    ids = parents.select(F.col(parent_key).alias("__k")).distinct()
    return rows.where(F.col(key).isNull()).unionByName(rows.join(ids, F.col(key) == F.col("__k"), "left_semi"))


def missing(requested: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(rows.select(key), key, "left_anti")


def updated(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns that a change sets replace the old ones; null changes nothing."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in names))
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in names}).select(*rows.columns)


def backfilled(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and the new ones whose key is not there yet."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def may_requeue(status: Column) -> Column:
    return status.isin("pending", "failed")


def may_cancel(status: Column) -> Column:
    return ~status.isin("completed", "cancelled")


def threads(messages: DataFrame, depth: int | None = None) -> DataFrame:
    """id, root, depth of every message in its tree (id, parent_id), parents first; up
    to ``depth`` levels if it is given."""
    from itertools import count

    from ..sources.tables import checkpointed, discard

    front = out = checkpointed(messages.where("parent_id is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth")))
    for level in count(1) if depth is None else range(1, depth + 1):
        below = messages.join(front.select(F.col("id").alias("parent_id"), "root"), "parent_id").select("id", "root", F.lit(level).alias("depth"))
        front = checkpointed(below.join(out.select("id", "root"), ["id", "root"], "left_anti"))  # ends, even where repeated ids make a ring
        if front.isEmpty():
            break
        old, out = out, checkpointed(out.unionByName(front))
        discard(old)
    return out


def through(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, name: str, most: int | None = None) -> DataFrame:
    """Rows of ``left`` with the values of ``right`` that a bridge (left_key, right_key) ties to
    them, sorted, repeats once; an empty array without any.  ``most`` bounds a list."""
    values = bridge.select(left_key, right_key).distinct().join(right.select(right_key, F.col(value).alias("__v")), right_key)
    lists = values.groupBy(left_key).agg(F.array_sort(F.collect_set("__v")).alias(name))
    out = left.join(lists, left_key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out if most is None else out.withColumn(name, F.slice(name, 1, most))


def parents(messages: DataFrame) -> DataFrame:
    """id, parent_id, parent_text of messages (id, parent_id, text) by a self join; null without a parent."""
    other = messages.select(F.col("id").alias("parent_id"), F.col("text").alias("parent_text"))
    return messages.select("id", "parent_id").join(other, "parent_id", "left").select("id", "parent_id", "parent_text")


def lowered(rows: DataFrame, column: str, known: list[str] | None = None) -> DataFrame:
    """A column in lower case; a value that is none of ``known`` then is an error."""
    low = F.lower(column)
    if known is not None:
        low = F.when(low.isNull() | low.isin(*known), low).otherwise(F.raise_error(F.concat(F.lit(f"{column} has an unknown value: "), low)).cast("string"))
    return rows.withColumn(column, low)


def filled(rows: DataFrame, **defaults: object) -> DataFrame:
    """Given values in place of nulls."""
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a key that occurs more than once is an error when they are read."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    named = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    checked = n.select(*keys, F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not unique: "), named)).cast("boolean")).alias("__ok"))
    return rows.join(checked, keys).where("__ok").select(*rows.columns)


def jobs_deleted(documents: DataFrame, jobs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) after the jobs of ``gone`` (id) are deleted: a document of a deleted ingestion job has failed."""
    dead = jobs.join(gone.select("id").distinct(), "id", "left_semi")
    lost = dead.where(F.col("job_type").startswith("ingestion_") & F.col("document_id").isNotNull()).select(F.col("document_id").alias("id")).distinct()
    changes = lost.select("id", F.lit("failed").alias("status"), F.lit("Job removed by user").alias("error_message"))
    return updated(documents, changes), jobs.join(gone.select("id").distinct(), "id", "left_anti")


def with_metadata(rows: DataFrame, column: str = "metadata", **fields: str) -> DataFrame:
    """Rows with a JSON object of other columns where ``column`` is null."""
    return rows.withColumn(column, F.coalesce(column, F.to_json(F.struct(*(F.col(c).alias(k) for k, c in fields.items())))))


def reindexed(documents: DataFrame, points: DataFrame, jobs: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, points, jobs) after the wanted documents are to be ingested again: their
    points go, they are pending with no chunks and no error, and each gets a queued job."""
    again = documents.where(F.coalesce(wanted, F.lit(False)))
    source = again.select(F.col("filename").alias("source_file")).distinct()
    changed = documents.withColumns({
        "status": F.when(F.coalesce(wanted, F.lit(False)), F.lit("pending")).otherwise(F.col("status")),
        "chunk_count": F.when(F.coalesce(wanted, F.lit(False)), F.lit(0)).otherwise(F.col("chunk_count")),
        "error_message": F.when(~F.coalesce(wanted, F.lit(False)), F.col("error_message")),
    })
    queued = again.select(F.col("id").alias("document_id"), F.concat(F.lit("ingestion_"), F.when(is_video(F.col("processing_type"), F.col("file_type")), "video").otherwise("file")).alias("job_type"), F.lit("queued").alias("status"))
    return changed, points.join(source, "source_file", "left_anti"), jobs.unionByName(queued, allowMissingColumns=True)


def prompt_changed(domains: DataFrame, given: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with ``again``: whether their domain's prompt is given anew and differs, and they are videos."""
    new = given.where("vlm_prompt is not null").select(F.col("id").alias("data_domain_id"), F.col("vlm_prompt").alias("__new"))
    old = domains.select(F.col("id").alias("data_domain_id"), F.col("vlm_prompt").alias("__old"))
    changed = old.join(new, "data_domain_id").where(~F.col("__old").eqNullSafe(F.col("__new"))).select("data_domain_id", F.lit(True).alias("__changed"))
    out = documents.join(changed, "data_domain_id", "left")
    return out.withColumn("again", F.coalesce("__changed", F.lit(False)) & is_video(F.col("processing_type"), F.col("file_type"))).select(*documents.columns, "again")
