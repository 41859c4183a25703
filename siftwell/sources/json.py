"""JSON in and out: strict parsing, replies of reviewers, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict(text: Column) -> Column:
    """text as a VARIANT; null unless it is valid JSON without repeated keys."""
    return F.try_parse_json(text)


def fenced(text: Column) -> Column:
    """The one fenced block of a reply, or the whole of a reply without one; null if there are several."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    return F.when(F.size(blocks) == 0, text).when(F.size(blocks) == 1, F.get(blocks, 0))


def replies(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """(batch_id, photo_id, rating, issue) for every photo that was asked for or answered.

    batches (batch_id, photo_ids), answers (batch_id, text) with [{"photo_id": .., "rating": ..}]. An answer is used
    only with a null issue; else issue says why: unreadable, repeated, unexpected, rating, missing.
    """
    parsed = answers.select("batch_id", F.from_json(fenced(F.col("text")), "array<struct<photo_id: string, rating: string>>").alias("rows"))
    rows = parsed.select("batch_id", F.explode_outer("rows").alias("r")).select("batch_id", "r.*")
    bad = rows.where("photo_id is null").select("batch_id", F.lit(None).cast("string").alias("photo_id"), F.lit(None).cast("int").alias("rating"), F.lit("unreadable").alias("issue"))
    given = rows.where("photo_id is not null").groupBy("batch_id", "photo_id").agg(F.count("*").alias("n"), F.min("rating").alias("rating"))
    asked = batches.select("batch_id", F.explode("photo_ids").alias("photo_id")).distinct().withColumn("asked", F.lit(True))
    both = asked.join(given, ["batch_id", "photo_id"], "full_outer")
    rating = F.when(F.col("rating").rlike("^[0-5]$"), F.col("rating").cast("int"))
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(rating.isNull(), "rating")
    return both.select("batch_id", "photo_id", F.when(issue.isNull(), rating).alias("rating"), issue.alias("issue")).unionByName(bad)


def whole(replies: DataFrame) -> DataFrame:
    """Rows of batches without any issue: all or nothing."""
    good = replies.groupBy("batch_id").agg(F.bool_and(F.col("issue").isNull()).alias("ok")).where("ok").select("batch_id")
    return replies.join(good, "batch_id", "left_semi")


def export(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The allowed columns as JSON lines; what is not listed never leaves."""
    rows.select(*columns).write.mode("errorifexists").json(path)
