"""Readers of landed JSON, one document per line.

Where order matters (a later entry replaces an earlier one) the documents of one file must differ in
``StartIndex``, the offset their page was requested with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark import schemas


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def playback_log(spark: SparkSession, path: str, num_days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Events of documents shaped {user name: [event, ...]}.

    ``num_days`` keeps events dated within that many days up to ``as_of`` (default: today). A user's
    events may be spread over any number of documents, so no single line has to hold them all.
    """
    # A JSON object with free keys is a map; as plain text per line it parses with the map's schema.
    documents = spark.read.text(path).select(
        F.from_json("value", schemas.PLAYBACK_LOG, {"mode": "FAILFAST"}).alias("log")
    )
    events = (
        documents.select(F.explode("log").alias("log_user", "events"))
        .select(F.explode("events").alias("event"))
        .select("event.*")
    )
    if num_days is None:
        return events
    until = F.lit(as_of).cast("date") if as_of else F.current_date()
    return events.where(F.to_date("date").between(F.date_sub(until, num_days), until))


def _in_place(spark: SparkSession, path: str, schema, items: str) -> DataFrame:
    """One row per list element, as ``_item``, with ``ingest_seq``, its place in the input.

    Places compare by the page's start index, then file name, then the position on the page.
    """
    pages = _read(spark, path, schema).select(
        F.coalesce("StartIndex", F.lit(0)).cast("long").alias("_start"),
        F.col("_metadata.file_path").alias("_file"),
        items,
    )
    return pages.select("_start", "_file", F.posexplode(items).alias("_pos", "_item")).select(
        "_item",
        F.struct(
            F.col("_start").alias("start"), F.col("_file").alias("file"), F.col("_pos").alias("pos")
        ).alias("ingest_seq"),
    )


def catalog_pages(spark: SparkSession, path: str) -> DataFrame:
    """Items of all pages with ``ingest_seq``."""
    return _in_place(spark, path, schemas.CATALOG_PAGE, "Items").select("_item.*", "ingest_seq")


def catalog_totals(spark: SparkSession, path: str) -> DataFrame:
    """Items received and items announced; they differ when a page is missing.

    A page that landed twice counts once, so it can't make up for a missing one.
    """
    pages = _read(spark, path, schemas.CATALOG_PAGE).select(
        # A page without a start index is a page of its own.
        F.coalesce(
            F.col("StartIndex").cast("string"),
            F.concat(F.col("_metadata.file_path"), F.lit("#"), F.monotonically_increasing_id()),
        ).alias("page"),
        F.coalesce(F.size("Items"), F.lit(0)).cast("long").alias("items"),
        "TotalRecordCount",
    )
    each = pages.groupBy("page").agg(F.max("items").alias("items"), F.max("TotalRecordCount").alias("announced"))
    return each.agg(F.sum("items").alias("items_received"), F.max("announced").alias("items_announced"))


def series_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One document per series; of repeated documents for a series one is kept."""
    documents = _read(spark, path, schemas.SERIES_METADATA)
    body = F.struct("GenreItems", "Genres")
    return (
        documents.groupBy("Id")
        .agg(F.max_by(body, F.md5(F.to_json(body).cast("binary"))).alias("_body"))
        .select("Id", "_body.GenreItems", "_body.Genres")
    )


def users(spark: SparkSession, path: str) -> DataFrame:
    """User name to id; of a repeated name the last entry wins."""
    entries = _in_place(spark, path, schemas.USERS, "Items")
    return entries.groupBy(F.col("_item.Name").alias("user_name")).agg(
        F.max_by("_item.Id", "ingest_seq").alias("user_id")
    )


def media_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folder name (or its collection type, or its id) to folder id; the last of a name wins."""
    entries = _in_place(spark, path, schemas.MEDIA_FOLDERS, "Items")
    empty = F.lit("")
    name = F.coalesce(
        F.nullif("_item.Name", empty), F.nullif("_item.CollectionType", empty), F.col("_item.Id")
    )
    return entries.groupBy(name.alias("folder_name")).agg(F.max_by("_item.Id", "ingest_seq").alias("folder_id"))


def ref_genres(spark: SparkSession, path: str) -> DataFrame:
    """Genre list entries with ``ingest_seq``."""
    return _in_place(spark, path, schemas.REF_GENRES, "genres").select("_item.id", "_item.name", "ingest_seq")
