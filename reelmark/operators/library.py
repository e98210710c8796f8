"""Catalogue items to the library, genre, tag and provider tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions import scalars as fn
from reelmark.plans.joins import lookup_join, measured_join

# The media server counts runtime in ticks of 100 ns.
TICKS_PER_SECOND = 10_000_000
TICKS_PER_MINUTE = 600_000_000.0


def filter_item_types(
    items: DataFrame, item_types: tuple[str, ...] = ("Movie", "Episode"), parent_id: str | None = None
) -> DataFrame:
    kept = items.where(F.col("Type").isin(*item_types))
    return kept.where(F.col("ParentId") == parent_id) if parent_id else kept


def _first_video(streams: str = "MediaStreams") -> Column:
    return F.get(F.filter(streams, lambda s: s["Type"] == "Video"), F.lit(0))


def first_video_stream(items: DataFrame) -> DataFrame:
    """Add ``video_codec``: the first video stream's codec, '' when there is no video stream."""
    video = _first_video()
    return items.withColumn("video_codec", F.when(video.isNull(), "").otherwise(video["Codec"]))


def resolution_fallback(items: DataFrame) -> DataFrame:
    """Add the resolution: where the item lacks a dimension, the missing or zero ones come from its video."""
    video = _first_video()
    lacking = (F.col("Width").isNull() | F.col("Height").isNull()) & video.isNotNull()

    def pick(name: str) -> Column:
        own = F.col(name)
        return F.when(lacking, F.coalesce(F.nullif(own, F.lit(0)), video[name])).otherwise(own)

    return items.withColumn("resolution_width", pick("Width")).withColumn("resolution_height", pick("Height"))


def generated_columns(library: DataFrame) -> DataFrame:
    """Runtime in whole seconds and in minutes, from ticks."""
    ticks = F.col("runtime_ticks")
    return library.withColumn(
        "runtime_seconds", F.call_function("div", ticks, F.lit(TICKS_PER_SECOND).cast("long"))
    ).withColumn("runtime_minutes", ticks / F.lit(TICKS_PER_MINUTE))


def project_library_item(items: DataFrame) -> DataFrame:
    """The stored columns of each item, in ingest order (`ingest_seq`)."""
    rows = resolution_fallback(first_video_stream(items)).select(
        F.col("Id").alias("item_id"),
        F.col("Name").alias("item_name"),
        F.col("Type").alias("item_type"),
        F.col("SeriesName").alias("series_name"),
        F.col("SeriesId").alias("series_id"),
        F.col("ParentIndexNumber").alias("season_number"),
        F.col("IndexNumber").alias("episode_number"),
        F.col("RunTimeTicks").alias("runtime_ticks"),
        F.col("PremiereDate").alias("premiere_date"),
        F.col("Overview").alias("overview"),
        F.col("CommunityRating").alias("community_rating"),
        F.col("ProductionYear").alias("production_year"),
        F.col("Path").alias("file_path"),
        F.col("Container").alias("container"),
        "video_codec",
        "resolution_width",
        "resolution_height",
        "ingest_seq",
    )
    return generated_columns(rows)


# ---- genres ---------------------------------------------------------------------------


def _named(entries: Column) -> Column:
    return F.filter(F.coalesce(entries, F.array()), lambda e: fn.not_blank(e["Name"]))


def _names(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["Name"])


def _extra_names(names: Column, entries: Column) -> Column:
    """Non-blank names of a plain list, each once, without those the object list already has."""
    plain = F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), fn.not_blank))
    return F.array_except(plain, _names(_named(entries)))


def _as_entries(objects: Column, names: Column, origin: str) -> Column:
    """One list of (id, name, origin): the objects with their id, then the names still without one."""
    listed = F.transform(
        F.coalesce(objects, F.array()),
        lambda e: F.struct(
            e["Id"].cast("long").alias("id"), e["Name"].alias("name"), F.lit("object").alias("origin")
        ),
    )
    unlisted = F.transform(
        names,
        lambda n: F.struct(F.lit(None).cast("long").alias("id"), n.alias("name"), F.lit(origin).alias("origin")),
    )
    return F.concat(listed, unlisted)


def genre_source_concat(items: DataFrame) -> DataFrame:
    """Each item's genre entries: its objects as they are, then plain names not among them.

    Both lists sit in one row, so the union is an array expression and nothing is shuffled.
    """
    return items.select(
        F.col("Id").alias("item_id"),
        F.col("Type").alias("item_type"),
        F.col("SeriesId").alias("series_id"),
        "ingest_seq",
        _as_entries(
            F.col("GenreItems"), _extra_names(F.col("Genres"), F.col("GenreItems")), "item"
        ).alias("entries"),
    )


def _first_by_name(entries: Column) -> Column:
    """Entries with a name, the first of each name."""
    named = _named(entries)
    names = _names(named)
    return F.filter(named, lambda e, i: F.array_position(names, e["Name"]) == i + 1)


def series_genres(series: DataFrame) -> DataFrame:
    """Genre entries an episode inherits from its series, one row per series."""
    return series.select(
        F.col("Id").alias("series_id"),
        _as_entries(
            _first_by_name(F.col("GenreItems")), _extra_names(F.col("Genres"), F.col("GenreItems")), "series"
        ).alias("series_entries"),
    )


def series_genre_fallback(entries: DataFrame, series: DataFrame) -> DataFrame:
    """Episodes with no named genre also take their series' entries."""
    named = F.exists("entries", lambda e: fn.not_blank(e["name"]))
    wants = (F.col("item_type") == "Episode") & ~named & fn.not_blank(F.col("series_id"))
    asked = entries.withColumn("_asked", F.when(wants, F.col("series_id")))
    inherited = lookup_join(
        asked,
        series_genres(series).withColumnRenamed("series_id", "_asked"),
        "_asked",
        "left",
        salt_on=["item_id"],
    )
    return inherited.withColumn(
        "entries",
        F.when(F.col("series_entries").isNotNull(), F.concat("entries", "series_entries")).otherwise(
            F.col("entries")
        ),
    ).select(*entries.columns)


def _ids_by_name(ref_genres: DataFrame, alias: str) -> DataFrame:
    return (
        ref_genres.where(F.col("name").isNotNull())
        .groupBy(F.lower("name").alias("_key"))
        .agg(F.max("id").alias(alias))
    )


def genre_id_lookup(rows: DataFrame, movie_genres: DataFrame, tv_genres: DataFrame) -> DataFrame:
    """Fill ``genre_id`` of plain names from the reference lists, else from the name itself.

    Columns used: item_type, genre_name, genre_id, origin. Only a zero from the list that is asked
    first falls through for an item's own names; for names taken from a series either zero does.
    """
    keyed = rows.withColumn("_key", F.when(F.col("origin") != "object", F.lower("genre_name")))
    # Both lists as one: the facts, where few names make up most rows, meet it once, and in place if it is small.
    ids = _ids_by_name(movie_genres, "_movie_id").join(_ids_by_name(tv_genres, "_tv_id"), "_key", "full")
    keyed = measured_join(keyed, ids, "_key", "left", salt_on=["item_id"])
    movie, tv, zero = F.col("_movie_id"), F.col("_tv_id"), F.lit(0).cast("long")
    made = fn.stable_id(F.col("genre_name"))
    own = F.when(
        F.col("item_type") == "Episode", F.coalesce(F.nullif(tv, zero), movie, made)
    ).otherwise(F.coalesce(F.nullif(movie, zero), tv, made))
    inherited = F.coalesce(F.nullif(tv, zero), F.nullif(movie, zero), made)
    return keyed.withColumn(
        "genre_id",
        F.when(F.col("origin") == "item", own)
        .when(F.col("origin") == "series", inherited)
        .otherwise(F.col("genre_id")),
    ).drop("_key", "_movie_id", "_tv_id")


def item_genres(
    items: DataFrame, movie_genres: DataFrame, tv_genres: DataFrame, series: DataFrame | None = None
) -> DataFrame:
    """One row per genre of an item: (item_id, genre_id, genre_name)."""
    entries = genre_source_concat(items)
    if series is not None:
        entries = series_genre_fallback(entries, series)
    rows = entries.select("item_id", "item_type", "ingest_seq", F.explode("entries").alias("_e")).select(
        "item_id",
        "item_type",
        F.col("_e.id").alias("genre_id"),
        F.col("_e.name").alias("genre_name"),
        F.col("_e.origin").alias("origin"),
    )
    return genre_id_lookup(rows, movie_genres, tv_genres).select("item_id", "genre_id", "genre_name")


# ---- tags and provider ids ---------------------------------------------------------------


def _in_order(position: Column) -> Column:
    return F.struct(F.col("ingest_seq").alias("item"), position.alias("position")).alias("ingest_seq")


def tag_source_concat(items: DataFrame) -> DataFrame:
    """One row per tag of an item, objects first, then plain names; `ingest_seq` gives the order."""
    entries = _as_entries(F.col("TagItems"), _extra_names(F.col("Tags"), F.col("TagItems")), "item")
    rows = items.select(F.col("Id").alias("item_id"), "ingest_seq", F.posexplode(entries).alias("_pos", "_e"))
    return rows.select(
        "item_id",
        F.when(F.col("_e.origin") == "object", F.col("_e.id"))
        .otherwise(fn.stable_id(F.col("_e.name")))
        .alias("tag_id"),
        F.col("_e.name").alias("tag_name"),
        _in_order(F.col("_pos")),
    )


def provider_ids(items: DataFrame) -> DataFrame:
    """One row per non-empty external id of an item."""
    rows = items.select(
        F.col("Id").alias("item_id"),
        "ingest_seq",
        F.posexplode("ProviderIds").alias("_pos", "provider", "provider_item_id"),
    )
    return filter_truthy_pid(rows).select("item_id", "provider", "provider_item_id", _in_order(F.col("_pos")))


def filter_truthy_pid(rows: DataFrame) -> DataFrame:
    return rows.where(fn.not_blank(F.col("provider_item_id")))
