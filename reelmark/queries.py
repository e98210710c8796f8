"""One query per operator over the driver's tables; `oracles.py` holds the SQL to compare with."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark import adapters as data
from reelmark import schemas
from reelmark.functions import scalars as fn
from reelmark.operators import history, library, maintenance, quality, reports, similar, titles
from reelmark.plans import loads
from reelmark.session import scratch_path, tune_joins
from reelmark.sources import cache, landing, tsv
from reelmark.sources.store import TableStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIGITS = 9


def query(fn_: Query) -> Query:
    @functools.wraps(fn_)
    def tuned(spark: SparkSession, sf: str) -> DataFrame:
        tune_joins(spark)
        return fn_(spark, sf)

    QUERIES[fn_.__name__] = tuned
    return fn_


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, DIGITS) for c in columns})


# ---- shared inputs ----------------------------------------------------------------------


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return history.sessions_agg(data.raw_events(spark, sf), data.library(spark, sf), data.GAP_MINUTES)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return landing.catalog_pages(spark, data.landed_catalog(spark, sf))


def _kept_items(spark: SparkSession, sf: str) -> DataFrame:
    return library.filter_item_types(_items(spark, sf))


def _ref(spark: SparkSession, sf: str, which: str) -> DataFrame:
    return landing.ref_genres(spark, data.landed_ref_genres(spark, sf, which))


def _item_genres(spark: SparkSession, sf: str) -> DataFrame:
    return library.item_genres(
        _kept_items(spark, sf),
        _ref(spark, sf, "movie"),
        _ref(spark, sf, "tv"),
        landing.series_metadata(spark, data.landed_series(spark, sf)),
    )


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return titles.title_genre_counts(data.titles(spark, sf), data.genres(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return titles.genre_vectors(_counts(spark, sf))


def _store(spark: SparkSession, name: str) -> TableStore:
    return TableStore(spark, scratch_path(spark, name))


# ---- sources ----------------------------------------------------------------------------


@query
def src_playback_log(spark: SparkSession, sf: str) -> DataFrame:
    return landing.playback_log(spark, data.landed_playback(spark, sf))


@query
def src_playback_log_recent(spark: SparkSession, sf: str) -> DataFrame:
    return landing.playback_log(spark, data.landed_playback(spark, sf), num_days=10, as_of="2024-01-31")


@query
def src_catalog_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select(
        "Id", "Name", "Type", "SeriesId", "RunTimeTicks", "Width", "Height", "CommunityRating",
        F.size(F.coalesce("MediaStreams", F.array())).cast("long").alias("streams"),
        F.element_at("ProviderIds", "Imdb").alias("imdb_id"),
    )


@query
def src_catalog_totals(spark: SparkSession, sf: str) -> DataFrame:
    return landing.catalog_totals(spark, data.landed_catalog(spark, sf))


@query
def src_series_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return landing.series_metadata(spark, data.landed_series(spark, sf)).select(
        "Id",
        F.transform(F.coalesce("GenreItems", F.array()), lambda g: g["Id"]).cast("string").alias("genre_item_ids"),
        F.concat_ws("|", "Genres").alias("genre_names"),
    )


@query
def src_users(spark: SparkSession, sf: str) -> DataFrame:
    return landing.users(spark, data.landed_users(spark, sf))


@query
def src_media_folders(spark: SparkSession, sf: str) -> DataFrame:
    return landing.media_folders(spark, data.landed_folders(spark, sf))


@query
def src_ref_genres(spark: SparkSession, sf: str) -> DataFrame:
    both = [_ref(spark, sf, which).select(F.lit(which).alias("kind"), "id", "name") for which in ("movie", "tv")]
    return both[0].unionByName(both[1])


def _register_tsv(name: str) -> None:
    def read(spark: SparkSession, sf: str) -> DataFrame:
        rows = tsv.read_tsv(spark, data.landed_tsv(spark, sf, name), name)
        return rows.withColumn("is_adult", F.col("is_adult").cast("int")) if name == "titles" else rows

    QUERIES[f"src_tsv_{name}"] = read


for _name in tsv.FILES:
    _register_tsv(_name)


@query
def src_encoded_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "encoded-cache")
    cache.encoded_cache(spark, path, lambda: titles.onehot_genres(_counts(spark, sf)))

    def not_again() -> DataFrame:
        raise AssertionError("the second read must come from the cache")

    return cache.encoded_cache(spark, path, not_again)


@query
def src_title_genre_query(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "titles")
    store.overwrite("titles", data.titles(spark, sf))
    store.overwrite("genres", data.genres(spark, sf))
    return titles.titles_genres_join(store.read("titles"), store.read("genres"))


@query
def scan_sessions(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "sessions")
    maintenance.sink_sessions(store, _sessions(spark, sf))
    return _rounded(store.read("sessions").drop("created_timestamp"), "completion_ratio")


@query
def scan_user_item_stats(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "stats")
    maintenance.sink_user_item_stats(store, history.user_item_stats(_sessions(spark, sf), data.library(spark, sf)))
    return _stats_rounded(store.read("user_item_stats").drop("last_updated_timestamp"))


# ---- sinks and maintenance -----------------------------------------------------------------


@query
def sink_raw_events(spark: SparkSession, sf: str) -> DataFrame:
    events = data.raw_events(spark, sf)
    store = _store(spark, "raw")
    # a null in a required column drops the row; duplicates stay
    holes = events.withColumn("user_id", F.when(F.col("duration") % 7 != 0, F.col("user_id")))
    maintenance.sink_raw_events(store, holes.unionByName(events))
    return store.read("raw_events").drop("row_id")


@query
def sink_sessions(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "sessions")
    maintenance.sink_sessions(store, _sessions(spark, sf))
    maintenance.sink_sessions(store, store.read("sessions"))  # rewriting replaces, it does not add
    return store.read("sessions").select(
        "session_id", "user_id", "item_id", "session_start_timestamp", "outcome",
        F.col("created_timestamp").isNotNull().alias("stamped"),
    )


@query
def sink_user_item_stats(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "stats")
    stats = history.user_item_stats(_sessions(spark, sf), data.library(spark, sf))
    maintenance.sink_user_item_stats(store, stats)
    return _rounded(
        store.read("user_item_stats").select(
            "stat_id", "user_id", "item_id", "total_sessions", "total_seconds_watched", "adherence_score",
            F.col("last_updated_timestamp").isNotNull().alias("stamped"),
        ),
        "adherence_score",
    )


def _old_library(spark: SparkSession, sf: str) -> DataFrame:
    """Every part under an old name, and one item per supplier that the catalogue no longer has."""
    columns = library.project_library_item(_items(spark, sf)).drop("ingest_seq").columns
    parts = data.library(spark, sf).withColumn("item_name", F.concat(F.lit("old "), "item_name"))
    gone = data.table(spark, sf, "supplier").select(
        F.concat(F.lit("gone-"), F.col("s_suppkey").cast("string")).alias("item_id"),
        F.col("s_name").alias("item_name"),
        F.lit("Movie").alias("item_type"),
    )
    rows = parts.unionByName(gone, allowMissingColumns=True)
    kinds = {c.name: c.dataType for c in schemas.TABLES["library_items"].schema}
    return rows.select(
        *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]
    )


@query
def upsert_library_items(spark: SparkSession, sf: str) -> DataFrame:
    new = library.project_library_item(_kept_items(spark, sf))
    merged = maintenance.upsert_library_items(_old_library(spark, sf), new)
    return merged.select("item_id", "item_name", "item_type", "series_id", "video_codec", "runtime_seconds")


def _old_genres(spark: SparkSession, sf: str) -> DataFrame:
    return _old_library(spark, sf).select("item_id", F.lit(1).cast("long").alias("genre_id"), F.lit("old").alias("genre_name"))


@query
def upsert_item_genres(spark: SparkSession, sf: str) -> DataFrame:
    ingested = _kept_items(spark, sf).select(F.col("Id").alias("item_id"))
    return maintenance.upsert_item_genres(_old_genres(spark, sf), _item_genres(spark, sf), ingested)


@query
def upsert_item_tags(spark: SparkSession, sf: str) -> DataFrame:
    old = _old_library(spark, sf).select(
        "item_id",
        F.when(F.col("item_type") != "Episode", 5).cast("long").alias("tag_id"),
        F.lit("old").alias("tag_name"),
    )
    return maintenance.upsert_item_tags(old, library.tag_source_concat(_kept_items(spark, sf)))


@query
def upsert_provider_ids(spark: SparkSession, sf: str) -> DataFrame:
    old = _old_library(spark, sf).select(
        "item_id", F.lit("Tmdb").alias("provider"), F.lit("old").alias("provider_item_id")
    )
    return maintenance.upsert_provider_ids(old, library.provider_ids(_kept_items(spark, sf)))


@query
def upsert_ref_genres(spark: SparkSession, sf: str) -> DataFrame:
    old = data.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = data.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"),
        F.concat_ws("/", "o_orderpriority", (F.col("o_orderkey") % 1000).cast("string")).alias("name"),
        F.col("o_orderkey").alias("ingest_seq"),
    )
    return maintenance.upsert_ref_genres(old, new)


@query
def prune_missing_items(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "prune")
    store.overwrite("library_items", _old_library(spark, sf))
    store.overwrite("item_genres", _old_genres(spark, sf))
    items = _kept_items(spark, sf)
    store.overwrite("item_tags", maintenance.upsert_item_tags(
        _old_library(spark, sf).select(
            "item_id", F.lit(1).cast("long").alias("tag_id"), F.lit("old").alias("tag_name")
        ),
        library.tag_source_concat(items),
    ))
    store.overwrite("item_provider_ids", library.provider_ids(items))
    removed = maintenance.prune_missing_items(store, items.select(F.col("Id").alias("item_id")))
    counts = reports.table_row_counts({name: store.read(name) for name in maintenance.ITEM_TABLES})
    return counts.withColumn("removed", F.lit(removed).cast("long"))


@query
def load_imdb_tables(spark: SparkSession, sf: str) -> DataFrame:
    return loads.load_imdb_tables(
        spark, _store(spark, "metadata"), data.landed_tsv_files(spark, sf), mode="overwrite"
    ).select("table_name", "rows")


@query
def load_imdb_contents(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "metadata")
    loads.load_imdb_tables(spark, store, data.landed_tsv_files(spark, sf), mode="append")
    people = [
        store.read(name).select(F.lit(name).alias("table_name"), "t_const", F.col("n_const").alias("value"))
        for name in ("directors", "writers")
    ]
    tags = store.read("genres").select(F.lit("genres").alias("table_name"), "t_const", F.col("genre").alias("value"))
    return people[0].unionByName(people[1]).unionByName(tags)


@query
def truncate_tables(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "truncate")
    store.overwrite("titles", data.titles(spark, sf))
    store.overwrite("genres", data.genres(spark, sf))
    before = {name: store.read(name) for name in ("titles", "genres")}
    after = maintenance.truncate_tables(store, ("titles", "genres"))
    return reports.table_row_counts(before).withColumn(
        "rows_left", F.lit(sum(after.values())).cast("long")
    )


@query
def reset_metadata_tables(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "reset")
    loads.load_imdb_tables(spark, store, data.landed_tsv_files(spark, sf), mode="overwrite")
    prefix = "reset_" + store.root.rsplit("-", 1)[1][:8] + "_"
    return maintenance.reset_tables(store, schemas.STAGING_TABLES + schemas.TITLE_TABLES, prefix)


@query
def snapshot_backup(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "backup")
    maintenance.sink_raw_events(store, data.raw_events(spark, sf))
    maintenance.sink_sessions(store, _sessions(spark, sf))
    return maintenance.snapshot_backup(
        store, ("raw_events", "sessions", "user_item_stats"), scratch_path(spark, "backups")
    )


@query
def sink_encoded_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "encoded")
    cache.sink_encoded_cache(titles.onehot_genres(_counts(spark, sf)), path)
    return spark.read.parquet(path)


@query
def table_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations",
    )
    return reports.table_row_counts({name: data.table(spark, sf, name) for name in names})


@query
def count_rows(spark: SparkSession, sf: str) -> DataFrame:
    files = data.landed_tsv_files(spark, sf)
    return reports.table_row_counts({name: tsv.read_tsv(spark, path, name) for name, path in files.items()})


@query
def load_metrics(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "metrics")
    measured = [
        maintenance.sink_raw_events(store, data.raw_events(spark, sf)),
        maintenance.sink_sessions(store, _sessions(spark, sf)),
    ]
    return loads.load_metrics(spark, measured).select("table_name", "rows", (F.col("seconds") > 0).alias("timed"))


@query
def analyze_tables(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "analyze")
    maintenance.sink_raw_events(store, data.raw_events(spark, sf))
    maintenance.sink_sessions(store, _sessions(spark, sf))
    prefix = "analyze_" + store.root.rsplit("-", 1)[1][:8] + "_"
    names = maintenance.create_all(store, ("raw_events", "sessions"), prefix)
    counted = maintenance.analyze_tables(spark, names)
    return counted.select(
        F.substring("table_name", len(prefix) + 1, 64).alias("table_name"), "row_count"
    )


@query
def schema_ddl(spark: SparkSession, sf: str) -> DataFrame:
    location = scratch_path(spark, "ddl")
    name = "ddl_" + location.rsplit("-", 1)[1][:8]
    maintenance.create_table(spark, name, "raw_events", location)
    maintenance.create_table(spark, name, "raw_events", location)  # exists: no error, no change
    columns = schemas.TABLES["raw_events"].schema.names
    data.raw_events(spark, sf).select(*columns).write.insertInto(name)
    maintenance.drop_table(spark, name)
    maintenance.drop_table(spark, name)  # gone: no error
    return spark.read.schema(schemas.TABLES["raw_events"].schema).parquet(location)


# ---- projections and filters ---------------------------------------------------------------


@query
def normalize_tz(spark: SparkSession, sf: str) -> DataFrame:
    return history.normalize_tz(data.raw_events(spark, sf), data.CUTOFF).select(
        "row_id", "date", "time", "event_ts"
    )


@query
def project_raw_event(spark: SparkSession, sf: str) -> DataFrame:
    return history.project_raw_event(landing.playback_log(spark, data.landed_playback(spark, sf)))


@query
def project_library_item(spark: SparkSession, sf: str) -> DataFrame:
    rows = library.project_library_item(_items(spark, sf)).drop("ingest_seq", "runtime_seconds", "runtime_minutes")
    return _rounded(rows, "community_rating")


@query
def generated_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = library.project_library_item(_items(spark, sf))
    return _rounded(rows.select("item_id", "item_name", "runtime_seconds", "runtime_minutes"), "runtime_minutes")


@query
def filter_item_types(spark: SparkSession, sf: str) -> DataFrame:
    return library.filter_item_types(_items(spark, sf), parent_id="F2").select("Id", "Name", "Type")


@query
def filter_nonblank(spark: SparkSession, sf: str) -> DataFrame:
    staging = tsv.read_tsv(spark, data.landed_tsv(spark, sf, "crew_staging"), "crew_staging")
    return titles.filter_nonblank(staging, "directors_csv")


@query
def filter_truthy_pid(spark: SparkSession, sf: str) -> DataFrame:
    return library.provider_ids(_items(spark, sf)).drop("ingest_seq")


@query
def filter_exists_runtime(spark: SparkSession, sf: str) -> DataFrame:
    return history.filter_exists_runtime(_sessions(spark, sf), data.library(spark, sf)).select(
        "session_id", "user_id", "item_id", "total_seconds_watched"
    )


@query
def first_video_stream(spark: SparkSession, sf: str) -> DataFrame:
    return library.first_video_stream(_items(spark, sf)).select("Id", "Name", "video_codec")


@query
def resolution_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return library.resolution_fallback(_items(spark, sf)).select(
        "Id", "Name", "resolution_width", "resolution_height"
    )


@query
def select_genre_columns(spark: SparkSession, sf: str) -> DataFrame:
    encoded = titles.onehot_genres(_counts(spark, sf))
    cells = F.array(*[F.col(f"`{c}`") for c in titles.select_genre_columns(encoded)])
    return encoded.select(
        "t_const",
        F.size(cells).alias("genre_columns"),
        F.aggregate(cells, F.lit(0), lambda a, x: a + x).alias("tags"),
    )


@query
def column_rename(spark: SparkSession, sf: str) -> DataFrame:
    positional = _sessions(spark, sf).select("user_id", "item_id", "session_count").toDF("0", "1", "2")
    return reports.column_rename(positional, ["user_id", "Item ID", "session_count"])


# ---- joins -----------------------------------------------------------------------------------


@query
def sessions_runtime_lookup(spark: SparkSession, sf: str) -> DataFrame:
    sessions = history.gap_sessions(data.raw_events(spark, sf), data.GAP_MINUTES)
    joined = history.with_runtime(sessions, data.library(spark, sf), ["user_id", "session_start_timestamp"])
    return joined.select(
        "user_id", "item_id", "session_start_timestamp", F.col("_runtime").alias("runtime_seconds")
    )


@query
def stats_left_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = history.with_runtime(
        _sessions(spark, sf), data.library(spark, sf), ["user_id", "session_start_timestamp"]
    )
    return joined.select(
        "user_id", "item_id", "session_start_timestamp", "total_seconds_watched",
        F.col("_runtime").alias("runtime_seconds"), F.col("_library_type").alias("library_item_type"),
    )


@query
def sessions_items_genres(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sessions_items_genres(_sessions(spark, sf), data.library(spark, sf), _item_genres(spark, sf))


@query
def titles_genres_join(spark: SparkSession, sf: str) -> DataFrame:
    return data.titles_genres(spark, sf)


@query
def update_completion_ratios(spark: SparkSession, sf: str) -> DataFrame:
    # sessions made before any runtime was known
    blind = data.library(spark, sf).withColumn("runtime_seconds", F.lit(None).cast("long"))
    sessions = history.sessions_agg(data.raw_events(spark, sf), blind, data.GAP_MINUTES)
    updated = history.update_completion_ratios(sessions, data.library(spark, sf))
    return _rounded(updated.select("session_id", "user_id", "item_id", "completion_ratio", "outcome"), "completion_ratio")


@query
def genre_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _items(spark, sf).select(
        F.col("Id").alias("item_id"), F.col("Name").alias("item_name"), F.col("Type").alias("item_type"),
        F.explode("Genres").alias("genre_name"), F.lit(None).cast("long").alias("genre_id"),
        F.lit("item").alias("origin"),
    )
    found = library.genre_id_lookup(rows, _ref(spark, sf, "movie"), _ref(spark, sf, "tv"))
    return found.drop("origin")


@query
def series_genre_fallback(spark: SparkSession, sf: str) -> DataFrame:
    entries = library.series_genre_fallback(
        library.genre_source_concat(_items(spark, sf)),
        landing.series_metadata(spark, data.landed_series(spark, sf)),
    )
    return entries.select("item_id", F.explode("entries").alias("_e")).where(
        F.col("_e.origin").eqNullSafe("series") | F.col("_e.name").isNull()
    ).select("item_id", F.col("_e.name").alias("genre_name"), F.col("_e.origin").alias("origin"))


@query
def prune_anti_semi(spark: SparkSession, sf: str) -> DataFrame:
    current = _items(spark, sf).select(F.col("Id").alias("item_id"))
    return maintenance.still_present(_old_genres(spark, sf), current).groupBy("genre_name").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.countDistinct("item_id").alias("items_kept")
    )


@query
def lateral_split(spark: SparkSession, sf: str) -> DataFrame:
    staging = tsv.read_tsv(spark, data.landed_tsv(spark, sf, "crew_staging"), "crew_staging")
    return titles.lateral_split(staging, "writers_csv", "n_const")


@query
def stats_with_item_names(spark: SparkSession, sf: str) -> DataFrame:
    lib = data.library(spark, sf)
    named = reports.stats_with_item_names(history.user_item_stats(_sessions(spark, sf), lib), lib)
    return _rounded(named, "total_minutes_watched", "avg_fraction_completed")


# ---- aggregations -----------------------------------------------------------------------------


@query
def sessions_agg(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_sessions(spark, sf), "completion_ratio")


@query
def sessions_agg_15_minutes(spark: SparkSession, sf: str) -> DataFrame:
    sessions = history.sessions_agg(
        data.raw_events(spark, sf), data.library(spark, sf), 15, completed_ratio=0.5, partial_ratio=0.1,
        min_sampled_seconds=30,
    )
    return _rounded(sessions, "completion_ratio")


def _stats_rounded(stats: DataFrame) -> DataFrame:
    return _rounded(
        stats, "total_minutes_watched", "best_completion_ratio", "average_completion_ratio",
        "days_between_first_last", "adherence_score",
    )


@query
def user_item_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _stats_rounded(history.user_item_stats(_sessions(spark, sf), data.library(spark, sf)))


@query
def conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).groupBy("item_id").agg(*history.conditional_counts())


@query
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        reports.session_summary(_sessions(spark, sf)), "avg_session_minutes", "avg_watch_minutes"
    )


@query
def outcome_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reports.outcome_distribution(_sessions(spark, sf))


@query
def onehot_genres(spark: SparkSession, sf: str) -> DataFrame:
    return titles.onehot_genres(_counts(spark, sf))


@query
def genre_counts(spark: SparkSession, sf: str) -> DataFrame:
    return titles.genre_counts(data.titles_genres(spark, sf))


@query
def title_genre_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query
def describe_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.describe_sessions(_sessions(spark, sf))


@query
def session_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.session_histograms(_sessions(spark, sf)), "bin_start")


# ---- windows -----------------------------------------------------------------------------------


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return history.mark_sessions(data.raw_events(spark, sf), data.GAP_MINUTES)


@query
def win_prev_event(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("row_id", "event_ts", "prev_event_timestamp")


@query
def win_session_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("row_id", "is_new_session")


@query
def win_session_group(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("row_id", "user_id", "item_id", "session_group_id")


@query
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return history.gap_sessions(data.raw_events(spark, sf), data.GAP_MINUTES).drop("item_kind")


# ---- sorts, limits, sets ------------------------------------------------------------------------


@query
def order_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).select(
        "session_id", "user_id", "item_id", "session_start_timestamp"
    ).orderBy("user_id", "item_id", "session_start_timestamp")


@query
def order_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.outcome_distribution(_sessions(spark, sf)).select("outcome")


@query
def head_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.sessions_items_genres(_sessions(spark, sf), data.library(spark, sf), _item_genres(spark, sf))
    return reports.head_items(rows, ["user_id", "item_id", "item_name", "genre_name"])


@query
def topk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return similar.knn_similar_titles(similar.title_profiles(_vectors(spark, sf)), k=1).select("title", "neighbour", "distance")


@query
def set_difference_ids(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.missing_ids(_old_library(spark, sf), _kept_items(spark, sf).select(F.col("Id").alias("item_id")))


@query
def genre_source_concat(spark: SparkSession, sf: str) -> DataFrame:
    return library.genre_source_concat(_items(spark, sf)).select("item_id", F.explode("entries").alias("_e")).select(
        "item_id", F.col("_e.id").alias("genre_id"), F.col("_e.name").alias("genre_name"),
        F.col("_e.origin").alias("origin"),
    )


@query
def tag_source_concat(spark: SparkSession, sf: str) -> DataFrame:
    return library.tag_source_concat(_items(spark, sf)).drop("ingest_seq")


@query
def item_genres(spark: SparkSession, sf: str) -> DataFrame:
    return _item_genres(spark, sf)


# ---- scalar functions ------------------------------------------------------------------------------


@query
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    rows = data.raw_events(spark, sf)
    moment = fn.parse_ts(F.col("date"), F.col("time"))
    later = fn.add_hours(moment, 17)
    csv = F.concat_ws(",", "item_type", F.lit(""), "item_name")
    return _rounded(
        rows.select(
            "row_id",
            moment.alias("parsed"),
            F.date_format(later, "yyyy-MM-dd HH:mm:ss").alias("later"),
            fn.seconds_between(moment, F.lit("2024-01-31").cast("timestamp")).alias("seconds_left"),
            fn.whole_minutes_between(moment, F.lit("2024-01-31").cast("timestamp")).alias("minutes_left"),
            fn.days_between(moment, F.lit("2024-01-31").cast("timestamp")).alias("days_left"),
            fn.cap(F.nullif("duration", F.lit(0).cast("long")) / F.lit(500.0)).alias("capped"),
            F.col("duration").cast("double").alias("as_real"),
            (F.col("duration") / 7).cast("long").alias("as_int"),
            F.when(F.col("duration") >= 1200, "long").when(F.col("duration") >= 300, "middle").otherwise("short").alias(
                "graded"
            ),
            fn.null_marker(F.when(F.col("duration") % 2 == 0, F.lit("\\N")).otherwise(F.col("item_name"))).alias(
                "unmarked"
            ),
            F.size(fn.split_csv(csv)).cast("int").alias("csv_parts"),
            F.element_at(fn.split_csv(csv), 2).alias("csv_second"),
            fn.stable_id(F.col("item_name")).alias("name_id"),
            F.lower("item_name").alias("lowered"),
            F.round(F.col("duration") / 7, 2).alias("two_digits"),
        ),
        "days_left", "capped",
    )


@query
def fn_map_items(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("Id", "Name", F.explode("ProviderIds").alias("provider", "provider_item_id"))


# ---- vectors and neighbours ------------------------------------------------------------------------


def _entries(vectors: DataFrame) -> DataFrame:
    return _rounded(
        vectors.select("t_const", F.explode("vector").alias("_e")).select(
            "t_const", F.col("_e.genre").alias("genre"), F.col("_e.weight").alias("weight")
        ),
        "weight",
    )


@query
def genre_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(_vectors(spark, sf))


@query
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(similar.normalize_vectors(_vectors(spark, sf)))


@query
def l2_normalize_dense(spark: SparkSession, sf: str) -> DataFrame:
    unit = similar.l2_normalize(data.table(spark, sf, "embeddings"))
    return _rounded(unit.select("vec_id", F.posexplode("embedding").alias("position", "weight")), "weight")


@query
def knn_similar_titles(spark: SparkSession, sf: str) -> DataFrame:
    return similar.knn_similar_titles(similar.title_profiles(_vectors(spark, sf)))


@query
def knn_similar_titles_encoded(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "titles")
    store.overwrite("titles", data.titles(spark, sf))
    store.overwrite("genres", data.genres(spark, sf))
    return loads.similar_titles(spark, store, scratch_path(spark, "encoded"))


@query
def knn_of_watched_titles(spark: SparkSession, sf: str) -> DataFrame:
    watched = _sessions(spark, sf).select(F.col("item_id").alias("title"))
    return similar.knn_similar_titles(similar.title_profiles(_vectors(spark, sf)), of=watched)


@query
def knn_dense_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = data.table(spark, sf, "embeddings").select(
        "vec_id", similar.dense_to_vector("embedding").alias("vector")
    )
    return similar.knn_similar_titles(similar.title_profiles(vectors, "vec_id"), signed=True)


def _taste(spark: SparkSession, sf: str, profiles: DataFrame) -> DataFrame:
    watched = _sessions(spark, sf).select(
        "user_id", F.col("item_id").alias("title"), F.col("completion_ratio").alias("weight")
    )
    return similar.user_taste_vector(watched, profiles)


@query
def user_taste_vector(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_taste(spark, sf, similar.title_profiles(_vectors(spark, sf))), "weight")


@query
def knn_for_user(spark: SparkSession, sf: str) -> DataFrame:
    profiles = similar.title_profiles(_vectors(spark, sf))
    return similar.knn_for_user(_taste(spark, sf, profiles), profiles)


def _titles_and_sessions(spark: SparkSession, sf: str) -> TableStore:
    store = _store(spark, "recommend")
    store.overwrite("titles", data.titles(spark, sf))
    store.overwrite("genres", data.genres(spark, sf))
    store.overwrite("sessions", _sessions(spark, sf))
    return store


@query
def because_you_watched(spark: SparkSession, sf: str) -> DataFrame:
    store = _titles_and_sessions(spark, sf)
    watched = store.read("sessions").select(F.col("item_id").alias("title"))
    return loads.because_you_watched(spark, store, scratch_path(spark, "encoded"), watched)


@query
def recommend_for_users(spark: SparkSession, sf: str) -> DataFrame:
    return loads.recommend_for_users(spark, _titles_and_sessions(spark, sf), scratch_path(spark, "encoded"))


@query
def recommend_unseen(spark: SparkSession, sf: str) -> DataFrame:
    return loads.recommend_for_users(spark, _titles_and_sessions(spark, sf), scratch_path(spark, "encoded"), k=5, unseen=True)


@query
def top_genres_of_users(spark: SparkSession, sf: str) -> DataFrame:
    genres = data.genres(spark, sf).select(F.col("t_const").alias("item_id"), F.col("genre").alias("genre_name"))
    return reports.top_genres_of_users(_sessions(spark, sf), genres)


@query
def top_items_of_users(spark: SparkSession, sf: str) -> DataFrame:
    stats = history.user_item_stats(_sessions(spark, sf), data.library(spark, sf))
    return reports.top_items_of_users(stats, data.library(spark, sf))


# ---- constraints -----------------------------------------------------------------------------------


@query
def dq_unique(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dq_unique(data.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dq_not_null(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dq_not_null(
        library.project_library_item(_items(spark, sf)), ("item_id", "series_id", "runtime_ticks", "resolution_width")
    )


@query
def dq_foreign_key(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dq_foreign_key(data.raw_events(spark, sf), "item_id", data.library(spark, sf), "item_id")


@query
def dq_max_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = data.table(spark, sf, "documents").select("text", "source", "lang")
    return quality.dq_max_length(rows, {"text": 512, "source": 12, "lang": 2})


# ---- whole jobs --------------------------------------------------------------------------------------


@query
def refresh_watch_history(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "refresh")
    paths = loads.LandedPaths(
        data.landed_playback(spark, sf),
        data.landed_catalog(spark, sf),
        data.landed_ref_genres(spark, sf, "movie"),
        data.landed_ref_genres(spark, sf, "tv"),
        data.landed_series(spark, sf),
    )
    loads.refresh_watch_history(
        spark, store, paths, cutoff=data.CUTOFF, gap_minutes=data.GAP_MINUTES
    )
    return _stats_rounded(store.read("user_item_stats").drop("last_updated_timestamp"))
