"""End-to-end jobs: the nightly rebuild and the metadata bulk load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmark import schemas
from reelmark.operators import history, library, maintenance, quality, similar, titles
from reelmark.plans.joins import lookup_join
from reelmark.session import cut_lineage, job
from reelmark.sources import landing, tsv
from reelmark.sources.cache import encoded_cache
from reelmark.sources.store import TableStore, empty, with_row_ids


@dataclass(frozen=True)
class LandedPaths:
    """Where the lander put each payload."""

    playback: str
    catalog: str
    movie_genres: str
    tv_genres: str
    series: str | None = None


def _previous(store: TableStore, name: str, rebuild: bool) -> DataFrame:
    rows = store.read(name)
    return empty(store.spark, rows.schema) if rebuild else rows


def load_ref_genres(
    spark: SparkSession, store: TableStore, paths: LandedPaths, rebuild: bool = False
) -> list[dict]:
    metrics = []
    for name, path in (("movie_genres", paths.movie_genres), ("tv_genres", paths.tv_genres)):
        new = landing.ref_genres(spark, path)
        quality.require_valid(new, schemas.TableSpec(new.schema, schemas.TABLES[name].not_null), name)
        metrics.append(
            store.overwrite(name, maintenance.upsert_ref_genres(_previous(store, name, rebuild), new))
        )
    return metrics


@job
def load_library(
    spark: SparkSession, store: TableStore, paths: LandedPaths, rebuild: bool = False
) -> tuple[list[dict], int]:
    """Ingest the whole catalogue, then prune what it no longer has; returns write metrics and items pruned.

    Fewer items than the pages announce means a page did not land: that stops the run, as pruning
    against half a catalogue would drop the other half.
    """
    totals = landing.catalog_totals(spark, paths.catalog).first()
    if totals["items_announced"] is not None and (totals["items_received"] or 0) < totals["items_announced"]:
        raise ValueError(f"catalogue incomplete: {totals['items_received']} of {totals['items_announced']} items")
    # Parsed once; the five reads below then take only the columns they need.
    items = cut_lineage(library.filter_item_types(landing.catalog_pages(spark, paths.catalog)))
    projected = library.project_library_item(items)
    required = schemas.TableSpec(projected.schema, schemas.TABLES["library_items"].not_null)
    quality.require_valid(projected, required, "library_items")
    series = landing.series_metadata(spark, paths.series) if paths.series else None
    genres = library.item_genres(items, store.read("movie_genres"), store.read("tv_genres"), series)
    ids = cut_lineage(items.select(F.col("Id").alias("item_id")).distinct())

    def old(name: str) -> DataFrame:
        return _previous(store, name, rebuild)

    metrics = [
        store.overwrite(
            "library_items",
            maintenance.upsert_library_items(old("library_items"), projected).withColumn(
                "last_updated", F.current_timestamp()
            ),
        ),
        store.overwrite(
            "item_genres",
            with_row_ids(cut_lineage(maintenance.upsert_item_genres(old("item_genres"), genres, ids)), "uuid"),
        ),
        store.overwrite(
            "item_tags", maintenance.upsert_item_tags(old("item_tags"), library.tag_source_concat(items))
        ),
        store.overwrite(
            "item_provider_ids",
            maintenance.upsert_provider_ids(old("item_provider_ids"), library.provider_ids(items)),
        ),
    ]
    return metrics, maintenance.prune_missing_items(store, ids)


def load_history(
    spark: SparkSession,
    store: TableStore,
    playback: str,
    cutoff: str = history.CLOCK_CUTOFF,
    num_days: int | None = None,
    as_of: str | None = None,
    **session_options,
) -> list[dict]:
    """Raw events, sessions and statistics from the playback log, or its last days; each table is replaced."""
    log = landing.playback_log(spark, playback, num_days, as_of)
    events = history.normalize_tz(history.project_raw_event(log), cutoff)
    metrics = [maintenance.sink_raw_events(store, events)]
    metrics.append(
        maintenance.sink_sessions(
            store, history.sessions_agg(store.read("raw_events"), store.read("library_items"), **session_options)
        )
    )
    metrics.append(
        maintenance.sink_user_item_stats(
            store, history.user_item_stats(store.read("sessions"), store.read("library_items"))
        )
    )
    return metrics


@job
def refresh_watch_history(
    spark: SparkSession,
    store: TableStore,
    paths: LandedPaths,
    backup_root: str | None = None,
    **options,
) -> DataFrame:
    """The nightly rebuild from empty tables; returns (table_name, rows, seconds).

    Genres come first because the library needs their ids, the library before the sessions because
    they need its runtimes: completion ratios are right in the one write of the sessions. With
    ``backup_root`` the previous state is copied there before anything is replaced, and a failed copy
    stops the run. Versions that are no longer in force go at the end.
    """
    names = schemas.REF_GENRE_TABLES + schemas.LIBRARY_TABLES + schemas.WATCH_HISTORY_TABLES
    if backup_root:
        maintenance.snapshot_backup(store, names, backup_root)
    metrics = load_ref_genres(spark, store, paths, rebuild=True)
    metrics += load_library(spark, store, paths, rebuild=True)[0]
    metrics += load_history(spark, store, paths.playback, **options)
    for name in names:
        store.vacuum(name)
    return load_metrics(spark, metrics)


def load_metrics(spark: SparkSession, metrics: list[dict]) -> DataFrame:
    """Rows and seconds of each table write, counted while writing."""
    return spark.createDataFrame(
        [(m["table_name"], m["rows"], m["seconds"]) for m in metrics],
        "table_name string, rows long, seconds double",
    )


def _next_id(store: TableStore, name: str) -> int:
    return store.read(name).agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]


@job
def load_imdb_tables(
    spark: SparkSession, store: TableStore, files: dict[str, str], mode: str = "append"
) -> DataFrame:
    """Load the eight metadata tables; returns (table_name, rows, seconds).

    ``files`` maps each file-backed table of `tsv.FILES` to its path. Appending a key that is already
    there is an error; ``mode="overwrite"`` replaces the tables instead. Each file is parsed once. A null in
    a required column, a text over its length or a repeated key stops the load before any table changes.
    """
    write = {"append": store.append, "overwrite": store.overwrite}[mode]

    def parsed(name: str) -> DataFrame:
        return cut_lineage(tsv.read_tsv(spark, files[name], name))

    staged = {name: parsed(name) for name in schemas.STAGING_TABLES}
    rows = {
        "directors": titles.lateral_split(staged["crew_staging"], "directors_csv", "n_const"),
        "episodes": parsed("episodes"),
        "genres": titles.lateral_split(staged["genres_staging"], "genres", "genre"),
        "persons": parsed("persons"),
        "ratings": parsed("ratings"),
        "titles": parsed("titles"),
        "writers": titles.lateral_split(staged["crew_staging"], "writers_csv", "n_const"),
        "roles": parsed("roles"),
    }
    for name, new in (staged | rows).items():
        spec = schemas.TABLES[name]
        quality.require_valid(new, schemas.TableSpec(spec.schema, spec.not_null, (), spec.max_length), name)
        if spec.unique:
            keys = list(spec.unique[0])
            seen = new.select(*keys)
            if mode == "append":
                seen = seen.unionByName(store.read(name).select(*keys))
            quality.require_valid(seen, schemas.TableSpec(spec.schema, (), spec.unique), name)
    metrics = [store.overwrite(name, new) for name, new in staged.items()]
    for name, new in rows.items():
        if "id" in schemas.TABLES[name].schema.names:
            new = with_row_ids(new, "id", _next_id(store, name) if mode == "append" else 0)
        metrics.append(write(name, new))
    for name in (*staged, *rows):
        store.vacuum(name)
    return load_metrics(spark, metrics)


def _profiles(spark: SparkSession, store: TableStore, cache_path: str, refresh: bool) -> DataFrame:
    """Unit genre vectors of all stored titles, from the cached genre encoding."""
    encoded = encoded_cache(
        spark,
        cache_path,
        lambda: titles.onehot_genres(titles.title_genre_counts(store.read("titles"), store.read("genres"))),
        refresh,
    )
    return similar.title_profiles(titles.encoded_to_vectors(encoded))


def similar_titles(
    spark: SparkSession, store: TableStore, cache_path: str, k: int = 5, refresh: bool = False
) -> DataFrame:
    """Neighbours of every stored title, from the cached genre encoding."""
    return similar.knn_similar_titles(_profiles(spark, store, cache_path, refresh), k)


def _named(rows: DataFrame, store: TableStore, title: str, name: str) -> DataFrame:
    names = store.read("titles").select(F.col("t_const").alias(title), F.col("primary_name").alias(name))
    return lookup_join(rows, names, title, "left")


def because_you_watched(
    spark: SparkSession, store: TableStore, cache_path: str, of: list[str] | DataFrame, k: int = 5, refresh: bool = False
) -> DataFrame:
    """The titles like the chosen ones, as a person reads them.

    ``of`` is a short list of title ids or a frame with a column ``title``; ids that are not stored give no rows.
    Returns (title, title_name, rank, neighbour, neighbour_name, distance).
    """
    chosen = of if isinstance(of, DataFrame) else spark.createDataFrame([(t,) for t in of], "title string")
    found = similar.knn_similar_titles(_profiles(spark, store, cache_path, refresh), k, of=chosen)
    both = _named(_named(found, store, "title", "title_name"), store, "neighbour", "neighbour_name")
    return both.select("title", "title_name", "rank", "neighbour", "neighbour_name", "distance")


def recommend_for_users(
    spark: SparkSession, store: TableStore, cache_path: str, k: int = 20, unseen: bool = False, refresh: bool = False
) -> DataFrame:
    """The titles nearest to what each user watched, weighted by completion: (user_id, rank, title, title_name, distance).

    Sessions of the store are matched to titles by id. ``unseen`` leaves out what the user has a session of; so
    many more titles are searched for as the user with most titles has watched.
    """
    profiles = _profiles(spark, store, cache_path, refresh)
    watched = store.read("sessions").select("user_id", F.col("item_id").alias("title"), F.col("completion_ratio").alias("weight"))
    taste = similar.user_taste_vector(watched, profiles)
    if unseen:
        seen = cut_lineage(watched.select("user_id", "title").distinct())
        most = seen.groupBy("user_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        found = similar.knn_for_user(taste, profiles, k + most).join(seen, ["user_id", "title"], "left_anti")
        by_rank = Window.partitionBy("user_id").orderBy("rank")
        found = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    else:
        found = similar.knn_for_user(taste, profiles, k)
    return _named(found, store, "title", "title_name").select("user_id", "rank", "title", "title_name", "distance")
