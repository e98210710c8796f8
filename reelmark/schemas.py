"""Column types and constraints of every table and landed payload."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_S, _I, _L, _D, _T, _B = StringType(), IntegerType(), LongType(), DoubleType(), TimestampType(), ByteType()


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


@dataclass(frozen=True)
class TableSpec:
    schema: StructType
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    sort_by: tuple[str, ...] = ()  # layout on disk, in place of an index


TABLES: dict[str, TableSpec] = {
    "raw_events": TableSpec(
        _struct(
            row_id=_L, date=_S, time=_S, user_id=_S, item_name=_S, item_id=_S, item_type=_S,
            duration=_L, remote_address=_S, user_name=_S, event_ts=_T,
        ),
        not_null=("date", "time", "user_id", "item_name", "item_id", "item_type", "duration", "user_name"),
        sort_by=("user_id", "event_ts"),
    ),
    "sessions": TableSpec(
        _struct(
            session_id=_S, user_id=_S, item_id=_S, session_start_timestamp=_T, session_end_timestamp=_T,
            session_span_minutes=_L, total_seconds_watched=_L, session_count=_L, completion_ratio=_D,
            outcome=_S, created_timestamp=_T,
        ),
        not_null=(
            "user_id", "item_id", "session_start_timestamp", "session_end_timestamp",
            "total_seconds_watched", "session_count",
        ),
        unique=(("user_id", "item_id", "session_start_timestamp"),),
        sort_by=("user_id", "session_end_timestamp"),
    ),
    "user_item_stats": TableSpec(
        _struct(
            stat_id=_S, user_id=_S, item_id=_S, total_sessions=_L, total_seconds_watched=_L,
            total_minutes_watched=_D, best_completion_ratio=_D, average_completion_ratio=_D,
            rewatch_count=_L, first_watched_timestamp=_T, last_watched_timestamp=_T,
            days_between_first_last=_D, adherence_score=_D, completed_sessions=_L, partial_sessions=_L,
            abandoned_sessions=_L, sampled_sessions=_L, last_updated_timestamp=_T,
        ),
        not_null=("user_id", "item_id", "total_sessions", "total_seconds_watched"),
        unique=(("user_id", "item_id"),),
        sort_by=("user_id", "adherence_score"),
    ),
    "library_items": TableSpec(
        _struct(
            item_id=_S, item_name=_S, item_type=_S, series_name=_S, series_id=_S, season_number=_I,
            episode_number=_I, runtime_ticks=_L, runtime_seconds=_L, runtime_minutes=_D, premiere_date=_S,
            date_created=_S, overview=_S, community_rating=_D, production_year=_I, file_path=_S,
            container=_S, video_codec=_S, resolution_width=_I, resolution_height=_I, last_updated=_T,
        ),
        not_null=("item_id", "item_name", "item_type"),
        unique=(("item_id",),),
        sort_by=("series_id", "season_number", "episode_number"),
    ),
    "item_genres": TableSpec(
        _struct(uuid=_L, item_id=_S, genre_id=_L, genre_name=_S),
        sort_by=("item_id",),
    ),
    "item_tags": TableSpec(
        _struct(item_id=_S, tag_id=_L, tag_name=_S),
        unique=(("item_id", "tag_id"),),
        sort_by=("item_id",),
    ),
    "item_provider_ids": TableSpec(
        _struct(item_id=_S, provider=_S, provider_item_id=_S),
        not_null=("item_id", "provider", "provider_item_id"),
        unique=(("item_id", "provider"),),
        sort_by=("provider", "item_id"),
    ),
    "movie_genres": TableSpec(_struct(id=_L, name=_S), ("id", "name"), (("id",), ("name",))),
    "tv_genres": TableSpec(_struct(id=_L, name=_S), ("id", "name"), (("id",), ("name",))),
    "titles": TableSpec(
        _struct(
            t_const=_S, type=_S, primary_name=_S, original_name=_S, is_adult=_B, start_year=_S,
            end_year=_S, runtime_minutes=_I,
        ),
        ("t_const",),
        (("t_const",),),
        {"t_const": 20, "type": 32, "primary_name": 512, "original_name": 512, "start_year": 8, "end_year": 8},
    ),
    "genres": TableSpec(
        _struct(id=_L, t_const=_S, genre=_S), ("t_const", "genre"), (), {"t_const": 20, "genre": 64}
    ),
    "directors": TableSpec(
        _struct(id=_L, t_const=_S, n_const=_S), ("t_const", "n_const"), (), {"t_const": 20, "n_const": 12}
    ),
    "writers": TableSpec(
        _struct(id=_L, t_const=_S, n_const=_S), ("t_const", "n_const"), (), {"t_const": 20, "n_const": 12}
    ),
    "episodes": TableSpec(
        _struct(t_const=_S, parent_t_const=_S, season_num=_I, episode_num=_I),
        ("t_const", "parent_t_const"),
        (("t_const",),),
        {"t_const": 20, "parent_t_const": 20},
    ),
    "roles": TableSpec(
        _struct(id=_L, t_const=_S, n_const=_S, category=_S, job=_S, characters=_S),
        ("t_const", "n_const"),
        (),
        {"t_const": 20, "n_const": 20, "category": 64, "job": 500},
    ),
    "ratings": TableSpec(
        _struct(t_const=_S, avg_rating=_D, num_votes=_I), ("t_const",), (("t_const",),), {"t_const": 20}
    ),
    "persons": TableSpec(
        _struct(n_const=_S, name=_S, birth_year=_S, death_year=_S),
        ("n_const",),
        (("n_const",),),
        {"n_const": 20, "name": 256, "birth_year": 8, "death_year": 8},
    ),
    "crew_staging": TableSpec(
        _struct(t_const=_S, directors_csv=_S, writers_csv=_S), ("t_const",), (), {"t_const": 12}
    ),
    "genres_staging": TableSpec(_struct(t_const=_S, genres=_S), ("t_const",), (), {"t_const": 12}),
}

WATCH_HISTORY_TABLES = ("raw_events", "sessions", "user_item_stats")
LIBRARY_TABLES = ("library_items", "item_genres", "item_tags", "item_provider_ids")
REF_GENRE_TABLES = ("movie_genres", "tv_genres")
TITLE_TABLES = (
    "directors", "episodes", "genres", "persons", "ratings", "titles", "writers", "roles",
)
STAGING_TABLES = ("crew_staging", "genres_staging")

# ---- landed payloads -------------------------------------------------------------------

PLAYBACK_EVENT = _struct(
    date=_S, time=_S, user_id=_S, item_name=_S, item_id=_S, item_type=_S, duration=_S,
    remote_address=_S, user_name=_S, user_has_image=BooleanType(),
)
PLAYBACK_LOG = MapType(_S, ArrayType(PLAYBACK_EVENT))

NAMED_ID = _struct(Name=_S, Id=_L)
MEDIA_STREAM = _struct(Type=_S, Codec=_S, Width=_I, Height=_I)
CATALOG_ITEM = _struct(
    Id=_S, Name=_S, Type=_S, SeriesName=_S, SeriesId=_S, ParentId=_S, ParentIndexNumber=_I,
    IndexNumber=_I, RunTimeTicks=_L, PremiereDate=_S, Overview=_S, CommunityRating=_D,
    ProductionYear=_I, Path=_S, Container=_S, Width=_I, Height=_I,
    MediaStreams=ArrayType(MEDIA_STREAM), GenreItems=ArrayType(NAMED_ID), Genres=ArrayType(_S),
    TagItems=ArrayType(NAMED_ID), Tags=ArrayType(_S), ProviderIds=MapType(_S, _S),
)
# StartIndex is the request parameter a page was fetched with; the lander stores it beside the page.
CATALOG_PAGE = _struct(StartIndex=_L, TotalRecordCount=_L, Items=ArrayType(CATALOG_ITEM))
SERIES_METADATA = _struct(Id=_S, GenreItems=ArrayType(NAMED_ID), Genres=ArrayType(_S))
USERS = _struct(StartIndex=_L, Items=ArrayType(_struct(Name=_S, Id=_S)))
MEDIA_FOLDERS = _struct(StartIndex=_L, Items=ArrayType(_struct(Name=_S, Id=_S, CollectionType=_S)))
REF_GENRES = _struct(StartIndex=_L, genres=ArrayType(_struct(id=_L, name=_S)))
