from __future__ import annotations

import zlib

import pytest

from conftest import rows
from reelmark.operators import library
from reelmark.sources import landing


def crc(name):
    return zlib.crc32(name.lower().encode()) & 0x7FFFFFFF


def item(ident, kind="Movie", **fields):
    return {"Id": ident, "Name": f"Name {ident}", "Type": kind, **fields}


def page(*items, start=0):
    return {"StartIndex": start, "TotalRecordCount": len(items), "Items": list(items)}


@pytest.fixture
def refs(spark):
    movie = spark.createDataFrame([(0, "Zero"), (1, "Drama"), (2, "Both"), (7, "dup"), (9, "DUP")], "id long, name string")
    tv = spark.createDataFrame([(0, "Nought"), (0, "Nil"), (5, "Both"), (6, "Crime"), (8, "Zero")], "id long, name string")
    return movie, tv


def genres_of(spark, land, refs, items, series=()):
    catalog = landing.catalog_pages(spark, land("catalog", page(*items)))
    documents = landing.series_metadata(spark, land("series", *series)) if series else None
    return rows(library.item_genres(catalog, *refs, documents))


def test_genre_objects_stay_as_they_are(spark, land, refs):
    got = genres_of(spark, land, refs, [item("1", GenreItems=[
        {"Name": "A", "Id": 1}, {"Name": "A", "Id": 1}, {"Id": 3}, {"Name": "", "Id": 4}, {"Name": "B"}])])
    assert got == sorted([("1", 1, "A"), ("1", 1, "A"), ("1", 3, None), ("1", 4, ""), ("1", None, "B")], key=repr)


def test_plain_names_fill_up_by_exact_case(spark, land, refs):
    got = genres_of(spark, land, refs, [item("1", GenreItems=[{"Name": "Drama", "Id": 50}], Genres=["Drama", "drama", "drama", "", None])])
    assert got == sorted([("1", 50, "Drama"), ("1", 1, "drama")], key=repr)


@pytest.mark.parametrize(
    "kind,name,want",
    [
        ("Movie", "both", 2), ("Episode", "both", 5), ("Trailer", "BOTH", 2),
        ("Movie", "Crime", 6), ("Episode", "Drama", 1),
        ("Movie", "Nowhere", crc("nowhere")), ("Movie", "NOWHERE", crc("nowhere")),
        ("Movie", "Zero", 8), ("Episode", "Zero", 8),  # id 0 falls through to the other list
        ("Movie", "Nought", 0), ("Episode", "Nought", crc("nought")),  # but the list asked last may give 0
        ("Movie", "dup", 9),
    ],
)
def test_genre_ids(spark, land, refs, kind, name, want):
    assert genres_of(spark, land, refs, [item("1", kind, Genres=[name])]) == [("1", want, name)]


def test_series_fallback(spark, land, refs):
    series = [
        {"Id": "S", "GenreItems": [{"Name": "A", "Id": 1}, {"Name": "A", "Id": 2}, {"Id": 3}], "Genres": ["A", "Drama", "Nought", "Nought", ""]},
        {"Id": "T", "Genres": ["Crime"]},
    ]
    items = [
        item("ep", "Episode", SeriesId="S"),
        item("unnamed", "Episode", SeriesId="T", GenreItems=[{"Id": 77}]),
        item("own", "Episode", SeriesId="S", Genres=["Own"]),
        item("movie", "Movie", SeriesId="S"),
        item("lost", "Episode", SeriesId="nowhere"),
        item("alone", "Episode", SeriesId=""),
    ]
    assert genres_of(spark, land, refs, items, series) == sorted(
        [
            ("ep", 1, "A"), ("ep", 1, "Drama"), ("ep", crc("nought"), "Nought"),
            ("unnamed", 77, None), ("unnamed", 6, "Crime"),
            ("own", crc("own"), "Own"),
        ],
        key=repr,
    )
    assert genres_of(spark, land, refs, items) == sorted([("unnamed", 77, None), ("own", crc("own"), "Own")], key=repr)


def test_tags_and_providers(spark, land):
    catalog = landing.catalog_pages(spark, land("catalog", page(
        item("1", TagItems=[{"Name": "Kids", "Id": 3}, {"Name": "x"}], Tags=["Kids", "4K", "4K", ""],
             ProviderIds={"Imdb": "tt1", "Tmdb": "", "Tvdb": None}),
        item("2"),
    )))
    assert rows(library.tag_source_concat(catalog), "item_id", "tag_id", "tag_name") == sorted(
        [("1", 3, "Kids"), ("1", None, "x"), ("1", crc("4k"), "4K")], key=repr
    )
    assert rows(library.provider_ids(catalog), "item_id", "provider", "provider_item_id") == [("1", "Imdb", "tt1")]


VIDEO = {"Type": "Video", "Codec": "h264", "Width": 1280, "Height": 720}


@pytest.mark.parametrize(
    "fields,codec,width,height",
    [
        ({}, "", None, None),
        ({"MediaStreams": []}, "", None, None),
        ({"MediaStreams": [{"Type": "Audio", "Codec": "aac"}], "Width": 0}, "", 0, None),
        ({"MediaStreams": [{"Type": "Audio", "Codec": "aac"}, VIDEO, {**VIDEO, "Codec": "hevc", "Width": 9}]}, "h264", 1280, 720),
        ({"MediaStreams": [{"Type": "Video"}]}, None, None, None),
        ({"MediaStreams": [VIDEO], "Width": None, "Height": 0}, "h264", 1280, 720),
        ({"MediaStreams": [VIDEO], "Width": 0, "Height": 5}, "h264", 0, 5),
        ({"MediaStreams": [VIDEO], "Height": 1080}, "h264", 1280, 1080),
        ({"MediaStreams": [{**VIDEO, "Width": None}], "Width": 0}, "h264", None, 720),
    ],
)
def test_streams(spark, land, fields, codec, width, height):
    catalog = landing.catalog_pages(spark, land("catalog", page(item("1", **fields))))
    row = library.project_library_item(catalog).first()
    assert (row.video_codec, row.resolution_width, row.resolution_height) == (codec, width, height)


def test_projection_and_runtime(spark, land):
    catalog = landing.catalog_pages(spark, land("catalog", page(
        item("1", "Episode", SeriesName="S", SeriesId="s", ParentIndexNumber=2, IndexNumber=3, RunTimeTicks=19_999_999),
        item("2"),
    )))
    got = {r.item_id: r for r in library.project_library_item(catalog).collect()}
    assert (got["1"].season_number, got["1"].episode_number, got["1"].series_id) == (2, 3, "s")
    assert got["1"].runtime_seconds == 1
    assert got["1"].runtime_minutes == pytest.approx(19_999_999 / 600_000_000)
    assert (got["2"].runtime_seconds, got["2"].runtime_minutes) == (None, None)


def test_type_filter(spark, land):
    catalog = landing.catalog_pages(spark, land("catalog", page(
        item("1", ParentId="a"), item("2", "Episode", ParentId="b"), item("3", "Trailer", ParentId="a"))))
    assert rows(library.filter_item_types(catalog), "Id") == [("1",), ("2",)]
    assert rows(library.filter_item_types(catalog, parent_id="a"), "Id") == [("1",)]
    assert rows(library.filter_item_types(catalog, ("Trailer",)), "Id") == [("3",)]
