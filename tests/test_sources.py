from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

import pytest

from conftest import rows
from reelmark.functions import scalars as fn
from reelmark.operators import titles
from reelmark.sources import landing, tsv
from reelmark.sources.cache import encoded_cache


def event(at, **fields):
    return dict(
        date=at, time="04:17:06", user_id="u1", item_name="Show - s01e02", item_id="7", item_type="Episode",
        duration="1563", user_name="Ann", user_has_image=False, **fields,
    )


def test_playback_log(spark, land):
    path = land("log", {"Ann": [event("2025-08-20"), event("2025-08-20")], "Bob": []}, {"Ann": [event("2025-08-10", remote_address="::1")]})
    got = landing.playback_log(spark, path)
    assert got.count() == 3
    assert rows(got, "date", "remote_address") == sorted([("2025-08-20", None)] * 2 + [("2025-08-10", "::1")], key=repr)
    assert landing.playback_log(spark, path, num_days=5, as_of="2025-08-21").count() == 2


def test_numbers_in_text_fields(spark, land):
    path = land("log", {"Ann": [{**event("2025-08-20"), "item_id": 7, "duration": 90}]})
    assert rows(landing.playback_log(spark, path), "item_id", "duration") == [("7", "90")]


def test_local_now(spark):
    shown = spark.range(1).select(fn.local_now().alias("t")).first().t
    wanted = datetime.now(ZoneInfo("Australia/Melbourne")).replace(tzinfo=None)
    assert abs((wanted - shown).total_seconds()) < 60


def test_broken_json_fails(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"Ann": [{"date": ')
    with pytest.raises(Exception):
        landing.playback_log(spark, str(tmp_path)).collect()


def test_pages_keep_their_order(spark, land):
    path = land("cat", {"StartIndex": 1000, "Items": [{"Id": "c"}]}, name="a.json")
    land("cat", {"StartIndex": 0, "TotalRecordCount": 3, "Items": [{"Id": "a"}, {"Id": "b"}]}, {"StartIndex": 2000, "Items": []}, name="b.json")
    pages = landing.catalog_pages(spark, path)
    assert [r.Id for r in pages.orderBy("ingest_seq").collect()] == ["a", "b", "c"]
    assert tuple(landing.catalog_totals(spark, path).first()) == (3, 3)


def test_users_last_of_a_name_wins(spark, land):
    path = land("users", {"Items": [{"Name": "a", "Id": "1"}, {"Name": "b", "Id": "2"}, {"Name": "a", "Id": "3"}]})
    assert rows(landing.users(spark, path)) == [("a", "3"), ("b", "2")]


def test_folder_names(spark, land):
    path = land("folders", {"Items": [
        {"Name": "movies", "Id": "1", "CollectionType": "x"}, {"Name": "", "Id": "2", "CollectionType": "tv"},
        {"Id": "3", "CollectionType": ""}, {"Id": "4"}]})
    assert rows(landing.media_folders(spark, path)) == [("3", "3"), ("4", "4"), ("movies", "1"), ("tv", "2")]


def test_tsv_keeps_raw_text(spark, tmp_path):
    header = "\t".join(tsv.FILES["titles"].header)
    lines = [
        header,
        "tt1\tmovie\t\"Open\tA \\ b\t0\t1999\t\\N\t90\tDrama,,Comedy",
        "tt2\t\\N\t\\N\t\t1\t\\N\t\\N\t\\N\t\\N",
    ]
    path = tmp_path / "title.basics.tsv"
    path.write_text("\n".join(lines) + "\n")
    got = {r.t_const: r for r in tsv.read_tsv(spark, str(path), "titles").collect()}
    assert tuple(got["tt1"]) == ("tt1", "movie", '"Open', "A \\ b", 0, "1999", None, 90)
    assert tuple(got["tt2"]) == ("tt2", None, None, "", 1, None, None, None)
    staging = tsv.read_tsv(spark, str(path), "genres_staging")
    assert rows(titles.lateral_split(staging, "genres", "genre")) == [("tt1", ""), ("tt1", "Comedy"), ("tt1", "Drama")]


@pytest.mark.parametrize("line", ["tt1\t5.5", "tt1\t5.5\t10\tx", "tt1\t5.5\tmany", "tt1\t\t10"])
def test_tsv_bad_lines_fail(spark, tmp_path, line):
    path = tmp_path / "r.tsv"
    path.write_text("tconst\taverageRating\tnumVotes\n" + line + "\n")
    with pytest.raises(Exception):
        tsv.read_tsv(spark, str(path), "ratings").collect()


def test_cache_reads_through(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def compute(value):
        def make():
            calls.append(value)
            return spark.createDataFrame([(value,)], "v int")
        return make

    assert encoded_cache(spark, path, compute(1)).first().v == 1
    assert encoded_cache(spark, path, compute(2)).first().v == 1
    assert encoded_cache(spark, path, compute(3), refresh=True).first().v == 3
    assert calls == [1, 3]


def test_a_doubled_page_does_not_make_up_for_a_missing_one(spark, land):
    one = {"Id": "1", "Name": "a", "Type": "Movie"}
    first = {"StartIndex": 0, "TotalRecordCount": 4, "Items": [one, {**one, "Id": "2"}]}
    path = land("catalog", first, first)
    assert tuple(landing.catalog_totals(spark, path).first()) == (2, 4)
