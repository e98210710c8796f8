from __future__ import annotations

import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reelmark.operators import maintenance
from reelmark.plans import loads
from reelmark.session import job, scratch_path
from reelmark.sources import tsv
from reelmark.sources.store import TableStore


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def test_store_rewrites_what_it_reads(spark, store):
    assert store.read("movie_genres").count() == 0
    assert store.overwrite("movie_genres", spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string"))["rows"] == 2
    before = store.read("movie_genres")
    store.overwrite("movie_genres", store.read("movie_genres").where("id = 2"))
    assert rows(store.read("movie_genres")) == [(2, "B")]
    assert before.count() == 2  # a reader of the earlier version is not disturbed
    store.append("movie_genres", spark.createDataFrame([(3, "C")], "id long, name string"))
    assert rows(store.read("movie_genres")) == [(2, "B"), (3, "C")]
    store.vacuum("movie_genres")
    assert rows(store.read("movie_genres")) == [(2, "B"), (3, "C")]
    store.drop("movie_genres")
    assert not store.exists("movie_genres")


def test_unfinished_version_is_ignored(spark, store, tmp_path):
    store.overwrite("tv_genres", spark.createDataFrame([(1, "A")], "id long, name string"))
    (tmp_path / "store" / "tv_genres" / "version=2").mkdir()
    assert rows(store.read("tv_genres")) == [(1, "A")]
    # nor is an append whose job was lost half way
    store.append("tv_genres", spark.createDataFrame([(2, "B")], "id long, name string"))
    store.append("tv_genres", spark.createDataFrame([(3, "C")], "id long, name string"))
    lost = next(f for f in (tmp_path / "store" / "tv_genres").glob("added=1.*") if "C" in str(spark.read.parquet(str(f)).collect()))
    (lost / "_SUCCESS").unlink()
    assert rows(store.read("tv_genres")) == [(1, "A"), (2, "B")]
    assert not store.in_one_folder("tv_genres")
    store.overwrite("tv_genres", store.read("tv_genres"))
    assert store.in_one_folder("tv_genres") and rows(store.read("tv_genres")) == [(1, "A"), (2, "B")]


def test_a_write_works_its_rows_out_once(spark, store):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    stats = spark.range(500).selectExpr("cast(id % 7 as string) AS user_id", "cast(id as string) AS item_id", "id AS total_sessions")
    counting = stats.mapInPandas(counted, stats.schema)
    assert store.overwrite("user_item_stats", counting)["rows"] == 500
    assert seen.value == 500


def test_a_job_leaves_no_steps(spark):
    paths = []

    @job
    def run(spark):
        paths.append(scratch_path(spark, "step"))
        spark.range(3).write.parquet(paths[0])
        return spark.read.parquet(paths[0]).count()

    assert run(spark) == 3
    assert not os.path.exists(paths[0])
    assert os.path.dirname(scratch_path(spark, "step")) == os.path.dirname(os.path.dirname(paths[0]))


def test_raw_events_drop_nulls_keep_duplicates(spark, store):
    event = ("2025-08-20", "01:00:00", "u", "n", "1", "Movie", 5, None, "U", None)
    data = [event, event, event[:2] + (None,) + event[3:], event[:6] + (None,) + event[7:]]
    frame = spark.createDataFrame(data,
                                  "date string, time string, user_id string, item_name string, item_id string, "
                                  "item_type string, duration long, remote_address string, user_name string, event_ts timestamp")
    maintenance.sink_raw_events(store, frame)
    assert store.read("raw_events").count() == 2
    assert store.read("raw_events").select("row_id").distinct().count() == 2


def test_library_upsert_last_row_wins(spark):
    old = spark.createDataFrame([("1", "old"), ("2", "kept")], "item_id string, item_name string")
    new = spark.createDataFrame([("1", "late", 5), ("1", "early", 3), ("3", "new", 1)], "item_id string, item_name string, ingest_seq int")
    assert rows(maintenance.upsert_library_items(old, new)) == [("1", "late"), ("2", "kept"), ("3", "new")]


def test_tag_upsert_keeps_null_ids(spark):
    old = spark.createDataFrame([("1", 5, "old"), ("1", None, "n")], "item_id string, tag_id long, tag_name string")
    new = spark.createDataFrame([("1", 5, "a", 1), ("1", 5, "b", 2), ("1", None, "n", 3)], "item_id string, tag_id long, tag_name string, ingest_seq int")
    assert rows(maintenance.upsert_item_tags(old, new)) == sorted([("1", 5, "b"), ("1", None, "n"), ("1", None, "n")], key=repr)


def test_genre_rows_do_not_pile_up(spark):
    shape = "item_id string, genre_id long, genre_name string"
    old = spark.createDataFrame([("1", 1, "A"), ("2", 2, "B"), ("3", 3, "C")], shape)
    new = spark.createDataFrame([("1", 1, "A"), ("1", 1, "A")], shape)
    ids = spark.createDataFrame([("1",), ("3",)], "item_id string")
    assert rows(maintenance.upsert_item_genres(old, new, ids)) == [("1", 1, "A"), ("1", 1, "A"), ("2", 2, "B")]


@pytest.mark.parametrize("seed", range(4))
def test_ref_genres_equal_replace_on_either_key(spark, seed):
    rng = random.Random(seed)
    old = [(i, f"old{i}") for i in range(3)]
    sequence = [(1, "A"), (2, "B"), (3, "A"), (2, "C")] + [(rng.randrange(8), rng.choice(["A", "B", "C", "D", "old1", "old2"])) for _ in range(12)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE g (id INTEGER PRIMARY KEY, name TEXT UNIQUE)")
    db.executemany("INSERT OR REPLACE INTO g VALUES (?, ?)", old + sequence)
    got = maintenance.upsert_ref_genres(
        spark.createDataFrame(old, "id long, name string"),
        spark.createDataFrame([(i, n, at) for at, (i, n) in enumerate(sequence)], "id long, name string, ingest_seq int"),
    )
    assert rows(got) == sorted(db.execute("SELECT id, name FROM g").fetchall(), key=repr)


def test_prune(spark, store):
    store.overwrite("library_items", spark.createDataFrame([("1", "a", "Movie"), ("2", "b", "Movie")], "item_id string, item_name string, item_type string"))
    store.overwrite("item_genres", spark.createDataFrame([("1", "A"), ("2", "B"), ("2", "C")], "item_id string, genre_name string"))
    store.overwrite("item_tags", spark.createDataFrame([("2", 1)], "item_id string, tag_id long"))
    current = spark.createDataFrame([("1",), ("9",)], "item_id string")
    assert maintenance.prune_missing_items(store, current) == 1
    assert [store.read(n).count() for n in maintenance.ITEM_TABLES] == [0, 1, 0, 1]
    assert maintenance.prune_missing_items(store, current) == 0


@pytest.mark.parametrize("live", [("1", "2"), ("1",)])
def test_prune_keeps_rows_of_items_never_in_the_library(spark, store, live):
    items = [("1", "a", "Movie"), ("2", "b", "Movie")]
    store.overwrite("library_items", spark.createDataFrame(items, "item_id string, item_name string, item_type string"))
    store.overwrite("item_tags", spark.createDataFrame([("1", 1), ("2", 1), ("orphan", 1), (None, 1)], "item_id string, tag_id long"))
    maintenance.prune_missing_items(store, spark.createDataFrame([(i,) for i in live], "item_id string"))
    assert rows(store.read("item_tags"), "item_id") == sorted([(i,) for i in (*live, "orphan", None)], key=repr)


def test_backup_and_truncate(spark, store, tmp_path):
    store.overwrite("movie_genres", spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string"))
    report = maintenance.snapshot_backup(store, ("movie_genres", "tv_genres"), str(tmp_path / "bak"), "20250820-010000")
    assert rows(report) == [("movie_genres", 2, 2)]
    assert maintenance.truncate_tables(store, ("movie_genres",)) == {"movie_genres": 0}
    copy = TableStore(spark, str(tmp_path / "bak" / "run_ts=20250820-010000"))
    assert rows(copy.read("movie_genres")) == [(1, "A"), (2, "B")]


def test_catalog_statistics(spark, store):
    store.overwrite("movie_genres", spark.range(7).select("id", F.col("id").cast("string").alias("name")))
    names = maintenance.create_all(store, ("movie_genres", "tv_genres"), "t_")
    assert rows(maintenance.analyze_tables(spark, names)) == [("t_movie_genres", 7), ("t_tv_genres", 0)]
    for name in names:
        maintenance.drop_table(spark, name)
    assert not spark.catalog.tableExists("t_movie_genres")


LINES = {
    "crew_staging": ["tt1\tnm1,nm2\t\\N", "tt2\t\\N\tnm3,,nm4", "tt3\t\tnm5"],
    "episodes": ["tt2\ttt1\t1\t\\N"],
    "titles": ["tt1\tmovie\tOne\tOne\t0\t1999\t\\N\t90\tDrama,Crime", "tt2\tmovie\tTwo\tTwo\t0\t1999\t\\N\t\\N\t\\N"],
    "persons": ["nm1\tAnn\t1950\t\\N\tactor\ttt1"],
    "ratings": ["tt1\t7.5\t100"],
    "roles": ["tt1\t1\tnm1\tactor\t\\N\t[\"Self\"]"],
}
LINES["genres_staging"] = LINES["titles"]


@pytest.fixture
def files(tmp_path):
    for name, lines in LINES.items():
        (tmp_path / f"{name}.tsv").write_text("\n".join(["\t".join(tsv.FILES[name].header), *lines]) + "\n")
    return {name: str(tmp_path / f"{name}.tsv") for name in LINES}


def test_metadata_load(spark, store, files):
    loads.load_imdb_tables(spark, store, files)
    assert rows(store.read("directors"), "t_const", "n_const") == [("tt1", "nm1"), ("tt1", "nm2")]
    assert rows(store.read("writers"), "t_const", "n_const") == [("tt2", ""), ("tt2", "nm3"), ("tt2", "nm4"), ("tt3", "nm5")]
    assert rows(store.read("genres"), "t_const", "genre") == [("tt1", "Crime"), ("tt1", "Drama")]
    assert rows(store.read("ratings")) == [("tt1", 7.5, 100)]
    with pytest.raises(ValueError, match="duplicate key"):
        loads.load_imdb_tables(spark, store, files)
    loads.load_imdb_tables(spark, store, files, mode="overwrite")
    assert store.read("titles").count() == 2
    ids = [r.id for r in store.read("writers").collect()]
    assert len(set(ids)) == 4 and min(ids) > 0


@pytest.mark.parametrize(
    ("table", "line", "message"),
    [
        ("episodes", "tt3\t\\N\t1\t1", "parent_t_const"),
        ("roles", "tt1\t1\t\\N\tactor\t\\N\t\\N", "n_const"),
        ("titles", "tt3\t" + "x" * 50 + "\tOne\tOne\t0\t1999\t\\N\t90\tDrama", "type"),
    ],
)
def test_declared_constraints_stop_the_load(spark, store, files, table, line, message):
    loads.load_imdb_tables(spark, store, files)
    with open(files[table], "a") as file:
        file.write(line + "\n")
    with pytest.raises(ValueError, match=message):
        loads.load_imdb_tables(spark, store, files, mode="overwrite")
    assert store.read("titles").count() == 2 and store.read("directors").count() == 2


def test_nightly_refresh(spark, store, land, tmp_path):
    paths = loads.LandedPaths(
        playback=land("log", {"Ann": [
            dict(date="2025-09-01", time="10:00:00", user_id="u", item_name="One", item_id="1", item_type="Movie", duration="600", user_name="Ann"),
            dict(date="2025-09-01", time="10:10:00", user_id="u", item_name="One", item_id="1", item_type="Movie", duration="300", user_name="Ann"),
        ]}),
        catalog=land("cat", {"TotalRecordCount": 2, "Items": [
            {"Id": "1", "Name": "One", "Type": "Movie", "RunTimeTicks": 10_000_000_000, "Genres": ["Drama"], "ProviderIds": {"Imdb": "tt1"}},
            {"Id": "2", "Name": "Two", "Type": "Episode", "SeriesId": "S"},
        ]}),
        movie_genres=land("mg", {"genres": [{"id": 18, "name": "Drama"}]}),
        tv_genres=land("tg", {"genres": [{"id": 80, "name": "Crime"}]}),
        series=land("series", {"Id": "S", "Genres": ["Crime"]}),
    )
    store.overwrite("movie_genres", spark.createDataFrame([(99, "Gone")], "id long, name string"))
    metrics = loads.refresh_watch_history(spark, store, paths, str(tmp_path / "bak"))
    assert metrics.where("table_name = 'raw_events'").first().rows == 2
    assert rows(store.read("movie_genres")) == [(18, "Drama")]
    assert rows(store.read("item_genres"), "item_id", "genre_id") == [("1", 18), ("2", 80)]
    session = store.read("sessions").first()
    assert (session.total_seconds_watched, session.session_count, session.completion_ratio, session.outcome) == (900, 2, 0.9, "completed")
    assert store.read("user_item_stats").first().total_sessions == 1
    assert TableStore(spark, next(str(p) for p in (tmp_path / "bak").iterdir())).read("movie_genres").first().name == "Gone"
    loads.load_history(spark, store, paths.playback, num_days=10, as_of="2025-08-31")  # the events come later
    assert store.read("raw_events").count() == 0
    # half a catalogue must not prune the other half
    land("cat", {"TotalRecordCount": 2, "Items": [{"Id": "1", "Name": "One", "Type": "Movie"}]})
    with pytest.raises(ValueError, match="1 of 2"):
        loads.refresh_watch_history(spark, store, paths)
    # an item without a name breaks a declared constraint and stops the ingest
    land("cat", {"Items": [{"Id": "3", "Type": "Movie"}]})
    with pytest.raises(ValueError, match="item_name"):
        loads.refresh_watch_history(spark, store, paths)
