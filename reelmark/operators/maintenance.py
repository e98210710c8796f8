"""Keeping stored tables current: checked inserts, upserts, pruning, backups, resets, DDL."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.plans.joins import lookup_join
from reelmark.plans.latest import latest_by_key
from reelmark.schemas import TABLES
from reelmark.session import cut_lineage
from reelmark.sources.store import TableStore, with_row_ids

LOCAL_ZONE = "Australia/Melbourne"
ITEM_TABLES = ("item_provider_ids", "item_genres", "item_tags", "library_items")


# ---- sinks ------------------------------------------------------------------------------


def insertable(rows: DataFrame, table: str) -> DataFrame:
    """Rows without a null in a required column; duplicates stay."""
    return rows.dropna(subset=[c for c in TABLES[table].not_null if c in rows.columns])


def sink_raw_events(store: TableStore, events: DataFrame) -> dict:
    return store.overwrite("raw_events", with_row_ids(insertable(events, "raw_events"), "row_id"))


def sink_sessions(store: TableStore, sessions: DataFrame) -> dict:
    return store.overwrite("sessions", sessions.withColumn("created_timestamp", F.current_timestamp()))


def sink_user_item_stats(store: TableStore, stats: DataFrame) -> dict:
    return store.overwrite("user_item_stats", stats.withColumn("last_updated_timestamp", F.current_timestamp()))


# ---- upserts ----------------------------------------------------------------------------


def _old_then_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of rows with `_order`: any new row comes after every old one."""
    columns = [c for c in new.columns if c != "ingest_seq"]
    seq_type = new.schema["ingest_seq"].dataType
    before = old.select(
        *columns, F.struct(F.lit(0).alias("batch"), F.lit(None).cast(seq_type).alias("seq")).alias("_order")
    )
    after = new.select(*columns, F.struct(F.lit(1).alias("batch"), F.col("ingest_seq").alias("seq")).alias("_order"))
    return before.unionByName(after)


def _upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    columns = [c for c in new.columns if c != "ingest_seq"]
    return latest_by_key(_old_then_new(old, new), keys, "_order").select(*columns)


def upsert_library_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by item_id; the last row in input order wins."""
    return _upsert(old, new, ["item_id"])


def upsert_item_genres(old: DataFrame, new: DataFrame, ingested: DataFrame) -> DataFrame:
    """New rows, plus old rows of items that were not ingested now."""
    ids = ingested.select("item_id").distinct()
    columns = ["item_id", "genre_id", "genre_name"]
    kept = lookup_join(old.select(*columns), ids, "item_id", "left_anti")
    return kept.unionByName(new.select(*columns))


def upsert_item_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by (item_id, tag_id); a null tag_id equals no other, so those rows all stay."""
    both = _old_then_new(old, new)
    keyed = latest_by_key(both.where(F.col("tag_id").isNotNull()), ["item_id", "tag_id"], "_order")
    return keyed.unionByName(both.where(F.col("tag_id").isNull()).drop("_order"))


def upsert_provider_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by (item_id, provider)."""
    return _upsert(old, new, ["item_id", "provider"])


def upsert_ref_genres(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace on equal id or equal name.

    A row stays only if nothing later has its id or its name, so it must be the last of both.
    """
    both = _old_then_new(old, new)
    last_of_id = latest_by_key(both.withColumn("_at", F.col("_order")), ["id"], "_order")
    last_of_name = both.groupBy("name").agg(F.max("_order").alias("_at"))
    return last_of_id.join(last_of_name, ["name", "_at"], "left_semi").select("id", "name")


# ---- pruning ------------------------------------------------------------------------------


def missing_ids(library: DataFrame, current: DataFrame) -> DataFrame:
    """Ids in the library that are not current: the set difference."""
    return lookup_join(
        library.select("item_id").distinct(), current.select("item_id").distinct(), "item_id", "left_anti"
    )


def still_present(rows: DataFrame, current: DataFrame) -> DataFrame:
    return lookup_join(rows, current.select("item_id").distinct(), "item_id", "left_semi")


def prune_missing_items(store: TableStore, current: DataFrame) -> int:
    """Rewrite the four item tables without the items that left the library; returns how many went.

    Rows of items that the library never held stay, whether anything is pruned or not.
    """
    gone = cut_lineage(missing_ids(store.read("library_items"), current))
    removed = gone.count()
    if removed:
        for name in ITEM_TABLES:
            store.overwrite(name, lookup_join(store.read(name), gone, "item_id", "left_anti"))
    return removed


# ---- whole tables -------------------------------------------------------------------------


def truncate_tables(store: TableStore, names: tuple[str, ...]) -> dict[str, int]:
    """Empty the tables and count what is left in each."""
    for name in names:
        store.truncate(name)
    return {name: store.read(name).count() for name in names}


def local_stamp(moment: datetime | None = None) -> str:
    return (moment or datetime.now(ZoneInfo(LOCAL_ZONE))).strftime("%Y%m%d-%H%M%S")


def snapshot_backup(store: TableStore, names: tuple[str, ...], backup_root: str, stamp: str | None = None) -> DataFrame:
    """Copy the tables to a folder stamped with local time; a copy that lost rows fails the run.

    Returns (table_name, live_rows, backup_rows). The live tables are left alone: the caller replaces
    them only after this returns.
    """
    spark = store.spark
    copy = TableStore(spark, f"{backup_root.rstrip('/')}/run_ts={stamp or local_stamp()}")
    report = []
    for name in names:
        if not store.exists(name):
            continue
        copied = copy.overwrite(name, store.read(name), cluster=False)["rows"]
        live, kept = store.read(name).count(), copy.read(name).count()
        if not live == kept == copied:
            raise RuntimeError(f"backup of {name} has {kept} of {live} rows")
        report.append((name, live, kept))
    return spark.createDataFrame(report, "table_name string, live_rows long, backup_rows long")


# ---- catalog ------------------------------------------------------------------------------


def create_table(spark: SparkSession, name: str, table: str, location: str) -> None:
    """CREATE TABLE IF NOT EXISTS with the declared columns, over Parquet files at ``location``."""
    columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in TABLES[table].schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{location}'")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_all(store: TableStore, names: tuple[str, ...], prefix: str = "") -> list[str]:
    """Catalog entries for stored tables, which must lie in one folder: one never written is created empty
    first, and one that rows were appended to is rewritten."""
    made = []
    for name in names:
        if not store.in_one_folder(name):
            store.overwrite(name, store.read(name))
        create_table(store.spark, f"{prefix}{name}", name, store.location(name))
        made.append(f"{prefix}{name}")
    return made


def described(spark: SparkSession, name: str, table: str) -> DataFrame:
    """What the catalog holds of a table beside what is declared: (column_name, declared, held), differences only."""
    held = {c.name: c.dataType for c in spark.catalog.listColumns(name)}
    declared = {c.name: c.dataType.simpleString() for c in TABLES[table].schema}
    rows = [(c, declared.get(c), held.get(c)) for c in [*declared, *(h for h in held if h not in declared)] if declared.get(c) != held.get(c)]
    return spark.createDataFrame(rows, "column_name string, declared string, held string")


def reset_tables(store: TableStore, names: tuple[str, ...], prefix: str) -> DataFrame:
    """Create catalog entries of all tables, count them by fresh statistics, empty them, and drop the entries.

    Returns (table_name, row_count, rows_left, columns): what the statistics said, what is left, and how many columns the
    catalog holds, all of them as declared, else the run fails.
    """
    spark = store.spark
    made = create_all(store, names, prefix)
    for name, entry in zip(names, made):
        wrong = described(spark, entry, name).collect()  # a row a column at most
        if wrong:
            raise RuntimeError(f"{entry} is not as declared: {wrong}")
    counted = {r["table_name"]: r["row_count"] for r in analyze_tables(spark, made, columns=True).collect()}
    for entry in made:
        drop_table(spark, entry)
    left = truncate_tables(store, names)
    rows = [(n, counted[e], left[n], len(TABLES[n].schema)) for n, e in zip(names, made)]
    return spark.createDataFrame(rows, "table_name string, row_count long, rows_left long, columns int")


def analyze_tables(spark: SparkSession, names: list[str], columns: bool = False) -> DataFrame:
    """Refresh the optimizer's statistics and report the row counts it now holds.

    With ``columns`` also each column's distinct values, nulls, range and lengths, by which the optimizer orders joins
    where ``spark.sql.cbo.enabled`` is set.
    """
    report = None
    for name in names:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))
        row = (
            spark.sql(f"DESCRIBE EXTENDED {name}")
            .where(F.col("col_name") == "Statistics")
            .select(
                F.lit(name).alias("table_name"),
                F.regexp_extract("data_type", r"(\d+) rows", 1).cast("long").alias("row_count"),
            )
        )
        report = row if report is None else report.unionByName(row)
    return report
