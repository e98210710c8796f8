"""The driver's tables reshaped into the engine's inputs, whole tables throughout.

`oracles.py` states the same reshaping as SQL, written separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.operators.titles import titles_genres_join
from reelmark.session import scratch_path
from reelmark.sources.tsv import FILES

GAP_MINUTES = 3 * 1440
CUTOFF = "2024-01-15 11:10:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(number: Column) -> Column:
    return F.when(number % 3 == 0, "Movie").when(number % 3 == 1, "Episode").otherwise("Trailer")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as playback events: half on twenty hot items, three of which the library lacks, half over all of `part`.

    There are five events to a part; of the second half, those of one in thirty-five are of items the library lacks.
    """
    hot = F.col("event_id") % 2 == 0
    folded = F.get_json_object("props", "$.k").cast("long") % 20
    number = F.when(hot, folded).otherwise(F.floor(F.col("event_id") / 5))
    missing = F.when(hot, folded >= 17).otherwise(F.col("event_id") % 35 == 1)
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_id").alias("row_id"),
            F.date_trunc("second", F.col("ts").cast("timestamp")).alias("event_ts"),
            F.col("user_id").cast("string").alias("user_id"),
            F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("user_name"),
            F.floor(F.col("value") * 20).cast("long").alias("duration"),
            number.alias("_number"),
            missing.alias("_missing"),
        )
        .select(
            "row_id",
            F.date_format("event_ts", "yyyy-MM-dd").alias("date"),
            F.date_format("event_ts", "HH:mm:ss").alias("time"),
            "user_id",
            F.concat(F.lit("Item "), F.col("_number").cast("string")).alias("item_name"),
            F.concat(F.when(F.col("_missing"), "clip-").otherwise(""), F.col("_number").cast("string")).alias(
                "item_id"
            ),
            _kind(F.col("_number")).alias("item_type"),
            "duration",
            F.when(F.col("row_id") % 4 != 0, F.concat(F.lit("10.0.0."), F.col("_number").cast("string"))).alias(
                "remote_address"
            ),
            "user_name",
            "event_ts",
        )
    )


def runtime_ticks(part_key: Column, size: Column) -> Column:
    return F.when(part_key % 4 != 3, size.cast("long") * 60 * 10_000_000 + 5)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as the stored library (the columns the history needs)."""
    key = F.col("p_partkey")
    ticks = runtime_ticks(key, F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("item_id"),
        F.col("p_name").alias("item_name"),
        _kind(key).alias("item_type"),
        ticks.alias("runtime_ticks"),
        F.expr("CASE WHEN p_partkey % 4 <> 3 THEN (p_size * 600000000L + 5) div 10000000 END").alias(
            "runtime_seconds"
        ),
    )


# ---- nested catalogue payloads, written as JSON lines ------------------------------------------

PAGE = 1000  # elements per landed document

_ITEM = """
named_struct(
  'Id', cast(i as string), 'Name', label, 'Type', kind,
  'SeriesName', if(kind = 'Episode', concat('Series ', i % 150), null),
  'SeriesId', if(kind = 'Episode', concat('S', i % 150), null),
  'ParentId', concat('F', i % 5), 'ParentIndexNumber', p_size % 10, 'IndexNumber', p_size,
  'RunTimeTicks', if(i % 4 <> 3, p_size * 600000000L + 5, null),
  'PremiereDate', concat(1950 + p_size, '-01-01'), 'Overview', concat(p_name, ' ', p_type),
  'CommunityRating', p_retailprice / 100, 'ProductionYear', 1950 + p_size,
  'Path', concat('/media/', i), 'Container', if(i % 2 = 0, 'mkv', 'mp4'),
  'Width', case i % 5 when 0 then null when 1 then 0 else 1920 end,
  'Height', case i % 4 when 0 then null when 1 then 0 else 1080 end,
  'MediaStreams', case i % 7 when 0 then null when 1 then array() else array(
      named_struct('Type', 'Audio', 'Codec', 'aac', 'Width', null, 'Height', null),
      named_struct('Type', 'Video', 'Codec', if(i % 7 = 2, null, 'h264'), 'Width', 1280,
                   'Height', if(i % 7 = 3, null, 720)),
      named_struct('Type', 'Video', 'Codec', 'hevc', 'Width', 3840, 'Height', 2160)) end,
  'GenreItems', case (i div 3) % 6 when 0 then null when 1 then array()
      when 2 then array(named_struct('Name', p_type, 'Id', p_size))
      when 3 then array(named_struct('Name', null, 'Id', 7))
      when 4 then array(named_struct('Name', p_type, 'Id', p_size), named_struct('Name', w1, 'Id', 500))
      else array(named_struct('Name', '', 'Id', 9), named_struct('Name', p_type, 'Id', p_size),
                 named_struct('Name', p_type, 'Id', p_size)) end,
  'Genres', case (i div 5) % 4 when 0 then null when 1 then array()
      when 2 then array(w1, '', w2, w1) else array(upper(w1), p_type, p_brand) end,
  'TagItems', case (i div 2) % 4 when 0 then null
      when 1 then array(named_struct('Name', p_brand, 'Id', null), named_struct('Name', p_brand, 'Id', null))
      when 2 then array(named_struct('Name', p_brand, 'Id', p_size))
      else array(named_struct('Name', '', 'Id', 5), named_struct('Name', p_brand, 'Id', 5)) end,
  'Tags', case (i div 7) % 3 when 0 then null when 1 then array(p_brand, w2, upper(w2))
      else array('', w2, w2) end,
  'ProviderIds', named_struct('Imdb', concat('tt', i), 'Tmdb', if(i % 2 = 0, '', cast(p_size as string)))
)
"""

_landed: dict[tuple, str] = {}


def _land(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """Write a payload once per session and data folder; returns its path."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        path = scratch_path(spark, name)
        make().write.text(path)
        _landed[key] = path
    return _landed[key]


def _documents(rows: DataFrame, order: str, item: Column, field: str, offset: int = 0, **extra) -> DataFrame:
    """JSON documents of at most PAGE elements each, in ``order`` (a dense number)."""
    pages = rows.groupBy((F.floor(F.col(order) / PAGE) * PAGE + offset).alias("StartIndex")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), item.alias("_i")))).alias("_all")
    )
    body = F.struct(
        "StartIndex",
        *[F.lit(value).alias(key) for key, value in extra.items()],
        F.transform("_all", lambda e: e["_i"]).alias(field),
    )
    return pages.select(F.to_json(body).alias("value"))


def landed_catalog(spark: SparkSession, sf_dir: str) -> str:
    """`part` as catalogue pages; every fiftieth item is listed again, renamed, on a later page."""

    def make() -> DataFrame:
        parts = table(spark, sf_dir, "part").selectExpr(
            "*", "p_partkey as i", "split_part(p_name, ' ', 1) as w1", "split_part(p_name, ' ', 2) as w2",
            "case p_partkey % 3 when 0 then 'Movie' when 1 then 'Episode' else 'Trailer' end as kind",
        )
        again = parts.where("i % 50 = 0")
        total = parts.count() + again.count()
        first = parts.withColumn("label", F.col("p_name")).withColumn("o", F.col("i"))
        second = again.withColumn("label", F.concat(F.lit("new "), F.col("p_name"))).withColumn(
            "o", F.floor(F.col("i") / 50)
        )
        item = F.expr(_ITEM)
        return _documents(first, "o", item, "Items", TotalRecordCount=total).unionByName(
            _documents(second, "o", item, "Items", offset=1_000_000_000_000, TotalRecordCount=total)
        )

    return _land(spark, sf_dir, "catalog", make)


def landed_series(spark: SparkSession, sf_dir: str) -> str:
    """`supplier` with its nation and region as one document per series."""

    def make() -> DataFrame:
        rows = (
            table(spark, sf_dir, "supplier")
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        return rows.select(
            F.to_json(
                F.expr("""named_struct(
                  'Id', concat('S', s_suppkey),
                  'GenreItems', case s_suppkey % 4 when 0 then null
                      when 1 then array(named_struct('Name', n_name, 'Id', n_nationkey),
                                        named_struct('Name', n_name, 'Id', 99),
                                        named_struct('Name', null, 'Id', 1))
                      when 2 then array() else array(named_struct('Name', r_name, 'Id', 11)) end,
                  'Genres', case s_suppkey % 3 when 0 then null
                      else array(n_name, 'Small', 'ring', 'ring', '', r_name) end)""")
            ).alias("value")
        )

    return _land(spark, sf_dir, "series", make)


def landed_ref_genres(spark: SparkSession, sf_dir: str, which: str) -> str:
    """The first (movie) or second (tv) words of part names, each with the least part key it occurs in."""
    position = {"movie": 1, "tv": 2}[which]

    def make() -> DataFrame:
        return (
            table(spark, sf_dir, "part")
            .groupBy(F.split_part("p_name", F.lit(" "), F.lit(position)).alias("name"))
            .agg(F.min("p_partkey").alias("id"))
            .agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("genres"))
            .select(F.to_json(F.struct("genres")).alias("value"))
        )

    return _land(spark, sf_dir, f"{which}-genres", make)


def landed_users(spark: SparkSession, sf_dir: str) -> str:
    """`customer` as user lists; names repeat, ids do not."""
    item = F.struct(
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("Name"),
        F.col("c_custkey").cast("string").alias("Id"),
    )
    return _land(
        spark, sf_dir, "users", lambda: _documents(table(spark, sf_dir, "customer"), "c_custkey", item, "Items")
    )


def landed_folders(spark: SparkSession, sf_dir: str) -> str:
    """`supplier` as media folders, some without a name or a collection type."""
    item = F.expr("""named_struct(
        'Name', case s_suppkey % 3 when 0 then '' when 1 then null else s_name end,
        'Id', cast(s_suppkey as string),
        'CollectionType', case s_suppkey % 2 when 0 then concat('type', s_nationkey) else '' end)""")
    return _land(
        spark, sf_dir, "folders", lambda: _documents(table(spark, sf_dir, "supplier"), "s_suppkey", item, "Items")
    )


def landed_playback(spark: SparkSession, sf_dir: str) -> str:
    """The raw events as {user: [events]} documents, at most PAGE event ids to a document."""

    def make() -> DataFrame:
        event = F.struct(
            "date", "time", "user_id", "item_name", "item_id", "item_type",
            F.col("duration").cast("string").alias("duration"), "remote_address", "user_name",
            F.lit(False).alias("user_has_image"),
        )
        documents = (
            raw_events(spark, sf_dir)
            .groupBy("user_name", F.floor(F.col("row_id") / PAGE))
            .agg(F.collect_list(event).alias("events"))
        )
        return documents.select(F.to_json(F.create_map("user_name", "events")).alias("value"))

    return _land(spark, sf_dir, "playback", make)


# ---- metadata files, written as tab-separated text ----------------------------------------------

_NULL = r"'\\N'"

TSV_SOURCES = {
    "crew_staging": ("lineitem", [
        "concat('tt', l_orderkey)",
        f"case l_linenumber % 4 when 0 then {_NULL} when 1 then '' else concat('nm', l_suppkey, ',nm', l_partkey) end",
        f"if(l_quantity > 40, {_NULL}, concat('nm', l_partkey, ',,nm', l_linenumber))",
    ]),
    "episodes": ("orders", [
        "concat('tt', o_orderkey)", "concat('tt', o_custkey)",
        f"if(o_orderstatus = 'P', {_NULL}, cast(month(o_orderdate) as string))", "cast(day(o_orderdate) as string)",
    ]),
    "titles": ("part", [
        "concat('tt', p_partkey)", "p_type", f"if(p_partkey % 11 = 0, {_NULL}, p_name)",
        r"concat('\"', p_name, '\\x')", "cast(p_partkey % 2 as string)", "cast(1950 + p_size as string)", _NULL,
        f"if(p_partkey % 4 = 3, {_NULL}, cast(p_size as string))",
        f"case p_partkey % 13 when 0 then {_NULL} when 1 then '' "
        "else concat_ws(',', p_type, p_brand, split_part(p_name, ' ', 1)) end",
    ]),
    "persons": ("customer", [
        "concat('nm', c_custkey)", "c_name", "cast(1930 + c_nationkey as string)",
        f"if(c_acctbal < 0, {_NULL}, '2001')", "lower(c_mktsegment)", "concat('tt', c_nationkey)",
    ]),
    "ratings": ("part", [
        "concat('tt', p_partkey)", "cast(p_size / 5 as string)", "cast(p_partkey * 3 as string)",
    ]),
    "roles": ("lineitem", [
        "concat('tt', l_orderkey)", "cast(l_linenumber as string)", "concat('nm', l_suppkey)", "lower(l_returnflag)",
        f"if(l_linestatus = 'F', {_NULL}, 'job')", r"concat('[\"', l_returnflag, '\\')",
    ]),
}
TSV_SOURCES["genres_staging"] = TSV_SOURCES["titles"]


def landed_tsv(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A metadata file made from a driver table, with its header line once per file part."""
    source, fields = TSV_SOURCES[name]
    header = "\t".join(FILES[name].header)

    def make() -> DataFrame:
        lines = table(spark, sf_dir, source).select(
            F.concat_ws("\t", *[F.expr(field) for field in fields]).alias("value")
        )
        return spark.createDataFrame([(header,)], "value string").unionByName(lines)

    return _land(spark, sf_dir, f"tsv-{source}-{len(fields)}", make)


def landed_tsv_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return {name: landed_tsv(spark, sf_dir, name) for name in TSV_SOURCES}


# ---- title genres ---------------------------------------------------------------------------------


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as titles; one in nineteen has no name."""
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as t_const", "if(p_partkey % 19 = 18, null, p_name) as primary_name"
    )


def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, brand and first name word of each part; some tags repeat, some are null.

    The word is marked because some words equal a type but for case, and Spark's column names ignore case.
    """
    word = "concat('is ', split_part(p_name, ' ', 1))"
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as t_const",
        f"""explode(case when p_partkey % 17 = 16 then array(cast(null as string))
                         when p_partkey % 10 = 9 then array(p_type, p_brand, {word}, p_type)
                         else array(p_type, p_brand, {word}) end) as genre""",
    )


def titles_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles_genres_join(titles(spark, sf_dir), genres(spark, sf_dir))
