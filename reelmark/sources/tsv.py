"""Readers of the public film/TV metadata dumps: tab-separated, header line, backslash-N for NULL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import scalars as fn


@dataclass(frozen=True)
class TsvFile:
    header: tuple[str, ...]
    columns: dict[str, tuple[str, str]]  # table column -> (file column, Spark type)


# File headers and the columns each table takes from them.
FILES: dict[str, TsvFile] = {
    "crew_staging": TsvFile(
        ("tconst", "directors", "writers"),
        {
            "t_const": ("tconst", "string"),
            "directors_csv": ("directors", "string"),
            "writers_csv": ("writers", "string"),
        },
    ),
    "episodes": TsvFile(
        ("tconst", "parentTconst", "seasonNumber", "episodeNumber"),
        {
            "t_const": ("tconst", "string"),
            "parent_t_const": ("parentTconst", "string"),
            "season_num": ("seasonNumber", "int"),
            "episode_num": ("episodeNumber", "int"),
        },
    ),
    "titles": TsvFile(
        (
            "tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear",
            "runtimeMinutes", "genres",
        ),
        {
            "t_const": ("tconst", "string"),
            "type": ("titleType", "string"),
            "primary_name": ("primaryTitle", "string"),
            "original_name": ("originalTitle", "string"),
            "is_adult": ("isAdult", "tinyint"),
            "start_year": ("startYear", "string"),
            "end_year": ("endYear", "string"),
            "runtime_minutes": ("runtimeMinutes", "int"),
        },
    ),
    "genres_staging": TsvFile(
        (
            "tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear",
            "runtimeMinutes", "genres",
        ),
        {"t_const": ("tconst", "string"), "genres": ("genres", "string")},
    ),
    "persons": TsvFile(
        ("nconst", "primaryName", "birthYear", "deathYear", "primaryProfession", "knownForTitles"),
        {
            "n_const": ("nconst", "string"),
            "name": ("primaryName", "string"),
            "birth_year": ("birthYear", "string"),
            "death_year": ("deathYear", "string"),
        },
    ),
    "ratings": TsvFile(
        ("tconst", "averageRating", "numVotes"),
        {
            "t_const": ("tconst", "string"),
            "avg_rating": ("averageRating", "double"),
            "num_votes": ("numVotes", "int"),
        },
    ),
    "roles": TsvFile(
        ("tconst", "ordering", "nconst", "category", "job", "characters"),
        {
            "t_const": ("tconst", "string"),
            "n_const": ("nconst", "string"),
            "category": ("category", "string"),
            "job": ("job", "string"),
            "characters": ("characters", "string"),
        },
    ),
}


def read_tsv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The table's columns from its file.

    Lines are split as plain text: quotes and backslashes stay as they are and an empty field is an
    empty string, which the CSV reader would turn into NULL. A line with the wrong number of fields,
    or a number that is none, fails the job.
    """
    spec = FILES[table]
    width = len(spec.header)
    lines = spark.read.option("lineSep", "\n").text(path).where(F.col("value") != "\t".join(spec.header))
    fields = F.split("value", "\t", -1)
    checked = F.when(F.size(fields) == width, fields).otherwise(
        F.raise_error(F.concat(F.lit(f"{table}: expected {width} fields in line: "), F.col("value")))
    )
    parts = lines.select(checked.alias("_f"))
    return parts.select(
        *[
            fn.null_marker(F.col("_f")[spec.header.index(source)]).cast(kind).alias(name)
            for name, (source, kind) in spec.columns.items()
        ]
    )
