"""Edit documents of games and chapter probes of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelbook.functions import text as X
from reelbook.schemas import CHAPTER_PROBE, EDIT_DOCUMENT


def read_edit_documents(spark: SparkSession, folder: str, *, per_file: bool = False) -> DataFrame:
    """Edit documents with the file they came from.

    ``per_file`` reads one indented document per file; otherwise one document per line, with its name in the line where
    :func:`write_edit_documents` was given one. See the document store for reading and replacing documents by name.
    """
    named = T.StructType([T.StructField("json_file", T.StringType()), *EDIT_DOCUMENT.fields])
    rows = spark.read.schema(named).option("multiLine", str(per_file).lower()).json(folder)
    name = F.coalesce("json_file", F.col("_metadata.file_name"))
    return rows.select(name.alias("json_file"), *EDIT_DOCUMENT.fieldNames())


def initial_edit_document(source_dir: Column, files: Column, filename: Column) -> Column:
    """Document a new game starts with."""
    none = F.array().cast("array<string>")
    # Content of a fresh edit document.
    return F.struct(
        F.lit("Team1").alias("team1"),
        F.lit("Team2").alias("team2"),
        source_dir.alias("dir"),
        files.alias("files"),
        filename.alias("filename"),
        F.lit(False).alias("verified"),
        F.lit(True).alias("training"),
        F.lit(True).alias("labeled"),
        F.lit(False).alias("rendered_file"),
        F.lit("").alias("game_mode"),
        none.alias("cuts"),
        none.alias("Warnings"),
    )


def write_edit_documents(documents: DataFrame, folder: str, *, column: str = "document", name: str | None = None) -> None:
    """Write a column of documents as JSON lines; the column ``name`` goes in front of each as ``json_file``."""
    whole = F.col(column) if name is None else F.struct(F.col(name).alias("json_file"), F.col(f"{column}.*"))
    documents.select(F.to_json(whole).alias("value")).write.text(folder)


def read_chapter_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Probe output, one JSON object per recording file: file, chapters."""
    return spark.read.schema(CHAPTER_PROBE).json(folder)


def ingest_chapters(probes: DataFrame, *keys: str) -> DataFrame:
    """One row per chapter in file order: keys, position from 1, start and end as mm:ss."""
    rows = probes.select(*keys, F.posexplode("chapters").alias("_pos", "_chapter"))
    return rows.select(
        *keys,
        (F.col("_pos") + 1).cast("bigint").alias("position"),
        X.mmss("_chapter.start_time").alias("start"),
        X.mmss("_chapter.end_time").alias("end"),
    )
