"""Edit documents by the name games know them by: read, replaced and read back whole.

A document is kept as its JSON text, so fields this library knows nothing of survive a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelbook.schemas import EDIT_DOCUMENT
from reelbook.sources.buckets import BucketTable, Snapshot

DOCUMENT_ROW = T.StructType([T.StructField("json_file", T.StringType()), T.StructField("document", T.StringType())])
#: Buckets of a store unless told otherwise.
BUCKETS = 64


def document_store(spark: SparkSession, root: str) -> BucketTable:
    """The store under a folder."""
    return BucketTable(spark, root, DOCUMENT_ROW, "json_file")


def read_document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder tree, one per file: json_file (the path below the folder), document. Texts are taken as they are."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    # The path of a file is an address; only its escapes are read, a plus sign is a plus sign.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return whole.select(F.substring_index(path, base, -1).alias("json_file"), F.col("value").alias("document"))


def as_rows(documents: DataFrame, *, document: str = "document") -> DataFrame:
    """Rows (json_file, ``document`` as struct) as the store takes them."""
    return documents.select("json_file", F.to_json(document).alias("document"))


def create_documents(store: BucketTable, documents: DataFrame, *, buckets: int = BUCKETS) -> Snapshot:
    """First snapshot of documents (json_file, document); a name given twice is refused."""
    return store.create(documents, buckets)


def parsed(documents: DataFrame) -> DataFrame:
    """Documents with their known fields as columns; a text that is no document has none."""
    keys = [c for c in documents.columns if c != "document"]
    return documents.select(*keys, F.from_json("document", EDIT_DOCUMENT).alias("_d")).select(*keys, "_d.*")


def documents_of_games(store: BucketTable, snapshot: Snapshot, games: DataFrame) -> DataFrame:
    """The document of each game: pk, json_file, document. Only buckets that hold one of them are read.

    A game without a file name, or whose file the store does not have, has a null document.
    """
    asked = games.select("pk", "json_file")
    held = store.read(snapshot, store.touched(snapshot, asked))
    return asked.join(held, "json_file", "left").select("pk", "json_file", "document")


def set_documents(store: BucketTable, snapshot: Snapshot, changes: DataFrame) -> Snapshot:
    """The snapshot after the documents of ``changes`` (json_file, document) take the place of those of their names, or join them.

    Only buckets with a change are read and written. Two changes of one document are refused, and so is a null document.
    """
    given = changes.select("json_file", F.coalesce("document", F.raise_error(F.lit("a document is missing")).cast("string")).alias("document"))
    buckets = store.touched(snapshot, given)
    stay = store.read(snapshot, buckets).join(given.select("json_file"), "json_file", "left_anti")
    return store.replace(snapshot, stay.select("json_file", "document").unionByName(given), buckets)


def set_documents_of_games(store: BucketTable, snapshot: Snapshot, games: DataFrame, changes: DataFrame) -> Snapshot:
    """The same with the changes named by game: pk, document. A change of a game that has no file name is refused."""
    named = changes.join(games.select("pk", "json_file"), "pk", "left")
    missing = F.raise_error(F.concat(F.lit("no document of game "), F.col("pk").cast("string"))).cast("string")
    return set_documents(store, snapshot, named.select(F.coalesce(F.when(F.col("json_file") != "", F.col("json_file")), missing).alias("json_file"), "document"))
