"""A library on disk: its tables, its manifest and its optional parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.parsing import parsed_hints
from lorekeep.sources.files import write_table

# fixed values: the parts of a library; the first is needed, the others are optional one by one
PARTS = ("chunks", "sections", "edges", "notes", "hints")
_MANIFEST = (
    "id string, label string, embeddingModel string, embeddingDimensions int, createdAt string, updatedAt string, "
    "chunkParams struct<targetTokens:int,overlapTokens:int>, documents array<struct<id:string,label:string,sha256:string,pageCount:int,chunkStart:long,chunkEnd:long>>"
)


class Library:
    """One library in a folder; its id is a slug, so that it can be no path out of the folder."""

    def __init__(self, spark: SparkSession, data_dir: str, library_id: str) -> None:
        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", library_id):
            raise ValueError(f"{library_id!r} is no library id")
        self.spark, self.id, self.path = spark, library_id, f"{data_dir.rstrip('/')}/{library_id}"

    def _at(self, part: str) -> str:
        return f"{self.path}/{part}"

    def has(self, part: str) -> bool:
        """Whether a part is there."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._at(part))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def save(self, part: str, df: DataFrame) -> None:
        """Writes a part anew; the folder is made if it is not there."""
        if part not in PARTS:
            raise ValueError(f"{part!r} is no part of a library")
        write_table(df, self._at(part))

    def load(self, part: str) -> DataFrame | None:
        """A part, or null where it is not there; the chunks must be."""
        if not self.has(part):
            if part == PARTS[0]:
                raise FileNotFoundError(f"{self.path} has no {part}")
            return None
        return self.spark.read.parquet(self._at(part))

    def remove(self, part: str) -> None:
        """Takes a part away, if it is there."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._at(part))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def graph(self) -> dict[str, DataFrame]:
        """The parts of the section graph that are there; none at all without sections."""
        if not self.has("sections"):
            return {}
        return {part: self.load(part) for part in ("sections", "edges", "notes") if self.has(part)}

    def save_manifest(self, manifest: DataFrame) -> None:
        """One row as JSON."""
        manifest.coalesce(1).write.mode("overwrite").json(self._at("manifest"))

    def manifest(self) -> DataFrame | None:
        """The manifest as one row, or null where there is none or it cannot be read."""
        if not self.has("manifest"):
            return None
        df = self.spark.read.schema(_MANIFEST).option("mode", "PERMISSIVE").json(self._at("manifest")).where("id is not null")
        return None if df.isEmpty() else df


def catalogue(spark: SparkSession, data_dir: str) -> DataFrame:
    """library_id, label, embedding_model of all libraries in a folder whose manifest can be read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{data_dir.rstrip('/')}/*/manifest")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    paths = [str(f.getPath()) for f in found]
    columns = (F.col("id").alias("library_id"), F.coalesce("label", F.col("id")).alias("label"), F.col("embeddingModel").alias("embedding_model"))
    if not paths:
        return spark.createDataFrame([], "library_id string, label string, embedding_model string")
    return spark.read.schema(_MANIFEST).json(paths).where("id is not null").select(*columns)


def hint_rows(files: DataFrame) -> DataFrame:
    """doc_id, topic, topic_norm, pages of hint files (a column ``raw`` of JSON); topics of one key merge."""
    from lorekeep.functions.text import index_key

    docs = files.select(F.explode(parsed_hints(F.col("raw"))).alias("doc_id", "topics"))
    topics = docs.select("doc_id", F.explode("topics").alias("topic", "pages"))
    keyed = topics.withColumn("topic_norm", index_key(F.col("topic"))).where("topic_norm <> ''")
    return keyed.groupBy("doc_id", "topic_norm").agg(
        F.min("topic").alias("topic"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages")
    )


def hints_json(hints: DataFrame) -> DataFrame:
    """raw: all hints (doc_id, topic, pages) as the JSON of one hint file for each document."""
    topics = F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "pages"))))
    by_doc = hints.groupBy("doc_id").agg(topics.alias("t"))
    return by_doc.select(F.to_json(F.struct(F.lit(1).alias("version"), F.create_map("doc_id", "t").alias("byDocument"))).alias("raw"))
