"""The pipeline over a folder that files keep arriving in.

Decoding, cleaning and all fields are narrow, so a stream runs the same plan as a batch, without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cvloom.functions.contact import contact
from cvloom.functions.profiles import profiles
from cvloom.functions.skills import with_skills
from cvloom.plans.pipeline import prepare, resume_records
from cvloom.sources.files import decode_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder, decoded."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return decode_files(raw)


def flat_fields(docs: DataFrame) -> DataFrame:
    """The fields that need no grouping, as an append-only stream."""
    d = with_skills(prepare(docs), "skills_text")
    return d.select("path", contact(F.col("clean_text")).alias("c"), "skills", profiles(F.coalesce("clean_text", F.lit("")), F.col("extra_urls")).alias("p"), "error").select("path", "c.*", "skills", "p.*", "error")


def run_pipeline(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Whole records of new documents, appended to Parquet. Records are narrow, so each file is decoded once; the sink's log
    makes a batch that is run again count once."""
    records = resume_records(docs, key="path")
    return records.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
