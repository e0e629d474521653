"""One document at a time: the record of a file, for callers without a DataFrame."""

from __future__ import annotations

import json
from pathlib import Path
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvloom.functions.profiles import profiles
from cvloom.functions.skills import SkillDictionary
from cvloom.plans.pipeline import RECORD, resume_records
from cvloom.sources.files import decode

Source = str | Path | bytes | IO[bytes]


class ParserError(Exception):
    """A file that cannot be read as a document."""


def read_source(source: Source, filename: str | None = None) -> tuple[str, bytes]:
    """(name, content) of a path, raw bytes or a binary file object. `filename` goes before a path in naming the format."""
    own_name = str(source) if isinstance(source, (str, Path)) else ""
    if isinstance(source, bytes):
        data = source
    elif own_name:
        if not Path(own_name).exists():
            raise ParserError(f"File not found: {own_name}")
        try:
            data = Path(own_name).read_bytes()
        except OSError as e:
            raise ParserError(f"Could not read file '{own_name}': {e}") from e
    elif hasattr(source, "read"):
        data = source.read()
    else:
        raise ParserError(f"Unsupported source type '{type(source).__name__}': a path, bytes or a binary file object is expected")
    return filename or own_name, data


def sources_frame(spark: SparkSession, sources: list[tuple[Source, str | None]]) -> DataFrame:
    """(path, content, error) of a few sources in hand, for `decode_files`. What cannot be read is a row with its error."""
    rows = []
    for source, filename in sources:
        try:
            rows.append((*read_source(source, filename), None))
        except ParserError as e:
            rows.append((filename or (str(source) if isinstance(source, (str, Path)) else ""), None, str(e)))
    return spark.createDataFrame(rows, "path string, content binary, error string")


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def extract_resume(source: Source, filename: str | None = None, spark: SparkSession | None = None, dictionary: SkillDictionary | None = None) -> dict[str, Any]:
    """The record of one document with the eight fields of RECORD. Raises ParserError if the file cannot be read."""
    name, data = read_source(source, filename)
    text, links, error = decode(name, data)
    if error:
        raise ParserError(error)
    one = _session(spark).createDataFrame([(name, text, links)], "path string, raw_text string, extra_urls array<string>")
    row = resume_records(one, key="path", dictionary=dictionary).first().asDict(recursive=True)
    return {field: row[field] for field in RECORD}


def extract_profiles(text: str, extra_urls: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str | None]:
    """The profile links of a cleaned text and of the links embedded in its file."""
    one = _session(spark).createDataFrame([(text, extra_urls or [])], "t string, u array<string>")
    return one.select(profiles(F.col("t"), F.col("u")).alias("p")).first().p.asDict()


def to_json(record: dict[str, Any]) -> str:
    """A record as people read it: indented by two, in ASCII."""
    return json.dumps(record, indent=2)


class ResumeExtractor:
    """The same as an object that holds a session and a skill dictionary."""

    def __init__(self, spark: SparkSession | None = None, dictionary: SkillDictionary | None = None):
        self.spark, self.dictionary = spark, dictionary

    def extract(self, source: Source, filename: str | None = None) -> dict[str, Any]:
        return extract_resume(source, filename, self.spark, self.dictionary)

    @classmethod
    def extract_resume(cls, source: Source, filename: str | None = None) -> dict[str, Any]:
        return cls().extract(source, filename)
