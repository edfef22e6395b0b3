"""The corpus pipeline: five stages over documents, each reading what the one before wrote.

Every stage takes any table with the columns of documents, further ones included, and says below what becomes of nulls,
empty and very long texts, ties and repeated rows. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import langid, mixing, neardup, packing, substring
from parcelflow.llm.common import delete, discard, materialize, noting, reads


#: What stages of this thread wrote on their way, by their place.
_written = threading.local()


def _forget(spark: SparkSession, before: int, docs: DataFrame | None = None) -> None:
    """Delete what stages before a place wrote on their way, unless docs still reads it."""
    held = _written.__dict__
    for place in [p for p in held if int(p) < before]:
        if docs is None or not reads(docs, held[place]):
            for path in held.pop(place):
                delete(spark, path)


def _stage(place: int):
    """A stage that begins by deleting what the stages before it wrote on their way: their output, its input, is written by then."""

    def made(work):
        @functools.wraps(work)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            _forget(spark, place, docs)
            with noting() as paths:
                out = work(spark, docs, sf_dir)
            _written.__dict__.setdefault(str(place), []).extend(paths)
            return out

        return stage

    return made


@_stage(0)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay, as they are.

    Null and empty texts, and those without letters, go; a null lang or source is no evidence; texts of any length are judged
    whole; languages that tie are told by code point; repeated rows are judged alike and all stay or go.
    """
    return langid.identify(docs).filter("kept").select("row.*")


@_stage(1)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, as it is: that of the least doc_id, null last.

    Null and empty texts are equal and form one class; texts of any length are compared whole; of rows that tie (equal id and
    equal text) the least row stays, so of repeated rows one does.
    """
    return neardup.keepers(docs)


@_stage(2)
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut from the texts; a document that keeps no word goes, one that loses none stays as it is.

    Null and empty texts have no words to lose and stay; passages are found in texts of any length, in the same one too; repeated
    rows of 35 words or more repeat each other and go, shorter ones stay.
    """
    return substring.strip_documents(docs)


@_stage(3)
def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, as it is.

    Null and empty texts have no words and are never taken; a null source is a source of its own; a document of any length is taken
    whole or not; documents whose finish times tie come by digest; repeated rows are documents of their own.
    """
    return mixing.mix(docs)


@_stage(4)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences: see packing.pack().

    A null or empty text is its end id alone; a long one is cut over many sequences; equal keys come by doc_id (null first) and
    text; repeated rows are packed each on their own.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing_to_targets),
    ("packing", pack_sequences),
]
#: Signatures, mixing order and tokens can't be had in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, written. What a stage wrote on its way is deleted when the next one begins, its output when that of the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    _forget(spark, len(STAGES))
    return docs
