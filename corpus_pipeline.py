"""A corpus pipeline over the documents table: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import langid, line_dedup, mixing, pieces
from netquarry.llm import near_copies as near_copies_of
from netquarry.llm.common import cut_lineage, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose n-grams are so far from every learned profile is in none of the languages; ordinary texts have 0.4 or more.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the corpus itself names; texts without letters or far from all languages go.

    A null or empty text has no letters. A null lang is filled with the language found, of equally near ones the first by
    name. If no document names a language, as in an empty table, nothing can be learned, and all stay. Rows are judged one
    by one, repeated ones alike.
    """
    profiles = langid.train(docs, "doc_id", "text", "lang", F.lit(True))
    if not profiles:
        return docs.select(*COLUMNS)
    found = docs.select(*COLUMNS, langid.identify(profiles)(F.col("text")).alias("_found"))
    kept = found.where((F.col("_found.lang_pred") != langid.UNKNOWN) & (F.col("_found.score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "_found.lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of ten documents or more, and long lines of two or more, out of all but the first; a document that has nothing left goes.

    Long lines have more than 50 words. The first document is the one with the smallest id, null before all, ties by a hash
    of id and text. Repeated rows (equal id and text) are one document and all come out alike. A null text is one empty
    line, and stays.
    """
    docs = docs.select(*COLUMNS)
    done = line_dedup.apply(docs, line_dedup.bitmaps(docs, keep_first=True, long_docs=2))
    kept = done.where((F.col("n_dropped") == 0) | (F.trim("kept") != ""))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; doc_id is taken for a key, rows that share it stay or go together.

    Near copies have a similarity of 0.8 or more in 5-word shingles. Texts without words, null ones too, are one group. A
    null id goes where the group has another one.
    """
    docs = docs.select(*COLUMNS)
    first = near_copies_of.smallest(docs)
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
    return kept.select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of the sources calls for: not at all, once or twice.

    A null source is a source, the last one. Repeated rows (equal id and text) are drawn one by one and come as often as all
    of them together were taken. Documents without words, null texts too, come as often as their source's whole part says.
    """
    docs = docs.select(*COLUMNS)
    return mixing.apply(docs, cut_lineage(mixing.mix(docs))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of the mix: its pieces' ids, where each begins and ends in the text, and the text decoded from them.

    A null text counts as empty: the end id alone, and an empty decoded text. Repeated rows and null ids come out as they came in.
    """
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoding),
]
#: Stages 1, 3, 4 and 5 are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each leaves is written as Parquet to the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
