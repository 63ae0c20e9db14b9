"""A corpus pipeline in four stages: language, near duplicates, repeated passages, packing.

Each stage takes the documents its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import langid, repeats
from gatewright.llm.common import put_back, stored, table
from gatewright.llm.langid import fit, identify, with_letters
from gatewright.llm.packing import pack, token_pieces
from gatewright.llm.queries import published_pattern, tokenizer
from gatewright.llm.repeats import remove_repeats
from gatewright.llm.shingles import first_of_groups

CAPACITY = 2048
#: Strings of so many words that start twice are repeated passages: those of over 50 words.
PASSAGE_WORDS = 51


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or text) go; a missing `lang` is filled with the predicted one.

    The classifier learns from the labelled documents among docs; if there are none, `lang` stays null. Ambiguous documents stay. Empty
    input gives no rows.
    """
    model = fit(docs)
    if model is None:
        return with_letters(docs)
    found = identify(docs, model).where("score > 0")  # 0 is for texts without a letter
    return put_back(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns, langid.OWN)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id: five-word shingles, similarity 0.8 or more, linked through."""
    return put_back(first_of_groups(docs, 5, 80, 100), docs.columns, ["_hash"])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 400-byte strings, and in strings of 51 words, that start anywhere else too are cut out of `text`; `n_chars` is the new length.

    Documents of which nothing remains go.
    """
    cut = remove_repeats(docs, words=PASSAGE_WORDS).withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)})
    return put_back(cut.where("text <> ''"), docs.columns, [*repeats.OWN, *repeats.INNER])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 2048 ids with their places in as few sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer("byte_bpe_50k.json"), published_pattern(), CAPACITY)
    kept = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(kept, CAPACITY, ["doc_id", "piece", "start", "ids_crc32"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_duplicates", without_near_copies),
    ("repeated_passages", without_repeats),
    ("packing", packed),
]

#: Language identification and tokenising cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
