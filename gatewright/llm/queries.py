"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm.common import stored, table
from gatewright.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_shard_shuffle(spark, sf_dir):
    from gatewright.llm.sharding import shuffle_into_shards

    placed = shuffle_into_shards(table(spark, sf_dir, "documents"), 40, seed=20)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_language_id(spark, sf_dir):
    from gatewright.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def tokenizer(name: str) -> str:
    """A vocabulary file's place; the only place where the box's files are named."""
    import public_tokenizers

    return public_tokenizers.path(name)


def published_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op4_byte_bpe(spark, sf_dir):
    from gatewright.llm.bpe import round_trip

    coded = round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), published_pattern())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_pattern_packing(spark, sf_dir):
    from gatewright.llm.packing import pack, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), published_pattern(), 2048)
    kept = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(kept, 2048, ["doc_id", "piece", "start", "ids_crc32"])


@query
def op6_site_templates(spark, sf_dir):
    from gatewright.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op7_license_scan(spark, sf_dir):
    from gatewright.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op1_hnsw_search(spark, sf_dir):
    from gatewright.llm.hnsw import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


@query
def op3_cover_tree_top_k(spark, sf_dir):
    from gatewright.llm.covertree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


@query
def op2_shingle_join(spark, sf_dir):
    from gatewright.llm.shingles import similar_groups

    found = similar_groups(table(spark, sf_dir, "documents"), 3, 90, 100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op8_repeat_removal(spark, sf_dir):
    from gatewright.llm.repeats import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.col("kept_text").alias("text"),
    )


@query
def op11_fill_in_middle(spark, sf_dir):
    from gatewright.llm.infill import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


@query
def op12_collocations(spark, sf_dir):
    from gatewright.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark, sf_dir):
    from gatewright.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), published_pattern())
