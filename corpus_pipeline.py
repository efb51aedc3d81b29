"""Documents to training tokens in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcast.checkpoints import cut, ensure_checkpoint_dir
from headcast.llm import bpe, decontaminate, quality_rules, secrets, similar

#: No more ids than this are broadcast to drop documents by; beyond, Spark joins them by exchange.
FEW_IDS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.

    Null, empty and wordless texts fail the base rules. Repeated rows are judged alike, each by itself; an empty table gives
    an empty one. Columns of any name are kept as they are.
    """
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (then the smallest text hash).

    Texts are linked if their sets of five-word shingles are 0.8 alike or more, each such pair being found and verified.
    Rows are known by id and text: those that share an id but differ in text stand for themselves, and of those that
    share both one stays. Rows without an id pass; null and empty texts are copies of each other.
    """
    key = ["doc_id", "__th"]
    groups = similar.grouped(docs.where("doc_id is not null").select("doc_id", "text"), keys=key)
    counted = cut(groups.groupBy(*key).agg(F.count("*").alias("n"), F.min("root").alias("root")))
    stay = counted.groupBy("root").agg(F.min(F.struct(*key)).alias("one")).select("one.*")
    several = counted.where("n > 1").select(*key)
    gone = cut(counted.where("n = 1").select(*key).join(stay, key, "left_anti").unionByName(several))
    side = F.broadcast(gone) if gone.count() <= FEW_IDS else gone
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("__th"))
    once = marked.join(side, key, "left_anti").select("row")
    repeated = cut(several.join(stay, key, "left_semi"))
    if not repeated.isEmpty():
        once = once.unionByName(marked.join(repeated, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row"))
    return once.select("row.*")


def _packed(docs: DataFrame) -> DataFrame:
    """``text``, and the other columns as one struct that no operator's own columns clash with."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``row`` of ``changed`` with its new ``text`` and number of characters, as the columns of ``docs``."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return changed.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document goes if they were over half of its words.

    Null and wordless texts hold no passage and stay. Repeated rows are cut alike; empty tables of documents or of the
    benchmark are no exception. Columns of any name are carried along; ``n_chars`` follows the new text.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate.mark_contamination(_packed(docs), benchmark, keep=["row", "text"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["first"]))
    left = decontaminate.without_spans(marked.where(2 * n_hit <= F.col("n_words")).select("row", "text", "hits"))
    return _with_text(docs, left)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark.

    Null texts stay null. Repeated rows are changed alike, an empty table gives an empty one, columns of any name are kept.
    """
    found = secrets.find_secrets(_packed(docs), keep=["row", "text"])
    return _with_text(docs, found.select("row", secrets.redact(F.col("text"), F.col("spans")).alias("text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids' count and hashes; these replace columns of the same names.

    A null text counts as empty: no tokens, the hashes of nothing. Repeated rows give repeated rows, an empty table an empty one.
    """
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN, keep=docs.columns)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_copies), ("benchmark decontamination", decontaminated), ("secret scans", without_secrets), ("byte-level BPE", tokens)]
#: The stages' estimates, components and token ids have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the shared checkpoint folder.

    Null texts fail the quality rules, as do empty ones; repeated rows become one. Further columns of ``documents`` are
    carried whole, whatever their names, up to the last stage. An empty table gives an empty one.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
