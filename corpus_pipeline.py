"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet
and reads again as the next stage's docs. All stages but the last return the columns of
``documents`` (extra columns of theirs travel on). Every stage judges all rows its predecessor
kept; null and empty texts, repeated rows and empty tables pass through as each operator states.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offerweave.llm import queries
from offerweave.llm.exact_dedup import exact_dedup, normalised
from offerweave.llm.language_id import NONE, identify
from offerweave.llm.near_copies import near_copies, text_digest
from offerweave.llm.packing import pack_documents
from offerweave.llm.shared import table
from offerweave.llm.substring_dedup import substring_dedup


def language(spark, docs, sf_dir):
    """Documents whose language can be told; texts that are null or have no letter go."""
    found = identify(docs, queries.language_model(spark, docs))
    return found.filter(F.col("lang_pred") != NONE).drop("lang_pred", "score")


def _stay(docs, kept, digest):
    """One row of ``docs`` for each row of ``kept`` (doc_id, text_sha256). Rows are told apart by
    doc_id and ``digest`` of their text, so null and repeated ids with different texts all count;
    of rows that agree in both the smallest by their other columns, in their order, stays."""
    key = lambda sha: F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)
    name = "_" * (1 + max(map(len, docs.columns)))
    kept = kept.select(key(F.col("text_sha256")).alias(name)).distinct()
    keyed = docs.withColumn(name, key(digest)).join(kept, name, "left_semi")
    mapped = [f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()]  # maps have no order
    order = F.struct(*[F.col(c) for c in docs.columns if c not in mapped])
    found = keyed.groupBy(name).agg(F.min(order).alias("_row"), *[F.first(c).alias(f"_{name}{i}") for i, c in enumerate(mapped)])
    return found.select(*[F.col(f"_{name}{mapped.index(c)}").alias(c) if c in mapped else F.col("_row")[c].alias(c) for c in docs.columns])


def exact(spark, docs, sf_dir):
    """The row with the smallest doc_id of each group of equal texts."""
    return _stay(docs, exact_dedup(docs).filter("kept"), F.sha2(normalised(F.col("text")), 256))


def near(spark, docs, sf_dir):
    """The document with the smallest doc_id of each group that links join: five-word shingles of
    Jaccard similarity 0.8 or more, candidates by operator 9 and by minimum hashes."""
    return _stay(docs, near_copies(docs), text_digest(F.col("text")))


def passages(spark, docs, sf_dir):
    """Texts without the words that windows of earlier documents cover; a document that keeps no
    word goes if it lost some. Texts that lose nothing stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substring_dedup(docs, keep=others, whole=True).filter("n_removed = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))
    return found.select(*[F.col("kept_text").alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packing(spark, docs, sf_dir):
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("substring dedup", passages),
    ("packing", packing),
]

#: The stages on language, fingerprints, windows and tokens are not SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs)
    return docs
