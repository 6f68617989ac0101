"""A corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and each works on all that its predecessor
kept. Extra columns of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import langid, linededup, neardup, packing, pii
from barloom.llm.common import discard, materialize, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identifiable language; put the predicted one in ``lang``.

    Machines learn from the labelled languages of ``docs`` itself; a text that is
    null or has no letter is rejected, and if nothing could be learned, all are.
    """
    found = langid.predict_languages(_boxed(docs, "text"), langid.train(docs), ["text", "_row"])
    kept = found.filter(F.col("lang_pred") != langid.UNKNOWN)
    return _unboxed(kept, docs.columns, text=F.col("text"), lang=F.col("lang_pred"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts; no document goes, even if none of its text is left."""
    kept = linededup.dedup_lines(_boxed(docs, "doc_id", "text"), carry=("_row",))
    return _unboxed(kept, docs.columns, doc_id=F.col("doc_id"), text=F.col("text"), n_chars=F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each near-duplicate group.

    Groups are of five-word shingles at a similarity of 0.8; rows that repeat a
    kept doc_id all stay, and so do rows of a null doc_id.
    """
    found = neardup.near_duplicates(docs, words=5, threshold=80)
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the names of its kinds; no document goes."""
    found = materialize(pii.annotate(_boxed(docs, "text")), "spans")  # read twice: by the models and for the result
    clean = found.withColumn("text", pii.redact(F.col("text"), pii.all_spans(pii.train(found))))
    return _unboxed(clean, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


def _boxed(docs: DataFrame, *direct: str) -> DataFrame:
    """The columns in ``direct`` and all others as one struct, so that no names clash."""
    return docs.select(*direct, F.struct(*(c for c in docs.columns if c not in direct)).alias("_row"))


def _unboxed(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns named, from ``new`` or else from the struct."""
    return rows.select(*((new[c] if c in new else F.col("_row")[c]).alias(c) for c in columns))


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages hold learned models and a packing search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch() as kept:  # what a stage writes for itself goes with it
            kept.append(after := materialize(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = after
    return docs
