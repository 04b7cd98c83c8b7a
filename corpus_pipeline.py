"""The corpus pipeline: from ``documents`` to token ids of a deduplicated, mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents. Null and empty texts: language ID rejects them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.llm import bpe, exact_dedup, language_id, ngram_join, source_mixing
from quernel.session import materialize, table


#: Rows of an Arrow batch: texts are long, and batches of the default 10,000 rows take tens of MB on both sides of each task.
BATCH_ROWS = 1000


def language(spark, docs, sf_dir):
    """Documents whose language is recognised stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return language_id.keep_identified(docs, language_id.learn(docs))


def exact(spark, docs, sf_dir):
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark, docs, sf_dir):
    """Of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, one stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return ngram_join.keep_one_of_each(docs, k=5, percent=80)


def mix(spark, docs, sf_dir):
    """One row for each pass of the mix over a document."""
    return source_mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark, docs, sf_dir):
    """doc_id, lang and source with the token ids of the whole text and digests of the ids and of the decoded text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return bpe.encode_texts(docs, carry=("doc_id", "lang", "source"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mix), ("bpe", tokens)]

#: SQL can't express language ID, which is learned, nor BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
