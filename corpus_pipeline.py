"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Toxic documents go, lines that an earlier document has are deleted, one document of each near-duplicate
group stays (five-word shingles, Jaccard similarity of 0.8 or more), the rest is put in the order of a mix
of sources, and texts are encoded to pieces, each with its place in the mix. SQL can't express the stages;
tests hold them against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm import line_dedup, mixing, ngram_join, pieces, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored under 0.5, learned from `labels`.

    Null and empty texts have no toxic word and stay; texts are scored whole; without usable labels all stay.
    Repeated rows are judged alike; a score of exactly 0.5 goes. An empty table stays empty; extra columns pass
    through, whatever their names."""
    return toxicity.keep_clean(docs, shared.table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that an earlier one has; n_chars follows the text (null for a null text).

    Null and empty texts lose nothing; rows with equal ids are neither earlier nor later than each other; rows
    without id lose nothing. An empty table stays empty; extra columns pass through, whatever their names."""
    out = line_dedup.deduped(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id.

    Null, empty and blank texts, and rows without id, stay; of rows with equal id and text one stays. An empty table
    stays empty; extra columns pass through, whatever their names."""
    return ngram_join.keep_first(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix.

    Every row stays, with nulls in any column and repeats included; a null source is a source. Ties inside a source
    go by a hash of the id. An empty table stays empty; extra columns pass through, whatever their names."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, round_trip, and position: the row's place in the mix, which Parquet files don't keep.

    Null and empty texts have no tokens; texts are encoded whole; repeated rows have places of their own. An empty
    table stays empty; extra columns are left out, whatever their names."""
    placed = mixing.schedule(docs.select("doc_id", "text", "source"))
    return pieces.tokenised(placed).select("doc_id", "source", "n_tokens", "token_ids", "round_trip", "position")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: Trained and iterative stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents of the folder; between stages the rows are kept as Parquet in the shared folder.

    What a stage made and read is deleted there once its result is written; the last stage's input stays, since its
    result is read lazily."""
    begin = shared.made()
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.written(docs, shared.made_since(begin))
    return docs
