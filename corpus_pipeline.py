"""A training corpus from documents: reject, deduplicate, cut, mix, encode. Part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder and gives what it reads back to the next. All stages but the last return the columns of docs. A stage
begins by letting go of the shuffle files of those before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelith.llm import mixing, near_duplicates, pieces, suffix_dedup, toxicity
from pixelith.llm.common import released, scratch, spare, stored, table
from pixelith.llm.queries import held_out

#: Repeated passages are cut from this many bytes on: 50 words have as many, and a spare.
PASSAGE = 100
#: A source's share of the bytes is its size to this power.
TEMPERATURE = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from the labelled ones that op4 learns from. A null text stays."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = spare("_toxicity", docs.columns)
    return toxicity.score(docs, model, out=out).where(F.col("text").isNull() | (F.col(out) < 0.5)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group: five-word shingles, a similarity of 0.8 or more. A null doc_id stays.

    What is kept grows with docs, so it is never broadcast, however small.
    """
    released(spark)
    found = near_duplicates.near_duplicates(docs, shingle=5, percent=80)
    name = spare("_kept", docs.columns)
    kept = found.where("kept").select(F.col("doc_id").alias(name)).hint("merge")
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without passages of PASSAGE bytes or more that a document with a smaller doc_id has; n_chars follows.

    No row goes: a document that is made of such passages stays with the text that is left, if need be an empty one.
    A null text stays null.
    """
    released(spark)
    prefix = spare("_cut_", docs.columns)
    cut = suffix_dedup.dedup(docs, length=PASSAGE, extra=tuple(docs.columns), prefix=prefix)
    changed, kept = F.col(prefix + "n_removed") > 0, F.col(prefix + "kept")
    new = {"text": F.when(changed, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in mixed order: each source's share of the bytes is its size to the power TEMPERATURE, by blocks. A null
    source is a source; rows of one doc_id share the place of the first; a null text is an empty one; no rows give none."""
    released(spark)
    return mixing.mixed_documents(docs, temperature=TEMPERATURE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """slot, offset, doc_id, source, n_tokens, ids_sha256, decoded_sha256 and the ids themselves, in mixed order.

    A table read back has no order of its own, so the place of each row is worked out again: it depends on the rows
    alone and is that of mix_sources. Sorting by (slot, offset) gives the mixed order wherever the rows are read. A null
    text has no tokens; repeated rows stay; no rows give none.
    """
    released(spark)
    placed = mixing.mixed_documents(docs.select("doc_id", "source", "text"), place=("slot", "offset"), temperature=TEMPERATURE)
    return pieces.round_trip(placed, public_tokenizers.path("piece_bpe_32k.model"), extra=("slot", "offset", "doc_id", "source"), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: No stage but the first join is SQL; tests hold the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for i, (_, stage) in enumerate(STAGES):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{i}", keep=i == len(STAGES) - 1)
    return docs
