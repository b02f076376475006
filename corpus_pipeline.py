"""Training-corpus pipeline: quality rules, near-dedup, suffix dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's documents. All but the last return the columns of
``documents``; the last returns the packed pieces.

1. ``quality_rules`` drops documents that the rules or the classifier reject.
2. ``near_dedup`` keeps the document of least id of each near-duplicate class.
3. ``suffix_dedup`` cuts bytes covered by a 50-byte string that also starts in a
   document of smaller id (a character cut into goes whole) and renews ``n_chars``.
4. ``decontaminate`` drops documents that hold a benchmark item.
5. ``packing`` packs the documents into sequences of at most 2048 tokens.

Defined cases: a null or empty text has fewer than 20 words, so the rules drop it; rows
that share an id are judged by their texts; of repeated rows one stays (``near_dedup``); an
empty table gives no rows; a text of any length goes through whole; further columns of
``documents``, whatever their names, go along up to the packing, whose rows are pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm.decontaminate import drop_contaminated
from reviewlake.llm.near_dup import keep_representatives
from reviewlake.llm.packing import pack
from reviewlake.llm.quality import fit_quality, keep_quality
from reviewlake.llm.queries import byte_bpe_path
from reviewlake.llm.storage import table, written
from reviewlake.llm.suffix_dedup import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), toxic_col="toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, byte_bpe_path())


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("suffix dedup", suffix_dedup),
          ("decontamination", decontaminate), ("packing", packing)]

#: SQL cannot express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
