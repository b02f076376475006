"""One query per operator, over its whole intended table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm.collocations import oracle_sql as collocations_sql
from reviewlake.llm.conversation_repair import oracle_sql as conversation_repair_sql
from reviewlake.llm.patricia import oracle_sql as exact_dedup_sql
from reviewlake.llm.storage import table
from reviewlake.llm.url_filter import oracle_sql as url_filter_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f
    return add


@query("op8_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.quality import fit_quality, score_quality
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), toxic_col="toxic"))


def byte_bpe_path() -> str:
    """The public byte-level BPE file; its path is a parameter of the operators."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op7_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), byte_bpe_path())


@query("op5_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.suffix_dedup import repeated_spans
    return repeated_spans(table(spark, sf_dir, "documents"))


@query("op6_context_tree")
def context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.ctw import score_texts
    return score_texts(table(spark, sf_dir, "documents"))


@query("op1_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.near_dup import near_duplicate_classes
    return near_duplicate_classes(table(spark, sf_dir, "documents")).drop("k")


@query("op2_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.decontaminate import find_contaminated
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_web_archive")
def web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.warc import archive_round_trip
    # Names of archive files differ from run to run, so they stay out of the result.
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("archive", "offset")


@query("op9_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.main_text import main_texts
    return main_texts(table(spark, sf_dir, "pages"))


@query("op10_url_filter", url_filter_sql())
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"))


@query("op3_quotation_linking")
def quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.quotations import reply_conversations
    return reply_conversations(table(spark, sf_dir, "conversations"))


@query("op13_conversation_repair", conversation_repair_sql())
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.conversation_repair import repair_damaged
    return repair_damaged(table(spark, sf_dir, "conversations"))


@query("op11_exact_dedup", exact_dedup_sql())
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.patricia import exact_duplicates
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op12_collocations", collocations_sql())
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))
