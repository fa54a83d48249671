"""Named queries of the text operators: (spark, folder) -> DataFrame over the whole tables of the folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import cutoffs, languages, leaks, packing, personal
from cairn.llm.batches import repeated_facts
from cairn.llm.near import NearDuplicates
from cairn.llm.pairs import co_occurrence, tag_baskets
from cairn.llm.words import first_text
from cairn.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return languages.labelled_texts(*(table(spark, folder, n) for n in ("memories", "agent_commands", "documents")))


def _languages(spark: SparkSession, folder: str) -> languages.LanguageModel:
    return languages.fit_languages(_labelled(spark, folder).select("text", F.col("label").alias("lang")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.mislabelled(_labelled(spark, folder), _languages(spark, folder)).select("src", "row_id", "lang")


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language, length and confidence of every segment of every text."""
    return languages.text_languages(_labelled(spark, folder), _languages(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = personal.personal_texts(table(spark, folder, "memories"), table(spark, folder, "goals"))
    return personal.find_personal(texts, table(spark, folder, "contacts"))


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with placeholders in the place of personal information."""
    texts = personal.personal_texts(table(spark, folder, "memories"), table(spark, folder, "goals"))
    return personal.mask_personal(texts, table(spark, folder, "contacts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_facts(table(spark, folder, "extracted_facts"))


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    return tag_baskets(table(spark, folder, "memories"), table(spark, folder, "goals"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return co_occurrence(_baskets(spark, folder), min_count=3, min_share=0.001, min_lift=3.0).select("item_a", "item_b")


def p6_odds(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs in at least three baskets and a thousandth of them, with how much more often than by chance."""
    pairs = co_occurrence(_baskets(spark, folder), min_count=3, min_share=0.001)
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def _near_memories(spark: SparkSession, folder: str) -> NearDuplicates:
    texts = table(spark, folder, "memories").select("seq", first_text(F.col("value.content"), F.col("value.summary")).alias("text"))
    return NearDuplicates(texts, similarity=0.65, shingle=1, id_col="seq")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near_memories(spark, folder).pairs().select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _near_memories(spark, folder).groups().select(F.col("id").alias("seq"), "group_id", "links")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    capacities = [r["capacity_tokens"] for r in table(spark, folder, "containers").select("capacity_tokens").distinct().collect()]
    return packing.assign(table(spark, folder, "documents"), capacities)


def p8_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of one, in containers of every capacity."""
    return _packed(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(_packed(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Into how many documents each leaked item went, and the most windows of it that one of them holds."""
    found = leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("windows").alias("most_windows"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return cutoffs.cut_texts(table(spark, folder, "documents")).select("doc_id")


def p10_by_source(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return cutoffs.cut_by_source(documents, cutoffs.cut_texts(documents))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_masked, p5_found, p6_found, p6_odds, p7_found, p7_groups, p8_assign, p8_fill, p9_found, p9_items, p10_found, p10_by_source)
}
