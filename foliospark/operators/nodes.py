"""Projections, filters and reports over node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_tokens

#: Characters up to which a text needs no summary.
SHORT = 200
GRANULAR = ("semantic_unit", "figure", "table", "keyword")


def without(nodes: DataFrame, *fields: str) -> DataFrame:
    return nodes.drop(*fields)


def for_description(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "idx", "parent_idx", "title", "node_id", "summary", "prefix_summary")


def for_search(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "idx", "node_id", "title", "summary", "start_index", "end_index", F.coalesce("node_type", F.lit("section")).alias("node_type"), F.nullif("semantic_type", F.lit("")).alias("semantic_type"))


def needs_summary(nodes: DataFrame) -> DataFrame:
    """nodes with `needed`, decided in order: long granular summaries stay; nothing to do without text; units and leaves need one
    when theirs is empty and the text is over 200 characters; figures and tables never; parents when theirs is empty."""
    kids = nodes.where("parent_idx is not null").groupBy("doc_id", F.col("parent_idx").alias("idx")).agg(F.count("*").alias("children"), F.avg((F.coalesce("summary", F.lit("")) != "").cast("int")).alias("summarised"))
    found = nodes.join(kids, ["doc_id", "idx"], "left")
    summary, text = F.coalesce("summary", F.lit("")), F.coalesce("text", F.lit(""))
    kind = F.coalesce("node_type", F.lit("section"))
    needed = (
        F.when((F.length(summary) > 50) & kind.isin("semantic_unit", "figure", "table"), False)
        .when(text == "", False)
        .when(kind == "semantic_unit", (summary == "") & (F.length(text) > SHORT))
        .when(kind.isin("figure", "table"), False)
        .when(F.col("children") > 0, summary == "")
        .otherwise((summary == "") & (F.length(text) > SHORT))
    )
    return found.select(*nodes.columns, F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("summarised", F.lit(0.0)).alias("summarised"), needed.alias("needed"))


def over_limit(nodes: DataFrame, limit: int = 110_000) -> DataFrame:
    return nodes.withColumn("tokens", count_tokens(F.col("text"))).where(F.col("tokens") > limit)


def of_semantic_type(nodes: DataFrame, wanted: str) -> DataFrame:
    return nodes.where(F.col("semantic_type") == wanted).select("doc_id", "node_id", "title", "summary", "start_index", "end_index")


def truncated_indices(items: DataFrame, pages: DataFrame, start: int = 1) -> DataFrame:
    """Items whose physical_index is beyond the document lose it; `truncated` tells them."""
    last = pages.groupBy("doc_id").agg((F.count("*") + F.lit(start - 1)).alias("last_"))
    out = items.join(last, "doc_id", "left")
    beyond = F.coalesce(F.col("physical_index") > F.coalesce("last_", F.lit(0)), F.lit(False))
    return out.select(*items.columns, beyond.alias("truncated")).withColumn("physical_index", F.when(~F.col("truncated"), F.col("physical_index")))


def large(nodes: DataFrame, pages: DataFrame, max_pages: int, max_tokens: int) -> DataFrame:
    """Nodes of more than max_pages pages and of max_tokens tokens at least, by prefix sums over pages."""
    upto = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = pages.select("doc_id", "page_no", F.sum("token_count").over(upto).alias("sum_"))
    low = sums.select("doc_id", (F.col("page_no") + 1).alias("start_index"), F.col("sum_").alias("low_"))
    high = sums.select("doc_id", F.col("page_no").alias("end_index"), F.col("sum_").alias("high_"))
    out = nodes.join(low, ["doc_id", "start_index"], "left").join(high, ["doc_id", "end_index"])
    out = out.withColumn("tokens", F.col("high_") - F.coalesce("low_", F.lit(0))).drop("low_", "high_")
    return out.where((F.col("end_index") - F.col("start_index") > max_pages) & (F.col("tokens") >= max_tokens))


def long_sections(nodes: DataFrame, paragraphs: Column, min_pages: float = 0.5, min_paragraphs: int = 3) -> DataFrame:
    """Sections worth subdividing: long enough, enough paragraphs, not locked, not granular leaves."""
    kind = F.coalesce("node_type", F.lit("section"))
    return nodes.where((F.col("end_index") - F.col("start_index") + 1 >= min_pages) & (F.size(paragraphs) >= min_paragraphs) & ~F.coalesce("text_locked", F.lit(False)) & (kind != "keyword"))


def saved_calls(nodes: DataFrame) -> DataFrame:
    """(nodes, needed, saved): how many summaries are due and what share is saved."""
    return needs_summary(nodes).agg(F.count("*").alias("nodes"), F.count_if("needed").alias("needed"), F.round(1 - F.avg(F.col("needed").cast("int")), 6).alias("saved"))
