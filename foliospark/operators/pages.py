"""Pages: ranges of them as text, grouping under a token budget, and splitting Markdown into pages."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_tokens, ordered_join


def range_text(nodes: DataFrame, pages: DataFrame, sep: str = "", label: bool = False, name: str = "text") -> DataFrame:
    """nodes with the text of pages start_index..end_index; pages that don't exist are left out, '' without any.

    The range is exploded to page numbers, so it is an equi-join. label wraps each page in its <physical_index_N> tags.
    """
    text = F.format_string("<physical_index_%d>\n%s\n<physical_index_%d>\n", "page_no", "page_text_", "page_no") if label else F.col("page_text_")
    numbers = nodes.where("start_index <= end_index").select("doc_id", "idx", F.explode(F.sequence("start_index", "end_index")).alias("page_no"))
    found = numbers.join(pages.select("doc_id", "page_no", F.col("text").alias("page_text_")), ["doc_id", "page_no"])
    texts = found.groupBy("doc_id", "idx").agg(ordered_join(F.col("page_no"), text, sep).alias(name))
    return nodes.join(texts, ["doc_id", "idx"], "left").withColumn(name, F.coalesce(name, F.lit("")))


def document_text(pages: DataFrame, sep: str = "") -> DataFrame:
    return pages.groupBy("doc_id").agg(ordered_join(F.col("page_no"), F.col("text"), sep).alias("text"), F.count("*").alias("page_count"))


def tagged(pages: DataFrame) -> DataFrame:
    """Pages in <physical_index_N> tags with a blank line after each, as they go to packing."""
    return pages.withColumn("text", F.format_string("<physical_index_%d>\n%s\n<physical_index_%d>\n\n", "page_no", "text", "page_no"))


def grouped(pages: DataFrame, max_tokens: int = 20_000, overlap: int = 1) -> DataFrame:
    """(doc_id, grp, page_no): consecutive pages in groups under a budget; a group begins with the last pages of the one before.

    A document within the budget is one group. The others aim at groups of even size; this is a true fold over a document's
    pages in their order, whose state is what the open group holds and the last pages: pages stream by, and no document is held whole.
    """
    total = F.sum("token_count").over(Window.partitionBy("doc_id"))
    rows = pages.select("doc_id", "page_no", "token_count", total.alias("total"))
    target = F.ceil((F.col("total") / F.ceil(F.col("total") / max_tokens) + max_tokens) / 2)
    rows = rows.withColumn("total", F.when(F.col("total") <= max_tokens, F.col("total")).otherwise(target).cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.select("doc_id", "page_no").schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, grp = object(), 0, 0
        last: deque[tuple] = deque(maxlen=overlap)
        for batch in batches:
            docs, groups, numbers = [], [], []
            for d, page, n, limit in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_no", "token_count", "total")), strict=True):
                if d != doc:
                    doc, held, grp = d, 0, 0
                    last.clear()
                n = math.nan if n is None else n  # nothing is over the budget with an unknown count
                if limit is not None and held + n > limit:
                    grp += 1
                    held = sum(k for _, k in last)
                    docs += [d] * len(last)
                    groups += [grp] * len(last)
                    numbers += [p for p, _ in last]
                held += n
                last.append((page, n))
                docs.append(d)
                groups.append(grp)
                numbers.append(page)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field("doc_id").type), pa.array(groups, pa.int32()), pa.array(numbers, batch.schema.field("page_no").type)], names=["doc_id", "grp", "page_no"])

    return rows.sortWithinPartitions("doc_id", "page_no", "token_count").mapInArrow(fold, f"doc_id {kinds['doc_id']}, grp int, page_no {kinds['page_no']}")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_num, line) from 1."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_num", "line")).withColumn("line_num", F.col("line_num") + 1)


def split_evenly(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): n_pages pages of equally many lines, the rest on the last page."""
    rows = lines(docs).join(docs.select("doc_id", F.greatest(F.coalesce("n_pages", F.lit(1)), F.lit(1)).alias("n_")), "doc_id")
    each = F.floor(F.count("*").over(Window.partitionBy("doc_id")) / F.col("n_"))
    rows = rows.select("*", each.alias("each_"))
    page = F.when(F.col("each_") == 0, F.col("n_") - 1).otherwise(F.least(F.floor((F.col("line_num") - 1) / F.nullif("each_", F.lit(0))), F.col("n_") - 1))
    return rows.groupBy("doc_id", (page + 1).cast("int").alias("page_no")).agg(ordered_join(F.col("line_num"), F.col("line"), "\n").alias("text"))


def split_at_markers(docs: DataFrame, ignore_case: bool = True) -> DataFrame:
    """(doc_id, page, text) by page marker comments; lines before the first are page 0, a repeated number takes its last segment."""
    pattern = ("(?i)" if ignore_case else "") + r"^<!--\s*Page\s+(\d+)\s*-->"
    w = Window.partitionBy("doc_id").orderBy("line_num")
    number = F.regexp_extract("line", pattern, 1).try_cast("int")
    rows = lines(docs).select("*", number.alias("mark"))
    rows = rows.select("*", F.sum(F.when(F.col("mark").isNotNull(), 1).otherwise(0)).over(w).alias("segment"), F.coalesce(F.last("mark", True).over(w), F.lit(0)).alias("page"))
    segments = rows.where("mark is null").groupBy("doc_id", "segment", "page").agg(ordered_join(F.col("line_num"), F.col("line"), "\n").alias("text"))
    return segments.groupBy("doc_id", "page").agg(F.max_by("text", "segment").alias("text"))


def markdown_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, token_count) of Markdown documents with n_pages expected pages.

    Marked pages count if they are half of the expected ones at least, missing ones being empty; else lines are split evenly.
    """
    marked = split_at_markers(docs)
    n = F.greatest(F.coalesce("n_pages", F.lit(1)), F.lit(1))
    fits = marked.groupBy("doc_id").agg(F.count("*").alias("have"), F.max("page").alias("top")).join(docs.select("doc_id", n.alias("n_")), "doc_id").where("top > 0 and have >= 0.5 * n_")
    wanted = fits.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("page"))
    first = wanted.join(marked, ["doc_id", "page"], "left").select("doc_id", (F.col("page") + 1).alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))
    even = split_evenly(docs.join(fits.select("doc_id"), "doc_id", "left_anti"))
    return first.unionByName(even).withColumn("token_count", count_tokens(F.col("text")))


def pages_of_nodes(nodes: DataFrame) -> DataFrame:
    """(doc_id, page_no, pos): distinct pages of nodes in the order of `pos`, first seen first."""
    seen = nodes.where("start_index <= end_index").select("doc_id", F.explode(F.sequence("start_index", "end_index")).alias("page_no"), "pos")
    return seen.groupBy("doc_id", "page_no").agg(F.min("pos").alias("pos"))


def estimated_page(line: Column, n_lines: Column, n_pages: Column) -> Column:
    """The page of a line when only the page count is known."""
    return F.when(F.coalesce(n_pages, F.lit(0)) <= 0, 1).otherwise(F.least(F.floor(line / (n_lines / n_pages)) + 1, n_pages)).cast("int")
