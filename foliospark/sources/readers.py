"""Readers of pages, Markdown files, sidecar metadata and saved structures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import settled
from ..functions.text import base_name, count_tokens, safe_name, stem

SIDECAR = (
    "table_of_contents array<struct<title:string,heading_level:int,page_id:int,polygon:array<array<double>>>>, "
    "page_stats array<struct<page_id:int,text_extraction_method:string,block_counts:array<array<string>>>>"
)


def text_pages(rows: DataFrame, doc_id: str, page_no: Column, text: str) -> DataFrame:
    """Any table of page texts as (doc_id, page_no, text, token_count)."""
    return rows.select(F.col(doc_id).alias("doc_id"), page_no.cast("int").alias("page_no"), F.coalesce(text, F.lit("")).alias("text"), count_tokens(F.col(text)).alias("token_count"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc_name, text): one row for each UTF-8 file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(stem(F.col("path")).alias("doc_id"), base_name(F.col("path")).alias("doc_name"), "text")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, table_of_contents, page_stats) of converter metadata files; unreadable files give nulls."""
    rows = spark.read.schema(SIDECAR).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))
    return rows.select(F.regexp_replace(stem(F.col("path")), "_meta$", "").alias("doc_id"), "table_of_contents", "page_stats")


def with_sidecar(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """docs with their sidecar where there is one; n_pages is its number of pages."""
    return docs.join(meta, "doc_id", "left").withColumn("n_pages", F.when(F.col("page_stats").isNotNull(), F.size("page_stats")))


def sidecar_sections(meta: DataFrame) -> DataFrame:
    """(doc_id, idx, level, title, page): contents of sidecars, pages from 1."""
    return meta.select("doc_id", F.posexplode("table_of_contents").alias("idx", "t")).select("doc_id", "idx", F.col("t.heading_level").alias("level"), "t.title", (F.col("t.page_id") + 1).alias("page"))


def structures(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc_name, structure) of saved structure files, structure as a variant; Unknown and [] where absent."""
    rows = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.try_parse_json("value").alias("v"))
    return rows.select(
        "doc_id", F.coalesce(F.try_variant_get("v", "$.doc_name", "string"), F.lit("Unknown")).alias("doc_name"),
        F.coalesce(F.try_variant_get("v", "$.structure", "variant"), F.parse_json(F.lit("[]"))).alias("structure"),
    )


def flattened(saved: DataFrame) -> DataFrame:
    """(doc_id, path, depth, title, node_id, start_index, end_index, node_type, summary, text) of nested structures, level by level
    until no node is left."""
    fields = {"title": "string", "node_id": "string", "start_index": "int", "end_index": "int", "node_type": "string", "summary": "string", "text": "string"}
    own = [F.try_variant_get("n", f"$.{k}", t).alias(k) for k, t in fields.items()]

    def below(rows: DataFrame, path: Column, held: Column) -> DataFrame:
        return settled(rows.select("doc_id", path.alias("up"), F.posexplode(held).alias("pos", "n")).select("doc_id", F.concat("up", F.array("pos")).alias("path"), *own, F.to_json(F.try_variant_get("n", "$.nodes", "variant")).alias("inner")))

    level = below(saved, F.array().cast("array<int>"), F.try_variant_get("structure", "$", "array<variant>"))
    out, depth = None, 0
    while True:
        rows = level.drop("inner").withColumn("depth", F.lit(depth))
        out = rows if out is None else out.unionByName(rows)
        inner = level.where("inner is not null")
        if not inner.limit(1).count():
            return out.select("doc_id", "path", "depth", *fields)
        level, depth = below(inner, F.col("path"), F.try_variant_get(F.try_parse_json("inner"), "$", "array<variant>")), depth + 1


def document_name(path: Column, title: Column) -> Column:
    """The file's name, or for streams the title with slashes replaced, or Untitled."""
    return F.coalesce(base_name(path), safe_name(F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))))


def binary_pages(files: DataFrame, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc_id, page_no, text, token_count) of binary files by a given page parser; files that aren't PDF paths are an error.

    files: path, content as spark.read.format("binaryFile") gives them. No parser is bundled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, i, text) for path, content in zip(batch["path"], batch["content"], strict=True) for i, text in enumerate(parse(content), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    checked = files.select(F.when(F.lower("path").endswith(".pdf"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("not a PDF: "), F.col("path")))).alias("path"), "content")
    pages = checked.mapInPandas(run, "doc_id string, page_no int, text string")
    return pages.withColumn("token_count", count_tokens(F.col("text")))


def page_images(images: DataFrame, min_pixels: int = 50) -> DataFrame:
    """Embedded images large enough, with their box in percent of the page and as base64 text.

    images: doc_id, page_no, width, height, x0, y0, x1, y1, page_width, page_height, content.
    """
    big = images.where((F.col("width") >= min_pixels) & (F.col("height") >= min_pixels))
    box = F.struct(*(F.round(100 * F.col(c) / F.col(p), 4).alias(n) for c, p, n in (("x0", "page_width", "x_min"), ("y0", "page_height", "y_min"), ("x1", "page_width", "x_max"), ("y1", "page_height", "y_max"))))
    return big.select("doc_id", "page_no", box.alias("bbox"), F.base64("content").alias("image"))
