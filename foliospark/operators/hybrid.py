"""Two trees of one document, from its pages and from its Markdown file, in one: nodes aligned by title and order."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised


def title_key(title: Column) -> Column:
    """What titles are compared by: lower case without white space, emphasis marks and a leading number."""
    return normalised(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), "[*_`#]", ""), r"^\s*(\d+\.)*\d*\.?\s+", ""))


def common_order(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence. Only pairs of equal keys are looked at, each in the log of its length."""
    places = defaultdict(list)
    for j, key in enumerate(right):
        places[key].append(j)
    ends: list[int] = []  # the smallest right place at which a chain of each length ends
    tops: list[tuple | None] = []
    for i, key in enumerate(left):
        for j in reversed(places.get(key, ())):  # from the right, so that one left place is used once
            n = bisect_left(ends, j)
            node = (i, j, tops[n - 1] if n else None)
            if n == len(ends):
                ends.append(j)
                tops.append(node)
            else:
                ends[n], tops[n] = j, node
    out, node = [], tops[-1] if tops else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def aligned(paged: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, idx, markdown_idx): which nodes of the two trees are one, in order: as many as can be. Empty keys match nothing.

    A document's keys are one task's work; texts take no part.
    """

    def keys(nodes: DataFrame) -> DataFrame:
        return nodes.select("doc_id", F.col("idx").cast("long").alias("idx"), title_key(F.col("title")).alias("key")).where("key <> ''")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"doc_id": [], "idx": [], "markdown_idx": []})
        a, b = a.sort_values("idx"), b.sort_values("idx")
        pairs = common_order(a["key"].tolist(), b["key"].tolist())
        return pd.DataFrame({"doc_id": a["doc_id"].iloc[0], "idx": [a["idx"].iat[i] for i, _ in pairs], "markdown_idx": [b["idx"].iat[j] for _, j in pairs]})

    kind = paged.schema["doc_id"].dataType.simpleString()
    return keys(paged).groupBy("doc_id").cogroup(keys(marked).groupBy("doc_id")).applyInPandas(run, f"doc_id {kind}, idx long, markdown_idx long")


def merged(paged: DataFrame, marked: DataFrame) -> DataFrame:
    """All nodes of both trees: doc_id, idx, markdown_idx, parent_idx, after_idx, source, title, start_index, end_index, text.

    A node in both (source `both`) keeps its pages and parent and takes the Markdown file's text if there is one. A node of one side stays as it is (`pages`,
    `markdown`); one of the Markdown file hangs under the paged node that its nearest aligned ancestor is (parent_idx, null if none is), after the
    paged node that the last aligned node before it is (after_idx). paged: doc_id, idx, parent_idx, title, start_index, end_index, text; marked:
    doc_id, idx, parent_idx, title, text.
    """
    from .tree import ascended

    pairs = aligned(paged, marked)
    texts = marked.select("doc_id", F.col("idx").cast("long").alias("markdown_idx"), F.col("text").alias("md_"))
    one = paged.withColumn("idx", F.col("idx").cast("long")).withColumn("parent_idx", F.col("parent_idx").cast("long")).join(pairs, ["doc_id", "idx"], "left").join(texts, ["doc_id", "markdown_idx"], "left")
    kept = F.when(F.coalesce("md_", F.lit("")) != "", F.col("md_")).otherwise(F.col("text"))
    one = one.select("doc_id", "idx", "markdown_idx", "parent_idx", F.lit(None).cast("long").alias("after_idx"), F.when(F.col("markdown_idx").isNull(), "pages").otherwise("both").alias("source"), "title", "start_index", "end_index", kept.alias("text"))
    rest = marked.withColumn("markdown_idx", F.col("idx").cast("long")).join(pairs.withColumnRenamed("idx", "paged_"), ["doc_id", "markdown_idx"], "left")
    near = ascended(rest.select("doc_id", "idx", "parent_idx", "paged_"), {"up_": F.col("paged_")}, lambda own, up: F.coalesce(own, up))
    before = Window.partitionBy("doc_id").orderBy("markdown_idx").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.join(near, ["doc_id", "idx"]).withColumn("after_idx", F.last("paged_", True).over(before)).where("paged_ is null")
    empty = F.lit(None).cast("int")
    rest = rest.select("doc_id", F.lit(None).cast("long").alias("idx"), "markdown_idx", F.col("up_").alias("parent_idx"), "after_idx", F.lit("markdown").alias("source"), "title", empty.alias("start_index"), empty.alias("end_index"), "text")
    return one.unionByName(rest)


def provenance(nodes: DataFrame) -> DataFrame:
    """(doc_id, both, only_pages, only_markdown) of merged() nodes."""
    return nodes.groupBy("doc_id").agg(*(F.count_if(F.col("source") == s).alias(n) for s, n in (("both", "both"), ("pages", "only_pages"), ("markdown", "only_markdown"))))
