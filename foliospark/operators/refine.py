"""Large sections divided again, round by round, by the headings in their own pages.

A frontier of sections is worked off: those over both limits look for headings among their pages, after their own heading and before the next
section's; the headings of the highest rank there become their children, and the next round's frontier is these children alone. A heading
becomes a child once at most, and each round goes at least one rank down, so rounds are at most the ranks of headings, and the loop
ends when no section is large or none can be divided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import discard, settled
from ..functions.text import normalised, strip
from .nodes import large

#: Headings with a number, with Markdown's marks, in capitals.
NUMBERED, MARKED, CAPITALS = r"^\s*((?:\d+\.)*\d+)\.?\s+(\p{Lu}[^.]{2,80})$", r"^(#{1,6})\s+(.+)$", r"^\s*([A-Z][A-Z ]{3,60})\s*$"
_PLACE = "struct<page:int,at:int>"


def headings(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, at, rank, structure, title, first): headings of the page texts, by line; rank 1 is the highest.

    rank: the number of Markdown's marks or of a code's parts, 1 for capitals. first: nothing but white space stands before it on its page.
    """
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("at", "line"), "text")
    line, marked, numbered = F.col("line"), F.rlike("line", F.lit(MARKED)), F.rlike("line", F.lit(NUMBERED))
    code = F.when(numbered & ~marked, F.regexp_extract(line, NUMBERED, 1))
    title = F.when(marked, F.regexp_extract(line, MARKED, 2)).when(numbered, F.regexp_extract(line, NUMBERED, 2)).when(F.rlike("line", F.lit(CAPITALS)), F.regexp_extract(line, CAPITALS, 1))
    rank = F.when(marked, F.length(F.regexp_extract(line, MARKED, 1))).when(numbered, F.size(F.split(code, r"\."))).otherwise(1)
    first = strip(F.array_join(F.slice(F.split("text", "\n"), F.lit(1), F.col("at")), "")) == ""
    rows = rows.withColumn("title", F.trim(title)).where("title is not null")
    return rows.select("doc_id", "page_no", "at", rank.cast("int").alias("rank"), code.alias("structure"), "title", first.alias("first"))


def _before(place: Column, other: Column) -> Column:
    return (place["page"] < other["page"]) | ((place["page"] == other["page"]) & (place["at"] < other["at"]))


def anchored(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with `here` and `stop`: where their own heading stands on their first page, and the next node's; null where it isn't there."""
    marks = found.select("doc_id", F.col("page_no").alias("start_index"), normalised(F.col("title")).alias("t_"), F.struct(F.col("page_no").cast("int").alias("page"), F.col("at").cast("int").alias("at")).alias("here"))
    marks = marks.groupBy("doc_id", "start_index", "t_").agg(F.min("here").alias("here"))
    own = nodes.withColumn("t_", normalised(F.col("title"))).join(marks, ["doc_id", "start_index", "t_"], "left").drop("t_")
    return own.withColumn("stop", F.lead("here").over(Window.partitionBy("doc_id").orderBy("idx")))


def divided(nodes: DataFrame, pages: DataFrame, max_pages: int, max_tokens: int, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes with their ends drawn in, and the new nodes (doc_id, idx, parent_idx, title, start_index, end_index, round, ord).

    nodes: doc_id, idx in the document's order, title, start_index, end_index. pages: doc_id, page_no, text, token_count. A section that is
    divided ends where its first child starts; the last child ends where it did. A child ends before the next one, or on its page if
    that begins further down. New idx are larger than old ones; ord is the place among new siblings. found: other headings().
    """
    found = settled(headings(pages) if found is None else found)
    old = anchored(nodes.select("doc_id", F.col("idx").cast("long").alias("idx"), "title", F.col("start_index").cast("int").alias("start_index"), F.col("end_index").cast("int").alias("end_index")), found)
    frontier, rounds, ends = settled(old), 0, []
    new = []
    places = found.withColumn("place", F.struct(F.col("page_no").cast("int").alias("page"), F.col("at").cast("int").alias("at")))
    while True:
        rounds += 1
        todo = large(frontier, pages, max_pages, max_tokens).select("doc_id", "idx", "end_index", "here", "stop", F.explode(F.sequence("start_index", "end_index")).alias("page_no"))
        inside = todo.join(places, ["doc_id", "page_no"])
        inside = inside.where((F.col("here").isNull() | _before(F.col("here"), F.col("place"))) & (F.col("stop").isNull() | _before(F.col("place"), F.col("stop"))))
        section = Window.partitionBy("doc_id", "idx")
        items = inside.withColumn("top_", F.min("rank").over(section)).where(F.col("rank") == F.col("top_"))
        w = section.orderBy("place")
        next_first = F.coalesce(F.lead("first").over(w), F.lit(False)).cast("int")
        items = items.select(
            "doc_id", F.col("idx").alias("parent_idx"), F.col("title"), F.col("page_no").alias("start_index"), F.coalesce(F.lead("page_no").over(w) - next_first, F.col("end_index")).alias("end_index"),
            F.col("place").alias("here"), F.coalesce(F.lead("place").over(w), F.col("stop")).alias("stop"), F.row_number().over(w).cast("long").alias("ord"),
        )
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_idx", "ord"))
        items = settled(items.withColumn("idx", F.lit(rounds * 10**12).cast("long") + number))
        discard(frontier)
        if not items.limit(1).count():
            discard(items)
            break
        new.append(items.select("doc_id", "idx", "parent_idx", "title", "start_index", "end_index", F.lit(rounds).alias("round"), "ord"))
        ends.append(items.groupBy("doc_id", F.col("parent_idx").alias("idx")).agg(F.min("start_index").alias("end_")))
        frontier = settled(items.select("doc_id", "idx", "title", "start_index", "end_index", "here", "stop"))
    if not new:
        empty = nodes.limit(0).select("doc_id", F.col("idx").cast("long").alias("idx"), F.lit(None).cast("long").alias("parent_idx"), "title", F.col("start_index").cast("int").alias("start_index"), F.col("end_index").cast("int").alias("end_index"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("ord"))
        return nodes, empty
    drawn, added = ends[0], new[0]
    for more, rows in zip(ends[1:], new[1:], strict=True):
        drawn, added = drawn.unionByName(more), added.unionByName(rows)

    def shrunk(rows: DataFrame) -> DataFrame:
        end = F.coalesce("end_", "end_index").cast(rows.schema["end_index"].dataType)
        joined = rows.withColumn("at_", F.col("idx").cast("long")).join(drawn.withColumnRenamed("idx", "at_"), ["doc_id", "at_"], "left")
        return joined.select(*(end.alias(c) if c == "end_index" else F.col(c) for c in rows.columns))

    return shrunk(nodes), shrunk(added)
