"""Tables of contents: matching titles to pages, page offsets, section ends, verification and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import settled
from ..functions.text import dot_leaders, normalised
from . import tree


def _order():
    return Window.partitionBy("doc_id").orderBy("list_index")


def toc_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_num, structure, title, page) of lines that end in a leader and a number."""
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split(dot_leaders(F.col("text")), "\n")).alias("line_num", "line"))
    pattern = r"^\s*((?:\d+\.)*\d+)?\.?\s*(.+?)\s*(?::|\s{2,}|\s)\s*(\d+)\s*$"
    rows = rows.where(F.rlike("line", F.lit(pattern)))
    return rows.select(
        "doc_id", "page_no", "line_num", F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).alias("structure"),
        F.regexp_replace(F.regexp_extract("line", pattern, 2), r"[\s:]+$", "").alias("title"), F.regexp_extract("line", pattern, 3).try_cast("int").alias("page"),
    )


def is_toc_page(text: Column) -> Column:
    """A contents heading, or three lines at least that end in a leader and a number."""
    heading = text.rlike(r"(?im)^\s*(table of )?contents\s*$")
    listed = F.regexp_count(text, F.lit(r"(?m)(\.{3,}|(\. ){3,})\s*\d+\s*$"))
    return heading | (listed >= 3)


def toc_run(pages: DataFrame, limit: int = 20) -> DataFrame:
    """(doc_id, page_no): the first run of contents pages that begins within limit pages. Needs a boolean column `yes`."""
    first = pages.where(F.col("yes") & (F.col("page_no") <= limit)).groupBy("doc_id").agg(F.min("page_no").alias("first_"))
    joined = pages.join(first, "doc_id")
    stop = joined.where((F.col("page_no") > F.col("first_")) & ~F.col("yes")).groupBy("doc_id").agg(F.min("page_no").alias("stop_"))
    return joined.join(stop, "doc_id", "left").where((F.col("page_no") >= F.col("first_")) & (F.col("page_no") < F.coalesce("stop_", F.lit(2147483647)))).select("doc_id", "page_no")


def matching_pairs(toc: DataFrame, found: DataFrame, start: int = 1) -> DataFrame:
    """(doc_id, pos, title, page, physical_index): equal titles, null ones included, at or after the start page."""
    right = found.select(F.col("doc_id").alias("d_"), F.col("title").alias("t_"), F.col("physical_index"))
    on = (F.col("doc_id") == F.col("d_")) & F.col("title").eqNullSafe(F.col("t_")) & (F.col("physical_index") >= start)
    return toc.join(right, on).select("doc_id", F.col("list_index").alias("pos"), "title", "page", "physical_index")


def page_offset(pairs: DataFrame) -> DataFrame:
    """(doc_id, offset): the commonest difference of physical index and page; of equally common ones the first met."""
    diffs = pairs.where("physical_index is not null and page is not null").groupBy("doc_id", (F.col("physical_index") - F.col("page")).alias("offset")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return diffs.groupBy("doc_id").agg(F.min_by("offset", F.struct(-F.col("n"), F.col("first"), F.col("offset"))).alias("offset"))


def apply_offset(toc: DataFrame, offsets: DataFrame) -> DataFrame:
    """physical_index from page and the document's offset; null without an offset. The page goes."""
    out = toc.drop("physical_index").join(offsets, "doc_id", "left")
    return out.withColumn("physical_index", F.col("page") + F.col("offset")).drop("page", "offset")


def section_bounds(items: DataFrame, pages: DataFrame) -> DataFrame:
    """start_index and end_index: a section ends before the next one, or on its page if that begins further down; the last at the document's end."""
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("last_"))
    w = _order()
    end = F.lead("physical_index").over(w) - F.when(F.coalesce(F.lead("appear_start").over(w), F.lit(False)), 1).otherwise(0)
    out = items.select("*", end.alias("end_"), F.lead("list_index").over(w).isNull().alias("final_")).join(last, "doc_id", "left")
    return out.select(*items.columns, F.col("physical_index").alias("start_index"), F.when(F.col("final_"), F.col("last_")).otherwise(F.col("end_")).alias("end_index"))


def with_preface(items: DataFrame) -> DataFrame:
    """A Preface item of structure 0 on page 1 for documents whose first item begins later."""
    first = items.groupBy("doc_id").agg(F.min_by("physical_index", "list_index").alias("p_"), F.min("list_index").alias("l_")).where("p_ > 1")
    preface = first.select("doc_id", (F.col("l_") - 1).alias("list_index"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"))
    return items.unionByName(preface, allowMissingColumns=True)


def appears(items: DataFrame, pages: DataFrame) -> DataFrame:
    """`found` and `appear_start`: whether the title is on its page, and whether the page begins with it. No index: no."""
    page = pages.select("doc_id", F.col("page_no").alias("physical_index"), normalised(F.col("text")).alias("text_"))
    title = normalised(F.col("title"))
    out = items.join(page, ["doc_id", "physical_index"], "left")
    return out.select(
        *items.columns, F.coalesce(F.contains("text_", title), F.lit(False)).alias("found"), F.coalesce(F.startswith("text_", title), F.lit(False)).alias("appear_start")
    )


def accuracy(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, checked, accuracy): share of items found on their page; 0 where the last index is in the first half of the document."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages_"))
    checked = appears(items, pages).where("physical_index is not null").groupBy("doc_id").agg(F.count("*").alias("checked"), F.avg(F.col("found").cast("int")).alias("share_"), F.max_by("physical_index", "list_index").alias("last_"))
    out = n.join(checked, "doc_id", "left")
    early = F.col("last_").isNull() | (F.col("last_") < F.col("pages_") / 2)
    return out.select("doc_id", F.coalesce("checked", F.lit(0)).alias("checked"), F.when(early, 0.0).otherwise(F.round("share_", 6)).alias("accuracy"))


def bounds_of_bad(items: DataFrame, pages: DataFrame, start: int = 1) -> DataFrame:
    """low and high for every item without `ok`: the nearest good index before and after it, else the document's ends."""
    last = pages.groupBy("doc_id").agg((F.count("*") + F.lit(start - 1)).alias("last_"))
    w, good = _order(), F.when(F.col("ok"), F.col("physical_index"))
    low = F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # backwards, so that the frame only grows
    high = F.last(good, True).over(Window.partitionBy("doc_id").orderBy(F.desc("list_index")).rowsBetween(Window.unboundedPreceding, -1))
    out = items.select("*", low.alias("low_"), high.alias("high_")).where("not ok").join(last, "doc_id", "left")
    return out.select("doc_id", "list_index", F.coalesce("low_", F.lit(start - 1)).alias("low"), F.coalesce("high_", "last_").alias("high"))


def bounds_of_missing(items: DataFrame) -> DataFrame:
    """(doc_id, list_index, low, high) of items without physical_index: the nearest index before, else 0, and after, else -1, so that the range
    of an item with nothing after it is empty."""
    w = _order()
    low = F.last("physical_index", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    high = F.last("physical_index", True).over(Window.partitionBy("doc_id").orderBy(F.desc("list_index")).rowsBetween(Window.unboundedPreceding, -1))
    out = items.select("*", low.alias("low_"), high.alias("high_")).where("physical_index is null")
    return out.select("doc_id", "list_index", F.coalesce("low_", F.lit(0)).alias("low"), F.coalesce("high_", F.lit(-1)).alias("high"))


def missing_headings(items: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, headings, missing, complete): how many numbered headings of the text a contents list lacks. headings as refine.headings() gives them."""
    listed = items.select("doc_id", normalised(F.col("title")).alias("t_")).distinct().withColumn("in_", F.lit(True))
    found = headings.where("structure is not null").withColumn("t_", normalised(F.col("title"))).join(listed, ["doc_id", "t_"], "left")
    told = found.groupBy("doc_id").agg(F.count("*").alias("headings"), F.count_if(F.col("in_").isNull()).alias("missing"))
    return told.withColumn("complete", F.col("missing") == 0)


def parsed_share(pages: DataFrame) -> DataFrame:
    """(doc_id, raw, parsed, complete): lines of contents pages that end in a number, and items parsed from them."""
    lines = pages.select("doc_id", F.explode(F.split(dot_leaders(F.col("text")), "\n")).alias("line"))
    raw = lines.groupBy("doc_id").agg(F.count_if(F.rlike("line", F.lit(r"\S.*\d+\s*$"))).alias("raw"))
    parsed = toc_lines(pages).groupBy("doc_id").agg(F.count("*").alias("parsed"))
    out = raw.join(parsed, "doc_id", "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    return out.withColumn("complete", F.col("raw") == F.col("parsed"))


def located(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, list_index, physical_index): the first page in low..high whose text holds the title; null if none does."""
    spans = items.where("low <= high").select("doc_id", "list_index", normalised(F.col("title")).alias("t_"), F.explode(F.sequence(F.greatest("low", F.lit(1)), F.greatest("high", F.lit(1)))).alias("page_no"))
    texts = pages.select("doc_id", "page_no", normalised(F.col("text")).alias("text_"))
    hit = spans.join(texts, ["doc_id", "page_no"]).where(F.contains("text_", "t_")).groupBy("doc_id", "list_index").agg(F.min("page_no").alias("physical_index"))
    return items.select("doc_id", "list_index").join(hit, ["doc_id", "list_index"], "left")


def repaired(items: DataFrame, pages: DataFrame) -> DataFrame:
    """One repair round: items not on their page are looked for between their good neighbours."""
    checked = appears(items, pages).drop("appear_start").withColumnRenamed("found", "ok")
    bad = bounds_of_bad(checked, pages).join(checked.select("doc_id", "list_index", "title"), ["doc_id", "list_index"])
    found = located(bad, pages).withColumnRenamed("physical_index", "new_")
    out = checked.join(found, ["doc_id", "list_index"], "left")
    return out.withColumn("physical_index", F.when(F.col("ok"), F.col("physical_index")).otherwise(F.coalesce("new_", "physical_index"))).drop("ok", "new_")


def page_has_numbers(lines: DataFrame) -> DataFrame:
    """(doc_id, numbered): whether half of the contents lines end with a number."""
    return lines.groupBy("doc_id").agg((F.avg(F.rlike("line", F.lit(r"\d+\s*$")).cast("int")) >= 0.5).alias("numbered"))


def continued(found: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, list_index, grp, structure, title, physical_index): headings as contents, carried on from group to group of a document's pages.

    found: doc_id, page_no, at, rank, structure, title (refine.headings). groups: doc_id, grp, page_no (pages.grouped), whose overlapping pages are
    read in the first group that has them. A group goes on from the ranks and numbers that those before left open: a heading closes the open ones
    of lower rank, and is numbered on where its own rank is open, or begins a level below. Documents with codes of their own keep them. So a
    heading stands below the nearest one before it of a higher rank, and its number is its place among those of its rank there; all that
    is windows over a document's headings, and codes are joined along ancestors, whatever the number of headings or groups.
    """
    if groups is None:
        rows = found.withColumn("grp", F.lit(0))
    else:
        rows = found.join(groups.groupBy("doc_id", "page_no").agg(F.min("grp").alias("grp")), ["doc_id", "page_no"])
    order = Window.partitionBy("doc_id").orderBy("grp", "page_no", "at", "rank", "structure", "title")
    rows = rows.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), F.col("grp").cast("int").alias("grp"), F.col("page_no").cast("int").alias("page_"), F.col("rank").cast("int").alias("level"), F.col("structure").alias("own_"), "title")
    rows = settled(rows)
    placed = settled(tree.with_level_parent(rows).withColumn("nth_", F.row_number().over(Window.partitionBy("doc_id", "parent_idx", "level").orderBy("idx"))))
    codes = tree.ascended(placed, {"code_": F.col("nth_").cast("string")}, lambda own, up: F.concat_ws(".", up, own))
    coded = rows.where("own_ is not null").select("doc_id", F.lit(True).alias("coded_")).distinct()
    out = placed.join(codes, ["doc_id", "idx"]).join(coded, "doc_id", "left")
    return out.select("doc_id", F.col("idx").alias("list_index"), "grp", F.when(F.col("coded_"), F.col("own_")).otherwise(F.col("code_")).alias("structure"), "title", F.col("page_").alias("physical_index"))


def filled_in_order(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, list_index, physical_index): titles looked for from page to page, each from where the one before was found on; null if it isn't there.

    A title that stands on many pages so takes its turn in the list. Which pages hold a title is told by comparing a document's titles with its pages, as
    titles may stand anywhere in a text; only hits are kept, and the fold goes over them.
    """
    texts = pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), normalised(F.col("text")).alias("text_"))
    wanted = items.select("doc_id", "list_index", normalised(F.coalesce("title", F.lit(""))).alias("t_"))
    hits = wanted.where("t_ <> ''").join(texts, "doc_id").where(F.contains("text_", "t_")).groupBy("doc_id", "list_index").agg(F.array_sort(F.collect_list("page_no")).alias("pages"))
    rows = wanted.join(hits, ["doc_id", "list_index"], "left")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("list_index", "pages"))).alias("items"))
    begin = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        at = F.array_min(F.filter(F.coalesce(x["pages"], F.array().cast("array<int>")), lambda p: p >= state["last"]))
        return F.struct(F.coalesce(at, state["last"]).alias("last"), F.concat(state["out"], F.array(at)).cast("array<int>").alias("out"))

    done = docs.select("doc_id", F.explode(F.arrays_zip(F.col("items"), F.aggregate("items", begin, step)["out"].alias("page"))).alias("x"))
    return done.select("doc_id", F.col("x.items.list_index").alias("list_index"), F.col("x.page").alias("physical_index"))
