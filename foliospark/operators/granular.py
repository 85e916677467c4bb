"""Granular structure: paragraphs to semantic units, figures, tables, keywords, and their places in the tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..reasoner import figure_type
from ..functions.text import collapse, ordered_join, paragraphs, shortened, strip
from .tree import ascended

#: Caption patterns in the order they are tried; a caption goes on over lines that begin with a non-letter.
FIGURE_CAPTIONS = (r"(?i)(?:^|\n)\s*(fig(?:ure)?\.?\s*\d+[a-z]?)\s*[:.]\s*([^\n]+(?:\n[^A-Za-z\n][^\n]*)*)", r"(?i)(fig(?:ure)?\.?\s*\d+[a-z]?)\s*[-|]\s*([^\n]+(?:\n[^A-Za-z\n][^\n]*)*)", r"(?i)(?:^|\n)\s*(fig(?:ure)?\.?\s*\d+[a-z]?)\s+([^\n]+(?:\n[^A-Za-z\n][^\n]*)*)")
TABLE_CAPTIONS = tuple(p.replace("fig(?:ure)?", "tab(?:le)?") for p in FIGURE_CAPTIONS)


def headers(lines: DataFrame, fence_aware: bool = True) -> DataFrame:
    """(doc_id, idx, level, title): Markdown headers; with fence_aware those outside fenced code only."""
    w = Window.partitionBy("doc_id").orderBy("line_num")
    trimmed = strip(F.col("line")) if fence_aware else F.col("line")
    fence = F.when(F.startswith(strip(F.col("line")), F.lit("```")), 1).otherwise(0)
    pattern = r"(?d)^(#{1,6})\s+(.+)$"
    rows = lines.select("*", trimmed.alias("t_"), (F.sum(fence).over(w) % 2 == 1).alias("fenced_") if fence_aware else F.lit(False).alias("fenced_"))
    rows = rows.where(~F.col("fenced_") & F.rlike("t_", F.lit(pattern)))
    return rows.select("doc_id", F.col("line_num").alias("idx"), F.length(F.regexp_extract("t_", pattern, 1)).alias("level"), strip(F.regexp_extract("t_", pattern, 2)).alias("title"), F.rlike("line", F.lit("^#{1,6}")).alias("flush"))


def section_text(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers at the line start with the text up to the next header of any level, trimmed. Needs idx as the line number."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    heads = found.where("flush").drop("flush").select("*", F.lead("idx").over(w).alias("stop_"))
    marks = lines.join(heads.select("doc_id", F.col("idx").alias("line_num"), F.lit(True).alias("h_")), ["doc_id", "line_num"], "left")
    at = F.last(F.when(F.col("h_"), F.col("line_num")), True).over(Window.partitionBy("doc_id").orderBy("line_num"))
    texts = marks.select("*", at.alias("idx")).where("idx is not null").groupBy("doc_id", "idx").agg(strip(ordered_join(F.col("line_num"), F.col("line"), "\n")).alias("text"))
    return heads.drop("stop_").join(texts, ["doc_id", "idx"], "left")


def figures(lines: DataFrame) -> DataFrame:
    """(doc_id, line_num, page_no, number): page images that Markdown refers to, the first of each line."""
    pattern = r"!\[[^\]]*\]\(_page_(\d+)_Figure_(\d+)\.(?:jpeg|jpg|png)\)"
    image = F.rlike("line", F.lit(pattern))
    number = [F.when(image, F.regexp_extract("line", pattern, k)).cast("int") for k in (1, 2)]  # Spark may take numbers of other lines before these are left out
    return lines.where(image).select("doc_id", "line_num", (number[0] + 1).alias("page_no"), number[1].alias("number"))


def pipe_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, line_start, line_end): from a pipe line to the line before the next blank one; a table open at the end is none."""
    w = Window.partitionBy("doc_id").orderBy("line_num")
    blank = strip(F.col("line")) == ""
    rows = lines.select("*", blank.alias("blank_"), F.coalesce(F.sum(F.when(blank, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("g_"))
    pipe = F.startswith(strip(F.col("line")), F.lit("|"))
    islands = rows.groupBy("doc_id", "g_").agg(F.min(F.when(pipe, F.col("line_num"))).alias("line_start"), F.max(F.when(F.col("blank_"), F.col("line_num"))).alias("stop_"))
    return islands.where("line_start is not null and stop_ is not null").select("doc_id", "line_start", (F.col("stop_") - 1).alias("line_end"))


def caption(text: Column, patterns: tuple[str, ...], kind: str, page: Column) -> Column:
    """struct(number, caption): the first pattern with both on the page; else a placeholder without caption."""
    found = []
    for p in patterns:
        number, told = strip(F.regexp_extract(text, p, 1)), collapse(F.regexp_extract(text, p, 2))
        found.append(F.when((number != "") & (told != ""), F.struct(number.alias("number"), told.alias("caption"))))
    return F.coalesce(*found, F.struct(F.concat(F.lit(f"{kind} (Page "), page.cast("string"), F.lit(")")).alias("number"), F.lit("").alias("caption")))


def captioned_figures(pages: DataFrame, patterns: tuple[str, ...] = FIGURE_CAPTIONS) -> DataFrame:
    """(doc_id, page_no, pos, number, caption): all captions of a page by the first pattern that finds any; a number counts once a page."""
    found = F.lit(None).cast("array<struct<number:string,caption:string>>")
    for p in patterns:
        hits = F.arrays_zip(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), strip).alias("number"), F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(2)), collapse).alias("caption"))
        hits = F.filter(hits, lambda x: (x["number"] != "") & (x["caption"] != ""))
        found = F.coalesce(found, F.when(F.size(hits) > 0, hits))
    rows = pages.select("doc_id", "page_no", F.posexplode(found).alias("at_", "x")).select("doc_id", "page_no", "at_", "x.number", "x.caption")
    first = rows.groupBy("doc_id", "page_no", "number").agg(F.min_by("caption", "at_").alias("caption"), F.min("at_").alias("at_"))
    order = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("at_")) - 1
    return first.select("doc_id", "page_no", order.alias("pos"), "number", "caption")


def embedded_or_detected(images: DataFrame, pages: DataFrame, detect: Callable[[DataFrame], DataFrame] = captioned_figures) -> DataFrame:
    """(doc_id, page_no, pos, number, caption, embedded): a document's embedded images as its figures; detect is asked only for documents without one.

    images: doc_id, page_no and any other columns; they are numbered within the document and captioned by the caption of that place on their page, if any.
    """
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", *(c for c in images.columns if c not in ("doc_id", "page_no") and images.schema[c].dataType.typeName() not in ("map", "variant"))))
    own = images.withColumn("nth_", order)
    own = own.select("doc_id", "page_no", (F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("nth_")) - 1).alias("pos"), F.concat(F.lit("Figure "), F.col("nth_").cast("string")).alias("own_"))
    told = captioned_figures(pages.join(own.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi"))
    own = own.join(told, ["doc_id", "page_no", "pos"], "left").select("doc_id", "page_no", "pos", F.coalesce("number", "own_").alias("number"), F.coalesce("caption", F.lit("")).alias("caption"), F.lit(True).alias("embedded"))
    rest = detect(pages.join(images.select("doc_id").distinct(), "doc_id", "left_anti")).withColumn("embedded", F.lit(False))
    return own.unionByName(rest)


def page_tables(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, pos, number, caption, body): a page's table captions together with its pipe tables.

    Captions and pipe tables of a page are paired in their order; a pipe table without caption is numbered by its page, and its header row stands for
    the caption; a caption without pipe table has no body. A table number counts once a page. A pipe table is a run of lines that begin with a bar.
    """
    named = captioned_tables(pages)
    first = named.groupBy("doc_id", "page_no", "number").agg(F.min_by("caption", "pos").alias("caption"), F.min("pos").alias("at_"))
    told = first.select("doc_id", "page_no", (F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("at_")) - 1).alias("pos"), "number", "caption")
    w = Window.partitionBy("doc_id", "page_no").orderBy("i")
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("bar_", F.startswith(strip(F.col("line")), F.lit("|")))
    runs = lines.withColumn("run_", F.sum((~F.col("bar_")).cast("int")).over(w)).where("bar_").groupBy("doc_id", "page_no", "run_").agg(ordered_join(F.col("i"), F.col("line"), "\n").alias("body"))
    drawn = runs.select("doc_id", "page_no", (F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("run_")) - 1).alias("pos"), "body")
    both = told.join(drawn, ["doc_id", "page_no", "pos"], "full")
    placeholder = F.concat(F.lit("Table (Page "), F.col("page_no").cast("string"), F.lit(", "), (F.col("pos") + 1).cast("string"), F.lit(")"))
    return both.select("doc_id", "page_no", "pos", F.coalesce("number", placeholder).alias("number"), F.coalesce("caption", F.array_join(table_cells(F.col("body"))["headers"], ", ")).alias("caption"), "body")


def captioned_tables(pages: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_id, page_no, pos, number, caption): every table caption of a page's text; compat reports each twice."""
    pattern = r"(?i)(?:table|tab\.)\s*(\d+)\s*[:.]\s*([^\n]+)"
    hits = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("c"))
    rows = pages.select("doc_id", "page_no", F.posexplode(hits).alias("pos", "x"))
    rows = rows.select("doc_id", "page_no", "pos", F.concat(F.lit("Table "), F.col("x.n")).alias("number"), strip(F.col("x.c")).alias("caption"))
    return rows.unionAll(rows) if compat else rows


def _neighbour(text: Column) -> Column:
    blank = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), strip), lambda p: p != "")
    return F.when(F.size(blank) > 0, blank).otherwise(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda p: p != ""))


def element_context(elements: DataFrame, pages: DataFrame, mention: str = r"\b[Ff]ig(?:ure)?\.?\s*\d+", limit: int = 2000) -> DataFrame:
    """elements with `context`: paragraphs around the first mention or around the element's place (top, middle, bottom), with
    neighbouring pages' where the element touches them or the text is short, cut at the limit. Needs page_no and place."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    around = pages.select("doc_id", "page_no", F.col("text").alias("page_"), paragraphs(F.col("text")).alias("p_"), _neighbour(F.lag("text").over(w)).alias("before_"), _neighbour(F.lead("text").over(w)).alias("after_"))
    out = elements.join(around, ["doc_id", "page_no"], "left")
    p, n = F.col("p_"), F.size("p_")
    first = F.array_position(F.transform(p, lambda x: x.rlike(mention)), F.lit(True))
    near = F.slice(p, F.greatest(first - 2, F.lit(1)).cast("int"), (first + 2 - F.greatest(first - 2, F.lit(1)) + 1).cast("int"))
    half = F.floor(n / 2).cast("int")
    middle = F.when(n <= 4, p).otherwise(F.slice(p, F.greatest(half - 1, F.lit(1)), 5))
    placed = F.when(F.col("place") == "top", F.slice(p, 1, 5)).when(F.col("place") == "bottom", F.slice(p, F.greatest(n - 4, F.lit(1)), 5)).otherwise(middle)
    own = F.array_join(F.when(first > 0, near).otherwise(placed), "\n\n")
    lead_in = F.array_join(F.slice(F.col("before_"), F.greatest(F.size("before_") - 1, F.lit(1)), 2), "\n\n")
    follow = F.array_join(F.slice(F.col("after_"), 1, 2), "\n\n")
    out = out.select(*elements.columns, "page_", n.alias("n_"), own.alias("own_"), lead_in.alias("lead_"), follow.alias("follow_"))
    first_part = F.when(((F.col("place") == "top") | (F.length("own_") < 300)) & (F.col("lead_") != ""), F.concat("lead_", F.lit("\n\n"), "own_")).otherwise(F.col("own_"))
    out = out.withColumn("own_", first_part)
    both = F.when(((F.col("place") == "bottom") | (F.length("own_") < 300)) & (F.col("follow_") != ""), F.concat("own_", F.lit("\n\n"), "follow_")).otherwise(F.col("own_"))
    context = F.when(F.col("page_").isNull(), "").when(F.col("n_") == 0, F.left("page_", F.lit(1000))).otherwise(shortened(both, limit))
    return out.select(*elements.columns, context.alias("context"))


def paragraph_pages(paras: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, para_idx, page_no): the first page at whose end the running text length reaches the paragraph's offset in the
    document's text; the document's first page if it is not found or none is long enough. Offsets ignore separators.

    An as-of join: ends of pages and offsets in one order, from the document's end on.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = pages.select("doc_id", F.lit(None).cast("int").alias("para_idx"), F.sum(F.length("text")).over(w).alias("at_"), "page_no")
    whole = pages.groupBy("doc_id").agg(ordered_join(F.col("page_no"), F.col("text"), "\n\n").alias("full_"), F.min("page_no").alias("first_"))
    at = paras.join(whole, "doc_id").select("doc_id", "para_idx", "first_", (F.call_function("instr", F.col("full_"), F.col("text")) - 1).alias("at_"))
    both = sums.unionByName(at.select("doc_id", "para_idx", F.col("at_").cast("long").alias("at_")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy(F.desc("at_"), F.col("para_idx").asc_nulls_first(), F.desc("page_no")).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.select("doc_id", "para_idx", "at_", F.last("page_no", True).over(order).alias("page_")).where("para_idx is not null and at_ >= 0").select("doc_id", "para_idx", "page_")
    return at.join(hit, ["doc_id", "para_idx"], "left").select("doc_id", "para_idx", F.coalesce("page_", "first_").alias("page_no"))


UNIT = "struct<start:int,end:int,page:int,title:string,summary:string>"


def repaired_units(units: DataFrame, n: Column) -> DataFrame:
    """(doc_id, unit, start_paragraph, end_paragraph, end_page, title, summary): units in order without overlaps.

    Units outside 0..n-1 go. A unit that begins before the last but one paragraph of its predecessor is merged with it, one
    that overlaps less begins after it; ends are clamped and empty units go. n is a column: paragraphs of the section.
    """
    rows = units.select("*", n.alias("n_")).where("start_paragraph >= 0 and start_paragraph <= end_paragraph")
    item = F.struct(F.col("start_paragraph").cast("int").alias("start"), F.col("pos").cast("int").alias("pos"), F.col("end_paragraph").cast("int").alias("end"), F.col("end_page").cast("int").alias("page"), "title", "summary")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("u"), F.first("n_").alias("n_"))
    empty = F.array().cast(f"array<{UNIT}>")
    begin = F.struct(empty.alias("out"), F.lit(-1).alias("last"))

    def step(s: Column, x: Column) -> Column:
        prev = F.try_element_at(s["out"], F.lit(-1))
        merge = (F.size(s["out"]) > 0) & (x["start"] <= s["last"]) & (x["start"] < s["last"] - 1)
        start = F.greatest(F.when(x["start"] <= s["last"], s["last"] + 1).otherwise(x["start"]), F.lit(0))
        end = F.least(x["end"], F.col("n_") - 1)
        joined = F.struct(
            prev["start"].alias("start"), F.greatest(prev["end"], end).alias("end"), F.greatest(prev["page"], x["page"]).alias("page"),
            F.concat(prev["title"], F.lit(" and "), x["title"]).alias("title"), F.concat(prev["summary"], F.lit(" "), x["summary"]).alias("summary"),
        )
        fresh = F.struct(start.alias("start"), end.alias("end"), x["page"].alias("page"), x["title"].alias("title"), x["summary"].alias("summary"))
        head = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        return (
            F.when(merge, F.struct(F.concat(head, F.array(joined)).cast(f"array<{UNIT}>").alias("out"), F.greatest(s["last"], end).alias("last")))
            .when(start <= end, F.struct(F.concat(s["out"], F.array(fresh)).cast(f"array<{UNIT}>").alias("out"), end.alias("last")))
            .otherwise(s)
        )

    done = docs.select("doc_id", F.posexplode(F.aggregate("u", begin.cast(f"struct<out:array<{UNIT}>,last:int>"), lambda s, x: step(s, x).cast(f"struct<out:array<{UNIT}>,last:int>"))["out"]).alias("unit", "x"))
    return done.select("doc_id", "unit", F.col("x.start").alias("start_paragraph"), F.col("x.end").alias("end_paragraph"), F.col("x.page").alias("end_page"), F.col("x.title").alias("title"), F.col("x.summary").alias("summary"))


def boundaries(units: DataFrame) -> DataFrame:
    """(doc_id, boundaries): sorted distinct starts, and one past the last end."""
    return units.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.concat(F.collect_list("start_paragraph"), F.array(F.max("end_paragraph") + 1)))).alias("boundaries"))


def unit_text(units: DataFrame, sections: DataFrame) -> DataFrame:
    """units with the text of their paragraphs, a blank line between. sections: (doc_id, paragraphs)."""
    out = units.join(sections.select("doc_id", F.col("paragraphs").alias("p_")), "doc_id")
    return out.withColumn("text", F.array_join(F.slice("p_", F.col("start_paragraph") + 1, F.col("end_paragraph") - F.col("start_paragraph") + 1), "\n\n")).drop("p_")


def parent_of(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(…elements, parent_idx): the smallest node whose range and all its ancestors' hold the element's; of equal ones the first.

    Ranges are exploded to pages for the join; `reach` is the part of a node's range that its ancestors share. Of the nodes that reach from a page
    to the same end only the smallest can be a parent, and elements of one range have the same one: so distinct ranges meet, whose number is bounded
    by the document's pages, and not every node with every element of a page.
    """
    spans = nodes.where("start_index <= end_index").select("doc_id", "idx", "lo", "hi", (F.col("end_index") - F.col("start_index") + 1).alias("size_"))
    spans = spans.where("lo <= hi").groupBy("doc_id", "lo", "hi").agg(F.min(F.struct("size_", F.col("idx").alias("node_"))).alias("n_"))
    at = spans.select("doc_id", "hi", "n_", F.explode(F.sequence("lo", "hi")).alias("start_index")).groupBy("doc_id", "start_index", "hi").agg(F.min("n_").alias("n_"))
    ranges = elements.select("doc_id", "start_index", "end_index").distinct()
    best = ranges.join(at, ["doc_id", "start_index"]).where("end_index <= hi").groupBy("doc_id", "start_index", "end_index").agg(F.min("n_").alias("n_"))
    best = best.select("doc_id", "start_index", "end_index", F.col("n_.node_").alias("parent_idx"), F.col("n_.size_").alias("parent_size"))
    out = elements.join(best, ["doc_id", "start_index", "end_index"], "left")
    return out.select(*elements.columns, "parent_idx", "parent_size")


def reach(nodes: DataFrame) -> DataFrame:
    """lo and hi: the range that a node shares with all its ancestors. Needs parent_idx."""
    spans = ascended(nodes, {"lo": F.col("start_index"), "hi": F.col("end_index")}, {"lo": F.greatest, "hi": F.least})
    return nodes.join(spans, ["doc_id", "idx"])


def inserted(elements: DataFrame, nodes: DataFrame, compat: bool = False) -> DataFrame:
    """elements with parent_idx and nested_under. Bounds are repaired first. By default all go to their section; compat nests later
    one-page elements under the first one of their page and section, as inserting them one by one would."""
    start = F.greatest(F.coalesce("start_index", F.lit(1)), F.lit(1))
    fixed = elements.withColumn("start_index", start).withColumn("end_index", F.greatest(F.coalesce("end_index", start), start))
    placed = parent_of(fixed, reach(nodes))
    first = F.min("element").over(Window.partitionBy("doc_id", "start_index", "end_index", "parent_idx"))
    nest = (F.coalesce("parent_size", F.lit(0)) != 1) & (first != F.col("element")) if compat else F.lit(False)
    return placed.select(*elements.columns, "parent_idx", F.when(nest, first).alias("nested_under"))


def element_nodes(elements: DataFrame) -> DataFrame:
    """Figures and tables as tree nodes: title from number and caption, text of caption and context, the rest as metadata."""
    title = F.concat("number", F.lit(": "), F.when(F.length("caption") > 50, F.concat(F.left("caption", F.lit(50)), F.lit("..."))).otherwise(F.col("caption")))
    return elements.select(
        *(c for c in ("element", "parent_idx", "summary") if c in elements.columns), "doc_id", title.alias("title"), F.col("page_no").alias("start_index"), F.col("page_no").alias("end_index"), F.col("kind").alias("node_type"),
        F.concat("caption", F.lit("\n\n"), "context").alias("text"), F.to_json(F.struct("number", "caption", F.when(F.col("kind") == "figure", figure_type(F.col("caption"))).alias("figure_type"))).alias("metadata"),
    )


def keyword_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """One locked node for each (term, context, relevance) of a node, with its text and pages. found: (doc_id, idx, keywords)."""
    rows = found.select("doc_id", "idx", F.posexplode("keywords").alias("ord", "k")).join(nodes.select("doc_id", "idx", "text", "start_index", "end_index"), ["doc_id", "idx"])
    return rows.select("doc_id", F.col("idx").alias("parent_idx"), "ord", F.col("k.term").alias("title"), F.col("k.context").alias("summary"), "text", "start_index", "end_index", F.lit("keyword").alias("node_type"), F.lit(True).alias("text_locked"), F.col("k.relevance").alias("relevance"))


def table_cells(text: Column) -> Column:
    """struct(headers, num_rows) of a pipe table's lines."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|")))
    body = F.filter(rows, lambda x: ~x.rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    cells = F.transform(F.filter(F.split(F.get(body, F.lit(0)), "\\|"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    return F.struct(cells.alias("headers"), F.greatest(F.size(body) - 1, F.lit(0)).alias("num_rows"))
