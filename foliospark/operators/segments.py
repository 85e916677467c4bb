"""Semantic units of sections by lexical cohesion, as in TextTiling.

The words of the paragraphs before and after every gap are compared by the cosine of their counts. A gap's depth is how far its similarity lies
below the peaks on both sides that one reaches uphill; gaps deeper than the section's mean depth less half a standard deviation, and at least
as deep as their neighbours, are boundaries. A section's words are counted where its row is and never shuffled; what follows is sums and windows over
(section, gap). Depths are whole millionths, so the cut-off is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import paragraphs
from .. import reasoner
from ..durable import settled
from .tree import ascended

#: Paragraphs on each side of a gap, paragraphs of a section that can be divided, letters of a word that counts.
SIDE, LEAST_PARAGRAPHS, LETTERS = 2, 3, 4
_WHOLE = 1_000_000
#: The semantic types of units, by type of section.
TYPES = {
    "introduction": ("motivation", "background", "literature_review", "research_gap", "contribution", "objectives"),
    "methods": ("materials", "sample_preparation", "characterization", "analysis", "experimental_setup", "procedure"),
    "results": ("experiment", "finding", "measurement", "observation", "analysis"),
    "discussion": ("interpretation", "comparison", "implications", "limitations", "future_work"),
    "default": (),
}


def gaps(sections: DataFrame, side: int = SIDE) -> DataFrame:
    """(doc_id, idx, gap, sim): similarity in millionths at the gap after paragraph `gap`, from 0. sections: doc_id, idx, p (paragraphs)."""
    words = F.transform("p", lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit(rf"\p{{L}}{{{LETTERS},}}"), F.lit(0)), " "))
    ids = {f.name: f.dataType.simpleString() for f in sections.select("doc_id", "idx").schema}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, paras in enumerate(batch.column("w").to_pylist()):
                counts = [Counter(x.split()) if x else Counter() for x in paras]
                for gap in range(len(counts) - 1):
                    left, right = (sum(some, Counter()) for some in (counts[max(gap + 1 - side, 0) : gap + 1], counts[gap + 1 : gap + 1 + side]))
                    few, many = (left, right) if len(left) <= len(right) else (right, left)
                    at.append(i)
                    found.append((gap, sum(n * many[w] for w, n in few.items() if w in many), sum(n * n for n in left.values()), sum(n * n for n in right.values())))
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "idx")]
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(keys + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "idx", "gap", "dot", "ll", "rr"])

    rows = sections.where(F.size("p") > 1).select("doc_id", "idx", words.alias("w"))
    found = rows.mapInArrow(compared, f"doc_id {ids['doc_id']}, idx {ids['idx']}, gap int, dot long, ll long, rr long")
    sim = F.when((F.col("ll") > 0) & (F.col("rr") > 0), F.floor(_WHOLE * F.col("dot") / F.sqrt(F.col("ll").cast("double") * F.col("rr")) + 0.5)).otherwise(0)
    return found.select("doc_id", "idx", "gap", F.coalesce(sim, F.lit(0)).cast("long").alias("sim"))


def depths(found: DataFrame) -> DataFrame:
    """found (doc_id, idx, gap, sim) with `depth`: how far sim lies below the peak uphill on the left plus that on the right."""
    key = ("doc_id", "idx")
    right, left = Window.partitionBy(*key).orderBy("gap"), Window.partitionBy(*key).orderBy(F.desc("gap"))
    # runs along which one goes uphill from each gap: they break where similarity falls on the way
    rows = found.withColumn("up_", F.coalesce((F.col("sim") > F.lag("sim").over(right)).cast("int"), F.lit(0))).withColumn("down_", F.coalesce((F.col("sim") > F.lag("sim").over(left)).cast("int"), F.lit(0)))
    rows = rows.withColumn("run_l", F.sum("up_").over(right.rowsBetween(Window.unboundedPreceding, 0))).withColumn("run_r", F.sum("down_").over(left.rowsBetween(Window.unboundedPreceding, 0)))
    peak_l = F.max("sim").over(Window.partitionBy(*key, "run_l").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    peak_r = F.max("sim").over(Window.partitionBy(*key, "run_r").orderBy(F.desc("gap")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*found.columns, (peak_l + peak_r - 2 * F.col("sim")).alias("depth"))


def boundaries(found: DataFrame) -> DataFrame:
    """(doc_id, idx, gap) of the gaps that divide: deep enough for their section, and no less deep than the next one on the left or right."""
    key = ("doc_id", "idx")
    wide = lambda c: c.cast("decimal(38,0)")
    d = wide(F.col("depth"))
    stats = found.groupBy(*key).agg(F.count("*").alias("n"), F.sum(d).cast("decimal(38,0)").alias("s"), F.sum((d * d).cast("decimal(38,0)")).cast("decimal(38,0)").alias("q"))
    w = Window.partitionBy(*key).orderBy("gap")
    rows = found.withColumn("before_", F.lag("depth").over(w)).withColumn("after_", F.lead("depth").over(w)).join(stats, [*key])
    # depth > mean - deviation / 2, times 2n: 2 (s - n depth) < sqrt(n q - s^2), by squares
    short = (2 * (F.col("s") - F.col("n") * F.col("depth"))).cast("decimal(38,0)")
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("decimal(38,0)")
    deep = (short < 0) | ((short * short).cast("decimal(38,0)") < spread)
    crest = (F.col("depth") > F.coalesce("before_", F.lit(-1))) & (F.col("depth") >= F.coalesce("after_", F.lit(-1)))
    return rows.where((F.col("depth") > 0) & deep & crest).select(*key, "gap")


def units(sections: DataFrame, side: int = SIDE, least: int = LEAST_PARAGRAPHS) -> DataFrame:
    """(doc_id, idx, unit, start_paragraph, end_paragraph): consecutive units that cover a section; sections without a boundary, or of fewer
    than `least` paragraphs, have none. sections: doc_id, idx, p (paragraphs)."""
    enough = sections.where(F.size("p") >= least)
    cut = boundaries(depths(gaps(enough, side)))
    size = enough.select("doc_id", "idx", F.size("p").alias("n_"))
    starts = cut.select("doc_id", "idx", (F.col("gap") + 1).alias("start_paragraph"))
    starts = starts.unionByName(cut.select("doc_id", "idx").distinct().withColumn("start_paragraph", F.lit(0)))
    w = Window.partitionBy("doc_id", "idx").orderBy("start_paragraph")
    rows = starts.join(size, ["doc_id", "idx"])
    return rows.select("doc_id", "idx", (F.row_number().over(w) - 1).alias("unit"), "start_paragraph", (F.coalesce(F.lead("start_paragraph").over(w), F.col("n_")) - 1).alias("end_paragraph"))


def semantic_type(section: Column, text: Column) -> Column:
    """The type of a unit among those of its section's type: the one whose words the text has most often, the first of equal ones; general if none."""
    out = F.lit("general")
    for kind, names in TYPES.items():
        if names:
            stems = [n.split("_")[0].rstrip("s")[:8] for n in names]
            # counts decide before places: n * 100 - place is largest for the first of the most frequent
            scores = F.array(*(F.regexp_count(text, F.lit(f"(?i){s}")) * 100 - i for i, s in enumerate(stems)))
            best = F.array_max(scores)
            name = F.when(best > 0, F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, best).cast("int"))).otherwise("general")
            out = F.when(section == kind, name).otherwise(out)
    return out


def unit_pages(found: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """found (doc_id, idx, unit, first, last: offsets in the section's text) with start_index and end_index: the first page of the section at
    whose end its running length reaches the offset, else the section's first page. One sort of page ends and offsets a section."""
    key = ("doc_id", "idx")
    held = nodes.join(found.select(*key).distinct(), [*key], "left_semi").where("start_index <= end_index")
    span = held.select(*key, "start_index", F.explode(F.sequence("start_index", "end_index")).alias("page_no")).join(pages.select("doc_id", "page_no", F.length("text").alias("n_")), ["doc_id", "page_no"])
    ends = span.select(*key, F.lit(None).cast("int").alias("unit"), F.lit(None).cast("string").alias("end_"), F.sum("n_").over(Window.partitionBy(*key).orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("at_"), "page_no")
    marks = found.select(*key, "unit", F.explode(F.create_map(F.lit("first"), F.col("first").cast("long"), F.lit("last"), F.col("last").cast("long"))).alias("end_", "at_"))
    order = Window.partitionBy(*key).orderBy(F.desc("at_"), F.col("unit").asc_nulls_first(), F.desc("page_no")).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(marks, allowMissingColumns=True).withColumn("page_", F.when(F.col("at_") >= 0, F.last("page_no", True).over(order))).where("unit is not null")
    told = both.groupBy(*key, "unit").agg(F.max(F.when(F.col("end_") == "first", F.col("page_"))).alias("a_"), F.max(F.when(F.col("end_") == "last", F.col("page_"))).alias("b_"))
    out = found.join(told, [*key, "unit"]).join(nodes.select(*key, F.col("start_index").alias("low_")), [*key])
    start = F.coalesce("a_", "low_")
    return out.select(*found.columns, start.alias("start_index"), F.greatest(start, F.coalesce("b_", "low_")).alias("end_index"))


def unit_nodes(nodes: DataFrame, pages: DataFrame | None = None, side: int = SIDE, least: int = LEAST_PARAGRAPHS) -> DataFrame:
    """Units of nodes (doc_id, idx, title, text, start_index, end_index) as nodes: doc_id, parent_idx, ord, title, semantic_type, text, start_index, end_index.

    Titles are the section's type and a number. Pages are those on which a unit's first and last paragraphs begin if pages are given, else the section's.
    """
    rows = settled(nodes.select("doc_id", "idx", "title", "text", "start_index", "end_index", paragraphs(F.col("text")).alias("p")))
    found = units(rows.select("doc_id", "idx", "p"), side, least)
    told = found.join(rows.select("doc_id", "idx", "title", F.col("text").alias("whole_"), "start_index", "end_index", "p"), ["doc_id", "idx"])
    text = F.array_join(F.slice("p", F.col("start_paragraph") + 1, F.col("end_paragraph") - F.col("start_paragraph") + 1), "\n\n")
    kind = reasoner.section_type(F.col("title"))
    first, last = (F.call_function("instr", F.col("whole_"), F.get("p", F.col(c))) - 1 for c in ("start_paragraph", "end_paragraph"))
    told = told.select("doc_id", "idx", "unit", kind.alias("kind_"), text.alias("text"), "start_paragraph", "end_paragraph", first.alias("first"), last.alias("last"), "start_index", "end_index")
    told = settled(told).select(
        "doc_id", "idx", "unit", F.concat("kind_", F.lit(" "), (F.col("unit") + 1).cast("string")).alias("title"), semantic_type(F.col("kind_"), F.col("text")).alias("semantic_type"),
        "text", "start_paragraph", "end_paragraph", "first", "last", "start_index", "end_index",
    )
    if pages is not None:
        told = unit_pages(told.drop("start_index", "end_index"), nodes, pages)
    return told.withColumn("ord", F.col("unit").cast("long")).withColumnRenamed("idx", "parent_idx").drop("unit", "first", "last")


def without_divided_ancestors(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (doc_id, parent_idx, ...) of nodes none of whose ancestors has rows too: what got units isn't looked into again."""
    has = rows.select("doc_id", F.col("parent_idx").alias("idx")).distinct().withColumn("has_", F.lit(True))
    marked = nodes.select("doc_id", "idx", "parent_idx").join(has, ["doc_id", "idx"], "left").withColumn("has_", F.coalesce("has_", F.lit(False)))
    above = ascended(marked, {"any_": F.col("has_")}, lambda own, up: own | F.coalesce(up, F.lit(False)))
    blocked = marked.join(above.select("doc_id", F.col("idx").alias("parent_idx"), "any_"), ["doc_id", "parent_idx"]).where("any_").select("doc_id", F.col("idx").alias("parent_idx"))
    return rows.join(blocked, ["doc_id", "parent_idx"], "left_anti")
