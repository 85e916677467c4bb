"""Section trees as adjacency lists: one row per node, (doc_id, idx) with idx in pre-order.

All loops over one document's nodes are windows or equi-joins over many documents at once. A document's windows run in one
task, so scale comes from the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..durable import discard, settled
from ..functions.text import ordered_join, padded

#: Levels that ascended() takes in one plan.
SHALLOW = 4
#: Nodes whose texts preordered_json() joins at once.
BLOCK = 4096


def _order():
    return Window.partitionBy("doc_id").orderBy("idx")


def levels_of(nodes: DataFrame) -> list[int]:
    """The distinct levels, few numbers whatever the table's size."""
    return [r["level"] for r in nodes.where("level is not null").select(F.col("level").cast("int").alias("level")).distinct().orderBy("level").collect()]


def _nearest(nodes: DataFrame, levels: Iterable[int] | None, window: WindowSpec, find: Callable, shift: int) -> Column:
    """find over the nearest rows of the levels up to the row's own (less shift) in the window."""
    known = sorted(levels) if levels is not None else levels_of(nodes)
    if not known:
        return F.lit(None).cast(nodes.schema["idx"].dataType)
    ranks = F.array_position(F.array(*map(F.lit, known)), F.col("level").cast("int")).cast("int")
    last = F.array(*((F.max if find is F.array_max else F.min)(F.when(F.col("level") == k, F.col("idx"))).over(window) for k in known))
    return find(F.slice(last, F.lit(1), ranks - shift))


def with_level_parent(nodes: DataFrame, levels: Iterable[int] | None = None) -> DataFrame:
    """parent_idx: the nearest earlier node of a smaller level, for any levels. A null level is a root and nobody's parent."""
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select("*", _nearest(nodes, levels, before, F.array_max, 1).alias("parent_idx"))


def preordered(nodes: DataFrame, inherited: str | None = None, levels: Iterable[int] | None = None) -> DataFrame:
    """nodes with parent_idx (as with_level_parent() has it), depth from 0, path_id (as sibling_ids() has it), pos (rank in pre-order, from 0), prev_depth and
    next_depth (of the rows around, null at the ends) and, if a column is named, from_above: its nearest value that isn't null, the node's own or an ancestor's.

    All windows share one partitioning by document, so rows are shuffled once. A row's ancestors are the latest rows of smaller levels, each later than those
    of still smaller ones. A null level is a root and nobody's parent; in pre-order it stands after the tree around it.
    """
    known = (sorted(levels) if levels is not None else levels_of(nodes)) or [0]
    none = F.lit(None).cast(nodes.schema["idx"].dataType)
    value = F.col(inherited) if inherited else F.lit(None).cast("int")
    unknown = F.lit(None).cast(nodes.schema[inherited].dataType if inherited else "int")
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct(F.col("idx").alias("i"), value.alias("v"))
    latest = F.array(*(F.last(F.when(F.col("level") == k, row), True).over(before) for k in known))
    rank = F.array_position(F.array(*map(F.lit, known)), F.col("level").cast("int")).cast("int")

    def down(up: Column, x: Column) -> Column:
        below = F.struct(x["i"].alias("i"), (up["n"] + 1).alias("n"), F.coalesce(x["v"], up["v"]).alias("v"), F.coalesce(up["root"], x["i"]).alias("root"))
        return F.when(x["i"].isNotNull() & (up["i"].isNull() | (x["i"] > up["i"])), below).otherwise(up)

    top = F.struct(none.alias("i"), F.lit(0).alias("n"), unknown.alias("v"), none.alias("root"))
    found = nodes.withColumn("up_", F.aggregate(F.slice(latest, F.lit(1), rank - 1), top, down))
    told = {"parent_idx": F.col("up_.i"), "depth": F.coalesce("up_.n", F.lit(0)), "root_": F.coalesce("up_.root", "idx")}
    found = found.withColumns(told | ({"from_above": F.coalesce(inherited, "up_.v")} if inherited else {})).drop("up_")
    whole = Window.partitionBy("doc_id").orderBy("root_", "idx")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    around = {"pos": F.row_number().over(whole) - 1, "prev_depth": F.lag("depth").over(whole), "next_depth": F.lead("depth").over(whole)}
    # nodes of a depth so far, less those there were at their parent, the latest row of the depth above: the rank among siblings
    counts = {f"n{k}_": F.count(F.when(F.col("depth") == k, 1)).over(upto) for k in range(len(known))}
    past = {f"p{k}_": F.last(F.when(F.col("depth") == k - 1, F.col(f"n{k}_")), True).over(upto) for k in range(1, len(known))}
    ranks = F.array(*((F.col(f"n{k}_") - F.col(f"p{k}_") if k else F.col("n0_")).cast("string") for k in range(len(known))))
    path = F.concat_ws(".", F.slice(ranks, F.lit(1), F.col("depth") + 1))
    return found.withColumns(around | counts).withColumns(past).withColumn("path_id", path).drop("root_", *counts, *past)


def with_code_parent(items: DataFrame) -> DataFrame:
    """parent_idx by structure codes: the latest earlier item that has the code without its last component, else none.

    Items and their wishes for a parent meet in one sort by code: each wish takes the last item of that code before it.
    """
    prefix = F.when(F.instr("structure", ".") > 0, F.regexp_extract("structure", r"^(.*)\.[^.]*$", 1))
    wish = items.select("doc_id", "idx", prefix.alias("code_"), F.lit(True).alias("wish_")).where("code_ is not null")
    both = items.where("structure is not null").select("doc_id", "idx", F.col("structure").alias("code_"), F.lit(False).alias("wish_")).unionByName(wish)
    before = Window.partitionBy("doc_id", "code_").orderBy("idx", F.desc("wish_")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.select("doc_id", "idx", "wish_", F.last(F.when(~F.col("wish_"), F.col("idx")), True).over(before).alias("parent_idx"))
    return items.join(found.where("wish_").drop("wish_"), ["doc_id", "idx"], "left")


def with_next(nodes: DataFrame, levels: Iterable[int] | None = None) -> DataFrame:
    """next_idx: where the subtree ends, the first later node of the same or a smaller level; null at the end.

    The window runs backwards, so that its frame only grows.
    """
    after = Window.partitionBy("doc_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select("*", _nearest(nodes, levels, after, F.array_min, 0).alias("next_idx"))


def with_subtree(nodes: DataFrame, length: Column) -> DataFrame:
    """descendants and subtree_chars (own text, then each non-empty descendant after a newline), from prefix sums."""
    size = F.coalesce(length, F.lit(0))
    w = _order()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = with_next(nodes).select("*", F.row_number().over(w).alias("r_"), F.sum(size + F.when(size > 0, 1).otherwise(0)).over(upto).alias("c_"), size.alias("own_"))
    whole = Window.partitionBy("doc_id")
    summed = summed.select("*", F.max("r_").over(whole).alias("n_"), F.max("c_").over(whole).alias("all_"))
    stop = summed.select(F.col("doc_id"), F.col("idx").alias("next_idx"), (F.col("r_") - 1).alias("r2_"), (F.col("c_") - F.col("own_") - F.when(F.col("own_") > 0, 1).otherwise(0)).alias("c2_"))
    joined = summed.join(stop, ["doc_id", "next_idx"], "left")
    return joined.select(
        *nodes.columns, "next_idx", (F.coalesce("r2_", "n_") - F.col("r_")).alias("descendants"), (F.coalesce("c2_", "all_") - F.col("c_") + F.col("own_")).alias("subtree_chars")
    )


def thinned(nodes: DataFrame, tokens: Column, least: int) -> DataFrame:
    """Nodes without an ancestor of fewer subtree tokens than least; absorber tells those that take in their descendants."""
    absorber = tokens < least
    reach = F.max(F.when(absorber, F.coalesce("next_idx", F.lit(2147483647)))).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return nodes.select("*", absorber.alias("absorber"), (F.coalesce(reach, F.lit(-1)) > F.col("idx")).alias("gone_")).where("not gone_").drop("gone_")


def absorbed_text(nodes: DataFrame, text: str) -> DataFrame:
    """(doc_id, idx, text): topmost absorbers' texts with those of their descendants, blank ones left out, blank lines between.

    Their subtrees are disjoint, so each node finds its absorber by a running maximum.
    """
    w = _order()
    stop = F.coalesce("next_idx", F.lit(2147483647))
    reach = F.max(F.when(F.col("absorber"), stop)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = nodes.select("*", stop.alias("stop_"), (F.coalesce(reach, F.lit(-1)) > F.col("idx")).alias("under_"))
    head = F.when(F.col("absorber") & ~F.col("under_"), F.struct(F.col("idx").alias("head"), F.col("stop_").alias("stop")))
    rows = rows.select("doc_id", "idx", text, F.last(head, True).over(w).alias("h_")).where("idx < h_.stop")
    return rows.where(F.trim(text) != "").groupBy("doc_id", F.col("h_.head").alias("head")).agg(ordered_join(F.col("idx"), F.col(text), "\n\n").alias("text")).withColumnRenamed("head", "idx")


def sequential_ids(nodes: DataFrame, start: int = 0) -> DataFrame:
    """node_id: four-digit pre-order numbers."""
    return nodes.withColumn("node_id", padded(F.row_number().over(_order()) - 1 + start))


def ascended(nodes: DataFrame, start: dict[str, Column], join: Callable[[Column, Column], Column] | dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(doc_id, idx, *start): each node's values joined with those of all its ancestors. Needs parent_idx.

    join(own, ancestors') is associative and takes a null for an absent ancestor. The first levels are joined in one plan, further ones by
    pointer doubling: a tree of depth d takes log2(d) rounds, each written once. Parents that form a cycle are an error.
    """
    joins = join if isinstance(join, dict) else dict.fromkeys(start, join)

    def joined(state: DataFrame, above: DataFrame) -> DataFrame:
        up = above.select("doc_id", F.col("idx").alias("go_"), F.col("go_").alias("next_"), *(F.col(n).alias(f"{n}_up_") for n in start))
        rows = state.join(up, ["doc_id", "go_"], "left")
        return rows.select("doc_id", "idx", F.col("next_").alias("go_"), *(joins[n](F.col(n), F.col(f"{n}_up_")).alias(n) for n in start))

    base = settled(nodes.select("doc_id", "idx", F.col("parent_idx").alias("go_"), *(c.alias(n) for n, c in start.items())))
    state = base
    for _ in range(SHALLOW - 1):  # trees of so few levels need one plan and one write
        state = joined(state, base)
    state = settled(state)
    discard(base)
    done, most = SHALLOW, None  # levels seen; nodes of the largest document
    while state.where("go_ is not null").limit(1).count():
        if most is None and done > SHALLOW:
            most = state.groupBy("doc_id").count().agg(F.max("count")).first()[0]
        if most is not None and done >= most:
            raise ValueError("parents form a cycle")
        done *= 2
        after = settled(joined(state, state))
        discard(state)
        state = after
    return state.drop("go_")


def _ranked(nodes: DataFrame, *order: Column | str) -> DataFrame:
    return nodes.withColumn("rank_", F.row_number().over(Window.partitionBy("doc_id", "parent_idx").orderBy(*order, "idx")))


def sibling_ids(nodes: DataFrame, pad: int = 0) -> DataFrame:
    """path_id: sibling ranks from the root, joined by dots, padded to pad digits, at any depth. Needs parent_idx."""
    rank = padded(F.col("rank_"), pad) if pad else F.col("rank_").cast("string")
    paths = ascended(_ranked(nodes), {"path_id": rank}, lambda own, up: F.concat_ws(".", up, own))
    return nodes.join(paths, ["doc_id", "idx"], "left")


def renumbered(nodes: DataFrame, *order: Column | str) -> DataFrame:
    """nodes with idx as pre-order rank from 0, siblings in the given order and then by the old idx; parent_idx follows."""
    ranked = settled(_ranked(nodes, *order).select("doc_id", "idx", "parent_idx", "rank_"))  # what else the nodes hold moves once, last
    paths = ascended(ranked, {"path_": F.array("rank_")}, lambda own, up: F.concat(F.coalesce(up, F.array().cast("array<int>")), own))
    ids = settled(paths.select("doc_id", "idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path_")) - 1).alias("new_")))
    up = ids.select("doc_id", F.col("idx").alias("parent_idx"), F.col("new_").alias("up_"))
    new = ranked.join(ids, ["doc_id", "idx"]).join(up, ["doc_id", "parent_idx"], "left").select("doc_id", "idx", "new_", "up_")
    out = nodes.join(new, ["doc_id", "idx"])
    return out.select(*({"idx": F.col("new_").alias("idx"), "parent_idx": F.col("up_").alias("parent_idx")}.get(c, F.col(c)) for c in nodes.columns))


def depths(nodes: DataFrame) -> DataFrame:
    """depth from 0, by the dots of path_id."""
    return nodes.withColumn("depth", F.length("path_id") - F.length(F.replace("path_id", F.lit("."), F.lit(""))))


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.where("parent_idx is not null").select("doc_id", F.col("parent_idx").alias("idx")).distinct()
    return nodes.join(parents, ["doc_id", "idx"], "left_anti")


def numbered_titles(nodes: DataFrame) -> DataFrame:
    """Second and later siblings of a title get (2), (3), ...; original_title keeps what was there."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_idx", "title").orderBy("idx"))
    return nodes.withColumn("original_title", F.col("title")).withColumn("nth_", nth).withColumn("title", F.when(F.col("nth_") > 1, F.concat("title", F.lit(" ("), F.col("nth_").cast("string"), F.lit(")"))).otherwise(F.col("title"))).drop("nth_")


def sorted_children(nodes: DataFrame) -> DataFrame:
    """ord: rank among siblings by start page, nulls last, ties as they were; roots keep their order."""
    by_page = F.row_number().over(Window.partitionBy("doc_id", "parent_idx").orderBy(F.col("start_index").asc_nulls_last(), "idx"))
    as_is = F.row_number().over(Window.partitionBy("doc_id", "parent_idx").orderBy("idx"))
    return nodes.withColumn("ord", F.when(F.col("parent_idx").isNull(), as_is).otherwise(by_page))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(
        F.count("*").alias("nodes"), F.max("depth").alias("max_depth"), *(F.count_if(F.coalesce("node_type", F.lit("section")) == t).alias(f"n_{t}") for t in ("section", "semantic_unit", "figure", "table", "keyword"))
    )


def depth_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count("*").alias("nodes"))


def issues(nodes: DataFrame) -> DataFrame:
    """(doc_id, idx, issue): missing title or bounds, start after end, child outside its parent."""
    parent = nodes.select(F.col("doc_id"), F.col("idx").alias("parent_idx"), F.col("start_index").alias("ps_"), F.col("end_index").alias("pe_"))
    found = nodes.join(parent, ["doc_id", "parent_idx"], "left")
    told = F.array_compact(
        F.array(
            F.when(F.coalesce("title", F.lit("")) == "", "missing title"),
            F.when(F.col("start_index").isNull(), "missing start_index"),
            F.when(F.col("end_index").isNull(), "missing end_index"),
            F.when(F.col("start_index") > F.col("end_index"), "start after end"),
            F.when((F.col("start_index") < F.col("ps_")) | (F.col("end_index") > F.col("pe_")), "outside parent"),
        )
    )
    return found.select("doc_id", "idx", F.explode(told).alias("issue"))


def duplicate_texts(nodes: DataFrame) -> DataFrame:
    """Parents with more than one child that has text, all texts equal."""
    return nodes.where("parent_idx is not null").groupBy("doc_id", "parent_idx").agg(F.count("text").alias("with_text"), F.count_distinct("text").alias("texts")).where("with_text > 1 and texts = 1")


def cycles(edges: DataFrame) -> DataFrame:
    """(doc_id, idx) of nodes on or under a cycle of parents, or with two parents. Ancestors are found by pointer doubling, until
    no ancestor is left or more steps are made than any document has nodes."""
    many = edges.groupBy("doc_id", "idx").agg(F.count_distinct("parent_idx").alias("n")).where("n > 1").select("doc_id", "idx")
    jump = settled(edges.groupBy("doc_id", "idx").agg(F.min("parent_idx").alias("up")))
    most = jump.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        if not jump.where("up is not null").limit(1).count():
            break
        on = jump.select("doc_id", F.col("idx").alias("up"), F.col("up").alias("next_"))
        jump = settled(jump.join(on, ["doc_id", "up"], "left").select("doc_id", "idx", F.col("next_").alias("up")))
    return many.unionByName(jump.where("up is not null").select("doc_id", "idx")).distinct()


def nested_json(nodes: DataFrame, fields: list[str], max_depth: int | None = None, children: str = "nodes") -> DataFrame:
    """(doc_id, structure): each document's tree as nested JSON, built from the deepest level up; children names their array. Needs depth and parent_idx.

    max_depth cuts deeper nodes off; by default the deepest node decides.
    """
    if max_depth is None:
        nodes = settled(nodes.select("doc_id", "idx", "parent_idx", "depth", *(c for c in fields if c not in ("doc_id", "idx", "parent_idx", "depth"))))
        max_depth = nodes.agg(F.max("depth")).first()[0] or 0

    def rendered(rows: DataFrame) -> Column:
        own = F.to_json(F.struct(*(F.col(c) for c in fields)))
        has = F.col("kids_").isNotNull()
        return F.when(has, F.concat(F.expr("left(own_, length(own_) - 1)"), F.lit(f',"{children}":['), F.col("kids_"), F.lit("]}"))).otherwise(own)

    base = nodes.withColumn("own_", F.to_json(F.struct(*(F.col(c) for c in fields))))
    below = None
    for depth in range(max_depth, -1, -1):
        level = base.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("kids_", F.lit(None).cast("string"))
        else:
            level = level.join(below, ["doc_id", "idx"], "left")
        done = level.withColumn("json_", rendered(level))
        below = done.groupBy("doc_id", F.col("parent_idx").alias("idx")).agg(ordered_join(F.col("idx"), F.col("json_"), ",").alias("kids_")) if depth else done
        if depth and depth % 8 == 0:
            below = settled(below)  # plans of deep trees stay small
        if depth == 0:
            return done.groupBy("doc_id").agg(F.concat(F.lit("["), ordered_join(F.col("idx"), F.col("json_"), ","), F.lit("]")).alias("structure"))
    raise ValueError("max_depth must not be negative")


def preordered_json(nodes: DataFrame, fields: list[str], children: str = "nodes") -> DataFrame:
    """(doc_id, structure): as nested_json() has it, of whole trees as preordered() gives them.

    Each node is one piece of text, with what it opens and closes: pieces are joined in order, within blocks of BLOCK nodes and then by document, so a
    node's text moves with its block only, however deep it stands.
    """
    rows = nodes.select("doc_id", "pos", "depth", "prev_depth", "next_depth", F.floor(F.col("pos") / BLOCK).alias("block_"), *(c for c in fields if c not in ("doc_id", "pos", "depth", "prev_depth", "next_depth")))
    rows = rows.repartition("doc_id", "block_")  # texts are made where they are joined
    own = F.to_json(F.struct(*fields))
    start = F.when(F.col("prev_depth").isNull(), "[").when(F.col("prev_depth") < F.col("depth"), "").otherwise(",")
    shut = F.concat(own, F.repeat(F.lit("]}"), F.col("depth") - F.coalesce("next_depth", F.lit(0))), F.when(F.col("next_depth").isNull(), "]").otherwise(""))
    opened = F.concat(F.left(own, F.length(own) - 1), F.lit(f',"{children}":['))
    piece = F.concat(start, F.when(F.col("next_depth") > F.col("depth"), opened).otherwise(shut))
    blocks = rows.groupBy("doc_id", "block_").agg(ordered_join(F.col("pos"), piece, "").alias("text_"))
    return blocks.groupBy("doc_id").agg(ordered_join(F.col("block_"), F.col("text_"), "").alias("structure"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
