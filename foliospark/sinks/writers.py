"""Trees as JSON, HTML and text rows; everything but the page template stays distributed."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape, paragraphs, shortened
from ..operators.tree import duplicate_texts, nested_json

#: Node types and the marks that lists show for them.
ICONS = {"section": "§", "semantic_unit": "¶", "figure": "▣", "table": "▦", "keyword": "#"}


def envelopes(nodes: DataFrame, docs: DataFrame, fields: list[str], max_depth: int | None = None) -> DataFrame:
    """(doc_id, json): name, structure and, where there is one, the description of each document."""
    trees = nested_json(nodes, fields, max_depth)
    told = F.nullif("doc_description", F.lit("")) if "doc_description" in docs.columns else F.lit(None).cast("string")
    head = F.to_json(F.struct("doc_name", told.alias("doc_description")))  # an absent description leaves no key
    body = F.concat(F.expr("left(head_, length(head_) - 1)"), F.lit(',"structure":'), "structure", F.lit("}"))
    return docs.withColumn("head_", head).join(trees, "doc_id").select("doc_id", body.alias("json"))


def write_json(trees: DataFrame, path: str, granularity: str) -> None:
    """One line a document, in a folder for the granularity."""
    trees.select("json").write.mode("overwrite").text(f"{path}/{granularity}_structure")


def outline(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(doc_id, idx, line): titles indented by two spaces for each level, with id and page down to max_depth."""
    rows = nodes if max_depth is None else nodes.where(F.col("depth") <= max_depth)
    indent = F.expr("repeat('  ', depth)")
    if max_depth is None:
        return rows.select("doc_id", "idx", F.concat(indent, "title").alias("line"))
    return rows.select("doc_id", "idx", F.concat(indent, F.lit("├─ "), "title", F.lit(" ("), "node_id", F.lit(", p."), F.col("start_index").cast("string"), F.lit(")")).alias("line"))


def sidebar(nodes: DataFrame) -> DataFrame:
    """(doc_id, idx, fragment): list items that open and close by the difference of depths; in idx order they are one list."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    after = F.coalesce(F.lead("depth").over(w), F.lit(0))
    icon = F.lit(ICONS["section"])
    for kind, mark in ICONS.items():
        icon = F.when(F.coalesce("node_type", F.lit("section")) == kind, mark).otherwise(icon)
    rows = nodes.select("*", after.alias("after_"), F.lead("idx").over(w).isNull().alias("last_"))
    tail = F.when(F.col("after_") > F.col("depth"), "<ul>").otherwise(F.concat(F.lit("</li>"), F.expr("repeat('</ul></li>', depth - after_)")))
    return rows.select("doc_id", "idx", F.concat(F.lit('<li data-id="'), html_escape(F.col("node_id")), F.lit('">'), icon, F.lit(" "), html_escape(F.col("title")), tail).alias("fragment"))


def preview(text: Column, n: int = 40) -> Column:
    return shortened(text, n)


def explorer(nodes: DataFrame, doc_id: object, limit: int = 5000) -> str:
    """An HTML page of one document's tree: the tree, a node's text (cut at limit) and its keywords, and a notice where a node's children all have one
    text. Its nodes come to the driver, one document's only. Needs idx, parent_idx, depth, title, node_id, start_index, end_index, text."""
    own = nodes.where(F.col("doc_id") == doc_id)
    told = own.join(duplicate_texts(own).select("doc_id", F.col("parent_idx").alias("idx"), F.lit(True).alias("alike")), ["doc_id", "idx"], "left")
    kind = F.coalesce("node_type", F.lit("section"))
    rows = [r.asDict() for r in told.orderBy("idx").select("idx", "parent_idx", "depth", "title", "node_id", "start_index", "end_index", kind.alias("node_type"), F.left(F.coalesce("text", F.lit("")), F.lit(limit)).alias("text"), F.coalesce("alike", F.lit(False)).alias("alike")).collect()]
    for r in rows:
        r["keywords"] = [k["title"] for k in rows if k["node_type"] == "keyword" and k["parent_idx"] == r["idx"]]
    items = "".join(f'<li style="margin-left:{r["depth"]}em" onclick="show({i})">{ICONS.get(r["node_type"], "")} {html.escape(r["title"] or "")}{" !" if r["alike"] else ""}</li>' for i, r in enumerate(rows))
    data = json.dumps(rows, ensure_ascii=False).replace("</", "<\\/")
    script = (
        f"const nodes={data};const put=(i,t)=>document.getElementById(i).textContent=t;"
        "function show(i){const n=nodes[i];put('d',n.title+' (p.'+n.start_index+'-'+n.end_index+')\\n\\n'+n.text);put('k',n.keywords.join(', '));put('w',n.alike?'All children have the same text.':'')}"
    )
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(str(doc_id))}</title><ul>{items}</ul><p id="w"></p><pre id="d"></pre><p id="k"></p><script>{script}</script>'


def patched_units(nodes: DataFrame) -> DataFrame:
    """Semantic units whose bounds lie in their parent's paragraphs get that text anew; parents are patched before children."""
    parent = nodes.select("doc_id", F.col("idx").alias("parent_idx"), paragraphs(F.col("text")).alias("p_"))
    out = nodes.join(parent, ["doc_id", "parent_idx"], "left")
    fits = (F.col("node_type") == "semantic_unit") & (F.col("start_paragraph") < F.size("p_")) & (F.col("end_paragraph") < F.size("p_")) & (F.col("start_paragraph") <= F.col("end_paragraph"))
    text = F.array_join(F.slice("p_", F.when(fits, F.col("start_paragraph") + 1).otherwise(1), F.when(fits, F.col("end_paragraph") - F.col("start_paragraph") + 1).otherwise(0)), "\n\n")
    return out.withColumn("text", F.when(F.coalesce(fits, F.lit(False)), text).otherwise(F.col("text"))).drop("p_")
