"""python -m foliospark FOLDER -o OUT: trees of Markdown files as JSON, one line a document."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .config import DEPTH, load
from .operators import tree
from .plans.pipelines import markdown_tree
from .session import build
from .sinks.writers import envelopes, write_json
from .sources.readers import markdown


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    parser.add_argument("path", help="Markdown files: a file, a folder or a pattern")
    parser.add_argument("-o", "--out", default="results")
    parser.add_argument("-g", "--granularity", choices=list(DEPTH), default="coarse")
    parser.add_argument("--model", default="rules")
    parser.add_argument("--thin", type=int, help="least tokens of a section that is kept apart")
    parser.add_argument("--summaries", action="store_true")
    parser.add_argument("--doc-description", action="store_true")
    given = parser.parse_args(arguments)
    config = load({"granularity": given.granularity, "model": given.model, "if_add_node_summary": given.summaries, "if_add_doc_description": given.doc_description})
    spark = build()
    docs = markdown(spark, given.path)
    nodes = tree.depths(tree.sibling_ids(markdown_tree(docs, given.thin, config)))
    told = docs.select("doc_id", "doc_name")
    if given.doc_description:
        from .reasoner import description

        told = told.join(description(nodes), "doc_id", "left")
    else:
        told = told.withColumn("doc_description", F.lit(None).cast("string"))
    fields = ["node_id", "title", "text", *(["summary", "prefix_summary"] if given.summaries else [])]
    write_json(envelopes(nodes, told, fields), given.out, given.granularity)


if __name__ == "__main__":
    main()
