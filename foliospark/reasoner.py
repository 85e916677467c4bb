"""Decisions behind one interface: deterministic rules by default, any callable over distinct prompts instead."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import settled
from .functions.text import collapse, sentences

#: Words that tell a section's type from its title.
SECTION_WORDS = {
    "introduction": "introduction|background|motivation|overview|related work|literature|preface|objectives",
    "methods": "method|methodology|materials|experimental|procedure|approach|setup|synthesis|fabrication|preparation|characterization techniques",
    "results": "result|finding|observation|performance|measurement|evaluation|experiments",
    "discussion": "discussion|conclusion|implication|limitation|future|summary|interpretation|outlook",
}


def section_type(title: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind in ("methods", "results", "discussion", "introduction"):
        out = out.when(F.lower(title).rlike(SECTION_WORDS[kind]), kind)
    return out.otherwise("default")


def figure_type(caption: Column) -> Column:
    out = F.when(F.lit(False), "")
    for words, kind in (("micrograph|sem |tem ", "microscopy"), ("spectr", "spectrum"), ("schematic|diagram|illustration", "diagram"), ("histogram|bar", "bar chart"), ("plot|curve|versus| vs", "line plot"), ("photo", "photograph")):
        out = out.when(F.lower(caption).rlike(words), kind)
    return out.otherwise("image")


def summary(text: Column, limit: int = 3000) -> Column:
    return sentences(F.left(F.coalesce(text, F.lit("")), F.lit(limit)), 2)


def first_sentence(text: Column) -> Column:
    return sentences(text, 1)


def element_summary(number: Column, caption: Column, kind: Column) -> Column:
    return F.when(caption != "", caption).otherwise(F.concat(number, F.lit(" ("), kind, F.lit(")")))


def description(nodes: DataFrame) -> DataFrame:
    """(doc_id, doc_description) of the root titles in order."""
    roots = nodes.where("parent_idx is null").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "title"))), lambda x: x["title"]), "; ").alias("doc_description"))
    return roots


def top_terms(units: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, idx, best): the n terms of highest tf-idf of each unit, as structs (s: the score, negated; term).

    Terms are cut out of the texts and counted once; a unit's terms meet by a window, so no list of all of them is built.
    """
    terms = units.select("doc_id", "idx", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{4,}"), F.lit(0))).alias("term"))
    tf = settled(terms.groupBy("doc_id", "idx", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").withColumn("score", F.round(F.col("tf") / F.col("df"), 9))
    order = F.row_number().over(Window.partitionBy("doc_id", "idx").orderBy(F.desc("score"), "term"))
    best = scored.select("doc_id", "idx", "term", "score", order.alias("nth_")).where(F.col("nth_") <= n)
    return best.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))).alias("best"))


def keywords(units: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, idx, keywords): the n terms of highest tf-idf of each unit, with the first sentence that has the term."""
    told = top_terms(units, n).join(units.select("doc_id", "idx", "text"), ["doc_id", "idx"])
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    context = F.transform("best", lambda b: F.struct(b["term"].alias("term"), collapse(F.coalesce(F.get(F.filter(found, lambda s: F.contains(F.lower(s), b["term"])), F.lit(0)), F.lit(""))).alias("context"), (-b["s"]).alias("relevance")))
    return told.select("doc_id", "idx", context.alias("keywords"))


def ask(prompts: DataFrame, call: Callable[[list[str]], list[str]], retries: int = 3, wait: float = 1.0) -> DataFrame:
    """prompts with `response`: distinct prompts are asked once, in batches; one that fails after the retries is null."""
    keyed = prompts.withColumn("key_", F.sha2("prompt", 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers: list[str | None] = [None] * len(batch)
            for attempt in range(retries):
                try:
                    answers = call(batch["prompt"].tolist())
                    break
                except Exception:  # the caller's service may fail in any way; what stays unanswered is null
                    time.sleep(wait * 2**attempt)
            yield pd.DataFrame({"key_": batch["key_"], "response": answers})

    asked = keyed.where("prompt is not null").select("key_", "prompt").dropDuplicates(["key_"]).mapInPandas(run, "key_ string, response string")
    return keyed.join(asked, "key_", "left").drop("key_")
