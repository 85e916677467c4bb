"""Answering questions by scoring tree nodes, and choosing documents by description or chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordered_join

K1, B, TITLE_BOOST = 1.2, 0.75, 3.0
#: Components of pairs of vectors that are multiplied at once.
PAIR_COMPONENTS = 4_000_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def bm25(nodes: DataFrame, questions: DataFrame, k: int = 10, boosts: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, idx, score, rank): the k best nodes of each question by BM25 over boosted title and summary.

    nodes: doc_id, idx, title, summary. questions: qid, question. Only nodes that share a term are joined. boosts
    (query_pattern, title_pattern, boost) multiplies scores where both patterns match; its few rules are broadcast by size.
    """
    words = nodes.select("doc_id", "idx", F.explode(terms(F.col("title"))).alias("term"), F.lit(TITLE_BOOST).alias("w")).unionByName(
        nodes.select("doc_id", "idx", F.explode(terms(F.col("summary"))).alias("term"), F.lit(1.0).alias("w"))
    )
    tf = words.groupBy("doc_id", "idx", "term").agg(F.sum("w").alias("tf"))
    lengths = tf.groupBy("doc_id", "idx").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    asked = questions.select("qid", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    hits = asked.join(df, "term").join(tf, "term").join(lengths, ["doc_id", "idx"]).join(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scores = hits.groupBy("qid", "doc_id", "idx").agg(F.round(F.sum(part), 6).alias("score"))
    if boosts is not None:
        told = scores.join(questions, "qid").join(nodes.select("doc_id", "idx", "title"), ["doc_id", "idx"])
        on = F.rlike(F.lower("question"), "query_pattern") & F.rlike(F.lower("title"), "title_pattern")
        rules = told.join(boosts, on, "left").groupBy("qid", "doc_id", "idx", "score").agg(F.coalesce(F.max("boost"), F.lit(1.0)).alias("by"))
        scores = rules.select("qid", "doc_id", "idx", F.round(F.col("score") * F.col("by"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "idx"))
    return scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def thinking(found: DataFrame) -> DataFrame:
    """(qid, thinking, node_list): the scores that led to the choice, and the chosen nodes in order."""
    line = F.concat(F.lit("node "), F.col("idx").cast("string"), F.lit(" of "), F.col("doc_id").cast("string"), F.lit(": "), F.format_string("%.6f", "score"))
    return found.groupBy("qid").agg(ordered_join(F.col("rank"), line, "\n").alias("thinking"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "idx"))), lambda x: F.struct(x["doc_id"], x["idx"])).alias("node_list"))


def context(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, context): "[title (p.N)]" and text of the chosen nodes in list order; unknown ids and empty texts are skipped, repeats stay.

    chosen: qid, pos, doc_id, node_id. Of nodes with one id the last counts.
    """
    last = nodes.groupBy("doc_id", "node_id").agg(F.max_by(F.struct("title", "start_index", "text"), "idx").alias("n"))
    rows = chosen.join(last, ["doc_id", "node_id"]).where("n.text <> ''")
    block = F.concat(F.lit("["), F.col("n.title"), F.lit(" (p."), F.col("n.start_index").cast("string"), F.lit(")]\n"), F.col("n.text"))
    return rows.groupBy("qid").agg(ordered_join(F.col("pos"), block, "\n\n").alias("context"))


def answers(contexts: DataFrame, questions: DataFrame, n: int = 2) -> DataFrame:
    """(qid, answer): the n sentences of the context that share most terms with the question, in the order of the text."""
    rows = contexts.join(questions, "qid").select("qid", terms(F.col("question")).alias("q"), F.posexplode(F.regexp_extract_all("context", F.lit(r"[^.!?]+[.!?]*"), F.lit(0))).alias("pos", "s"))
    scored = rows.select("qid", "pos", "s", F.size(F.array_intersect("q", terms(F.col("s")))).alias("hits"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "pos"))).where(F.col("r") <= n)
    return best.groupBy("qid").agg(F.trim(ordered_join(F.col("pos"), F.col("s"), "")).alias("answer"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _regular(vector: Column) -> Column:
    """Whether a vector has finite components only, and one that isn't zero, none so large or small that squares are lost."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > 1e100))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: F.abs(x.cast("double")) > 1e-100), F.lit(False))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order of their components."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _packed(rows: DataFrame, key: str, vector: str, more: str | None = None) -> DataFrame:
    """(dim, ids, labels, matrix): rows of one length in blocks, as arrays of doubles. key is a whole number."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, held in batch.groupby(batch["v"].str.len()):
                matrix = np.stack([np.asarray(v, dtype=np.float64) for v in held["v"]])
                yield pd.DataFrame({"dim": [int(dim)], "ids": [held["k"].to_numpy(np.int64).tobytes()], "rows": [held["n"].tolist()], "matrix": [matrix.tobytes()]})

    own = F.col(more).cast("string") if more else F.lit(None).cast("string")
    return rows.select(F.col(key).cast("long").alias("k"), own.alias("n"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(pack, "dim int, ids binary, rows array<string>, matrix binary")


def top_chunks(chunks: DataFrame, queries: DataFrame, k: int = 10, block: int = 1000) -> DataFrame:
    """(qid, doc_id, chunk, score, rank): the k nearest chunks of every query vector, against all chunks.

    Queries go in blocks of about `block` vectors, the most that is sent to every executor at once; each block reads the chunks
    once, and only its k best of each task are shuffled. All pairs are scored by products of blocks of vectors; what may be among a block's k
    best is scored again, component by component in their order, so scores don't depend on how blocks are cut. Vectors with null or
    non-finite components, or of zeros only, are scored pair by pair. qid and chunk are whole numbers.
    """
    blocks = max(1, -(-queries.count() // block))
    near = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk")
    wide, asked = _regular(F.col("vector")), _regular(F.col("query"))
    kinds = {f.name: f.dataType for f in chunks.schema.fields + queries.schema.fields}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, other, ids, labels, matrix, qids, asked_ in batch[["dim", "q_dim", "ids", "rows", "matrix", "q_ids", "q_matrix"]].itertuples(index=False):
                chunk, qid = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                if dim != other:  # no cosine: what comes first by its id stands for all
                    at = np.argsort(chunk, kind="stable")[:k]
                    row, col = np.repeat(np.arange(len(qid)), len(at)), np.tile(at, len(qid))
                    score = np.full(len(row), np.nan)
                else:
                    x, q = np.frombuffer(matrix).reshape(-1, dim), np.frombuffer(asked_).reshape(-1, dim)
                    rough = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
                    least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
                    row, col = np.nonzero(rough >= (least - 3e-6)[:, None])  # equal ones after rounding stay
                    size = max(1, PAIR_COMPONENTS // dim)
                    score = np.concatenate([_dot(x[col[i : i + size]], q[row[i : i + size]]) for i in range(0, len(row), size)])
                    score = score / np.sqrt(_dot(x, x)[col] * _dot(q, q)[row])
                    # of copies, whose scores are the same, the first k
                    order = np.lexsort((chunk[col], -score, row))
                    row, col, score = row[order], col[order], score[order]
                    new = np.concatenate(([True], (row[1:] != row[:-1]) | (score[1:] != score[:-1])))
                    keep = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) < k
                    row, col, score = row[keep], col[keep], score[keep]
                yield pd.DataFrame({"qid": qid[row], "doc_id": np.array(labels, dtype=object)[col], "chunk": chunk[col], "score": score})

    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        ours = _packed(part.where(asked), "qid", "query").select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        found = _packed(chunks.where(wide), "chunk", "vector", "doc_id").join(F.broadcast(ours)).mapInPandas(nearest, "qid long, doc_id string, chunk long, score double")
        score = F.round(F.nanvl("score", F.lit(None).cast("double")), 6).alias("score")
        scored = found.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("qid", "doc_id", "chunk")), score)
        for rows, sent in ((chunks.where(~wide), part), (chunks.where(wide), part.where(~asked))):
            scored = scored.unionByName(rows.join(F.broadcast(sent)).select("qid", "doc_id", "chunk", F.round(cosine(F.col("vector"), F.col("query")), 6).alias("score")))
        best = scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def document_scores(found: DataFrame) -> DataFrame:
    """(qid, doc_id, doc_score): the retrieved chunks' scores, summed and damped by their number."""
    return found.groupBy("qid", "doc_id").agg(F.round(F.sum("score") / F.sqrt(F.count("*") + 1), 6).alias("doc_score"))
