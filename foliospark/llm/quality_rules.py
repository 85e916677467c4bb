"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The ratio compares the multinomial of trusted documents (labelled good and not toxic) with that of the raw corpus over
hashed word n-grams. Both are counted over all documents; a bucket's log ratio is log((t + s) / (e + s)) with its trusted
count t, the trusted count e that its raw share predicts, and s for smoothing. Ratios of both signs are drawn towards
zero (the soft threshold of an L1 penalty) by `margin`, or by `errors` standard errors of a bucket's count if that is more:
this takes the sampling noise out at any size of corpus, so that buckets say something as soon as their counts do. A document's score is the sum over all its n-grams, divided by its number of words plus a constant; it is rejected when the
score is under the threshold. All documents are thresholded alike.

Null text has no words. Empty texts fail the base rule. Repeated or null document ids are rows of their
own. Scoring is one narrow pass: texts are never shuffled. The model is an array of `buckets` numbers for each order, found once
by a scalar subquery. Without any trusted document every ratio is 0 and only the base rule decides. Extra columns of any name
stay; a column with the result's name is an error.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, materialize

#: White space between words, and the characters counted as symbols.
WHITE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
BUCKETS, ORDERS = 1 << 18, (1, 2)
#: So many different repeated windows of a text are looked up one by one; more are found by sorting.
FEW = 16
SMOOTHING, MARGIN, ERRORS, EXTRA_LENGTH, THRESHOLD = 0.5, 1.0, 4.0, 50.0, -0.029
#: At most about so many labelled documents are trusted; beyond it a share of them by the hash of their ids.
MAX_TRUSTED = 200_000


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with the values as columns. Each is computed once: a generator stands between it and the plan steps that use it,
    so the optimizer never copies its expression into them. The value itself is a projection's, where expressions are compiled."""
    for name, value in values.items():
        (held,) = free(df, "held")
        df = df.select("*", value.alias(held)).select(*df.columns, F.explode(F.array(held)).alias(name))
    return df


def words_of(text: Column) -> Column:
    """Words of a text. Splitting leaves an empty one at most at each end, which is cut off."""
    found = F.split(F.coalesce(text, F.lit("")), WHITE)
    first, last = (F.get(found, F.lit(0)) == "").cast("int"), ((F.size(found) > 1) & (F.element_at(found, -1) == "")).cast("int")
    return F.when((first == 0) & (last == 0), found).otherwise(F.slice(found, first + 1, F.size(found) - first - last))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def longer(hashes: Column) -> Column:
    """Hashes of n + 1 consecutive words, from those of n: each with its successor."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def covered_words(windows: Column, repeated: Column) -> Column:
    """Words that the repeated 3-word windows cover. repeated: the hashes that windows hold more than once."""

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def by_sorting(found: Column) -> Column:  # many repeated windows: equal neighbours in order
        def twice(x: Column, i: Column) -> Column:
            other = (F.get(found, i - 1)["h"] == x["h"]) | (F.get(found, i + 1)["h"] == x["h"])
            return F.when(other, x["i"])

        return F.array_sort(F.filter(F.transform(found, twice), lambda p: p.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    by_looking = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda p: p.isNotNull())
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.when(F.size(repeated) <= FEW, by_looking).otherwise(let(placed, by_sorting))
    return F.when(F.size(repeated) == 0, 0).otherwise(let(starts, covered))


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    own = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(own) - F.size(F.array_distinct(own))


def total_weight(grams: Column, weights: tuple[Column, int], buckets: int) -> Column:
    """The sum of the weights of n-grams, given by their hashes."""
    table, slots = weights

    def slot(h: Column) -> Column:
        return F.get(table, F.pmod(h, F.lit(slots)).cast("int"))

    def weight(h: Column) -> Column:
        return F.aggregate(slot(h), F.lit(0.0), lambda s, e: s + F.when(e["b"] == F.pmod(h, F.lit(buckets)), e["w"]).otherwise(0.0))

    return F.aggregate(F.filter(grams, lambda h: slot(h).isNotNull()), F.lit(0.0), lambda s, h: s + weight(h))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """(id): ids labelled good and never toxic; of more than max_trusted about as many, by their hash."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    good = good.where("q = 1 and x = 0").select(F.col("doc_id").cast("long").alias("id"))
    n = good.count()
    if n > max_trusted:
        good = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_trusted / n)))
    return good


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """(bucket, ratio, error): log ratios of the buckets that occur, of `buckets` for each order, and their standard errors; counted over all documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    trusted = F.broadcast(trusted_ids(labels, max_trusted).withColumn("t", F.lit(1)))  # bounded by max_trusted
    rows = once(rows.join(trusted, "id", "left").select(F.coalesce("t", F.lit(0)).alias("t"), "text"), words=words_of(F.col("text")))
    rows = once(rows.select("t", "words"), h1=word_hashes(F.col("words"))).drop("words")
    names = [f"h{n}" for n in range(1, max(orders) + 1)]
    for name, shorter in zip(names[1:], names, strict=False):
        rows = once(rows, **{name: longer(F.col(shorter))})
    held = [names[n - 1] for n in orders]
    ends = [sum((F.size(c) for c in held[:k]), F.lit(0)).alias(f"end{k}") for k in range(1, len(held))]
    found = rows.select("t", *ends, F.posexplode(F.concat(*held)).alias("at", "h"))
    order = sum((F.when(F.col("at") >= F.col(f"end{k}"), 1).otherwise(0) for k in range(1, len(held))), F.lit(0))
    found = found.select("t", (F.pmod("h", F.lit(buckets)).cast("int") + order * buckets).alias("bucket"))
    counts = materialize(found.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("good")))
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    share = (total["good"] or 0) / max(total["raw"] or 0, 1)
    expected = F.col("raw") * share + smoothing
    return counts.select("bucket", F.log((F.col("good") + smoothing) / expected).alias("ratio"), (1 / F.sqrt(expected)).alias("error"))


def model_weights(model: DataFrame, buckets: int, n_orders: int, margin: float, errors: float) -> list[tuple[Column, int]]:
    """For each order a literal array of slots, and their number; slot b modulo that holds (bucket, weight) of bucket b. Null: none.

    Only buckets whose ratio is beyond the margin and the errors have a weight. There are eight slots for each of them or more, if so many buckets are, so a lookup is one
    access, and the array's size is the model's, whatever the corpus.
    """
    weight = F.signum("ratio") * F.greatest(F.abs("ratio") - F.greatest(F.lit(margin), errors * F.col("error")), F.lit(0.0))
    known = model.select("bucket", F.round(weight, 4).alias("weight")).where("weight <> 0").collect()  # at most one row a bucket
    out = []
    for k in range(n_orders):
        own = [(row["bucket"] - k * buckets, row["weight"]) for row in known if row["bucket"] // buckets == k]
        slots: list[list | None] = [None] * math.gcd(buckets, 1 << max(10, (8 * len(own)).bit_length()))
        for b, w in own:
            slots[b % len(slots)] = [*(slots[b % len(slots)] or []), {"b": b, "w": w}]
        out.append((F.from_json(F.lit(json.dumps(slots)), "array<array<struct<b:int,w:double>>>"), len(slots)))
    return out


def score(docs: DataFrame, model: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, margin: float = MARGIN, errors: float = ERRORS, threshold: float = THRESHOLD, result: str = "quality_") -> DataFrame:
    """docs with a struct column named by result: the base counts, base_failed, the score and kept; one row per input row."""
    if result in docs.columns:
        raise ValueError(f"docs has a column {result} already")
    text, words, facts, *hashes = free(docs, "text", "words", "facts", *(f"h{n}" for n in range(1, max(*orders, 3) + 1)))
    rows = docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    rows = once(rows, **{words: words_of(F.col(text))})
    rows = once(rows, **{hashes[0]: word_hashes(F.col(words))})
    for name, shorter in zip(hashes[1:], hashes, strict=False):
        rows = once(rows, **{name: longer(F.col(shorter))})
    n, windows = F.size(words), F.col(hashes[2])
    weights = model_weights(model, buckets, len(orders), margin, errors)
    total = sum((total_weight(F.col(hashes[k - 1]), w, buckets) for k, w in zip(orders, weights, strict=True)), F.lit(0.0))
    lines = F.split(text, "\n")
    found = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.when(F.size(lines) == F.size(F.array_distinct(lines)), 0).otherwise(duplicate_lines(lines)).cast("long").alias("n_dup_lines"),
        (total / (n + EXTRA_LENGTH)).alias("score"),
    )
    ordered = F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(windows)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*docs.columns, hashes[2], found.alias(facts), ordered.alias(words))
    rows = once(rows, **{hashes[0]: F.col(words)})
    twice = F.array_distinct(F.filter(hashes[0], lambda h, i: h == F.get(F.col(hashes[0]), i + 1)))
    rows = once(rows, **{hashes[1]: twice})
    q = F.col(facts)
    counts = F.struct(*(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "score")), covered_words(windows, F.col(hashes[1])).cast("long").alias("n_repeat_words"))
    rows = once(rows.select(*docs.columns, facts, hashes[1], hashes[2]), **{result: counts})
    q = F.col(result)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    verdict = F.struct(*(q[c].alias(c) for c in names), failed.alias("base_failed"), F.round(q["score"], 9).alias("score"), (~failed & (q["score"] >= threshold)).alias("kept"))
    return rows.select(*docs.columns, verdict.alias(result))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the column quality_, by a model fitted to docs and labels."""
    return score(docs, fit(docs, labels))
