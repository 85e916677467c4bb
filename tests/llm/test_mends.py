"""Null and repeated ids of vectors, labelled formats of any length, clashing columns, texts of one id, crowded turns."""

import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import chat_format, embedding_dedup, ngram_join, secret_scan, substring_dedup


def linked(rows):
    """(vec_id, n_links, component_id, kept) of each row, every row a node of its own."""
    unit = [None if label is None or not v or not any(v) else np.array(v) / np.linalg.norm(v) for _, v, label in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(n)]
    part = list(range(n))
    for _ in range(n):
        part = [min([part[i], *(part[j] for j in near[i])]) for i in range(n)]
    least = {p: min((rows[i][0] for i in range(n) if part[i] == p and rows[i][0] is not None), default=None) for p in set(part)}
    return Counter((rows[i][0], len(near[i]), least[part[i]], rows[i][0] == least[part[i]]) for i in range(n))


@pytest.mark.parametrize("shard", [8192, 12])
def test_vectors_with_null_and_repeated_ids(spark, shard):
    rng = np.random.default_rng(9)
    heart = rng.normal(size=(9, 8))
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (1, [0.0, 1.0], 2), (1, [1.0, 0.0], 2), (4, [0.05, 1.0], 2), (5, [1.0, 0.05], 2), (None, [0.0, 1.0], 3), (None, [0.02, 1.0], 3), (None, [-1.0, 0.0], 3)]
    for i in range(80):
        rows.append((rng.choice([None, i % 17, i]), (heart[i % 9] + 0.1 * rng.normal(size=8)).tolist(), int(i % 2)))
    rows += rows[20:24]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=shard)
    assert Counter(tuple(r) for r in found.collect()) == linked(rows)


def test_clustered_vectors_lose_no_link(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(150, 16)), 12, axis=0) + 0.12 * rng.normal(size=(1800, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for shard in (8192, 400):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table, shard=shard).collect()}
        assert sum(got.values()) >= 0.995 * links.sum() > 5000
        assert all(got[i] <= links[i] for i in got)


@pytest.mark.parametrize(("shape", "glue"), [(["acme_", ("abcdef0123456789", 8, 8)], "x"), (["zz-", ("abcdefghij0123456789", 300, 302)], "path/"), ([("ABCDEF", 1, 1), ("0123456789", 8, 8), "#" * 0, ("QRSTUV", 4, 4)], "")])
def test_labelled_formats_of_any_length(shape, glue):
    held = secret_scan.examples([shape], 250, 3)
    found = secret_scan.Scanner({"acme": held[:150], "": secret_scan.examples(secret_scan.HARMLESS, 600, 5)})
    hits = sum(any(kind == "acme" for _, _, kind, _ in found.spans(f"see {glue}{token} here")[1]) for token in held[150:])
    assert hits >= 95
    assert not found.spans("plain words and numbers-like 12 things")[1]


def test_universal_ids_are_no_secrets():
    found, rng = secret_scan.scanner(), random.Random(2)
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    assert not any(found.spans(f"id {hexa(8)}-{hexa(4)}-4{hexa(3)}-a{hexa(3)}-{hexa(12)}.")[1] for _ in range(200))
    assert secret_scan.Scanner({"": ["harmless"]}).spans("token: abcdef1 and ghp_" + "q" * 36)[1] == [(0, 0, "assign", 14)]


def test_substrings_with_clashing_columns_and_equal_ids(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage + " one", 7, "x"), (2, "a b " + passage, 8, "x"), (2, passage + " other", 9, "x"), (2, "c " * 40, 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, span_id_ int, spans_ string")
    for shared in (False, True):
        if shared:  # all texts of an id have one tag
            from pyspark.sql import functions as F

            monkeypatch.setattr(substring_dedup, "tag_of", lambda c: F.lit(5))
        found = substring_dedup.deduplicate(docs)
        assert found.columns == [*docs.columns, "removal"]
        assert {(r["doc_id"], r["span_id_"], r["removal"]["n_words"], r["removal"]["n_removed"]) for r in found.collect()} == {(1, 7, 31, 0), (2, 8, 32, 30), (2, 9, 31, 30), (2, 9, 40, 0)}
    with pytest.raises(ValueError, match="already"):
        substring_dedup.deduplicate(docs.withColumn("Removal", docs["doc_id"]))


def test_crowded_turns_are_split(spark):
    rows = [(1, None, "user", f"what {i}?") for i in range(3000)] + [(2, 5, "user", "same?")] * 900 + [(2, 6, "assistant", "yes")] + [(3, i, "user", f"q {i}?") for i in range(-70, 70)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    own = turns.selectExpr("cast(conv_id as string) as conv_id", "coalesce(turn, -1) as turn", "role", "text", "xxhash64(role, text) as tie")
    placed = chat_format.with_block(own, most=200).collect()
    assert len(placed) == len(rows)
    sizes = Counter((r["conv_id"], r["block"]) for r in placed)
    assert max(n for (c, _), n in sizes.items() if c in ("1", "2")) <= 200
    assert {c: len({b for k, b in sizes if k == c}) for c in ("3",)} == {"3": 4}  # turns -70 to -65, -64 to -1, 0 to 63, 64 to 69
    for c in ("1", "2", "3"):  # blocks follow one another in the order of turns
        mine = sorted(((r["block"], r["turn"]) for r in placed if r["conv_id"] == c))
        assert [t for _, t in mine] == sorted(t for _, t in mine)
    found = chat_format.reformat(turns).collect()
    assert sum(r["n_lines"] for r in found) == len(rows)
    assert {r["block"] for r in found if r["conv_id"] == 3} == {0, 1, 2, 3}


def components(n, pairs):
    part = list(range(n))

    def root(a):
        while part[a] != a:
            a = part[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        part[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_documents_of_one_lowest_key_stand_for_each_other():
    """Blocks, then buckets, connect what all keys together connect."""
    rng = random.Random(1)
    for _ in range(1500):
        n, many = rng.randint(1, 14), rng.randint(1, 12)
        docs = [rng.sample(range(many), rng.randint(1, min(many, 5))) for _ in range(n)]
        at = [0, *sorted(rng.sample(range(n + 1), min(2, n))), n]
        pairs, rows = [], []

        def meet(entries):
            keys, who, low = (np.array(c, dtype=kind) for c, kind in zip(zip(*entries), (np.uint64, np.int64, np.uint64)))
            found = ngram_join.meet(keys, who, low)
            pairs.extend(found[3].tolist())
            return list(zip(*(c.tolist() for c in found[:3])))

        for a, b in zip(at, at[1:]):
            if a < b:
                rows += meet([(k, i, min(docs[i])) for i in range(a, b) for k in docs[i]])
        for bucket in range(3):
            if mine := [r for r in rows if r[0] % 3 == bucket]:
                meet(mine)
        assert components(n, pairs) == components(n, [(i, next(j for j in range(n) if k in docs[j])) for i in range(n) for k in docs[i]])
