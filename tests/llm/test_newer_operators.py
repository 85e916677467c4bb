"""Collocations, common lines and centroids against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliospark.llm import centroids, collocations, line_dedup

SCHEMA = "doc_id long, text string, lang string, n long, score double, words string, bucket string"


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rows():
    rng = random.Random(5)
    common = ["le", "la", "é", "İx", "the", "of", "X\x1cy", "b c", "zz"]
    words = common * 6 + ["w%d" % i for i in range(60)]
    lines = ["  Same line\t", "same LINE", "Éa", "éa", "", "   ", "x", "rare %d"]
    out = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 12)):
            text.append(rng.choice(lines).replace("%d", str(rng.random())) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 14))) + rng.choice([".", ",", " ;", "!?", "\t", "\x0b", ""]))
        out.append((i, rng.choice(["\n", "\n\n", "\r\n"]).join(text), rng.choice(["en", "fr", None, "und"])))
    out += [(200, None, "en"), (201, "", "fr"), (202, "le la the of " * 900, "en"), (202, "le la the of " * 900, "en"), (None, "le la\nsame line\nle la", None), (None, "le la\nsame line\nle la", None), (203, "y" * 200_000, "en")]
    return [(*r, 1, 0.5, "taken", "taken") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def mined(least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows():
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in (1, 2, 3, 4):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        best = []
        for p, a in many.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            covered = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in many.items())
            if not covered:
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize(("least", "top", "bucket", "block"), [(5, 2000, 2_000_000, 8 << 20), (3, 40, 40, 2000), (2, 2000, 7, 300)])
def test_collocations(docs, monkeypatch, least, top, bucket, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    found = collocations.mine(docs, least=least, top=top, bucket=bucket)
    got = [(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect()]
    told = mined(least, top)
    assert len(got) == len(told) > 20
    assert set(got) == told


def test_collocations_when_words_share_entries(docs, monkeypatch):
    monkeypatch.setattr(collocations, "ENTRIES", 8)
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.mine(docs, least=4, bucket=500).collect()} == mined(4, 2000)


def test_fragments_hold_each_phrase_once():
    rng = random.Random(1)
    words, ids = collocations.tokenized([" ".join(rng.choices("abcde", [1, 2, 3, 4, 9], k=400)).encode() + b". a"])
    table = np.full(1 << 10, 5, dtype=np.int64)
    sent = [x[2:] for x in collocations.fragments("en", words.to_pylist(), ids, table, 3, 100, 4)]
    held = Counter()
    for told, columns, count in collocations.owned([s for s in sent], 4):
        for row, c in zip(np.stack(columns, axis=1).tolist(), count.tolist(), strict=True):
            held[tuple(told[i] for i in row)] += c
    sequence = [b"." if i < 0 else words[i].as_py() for i in ids]
    assert held == Counter(t for m in (2, 3, 4) for i in range(len(sequence) - m + 1) if b"." not in (t := tuple(sequence[i : i + m])))


def cut(least, shortest):
    split = [(i, t, (t or "").split("\n")) for i, t, *_ in rows()]
    key = lambda x: folded(x.strip(" \t\n\x0b\x0c\r"))
    count = Counter(k for _, _, lines in split for k in {key(x) for x in lines})
    out = []
    for i, text, lines in split:
        kept = [x for x in lines if not (len(key(x)) >= shortest and count[key(x)] >= least)]
        text = "\n".join(kept) if len(kept) < len(lines) else text
        out.append((i, text, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("least", "shortest", "shard", "probes"), [(10, 1, 1 << 18, 1 << 20), (2, 2, 7, 64), (3, 6, 40, 1 << 20), (10**6, 1, 9, 9)])
def test_lines(docs, least, shortest, shard, probes):
    found = line_dedup.drop_common(docs, shortest, least, shard=shard, probes=probes)
    assert found.columns == [*docs.columns, "lines"]
    assert Counter((r["doc_id"], r["text"], *r["lines"]) for r in found.collect()) == cut(least, shortest)


def test_heavy_lines_need_no_shard(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('Very common\\n', id) as text", "1 as places_", "2 as id_")
    found = line_dedup.drop_common(docs, probes=640).collect()  # a line of 400 documents is heavy
    assert {(r["doc_id"], r["text"], r["lines"]["n_dropped"]) for r in found} == {(i, str(i), 1) for i in range(400)}
    with pytest.raises(ValueError, match="already"):
        line_dedup.drop_common(docs, result="Places_")


def test_perfect_hash_is_minimal_and_rejects_foreign_keys():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, size=(2, 30_000), dtype=np.uint64)
    a[:500] = a[0]  # keys that differ in one half only
    hash_ = line_dedup.PerfectHash.unpacked(line_dedup.PerfectHash.of(a, b).packed())
    slots = hash_.slots(a, b)
    assert sorted(slots.tolist()) == list(range(len(a)))
    assert sum(x.sum() for x in hash_.bits) == len(a)
    prints = np.empty(len(a), dtype=np.uint64)
    prints[slots] = b
    foreign = rng.integers(0, 1 << 63, size=(2, 5000), dtype=np.uint64)
    at = hash_.slots(*foreign)
    assert not (prints[at][at >= 0] == foreign[1][at >= 0]).any()
    assert line_dedup.PerfectHash.of(a[:0], b[:0]).slots(a[:3], b[:3]).tolist() == [-1, -1, -1]


def vectors():
    rng = np.random.default_rng(8)
    heart = rng.normal(size=(7, 64))
    x = (heart[rng.integers(0, 7, size=300)] + 0.2 * rng.normal(size=(300, 64))).astype(np.float32).astype(float)
    x[40:60] = x[39]  # a group of copies
    out = [(i, row.tolist()) for i, row in enumerate(x)]
    out += [(7, x[3].tolist()), (7, x[4].tolist()), (None, x[5].tolist()), (500, None), (501, [1.0] * 63), (502, []), (503, [None] * 64), (504, [float("nan")] * 64), (505, [float("inf")] * 64), (506, [0.0] * 64), (507, [-0.001] * 64)]
    return out


def clustered(k, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors() if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in start]
    for step in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]
        if step < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, b) in zip(kept, best, strict=True) if b == j]
                if mine:
                    centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    total, each = sum(d for d, _ in best), Counter()
    for d, j in best:
        each[j] += d
    return Counter((i, j, d, each[j], total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best, strict=True))


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (5, 2), (400, 1), (3, 0)])
def test_centroids(spark, k, rounds):
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors()], "vec_id long, embedding array<double>, cluster string").repartition(3)
    assert Counter(tuple(r) for r in centroids.cluster(table, k=k, rounds=rounds).collect()) == clustered(k, rounds)


def test_bounds_hold_and_screen():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-300, 300, size=(500, 64)), rng.integers(-(1 << 27), 1 << 27, size=(50, 64)), np.zeros((3, 64), dtype=np.int64)])
    scale = rng.integers(1, 40, size=(30, 8)).repeat(8, axis=1)
    c = np.concatenate([rng.integers(-30, 30, size=(30, 64)) * scale, x[:5], x[500:502]])
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (centroids.bounds(centroids.norms(x), centroids.norms(c)) <= exact).all()
    best, distance, taken = centroids.nearest(x, centroids.norms(x), c)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert taken < exact.size


def test_components_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.mine(docs).count() == line_dedup.drop_common(docs).count() == 0
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert [(r["cluster"], r["distance"]) for r in centroids.cluster(only).collect()] == [(0, 0)]
