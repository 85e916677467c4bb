"""Candidate groups that outgrow a block: finer signatures that lose no link, and leaders in blocks of their own bounds."""

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import ngram_join as J


def test_finer_signatures_lose_no_link():
    """Sets that differ as much as a link allows share a signature in the band of the smaller one."""
    rng = np.random.default_rng(3)
    for size in (4, 5, 9, 27, 60, 141, 500):
        for _ in range(40):
            every = rng.integers(0, 1 << 63, size=2 * size, dtype=np.uint64)
            a = every[:size]
            lost = int(rng.integers(0, size // 5 + 1))
            added = (size - lost) * 100 // 80 - size if lost < size // 5 else 0
            b = every[lost : size + max(added, 0)]
            both, whole = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * both < 80 * whole:
                continue
            band = int(np.searchsorted(J.bands(80, 100), min(len(a), len(b)), side="right")) - 1
            for spare in (0, 2):
                sent = [J.fine_parts(np.sort(x), band, 80, 100, rng.random(len(x)), spare) for x in (a, b)]
                assert len(np.intersect1d(*sent)), (size, lost, added)


def test_wide_groups_are_cut_and_searched(spark, monkeypatch):
    """Groups of more documents than a block holds: chance meetings fall apart, every link is found."""
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(6)]
    rows = []
    for i in range(150):  # few words, so that unrelated texts share shingles
        rows.append((i, " ".join(rng.choice(common, size=30))))
    for i in range(150, 190):
        text = rows[i - 150][1].split()
        text[int(rng.integers(0, 30))] = "x"
        rows.append((i, " ".join(text)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    part = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    monkeypatch.setattr(J, "BLOCK_DOCS", 8)
    most = []
    led = J._led
    monkeypatch.setattr(J, "_led", lambda *a: most.append(led(*a).groupBy("grp", "block").count().agg(F.max("count")).first()[0]) or led(*a))
    found = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70, 100).collect()}
    assert found == part
    assert all(m is None or m <= 24 for m in most)  # dealt by hash: some blocks hold more than the mean


def test_tasks_follow_the_texts(spark, monkeypatch):
    """More text is dealt over more tasks, whatever the session's setting."""
    from foliospark.llm import shared

    docs = spark.createDataFrame([(i, "a b c" * 20) for i in range(50)], "doc_id long, text string")
    assert shared.spread(docs, "text") == shared.partitions(spark)
    monkeypatch.setattr(shared, "SPREAD_CHARS", 100)
    assert shared.spread(docs, "text") == 50
