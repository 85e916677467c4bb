"""Work that must not grow with the square of a document or table: what plans hold, and the same rows by plain loops."""

import random

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_groups_stream(spark):
    """The fold over pages keeps no list of what it made (ArrayAggregate copies its state at every step)."""
    from foliospark.operators import pages as P

    rng = random.Random(3)
    rows = [(d, p, rng.choice((None, 0, 5, 40, 90, 300)) if d == 3 else rng.choice((5, 40, 90, 300))) for d in (None, 1, 2, 3) for p in range(1, 60)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, token_count int")
    for overlap in (0, 1, 3):
        found = P.grouped(pages, 200, overlap)
        assert "collect_list" not in plan(found) and "aggregate(" not in plan(found)
        told = []
        for d in (None, 1, 2):
            own = [(p, n) for e, p, n in rows if e == d]
            total = sum(n for _, n in own)
            target = -(-(total / -(-total // 200) + 200) // 2)
            held, grp = 0, 0
            for i, (p, n) in enumerate(own):
                if held + n > target:
                    grp, back = grp + 1, own[max(i - overlap, 0) : i]
                    held = sum(k for _, k in back)
                    told += [(d, grp, q) for q, _ in back]
                held += n
                told.append((d, grp, p))
        got = [tuple(r) for r in found.where("doc_id is null or doc_id <> 3").collect()]
        assert sorted(map(str, got)) == sorted(map(str, told))


def test_headings_without_a_fold(spark):
    """Codes of headings come from windows; documents with codes of their own keep them."""
    from foliospark.operators import toc

    rng = random.Random(5)
    rows = [(d, p, 0, rng.randint(1, 4), None if d < 3 or p % 5 else f"{p}.1", f"h{p}") for d in (1, 2, 3) for p in range(1, 80)]
    found = toc.continued(spark.createDataFrame(rows, "doc_id long, page_no int, at int, rank int, structure string, title string"))
    assert "collect_list" not in plan(found) and "aggregate(" not in plan(found)
    told = []
    for d in (1, 2, 3):
        open_: list[list[int]] = []
        for i, (_, p, _, rank, own, title) in enumerate(r for r in rows if r[0] == d):
            open_ = [o for o in open_ if o[0] <= rank]
            if open_ and open_[-1][0] == rank:
                open_[-1][1] += 1
            else:
                open_.append([rank, 1])
            told.append((d, i, 0, own if d == 3 else ".".join(str(n) for _, n in open_), title, p))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, told))


def test_parents_of_elements_by_ranges(spark):
    """Elements and nodes that share a range meet once: the join sees distinct ranges, not every pair."""
    from foliospark.operators import granular as G

    rng = random.Random(7)
    nodes = [(1, i, *sorted((rng.randint(1, 6), rng.randint(1, 6)))) for i in range(300)]
    wanted = [(1, e, *sorted((rng.randint(1, 7), rng.randint(1, 7)))) for e in range(200)]
    tree_rows = spark.createDataFrame(nodes, "doc_id long, idx int, start_index int, end_index int").withColumn("lo", F.col("start_index")).withColumn("hi", F.col("end_index"))
    found = G.parent_of(spark.createDataFrame(wanted, "doc_id long, element int, start_index int, end_index int"), tree_rows)
    text = plan(found)
    assert text.count("Aggregate [doc_id") >= 4  # nodes by range, by page, elements by range, the smallest
    for r in found.collect():
        fits = [(z - a + 1, i) for _, i, a, z in nodes if a <= r.start_index and r.end_index <= z]
        assert (r.parent_size, r.parent_idx) == (min(fits) if fits else (None, None))


def test_nearest_vectors_by_blocks(spark):
    """Vectors are scored by blocks, with ties, copies, other lengths and odd ones as pair by pair."""
    from foliospark.operators import search as S

    rng = random.Random(11)
    vectors = [[rng.choice((-1.0, 0.5, 2.0, 3.0)) for _ in range(4)] for _ in range(60)] + [[1.0, 2.0, 3.0, 4.0]] * 15 + [[1.0, 2.0], None, [1.0, None, 2.0, 0.0], [float("inf"), 1.0, 1.0, 1.0]]
    rows = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(vectors)], "chunk long, doc_id int, vector array<float>").repartition(3)
    asked = rows.where("chunk % 7 = 0").select(F.col("chunk").alias("qid"), F.col("vector").alias("query"))
    found = S.top_chunks(rows, asked, 5, 4)
    assert "MapInPandas" in plan(found)
    told = rows.join(asked).withColumn("score", F.round(S.cosine(F.col("vector"), F.col("query")), 6))
    told = told.withColumn("rank", F.row_number().over(S.Window.partitionBy("qid").orderBy(F.desc("score"), "chunk"))).where("rank <= 5")
    assert found.columns == ["qid", "doc_id", "chunk", "score", "rank"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, told.select(*found.columns).collect())))


def test_gaps_without_shuffled_words(spark):
    """Words are counted where a section's row is: the similarities of gaps need no exchange."""
    from foliospark.operators import segments

    rows = spark.createDataFrame([(1, 0, ["Alpha beta alpha", "alpha", "", "gamma beta"]), (2, 0, ["alone here"]), (3, 1, ["a b", "c d"])], "doc_id long, idx int, p array<string>")
    found = segments.gaps(rows)
    assert "Aggregate" not in plan(found) and "Join" not in plan(found)
    # gap 0: (2, 1) and (1, 0); gap 1: (3, 1) and (0, 1, gamma); gap 2: (1, 0) and (0, 1, gamma)
    told = [(1, 0, 0, round(1e6 * 2 / 5**0.5)), (1, 0, 1, round(1e6 * 1 / 20**0.5)), (1, 0, 2, 0), (3, 1, 0, 0)]
    assert sorted(map(tuple, found.collect())) == told


def test_large_tables_are_not_sent_through_the_driver(spark):
    """Settled tables whose files are over a bound are joined by sorting, also as the union of a fold; small ones may be sent to all."""
    from foliospark import durable

    def joined(n):
        rows = durable.settled(spark.range(n).withColumn("v", F.xxhash64("id")))
        return plan_of(spark.range(10**8).join(rows.select(F.col("id"), "v"), "id", "left"))

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in joined(100)
    assert "BroadcastHashJoin" not in joined(100_000)
    one, two = (durable.settled(spark.range(11_000).withColumn("v", F.xxhash64("id", F.lit(k)))) for k in (1, 2))  # neither alone is over the bound
    both = one.unionByName(two)
    assert "BroadcastHashJoin" in plan_of(spark.range(10**8).join(both, "id", "left"))
    assert "BroadcastHashJoin" not in plan_of(spark.range(10**8).join(durable.kept_apart(both), "id", "left"))


def test_elements_are_numbered_without_a_sort(spark, monkeypatch):
    """Nodes of elements stream out of the last join, in parts; numbers and copies are those of one sort a document."""
    from foliospark.operators import markdown

    monkeypatch.setattr(markdown, "PART", 2)
    rng = random.Random(2)
    sections = [(d, i, None if i % 4 == 0 else i - i % 4, f"s{i}", rng.choice((1, 2, 3, None))) for d in (1, 2) for i in range(12)]
    found = [(d, rng.choice(("figure", "table")), pos, rng.randint(1, 4), pos % 3, pos, pos + 1) for d in (1, 2, 3) for pos in range(9)]
    out = markdown.with_elements(spark.createDataFrame(sections, "doc_id long, idx int, parent_idx int, title string, page int"), spark.createDataFrame(found, "doc_id long, kind string, pos int, page_no int, number int, line_start int, line_end int"))
    assert plan(out).count("Window") == 0
    told = []
    for d in (1, 2):
        at, new, copies = {}, -1, {}
        for _, i, up, _, page in (s for s in sections if s[0] == d):
            new += 1
            at[i] = new
            told.append((new, at.get(up), "section", None))
            for _, kind, pos, *_ in sorted((f for f in found if f[0] == d and f[3] == (page or 1)), key=lambda f: f[1:3]):
                new += 1
                copies[kind, pos] = copies.get((kind, pos), 0) + 1
                told.append((new, at[i], kind, copies[kind, pos]))
    got = [(r.idx, r.parent_idx, r.node_type, r.copy) for r in out.orderBy("doc_id", "idx").collect()]
    assert sorted(map(str, got)) == sorted(map(str, told))


def test_keywords_without_lists_of_all_terms(spark):
    """Texts are cut into terms once, units keep no list of all their terms; repeated units are one."""
    from collections import Counter

    from foliospark import reasoner

    texts = [(1, 0, "alpha beta alpha. Gamma"), (1, 1, "beta beta delta"), (2, 0, None), (2, 1, ""), (3, 0, "alpha ab"), (3, 0, "Beta gamma")]
    units = spark.createDataFrame(texts, "doc_id long, idx int, text string")
    found = reasoner.keywords(units, 2)
    assert plan(reasoner.top_terms(units, 2)).count("regexp_extract_all") == 0  # done, and kept
    assert "WindowGroupLimit" in plan(found)
    tf = Counter((d, i, w) for d, i, t in texts for w in (t or "").lower().replace(".", "").split() if len(w) > 3)
    df = Counter(w for _, _, w in tf)
    for r in found.collect():
        own = sorted((-round(n / df[w], 9), w) for (d, i, w), n in tf.items() if (d, i) == (r.doc_id, r.idx))[:2]
        assert [(-k.relevance, k.term) for k in r.keywords] == own
    assert found.count() == 4


def test_markdown_is_cut_into_lines_once(spark, monkeypatch):
    """What thinning reads many times is settled: its plans hold no split of the texts."""
    from foliospark.operators import tree
    from foliospark.plans import pipelines

    seen = []
    sized = tree.with_subtree
    monkeypatch.setattr(tree, "with_subtree", lambda nodes, length: seen.append(plan(nodes)) or sized(nodes, length))
    docs = spark.createDataFrame([(1, "# A\nwords\n## B\n" + "more " * 60 + "\n## C\nx")], "doc_id long, text string")
    found = pipelines.markdown_tree(docs, 40)
    assert seen and "split(" not in seen[0]
    assert sorted(r.title for r in found.collect()) == ["A", "B", "C"]


def test_converted_trees_in_one_partitioning(spark, monkeypatch):
    """Contents as nested JSON: rows move once for the windows, once to blocks, blocks once to documents, and nothing is written between; null levels,
    gaps, null pages and titles, as by plain loops."""
    import json

    from foliospark.operators import folds, markdown
    from foliospark.operators import tree as T

    def unwanted(df):
        raise AssertionError("written between")

    for module in (T, folds, markdown):
        monkeypatch.setattr(module, "settled", unwanted)
    monkeypatch.setattr(T, "BLOCK", 5, raising=False)
    rng = random.Random(13)
    rows = [(d, 3 * i, rng.choice((None, 1, 2, 2, 4, 4, 7) if d < 4 else (None,) if d == 4 else (3,)), rng.choice((None, f'"t" {i}', f"t\\{i}")), rng.choice((None, i // 4, 1 + i // 3))) for d in range(1, 6) for i in range(1 if d == 5 else 60)]
    sections = spark.createDataFrame(rows, "doc_id long, idx int, level int, title string, page int")
    bounds, told = {}, {}
    for d in range(1, 6):
        own = [r[1:] for r in rows if r[0] == d]
        up = {i: max((j for j, k, *_ in own if j < i and k is not None and level is not None and k < level), default=None) for i, level, *_ in own}
        page = {i: p for i, _, _, p in own}
        start: dict[int, int] = {}
        for i, *_ in own:
            at = i
            while at is not None and page[at] is None:
                at = up[at]
            start[i] = 1 if at is None else page[at]
        kids = {i: [j for j in up if up[j] == i] for i in (None, *up)}

        def end(i, d=d, up=up, page=page, start=start, kids=kids):
            if kids[i]:
                return end(kids[i][-1])
            after = [j for j in kids[up[i]] if j > i]
            return start[i] if not after else start[i] if page[after[0]] is None else page[after[0]] - 1

        def made(parent, path, own=own, start=start, kids=kids, end=end):
            out = []
            for n, i in enumerate(kids[parent], 1):
                title = next(t for j, _, t, _ in own if j == i)
                node = ({"title": title} if title is not None else {}) | {"start_page": start[i], "end_page": end(i), "type": "section", "node_id": f"{path}{n}"}
                out.append(node | ({"children": made(i, f"{path}{n}.")} if kids[i] else {}))
            return out

        told[d] = made(None, "")
        bounds |= {(d, i): (start[i], end(i)) for i in up}
    found = markdown.converted(sections)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert {r.doc_id: json.loads(r.structure) for r in found.collect()} == told
    ends = folds.page_ends(T.with_level_parent(sections))
    assert ends._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.doc_id, r.idx): (r.start_page, r.end_page) for r in ends.collect()} == bounds
    placed = {(r.doc_id, r.idx): r for r in T.preordered(sections, "page").collect()}
    parents = {(r.doc_id, r.idx): r.parent_idx for r in T.with_level_parent(sections).collect()}
    assert {k: r.parent_idx for k, r in placed.items()} == parents and all(r.depth == r.path_id.count(".") for r in placed.values())
    assert markdown.converted(sections.where("doc_id > 9")).count() == 0


def test_elements_without_whole_documents(spark, monkeypatch):
    """Elements come from lines: no row holds a document's text, and the same elements are found as in the text."""
    from foliospark.operators import markdown
    from foliospark.queries import QUERIES

    monkeypatch.setattr(markdown, "settled", lambda df: df)
    assert "collect_list" not in plan(QUERIES["md_elements_in_sections"](spark, "/root/testdata/sf0.001"))
    texts = {1: "# A\n![](_page_0_Figure_1.png)\n| a |\n| b |\n\nmore\n![](_page_4_Figure_2.jpg)\n| open", 2: "", 3: "| x |\n"}
    docs = spark.createDataFrame([(d, t, 3) for d, t in texts.items()], "doc_id long, text string, n_pages int")
    rows = [(d, i, line) for d, t in texts.items() for i, line in enumerate(t.split("\n"), 1)]
    size = spark.createDataFrame([(d, t.count("\n") + 1, 3) for d, t in texts.items()], "doc_id long, n_ int, n_pages int")
    found = markdown.line_elements(spark.createDataFrame(rows, "doc_id long, line_num int, line string"), size)
    told = {(1, "figure", 2, 1, 1, None, None), (1, "figure", 7, 5, 2, None, None), (1, "table", 3, 2, None, 3, 4), (3, "table", 1, 2, None, 1, 1)}
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in markdown.elements(docs).collect()} == told


def test_trees_leave_no_files_but_their_own(spark):
    """What was written on the way is deleted, and texts stay once with the nodes they were cut for."""
    import glob

    from foliospark import durable
    from foliospark.plans import pipelines

    folder = spark.conf.get("spark.checkpoint.dir")
    had = set(glob.glob(f"{folder}/settled-*"))
    kept = durable.settled_alone(lambda: durable.settled(durable.settled_alone(lambda: durable.settled(spark.range(5)))))
    assert len(set(glob.glob(f"{folder}/settled-*")) - had) == 1 and kept.count() == 5
    had = set(glob.glob(f"{folder}/settled-*"))
    topics = ("garnet lithium ceramic powder", "sintering furnace temperature oxygen")
    body = "\n\n".join(f"{topics[i // 3]} measured again sample." for i in range(6))
    pages = spark.createDataFrame([(1, i, f"# Part {i}\n\n{body}\n\nFigure {i}: A curve\n", 50) for i in (1, 2)], "doc_id long, page_no int, text string, token_count int")
    found = pipelines.build_tree(pages, {"granularity": "keywords"})
    new = set(glob.glob(f"{folder}/settled-*")) - had
    holding = [p for p in new if "text" in spark.read.parquet(p).columns]
    assert len(holding) <= 4 and len(new) <= 9  # sections, two depths of units, elements
    rows = {r.idx: r for r in found.collect()}
    words = [r for r in rows.values() if r.node_type == "keyword"]
    assert words and all(r.text == rows[r.parent_idx].text and r.title in r.text.lower() for r in words)
    assert all(r.text for r in rows.values())
