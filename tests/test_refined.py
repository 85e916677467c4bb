"""Sections divided again, units by cohesion, folds, Markdown trees, hybrids, contents in groups, quarantine, stage logs."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.operators import folds, granular, hybrid, markdown, refine, segments, toc
from foliospark.operators import pages as P
from foliospark.operators import tree as T
from foliospark.plans import answers, pipelines
from foliospark.plans.metrics import StageLog, StreamLog

PAGES = "doc_id long, page_no int, text string, token_count int"
NODES = "doc_id long, idx int, parent_idx int, title string, start_index int, end_index int"


def test_sections_divided_round_by_round(spark):
    text = {1: "# Book\nwords", 5: "tail\n## One", 6: "### Deep in one", 30: "## Two", 33: "### A", 40: "rest\n### B", 41: "# Next\n## Not of the book", 60: "end"}
    pages = spark.createDataFrame([(1, p, text.get(p, "plain"), 100) for p in range(1, 61)] + [(2, p, "no heading", 100) for p in range(1, 41)], PAGES)
    nodes = spark.createDataFrame([(1, 0, None, "Book", 1, 41), (1, 1, None, "Next", 41, 60), (2, 0, None, "Alone", 1, 40)], NODES)
    old, new = refine.divided(nodes, pages, 10, 500)
    assert {(r.doc_id, r.title, r.start_index, r.end_index) for r in old.collect()} == {(1, "Book", 1, 5), (1, "Next", 41, 41), (2, "Alone", 1, 40)}
    rows = {r.idx: r for r in new.collect()}
    titled = {(r.title, r.start_index, r.end_index, r.round, rows[r.parent_idx].title if r.parent_idx in rows else r.parent_idx) for r in rows.values()}
    # Two begins on top of page 30, so One ends before it; both are large and divided once more
    assert titled == {("One", 5, 6, 1, 0), ("Two", 30, 33, 1, 0), ("Deep in one", 6, 29, 2, "One"), ("A", 33, 40, 2, "Two"), ("B", 40, 41, 2, "Two"), ("Not of the book", 41, 60, 1, 1)}
    small, none = refine.divided(nodes, pages, 100, 500)
    assert none.count() == 0 and small.count() == 3
    assert refine.divided(nodes.limit(0), pages, 1, 1)[1].count() == 0


def test_units_follow_the_words(spark):
    first, second = "garnet powder furnace sintering density", "voltage battery cycling capacity anode"
    paras = [first] * 4 + [second] * 5
    rows = spark.createDataFrame([(1, 0, paras), (1, 1, [first] * 6), (1, 2, [first, second]), (2, 0, []), (2, 1, ["-", "1", "?", "!"])], "doc_id long, idx int, p array<string>")
    assert {(r.doc_id, r.idx, r.unit, r.start_paragraph, r.end_paragraph) for r in segments.units(rows).collect()} == {(1, 0, 0, 0, 3), (1, 0, 1, 4, 8)}
    sims = {r.gap: r.sim for r in segments.gaps(rows.where("idx = 0 and doc_id = 1")).collect()}
    assert sims[0] == sims[1] == sims[7] == 1_000_000 and sims[3] == 0 and 0 < sims[2] < 1_000_000


def test_units_as_nodes(spark):
    pages = spark.createDataFrame([(1, 1, "garnet powder density\n\ngarnet powder density materials\n\n", 5), (1, 2, "garnet powder\n\nvoltage capacity analysis cycling\n\nvoltage analysis capacity", 5), (1, 3, "\n\nvoltage cycling capacity", 5)], PAGES)
    nodes = spark.createDataFrame([(1, 7, "Methods", 1, 3)], "doc_id long, idx int, title string, start_index int, end_index int")
    found = segments.unit_nodes(P.range_text(nodes, pages), pages).orderBy("ord").collect()
    assert [(r.parent_idx, r.title, r.semantic_type, r.start_index, r.end_index) for r in found] == [(7, "methods 1", "materials", 1, 1), (7, "methods 2", "analysis", 2, 3)]
    tree = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, None)], "doc_id long, idx int, parent_idx int")
    rows = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (1, 4, "c")], "doc_id long, parent_idx int, title string")
    assert {r.title for r in segments.without_divided_ancestors(rows, tree).collect()} == {"a", "c"}  # 3 stands below 2


def test_summaries_from_children_at_any_depth(spark):
    rows = [(1, 0, None, "root", "Own text. And more.", None)]
    rows += [(1, i, i - 1, f"t{i}", f"Text of level {i} is here. Second. Third.", None) for i in range(1, 7)]
    rows += [(2, 0, None, "wide", "Wide text.", None)] + [(2, i, 0, f"c{i}", "x", f"summary number {i:02d} that is long." if i % 2 else "short") for i in range(1, 31)]
    rows += [(3, 0, None, "few", "A. B. C.", None), (3, 1, 0, "a", "", None), (3, 2, 0, "b", "", "long enough to be counted here")] + [(3, 3, 0, "c", "", None)]
    nodes = spark.createDataFrame(rows, "doc_id long, idx int, parent_idx int, title string, text string, summary string")
    found = {(r.doc_id, r.idx): r for r in folds.summaries(nodes).collect()}
    assert len(found) == len(rows)
    assert found[1, 6].summary == "Text of level 6 is here. Second." and not found[1, 6].from_children
    assert found[1, 5].summary == "t5 covers t6: Text of level 6 is here." and found[1, 0].from_children
    assert found[1, 0].summary.startswith("root covers t1: t1 covers t2: t2 covers t3")
    assert found[2, 0].summary == "wide covers " + "; ".join(f"c{i}: summary number {i:02d} that is long." for i in range(1, 20, 2))
    assert (found[3, 0].summary, found[3, 1].summary) == ("A. B.", "")  # one of three children is too few
    only = folds.summaries(nodes, F.col("idx") > 0)
    assert only.where("idx = 0 and summary = ''").count() == 3
    long = spark.createDataFrame([(1, 0, None, "t", "y" * 4000)], "doc_id long, idx int, parent_idx int, title string, text string")
    assert folds.summaries(long).first().summary == "y" * 3000 + folds.CUT_MARK[:-1]  # no sentence ends before the mark


def test_page_ends_and_converted_tree(spark):
    """A contents list whose first titles share a page: ranges may be empty, a parent ends with its last child."""
    listed = [("Journal", None, 1), ("Paper", 1, 1), ("Info", 2, 1), ("History", 2, 1), ("1. Introduction", 2, 1), ("2. Methods", 2, 2), ("2.1. Cells", 3, 2), ("2.2. Films", 3, 4), ("3. End", 2, None)]
    sections = spark.createDataFrame([(1, i, level, title, page) for i, (title, level, page) in enumerate(listed)], "doc_id long, idx int, level int, title string, page int")
    found = json.loads(markdown.converted(sections).first().structure)
    leaf = lambda title, a, z, i: {"title": title, "start_page": a, "end_page": z, "type": "section", "node_id": i}
    assert found == [
        leaf("Journal", 1, 0, "1"),
        leaf("Paper", 1, 1, "2") | {"children": [leaf("Info", 1, 0, "2.1"), leaf("History", 1, 0, "2.2"), leaf("1. Introduction", 1, 1, "2.3"), leaf("2. Methods", 2, 4, "2.4") | {"children": [leaf("2.1. Cells", 2, 3, "2.4.1"), leaf("2.2. Films", 4, 4, "2.4.2")]}, leaf("3. End", 1, 1, "2.5")]},
    ]


def test_markdown_files_with_sidecars(spark):
    text = "# A\n![](_page_0_Figure_1.jpeg)\nalpha text. more of it.\n## B\n| h |\n|---|\n| 1 |\n\nbeta\n# C\n![](_page_1_Figure_2.png)"
    docs = spark.createDataFrame([(1, text), (2, "# Only\n```\n# no\n```\n## Sub\nbody"), (3, None)], "doc_id long, text string")
    meta = spark.createDataFrame([(1, [("A", 1, 0), ("B", 2, 0), ("C", 1, 1)], ["p", "p"])], "doc_id long, table_of_contents array<struct<title:string,heading_level:int,page_id:int>>, page_stats array<string>")
    found = pipelines.markdown_page_tree(docs, meta).orderBy("doc_id", "idx").collect()
    told = [(r.doc_id, r.idx, r.parent_idx, r.node_type, r.title, r.start_index, r.end_index, r.copy) for r in found]
    assert told == [
        (1, 0, None, "section", "A", 1, 1, None), (1, 1, 0, "figure", "Figure 1: [Extracted from markdown]", 1, 1, 1), (1, 2, 0, "table", "Table: Lines 5-7", 1, 1, 1), (1, 3, 0, "section", "B", 1, 1, None),
        (1, 4, 3, "figure", "Figure 1: [Extracted from markdown]", 1, 1, 2), (1, 5, 3, "table", "Table: Lines 5-7", 1, 1, 2), (1, 6, None, "section", "C", 2, 2, None), (1, 7, 6, "figure", "Figure 2: [Extracted from markdown]", 2, 2, 1),
        (2, 0, None, "section", "Only", 1, 1, None), (2, 1, 0, "section", "Sub", 1, 1, None),
    ]
    assert json.loads(found[2].metadata)["table_number"] == "Table 2" and found[3].summary
    lines = P.lines(docs)
    ranges = {(r.doc_id, r.title): (r.line_start, r.line_end, r.text) for r in markdown.range_lines(markdown.line_ranges(lines), lines).collect()}
    assert ranges[1, "A"][:2] == (1, 9) and ranges[1, "A"][2] == "\n".join(text.split("\n")[:9]) and ranges[1, "B"][2] == "\n".join(text.split("\n")[3:9])
    assert ranges[2, "no"][:2] == (3, 6)  # no fences here: the plain header rule


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abcdef", k=rng.randint(0, 14)) for _ in range(2))
        pairs = hybrid.common_order(a, b)
        assert len(pairs) == longest_common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_hybrid_keeps_all_nodes(spark):
    paged = spark.createDataFrame([(1, 0, None, "1. Intro", 1, 2, "p0"), (1, 1, None, "Methods", 2, 4, "p1"), (1, 2, 1, "Cells", 3, 3, "p2"), (1, 3, None, "Notes", 5, 5, "p3"), (2, 0, None, "Alone", 1, 1, "q")], NODES + ", text string")
    marked = spark.createDataFrame([(1, 0, None, "**Intro**", "m0"), (1, 1, None, "Methods", ""), (1, 2, 1, "Films", "m2"), (1, 3, 2, "Under films", "m3"), (1, 4, 1, "Cells", "m4"), (3, 0, None, "Other", "m")], "doc_id long, idx int, parent_idx int, title string, text string")
    rows = hybrid.merged(paged, marked)
    assert {(r.doc_id, r.idx, r.markdown_idx, r.parent_idx, r.after_idx, r.source, r.text) for r in rows.collect()} == {
        (1, 0, 0, None, None, "both", "m0"), (1, 1, 1, None, None, "both", "p1"), (1, 2, 4, 1, None, "both", "m4"), (1, 3, None, None, None, "pages", "p3"), (2, 0, None, None, None, "pages", "q"),
        (1, None, 2, 1, 1, "markdown", "m2"), (1, None, 3, 1, 1, "markdown", "m3"), (3, None, 0, None, None, "markdown", "m"),
    }
    assert {tuple(r) for r in hybrid.provenance(rows).collect()} == {(1, 3, 1, 2), (2, 0, 1, 0), (3, 0, 0, 1)}


def test_contents_go_on_over_groups(spark):
    text = {1: "# A", 2: "## A1\n### A1x", 3: "## A2", 4: "# B\n### B..", 5: "### Bz\n## B1"}
    pages = spark.createDataFrame([(1, p, t, 10) for p, t in text.items()] + [(2, 1, "1.2 Own code\nx\n3 Other", 10)], PAGES)
    groups = spark.createDataFrame([(1, g, p) for g, ps in enumerate([(1, 2), (2, 3), (3, 4), (4, 5)]) for p in ps] + [(2, 0, 1)], "doc_id long, grp int, page_no int")
    found = toc.continued(refine.headings(pages), groups).orderBy("doc_id", "list_index").collect()
    assert [(r.grp, r.structure, r.title) for r in found if r.doc_id == 1] == [(0, "1", "A"), (0, "1.1", "A1"), (0, "1.1.1", "A1x"), (1, "1.2", "A2"), (2, "2", "B"), (2, "2.1", "B.."), (3, "2.2", "Bz"), (3, "2.1", "B1")]
    assert [r.structure for r in found if r.doc_id == 2] == ["1.2", "3"]
    whole = toc.continued(refine.headings(pages)).drop("grp")
    assert whole.exceptAll(toc.continued(refine.headings(pages), groups).drop("grp")).count() == 0


def test_titles_found_in_their_order(spark):
    pages = spark.createDataFrame([(1, 1, "Summary of all", 1), (1, 2, "Start. Summary", 1), (1, 3, "middle", 1), (1, 4, "Summary", 1)], PAGES)
    items = spark.createDataFrame([(1, 0, "Start"), (1, 1, "SUM MARY"), (1, 2, "absent"), (1, 3, "middle"), (1, 4, "Summary"), (1, 5, None)], "doc_id long, list_index int, title string")
    assert [r.physical_index for r in toc.filled_in_order(items, pages).orderBy("list_index").collect()] == [2, 2, None, 3, 4, None]


def test_a_list_without_right_numbers_is_the_second_mode(spark):
    body = {2: "Alpha begins", 3: "more", 4: "Beta begins", 5: "Gamma begins"}
    pages = spark.createDataFrame([(1, 1, "Contents\nAlpha ........ 90\nBeta ........ 7\nGamma ........ 3", 9)] + [(1, p, t, 9) for p, t in body.items()], PAGES)
    assert {(r.title, r.physical_index) for r in pipelines.contents(pages).collect()} == {("Alpha", 2), ("Beta", 4), ("Gamma", 5)}


def test_large_sections_in_the_page_plan(spark):
    text = {1: "Contents\nAlpha ........ 2\nBeta ........ 40\nGamma ........ 60", 2: "Alpha\nwords", 10: "## Part one", 25: "## Part two", 40: "Beta", 60: "Gamma"}
    pages = spark.createDataFrame([(1, p, text.get(p, f"page {p}"), 1000) for p in range(1, 64)], PAGES)
    options = {"enable_figure_detection": False, "enable_table_detection": False, "if_add_node_summary": False}
    log = StageLog("r")
    found = pipelines.build_tree(pages, options | {"max_page_num_each_node": 10, "max_token_num_each_node": 5000}, log=log).orderBy("idx").collect()
    assert [(r.title, r.parent_idx, r.start_index, r.end_index) for r in found if r.title != "Preface"][:4] == [("Alpha", None, 2, 10), ("Part one", 1, 10, 24), ("Part two", 1, 25, 39), ("Beta", None, 40, 59)]
    assert [(r.stage, r.nodes_before, r.nodes_after, r.difference) for r in log.table(spark).collect()] == [("sections", None, 6, None), ("nodes", 6, 6, 0)]
    assert len(pipelines.build_tree(pages, options | {"max_page_num_each_node": 100}).collect()) == 4


def test_embedded_images_before_captions(spark):
    pages = spark.createDataFrame([(1, 1, "Figure 4: Named\nFigure 5: Other", 1), (2, 1, "Figure 1: One\ntext\nFigure 2: Two\nas Figure 1: again", 1), (3, 1, "none", 1)], PAGES)
    images = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "doc_id long, page_no int, image string")
    asked = []

    def detect(rows):
        asked.append({r.doc_id for r in rows.collect()})
        return granular.captioned_figures(rows)

    found = granular.embedded_or_detected(images, pages, detect)
    assert {(r.doc_id, r.page_no, r.number, r.caption, r.embedded) for r in found.collect()} == {(1, 1, "Figure 4", "Named", True), (1, 2, "Figure 2", "", True), (2, 1, "Figure 1", "One", False), (2, 1, "Figure 2", "Two", False)}
    assert asked == [{2, 3}]


def test_drawn_and_captioned_tables(spark):
    pages = spark.createDataFrame([(1, 1, "Table 1: First\n| a | b |\n|--|--|\n| 1 | 2 |\ntext\n| c |\nTable 1: again", 1), (1, 2, "Table 2. Alone", 1)], PAGES)
    assert [(r.page_no, r.number, r.caption, r.body) for r in granular.page_tables(pages).orderBy("page_no", "pos").collect()] == [(1, "Table 1", "First", "| a | b |\n|--|--|\n| 1 | 2 |"), (1, "Table (Page 1, 2)", "c", "| c |"), (2, "Table 2", "Alone", None)]


def test_answers_with_faults_are_asked_again_and_quarantined(spark):
    def unit(title, **more):
        return {"title": title, "start_paragraph": 0, "end_paragraph": 1, "semantic_type": "x", **more}

    def call(prompts):
        out = []
        for p in prompts:
            tried = p.count("did not hold")
            if p.startswith("good"):
                out.append("```json\n" + json.dumps({"semantic_units": [unit("a"), unit("b", summary=None)]}) + "\n```")
            elif p.startswith("second") and tried:
                assert "end_paragraph is missing" in p
                out.append(json.dumps({"semantic_units": [unit("c")]}))
            elif p.startswith("second"):
                out.append(json.dumps({"semantic_units": [unit("lost"), {"title": "d", "start_paragraph": 1, "semantic_type": "y"}]}))
            elif p.startswith("never"):
                out.append(json.dumps({"semantic_units": [unit("e"), unit("f", start_paragraph="three"), 7]}))
            else:
                out.append("I would rather not.")
        return out

    sections = spark.createDataFrame([(1, 0, "good"), (1, 1, "second"), (2, 0, "never"), (2, 1, "prose"), (3, 0, None)], "doc_id long, idx int, prompt string")
    good, held = answers.units(sections, call, attempts=3)
    assert {(r.doc_id, r.idx, r.attempt, r.pos, r.title, r.end_paragraph) for r in good.collect()} == {(1, 0, 1, 0, "a", 1), (1, 0, 1, 1, "b", 1), (1, 1, 2, 0, "c", 1), (2, 0, 3, 0, "e", 1)}
    told = Counter((r.doc_id, r.idx, r.pos, r.reason, r.final) for r in held.collect())
    assert told == Counter({
        (1, 1, 1, "end_paragraph is missing", False): 1, (2, 0, 1, "start_paragraph is no int", False): 2, (2, 0, 1, "start_paragraph is no int", True): 1, (2, 0, 2, "no object", False): 2, (2, 0, 2, "no object", True): 1,
        (2, 1, None, "not JSON", False): 2, (2, 1, None, "not JSON", True): 1, (3, 0, None, "no response", False): 2, (3, 0, None, "no response", True): 1,
    })


def test_stage_logs(spark, tmp_path):
    log = StageLog("run")
    first = log.watch("rows", spark.range(10), total=F.sum("id"))
    first.write.parquet(str(tmp_path / "a"))
    log.watch("half", spark.read.parquet(str(tmp_path / "a")).where("id < 5"), "rows").write.format("noop").mode("overwrite").save()
    log.write(spark, str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).orderBy("step").collect()] == [("run", 0, "rows", None, 10, None, {"total": "45"}), ("run", 1, "half", 10, 5, -5, {})]


def test_stream_logs(spark, tmp_path):
    listener = StreamLog()
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.json(str(tmp_path / "in"))
        rows = spark.readStream.schema("id long").json(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("rows"))
        query = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()
        for _ in range(100):
            if listener.table(spark).count():
                break
            __import__("time").sleep(0.1)
        assert sum(int(r.metrics["rows"]) for r in listener.table(spark).where("name = 'seen'").collect()) == 7
    finally:
        spark.streams.removeListener(listener)
