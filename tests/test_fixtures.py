"""Small known cases of the operators."""

import pytest
from pyspark.sql import functions as F

from foliospark import config, reasoner
from foliospark.functions import text as X
from foliospark.operators import folds
from foliospark.operators import granular as G
from foliospark.operators import pages as P
from foliospark.operators import tree as T
from foliospark.sources import readers


def nodes(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, idx int, parent_idx int, title string, start_index int, end_index int")


def test_hierarchical_ids(spark):
    found = T.sibling_ids(nodes(spark, [(1, None, "a", 1, 2), (2, 1, "b", 1, 1), (3, 1, "c", 2, 2), (4, 3, "d", 2, 2), (5, None, "e", 3, 3)]), 4)
    assert [r.path_id for r in found.orderBy("idx").collect()] == ["0001", "0001.0001", "0001.0002", "0001.0002.0001", "0002"]


def chain(spark, n):
    """One document whose nodes stand one below the other."""
    return spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("idx"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent_idx"), (F.col("id") + 1).cast("int").alias("level"), F.col("id").cast("string").alias("title"), F.lit(1).alias("start_index"), F.col("id").cast("int").alias("end_index"))


def test_deep_trees(spark):
    deep = chain(spark, 100)
    assert all(r.parent_idx == (r.idx - 1 if r.idx else None) for r in T.with_level_parent(deep.drop("parent_idx").where("idx < 40")).collect())
    paths = {r.idx: r.path_id for r in T.sibling_ids(deep).collect()}
    assert paths == {i: ".".join(["1"] * (i + 1)) for i in range(100)}
    assert T.cycles(deep).count() == 0
    looped = deep.withColumn("parent_idx", F.when(F.col("idx") == 50, F.lit(60)).otherwise(F.col("parent_idx")))
    assert T.cycles(looped).count() == 50
    with pytest.raises(ValueError, match="cycle"):
        T.sibling_ids(looped)
    assert T.nested_json(T.depths(T.sibling_ids(deep.where("idx < 20"))), ["title"]).first().structure.count('"title"') == 20
    assert {r.end_index for r in folds.ends_with_children(deep).collect()} == {99}
    assert {(r.lo, r.hi) for r in G.reach(deep.withColumn("end_index", 200 - F.col("idx"))).where("idx = 99").collect()} == {(1, 101)}


def test_levels_with_gaps_and_nulls(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 2, 9), (1, 3, None), (1, 4, 9), (1, 5, 1), (1, 6, 40)], "doc_id long, idx int, level int")
    found = {r.idx: (r.parent_idx, r.next_idx) for r in T.with_next(T.with_level_parent(rows)).collect()}
    assert found == {1: (None, 5), 2: (1, 4), 3: (None, None), 4: (1, 5), 5: (None, None), 6: (5, None)}
    assert T.with_next(T.with_level_parent(rows.limit(0))).count() == 0


def test_renumbered(spark):
    rows = spark.createDataFrame([(1, 7, None, 0), (1, 3, 7, 2), (1, 9, 7, 1), (1, 1, 9, 0), (1, 8, None, 1)], "doc_id long, idx int, parent_idx int, ord int")
    assert [(r.idx, r.parent_idx, r.ord) for r in T.renumbered(rows, "ord").orderBy("idx").collect()] == [(0, None, 0), (1, 0, 1), (2, 1, 0), (3, 0, 2), (4, None, 1)]


def test_parent_of_a_page(spark):
    tree = nodes(spark, [(1, None, "Introduction", 1, 3), (2, 1, "Background", 1, 2), (3, 1, "Motivation", 2, 3), (4, None, "Methods", 4, 6)])
    elements = spark.createDataFrame([(1, 1, 2, 2), (1, 2, 5, 5), (1, 3, 1, 3), (1, 4, 20, 20)], "doc_id long, element int, start_index int, end_index int")
    found = {r.element: r.parent_idx for r in G.inserted(elements, tree).collect()}
    assert found == {1: 2, 2: 4, 3: 1, 4: None}


def test_children_by_page(spark):
    tree = nodes(spark, [(1, None, "root", 1, 9), (2, 1, "C", 7, 7), (3, 1, "A", 2, 2), (4, 1, "B", 4, 4)])
    assert [r.title for r in T.sorted_children(tree).where("parent_idx = 1").orderBy("ord").collect()] == ["A", "B", "C"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [([(0, 1), (2, 3)], [(0, 1), (2, 3)]), ([(0, 2), (1, 3)], [(0, 2), (3, 3)]), ([(0, 5)], [(0, 3)]), ([(0, 3), (0, 2)], [(0, 3)]), ([], [])],
)
def test_unit_repair(spark, given, expected):
    rows = [(1, i, a, b, 1, f"t{i}", "s") for i, (a, b) in enumerate(given)]
    units = spark.createDataFrame(rows, "doc_id long, pos int, start_paragraph int, end_paragraph int, end_page int, title string, summary string")
    assert [(r.start_paragraph, r.end_paragraph) for r in G.repaired_units(units, F.lit(4)).orderBy("unit").collect()] == expected


def test_paragraphs(spark):
    rows = spark.createDataFrame([(" a \n\nb\n\n\nc",), ("a\nb\n",), ("",), (None,)], "text string").select(X.paragraphs(F.col("text")).alias("p")).collect()
    assert [r.p for r in rows] == [["a", "b", "c"], ["a", "b"], [], []]


def test_page_range(spark):
    pages = spark.createDataFrame([(1, i, f"page {i}", 2) for i in range(1, 5)], "doc_id long, page_no int, text string, token_count int")
    assert P.range_text(nodes(spark, [(1, None, "a", 2, 3), (2, None, "b", 9, 9)]), pages, "\n\n").orderBy("idx").first().text == "page 2\n\npage 3"


def test_section_types(spark):
    titles = {"1. Introduction": "introduction", "Materials and Methods": "methods", "Experimental Procedure": "methods", "3 Results": "results", "Conclusions": "discussion", "Appendix A": "default"}
    rows = spark.createDataFrame([(t,) for t in titles], "title string").select("title", reasoner.section_type(F.col("title")).alias("kind")).collect()
    assert {r.title: r.kind for r in rows} == titles


def test_config():
    assert config.load({"granularity": "fine", "model": None}).max_depth == 2
    assert config.load({"if_add_node_text": "no"}).if_add_node_text is False
    with pytest.raises(ValueError, match="unknown"):
        config.load({"extract_tables": True})


def test_reasoner_asks_each_prompt_once(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, prompt string")
    found = reasoner.ask(prompts, lambda batch: [p.upper() for p in batch])
    assert {r.id: r.response for r in found.collect()} == {1: "A", 2: "A", 3: "B", 4: None}


def test_saved_structures(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"doc_name": "d", "structure": [{"title": "a", "start_index": 1, "nodes": [{"title": "b"}]}, {"title": "c"}]}')
    found = readers.flattened(readers.structures(spark, str(tmp_path / "x.json"))).orderBy("path").collect()
    assert [(r.title, r.depth, r.start_index) for r in found] == [("a", 0, 1), ("b", 1, None), ("c", 0, None)]


def test_streaming_folder(spark, tmp_path):
    from foliospark.streaming.folders import watch_markdown

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\ntext\n## B\nmore")
    watch_markdown(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.title for r in spark.read.parquet(str(tmp_path / "out")).orderBy("idx").collect()] == ["A", "B"]


def test_cut_without_prior_markers(spark):
    docs = spark.createDataFrame([(1, "x\n<!-- Page 1 -->\na\n<!-- page 1 -->\nb", 2), (2, "p\nq\nr", 2)], "doc_id long, text string, n_pages int")
    found = {(r.doc_id, r.page_no): r.text for r in P.markdown_pages(docs).collect()}
    assert found == {(1, 1): "x", (1, 2): "b", (2, 1): "p", (2, 2): "q\nr"}


def test_build_tree_in_pre_order(spark):
    """Units, figures and keywords stand below their sections, numbered in pre-order."""
    from foliospark.plans import pipelines

    topics = ("garnet lithium ceramic powder", "sintering furnace temperature oxygen", "impedance spectra voltage cycling")
    body = "\n\n".join(f"{topics[i // 6]} measured again {('alpha', 'beta')[i // 3 % 2]} sample {('alpha', 'beta')[i // 3 % 2]}." for i in range(18))
    rows = [(1, i, f"# Part {i}\n\n{body}\n\nFigure {i}: A curve\n\nTable {i}: Values\n", 50) for i in (1, 2, 3)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string, token_count int")
    for granularity in ("coarse", "keywords"):  # the second goes through all depths
        found = pipelines.build_tree(pages, {"granularity": granularity, "if_add_doc_description": True}).orderBy("idx").collect()
        assert [r.idx for r in found] == list(range(len(found))) and [r.node_id for r in found] == [f"{i:04d}" for i in range(len(found))]
        path: list[int] = []  # pre-order: the parent is always on the way to the node before
        for r in found:
            while path and path[-1] != r.parent_idx:
                path.pop()
            assert r.parent_idx == (path[-1] if path else None)
            path.append(r.idx)
        kinds = {r.node_type for r in found}
        assert {"section", "figure", "table"} <= kinds
        assert ("semantic_unit" in kinds) == (granularity != "coarse") and ("keyword" in kinds) == (granularity == "keywords")
        assert {r.doc_description for r in found} == {"Part 1; Part 2; Part 3"}
        by = {r.idx: r for r in found}
        assert all(by[r.parent_idx].start_index <= r.start_index <= by[r.parent_idx].end_index for r in found if r.node_type == "figure")
    assert sum(r.node_type == "semantic_unit" for r in pipelines.build_tree(pages, {"granularity": "fine"}).collect()) > sum(r.node_type == "semantic_unit" for r in pipelines.build_tree(pages, {"granularity": "medium"}).collect())
