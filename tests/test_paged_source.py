"""Paged files in batch and as a stream, with a toy parser."""

import os

import pytest
from pyspark.sql import functions as F

from foliospark.sources import paged


@pytest.fixture
def folder(tmp_path, spark):
    # the parser is a module that Python workers can import
    here = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = here + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark.sparkContext.addPyFile(os.path.join(here, "toy_parser.py"))
    for name in ("a", "b"):
        (tmp_path / f"{name}.toy").write_text("\f".join(f"{name} page {i}" for i in range(1, 8)))
    paged.register(spark)
    return tmp_path


def asked(folder, name):
    note = folder / f"{name}.toy.asked"
    return note.read_text().split() if note.exists() else []


def read(spark, folder, **options):
    return spark.read.format("paged").options(path=f"{folder}/*.toy", parser="toy_parser:pages", **options).load()


def test_all_pages(spark, folder):
    found = read(spark, folder)
    assert found.count() == 14
    assert {(r.page_no, r.text, r.token_count) for r in found.where(F.col("doc_id").endswith("/b")).collect()} == {(i, f"b page {i}", 2) for i in range(1, 8)}


def test_only_wanted_pages_and_files_are_parsed(spark, folder):
    rows = read(spark, folder).where((F.col("page_no") >= 3) & (F.col("page_no") <= 5) & (F.col("doc_id") == f"{folder}/a")).collect()
    assert [r.text for r in rows] == ["a page 3", "a page 4", "a page 5"]
    assert set(asked(folder, "a")) == {"3-5"} and asked(folder, "b") == []
    assert read(spark, folder).where("page_no > 9 and page_no < 4").count() == 0


def test_one_file_in_several_tasks(spark, folder):
    found = read(spark, folder, counter="toy_parser:count", pages_per_task="3")
    assert found.count() == 14
    assert set(asked(folder, "a")) == {"1-3", "4-6", "7-7"}
    with pytest.raises(Exception, match="counter"):
        read(spark, folder, pages_per_task="3").count()


def test_stream_takes_each_file_once(spark, folder):
    def run():
        rows = spark.readStream.format("paged").options(path=f"{folder}/*.toy", parser="toy_parser:pages").load()
        rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(once=True).start(f"{folder}/out").awaitTermination()
        return sorted((r.doc_id[-1], r.page_no) for r in spark.read.schema(paged.SCHEMA).parquet(f"{folder}/out").collect())

    assert run() == [(n, i) for n in "ab" for i in range(1, 8)]
    (folder / "c.toy").write_text("one\ftwo")
    assert run() == [(n, i) for n in "ab" for i in range(1, 8)] + [("c", 1), ("c", 2)]
    assert len(asked(folder, "a")) == 1
