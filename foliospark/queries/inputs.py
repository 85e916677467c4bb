"""Deterministic inputs from the driver's tables, in SQL that Spark and the oracle's engine both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Nations as documents, customers and orders as sections below them, in pre-order.
TREE = """
select doc_id, idx, level, title, num, concat(title, ' text') as text, cast(idx % 97 + 1 as int) as start_index,
  cast(idx % 97 + 1 + num % 5 - case when num % 11 = 0 then 7 else 0 end as int) as end_index,
  case when num % 7 = 1 then 'figure' when num % 7 = 2 then 'table' when num % 7 = 3 then 'semantic_unit' end as node_type,
  case when num % 3 = 0 then concat('summary of ', title, ' with the words that make it longer than fifty characters') when num % 3 = 1 then '' end as summary,
  case when num % 4 = 0 then 'methods' when num % 4 = 1 then '' end as semantic_type
from (
  select doc_id, cast(row_number() over (partition by doc_id order by a, b) as int) as idx, level, title, num from (
    select n_nationkey as doc_id, -1 as a, -1 as b, 1 as level, n_name as title, n_nationkey as num from {nation}
    union all select c_nationkey, c_custkey, -1, 2, c_name, c_custkey from {customer}
    union all select c_nationkey, c_custkey, o_orderkey, 3, concat('Order ', cast(o_orderkey as string)), o_orderkey from {orders} join {customer} on o_custkey = c_custkey
  ) u
) v
"""
#: Markdown lines of these trees: four for each section, some in fences, with tables, images and blank lines.
LINES = f"""
select doc_id, cast(idx * 4 - 3 + k as int) as line_num, case
  when k = 0 then concat(repeat('#', level), ' ', title)
  when k = 1 then case when num % 5 = 0 then '```' else concat('text of ', title) end
  when k = 2 then case when num % 5 = 0 then '# not a header' when num % 3 = 0 then '| a | b |' else concat('![](_page_', cast(num % 9 as string), '_Figure_', cast(num % 4 as string), '.png)') end
  else case when num % 5 = 0 then '```' when num % 2 = 0 then '' else 'more' end end as line
from ({TREE}) t, (select 0 as k union all select 1 union all select 2 union all select 3) ks
"""
#: Conversations as paged documents.
PAGES = "select conv_id as doc_id, cast(turn + 1 as int) as page_no, text, cast(floor(length(text) / 4) as int) as token_count from {conversations}"
#: A contents item for each page, some indices off by one, some beyond the document, some absent.
TOC = f"""
select doc_id, page_no as list_index, case when page_no % 3 = 1 then cast(page_no as string) else concat(cast(page_no - page_no % 3 as string), '.', cast(page_no as string)) end as structure,
  substring(text, 1, 14) as title, page_no + 2 as page,
  cast(case when doc_id % 5 = 0 and page_no % 3 = 2 then null when doc_id % 3 = 0 then page_no + 1 else page_no end as int) as physical_index, page_no % 2 = 0 as appear_start
from ({PAGES}) p
"""
#: Whole documents.
DOCS = "select doc_id, text, cast(1 + doc_id % 7 as int) as n_pages from {documents}"


def of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of an input."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def oracle(sql: str, **inputs: str) -> str:
    """The oracle's text with the inputs as common table expressions."""
    heads = ", ".join(f"{name} as ({re.sub(r'{(\w+)}', r'\1', text)})" for name, text in inputs.items())
    return f"with recursive {heads} {sql}"
