"""Queries over section trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nodes as N
from ..operators import tree as T
from ..sinks import writers
from .inputs import TREE, of, oracle

#: The parent of a section, told without windows by the last section of a smaller level.
_PARENT = "p as (select t.*, (select max(u.idx) from t u where u.doc_id = t.doc_id and u.idx < t.idx and u.level < t.level) as parent_idx from t)"
_NEXT = "x as (select t.*, (select min(u.idx) from t u where u.doc_id = t.doc_id and u.idx > t.idx and u.level <= t.level) as next_idx from t)"
_RANKED = f"{_PARENT}, r as (select *, row_number() over (partition by doc_id, parent_idx order by idx) as rk from p)"


def _sql(tail: str, more: str = "") -> str:
    return oracle(tail, t=TREE) if not more else oracle(f", {more} {tail}", t=TREE)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return of(spark, d, TREE)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return T.with_level_parent(_tree(spark, d))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    code = "case when level = 2 and num % 4 = 0 then null when level = 1 then cast(doc_id as string) when level = 2 then concat(cast(doc_id as string), '.', cast(num as string)) else concat(cast(doc_id as string), '.', cast(num % 50 as string), '.', cast(num as string)) end"
    return _tree(spark, d).withColumn("structure", F.expr(code))


_CODES = "c as (select *, case when level = 2 and num % 4 = 0 then null when level = 1 then cast(doc_id as string) when level = 2 then concat(cast(doc_id as string), '.', cast(num as string)) else concat(cast(doc_id as string), '.', cast(num % 50 as string), '.', cast(num as string)) end as structure from t)"
_PATHS = f"{_RANKED}, w as (select doc_id, idx, parent_idx, cast(rk as varchar) as dotted, lpad(cast(rk as varchar), 4, '0') as padded, 0 as depth from r where parent_idx is null union all select r.doc_id, r.idx, r.parent_idx, w.dotted || '.' || cast(r.rk as varchar), w.padded || '.' || lpad(cast(r.rk as varchar), 4, '0'), w.depth + 1 from r join w on r.doc_id = w.doc_id and r.parent_idx = w.idx)"
_SUBTREE = f"{_NEXT}, s as (select x.*, (select count(*) from t u where u.doc_id = x.doc_id and u.idx > x.idx and u.idx < coalesce(x.next_idx, 2147483647)) as descendants, length(text) + (select coalesce(sum(length(u.text) + 1), 0) from t u where u.doc_id = x.doc_id and u.idx > x.idx and u.idx < coalesce(x.next_idx, 2147483647)) as subtree_chars from x)"
_FULL = 120


def _full(spark: SparkSession, d: str) -> DataFrame:
    return T.depths(T.sibling_ids(_parents(spark, d)))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return T.with_subtree(_tree(spark, d), F.length("text"))


def _json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nested trees: the order of titles that the JSON holds, and the whole of it."""
    trees = T.nested_json(_full(spark, d), ["title", "start_index", "end_index"], 2)
    titles = F.regexp_extract_all("structure", F.lit('"title":"([^"]*)"'), F.lit(1))
    return trees.select("doc_id", F.size(titles).alias("n"), F.md5(F.array_join(titles, "|")).alias("titles"), F.length("structure").alias("size"), F.md5("structure").alias("structure"))


_OWN_JSON = """'{"title":"' || p.title || '","start_index":' || p.start_index || ',"end_index":' || p.end_index"""


def _nested(level: int, below: str | None) -> str:
    if not below:
        return f"j{level} as (select p.doc_id, p.idx, p.parent_idx, {_OWN_JSON} || '}}' as j from p where level = {level})"
    return f"""j{level} as (select p.doc_id, p.idx, p.parent_idx, {_OWN_JSON} || coalesce(',"nodes":[' || k.js || ']', '') || '}}' as j from p left join (select doc_id, parent_idx, string_agg(j, ',' order by idx) as js from {below} group by all) k on k.doc_id = p.doc_id and k.parent_idx = p.idx where level = {level})"""


_NESTED = f"{_PARENT}, {_nested(3, None)}, {_nested(2, 'j3')}, {_nested(1, 'j2')}"
_ICON = "case t.node_type " + " ".join(f"when '{k}' then '{v}'" for k, v in writers.ICONS.items()) + f" else '{writers.ICONS['section']}' end"


FOUND = {
    "tree_header_parents": (lambda s, d: _parents(s, d).select("doc_id", "idx", "level", "title", "parent_idx"), _sql("select doc_id, idx, level, title, parent_idx from p", _PARENT)),
    "tree_code_parents": (
        lambda s, d: T.with_code_parent(_codes(s, d)).select("doc_id", "idx", "structure", "parent_idx"),
        _sql("select doc_id, idx, structure, (select max(u.idx) from c u where u.doc_id = c.doc_id and u.idx < c.idx and u.structure = regexp_extract(c.structure, '^(.*)\\.[^.]*$', 1)) as parent_idx from c", _CODES),
    ),
    "tree_section_ends": (lambda s, d: T.with_next(_tree(s, d)).select("doc_id", "idx", "next_idx"), _sql("select doc_id, idx, next_idx from x", _NEXT)),
    "tree_subtree_tokens": (
        lambda s, d: _sized(s, d).select("doc_id", "idx", "descendants", F.floor(F.col("subtree_chars") / 4).alias("tokens")),
        _sql("select doc_id, idx, descendants, cast(floor(subtree_chars / 4) as bigint) as tokens from s", _SUBTREE),
    ),
    "tree_thinning": (
        lambda s, d: T.thinned(_sized(s, d), F.floor(F.col("subtree_chars") / 4), 60).select("doc_id", "idx", "title", "absorber"),
        _sql("select doc_id, idx, title, floor(subtree_chars / 4) < 60 as absorber from s where not exists (select 1 from s a where a.doc_id = s.doc_id and a.idx < s.idx and s.idx < coalesce(a.next_idx, 2147483647) and floor(a.subtree_chars / 4) < 60)", _SUBTREE),
    ),
    "tree_absorbed_text": (
        lambda s, d: T.absorbed_text(_sized(s, d).withColumn("absorber", (F.col("level") == 2) & (F.col("num") % 10 == 0)), "text"),
        _sql("select x.doc_id, x.idx, string_agg(u.text, chr(10) || chr(10) order by u.idx) as text from x join t u on u.doc_id = x.doc_id and u.idx >= x.idx and u.idx < coalesce(x.next_idx, 2147483647) where x.level = 2 and x.num % 10 = 0 group by all", _NEXT),
    ),
    "tree_sequential_ids": (lambda s, d: T.sequential_ids(_tree(s, d)).select("doc_id", "idx", "node_id"), _sql("select doc_id, idx, case when length(cast(idx - 1 as varchar)) >= 4 then cast(idx - 1 as varchar) else lpad(cast(idx - 1 as varchar), 4, '0') end as node_id from t")),
    "tree_builder_ids": (lambda s, d: T.sequential_ids(_tree(s, d), 1).select("doc_id", "idx", "node_id"), _sql("select doc_id, idx, case when length(cast(idx as varchar)) >= 4 then cast(idx as varchar) else lpad(cast(idx as varchar), 4, '0') end as node_id from t")),
    "tree_hierarchical_ids": (lambda s, d: T.sibling_ids(_parents(s, d), 4).select("doc_id", "idx", F.col("path_id").alias("node_id")), _sql("select doc_id, idx, padded as node_id from w", _PATHS)),
    "tree_dotted_ids": (lambda s, d: _full(s, d).select("doc_id", "idx", F.col("path_id").alias("node_id"), "depth"), _sql("select doc_id, idx, dotted as node_id, depth from w", _PATHS)),
    "tree_leaves": (lambda s, d: T.leaves(_parents(s, d)).select("doc_id", "idx", "title"), _sql("select doc_id, idx, title from p where not exists (select 1 from p q where q.doc_id = p.doc_id and q.parent_idx = p.idx)", _PARENT)),
    "tree_is_leaf": (
        lambda s, d: _parents(s, d).join(T.leaves(_parents(s, d)).select("doc_id", "idx", F.lit(True).alias("l")), ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("l", F.lit(False)).alias("is_leaf")),
        _sql("select doc_id, idx, idx not in (select q.parent_idx from p q where q.doc_id = p.doc_id and q.parent_idx is not null) as is_leaf from p", _PARENT),
    ),
    "tree_numbered_titles": (
        lambda s, d: T.numbered_titles(_parents(s, d).withColumn("title", F.concat(F.lit("Part "), (F.col("num") % 3).cast("string")))).select("doc_id", "idx", "original_title", "title"),
        _sql("select doc_id, idx, 'Part ' || cast(num % 3 as varchar) as original_title, case when k > 1 then 'Part ' || cast(num % 3 as varchar) || ' (' || cast(k as varchar) || ')' else 'Part ' || cast(num % 3 as varchar) end as title from (select *, row_number() over (partition by doc_id, parent_idx, num % 3 order by idx) as k from p) z", _PARENT),
    ),
    "tree_sorted_children": (
        lambda s, d: T.sorted_children(_parents(s, d)).select("doc_id", "idx", "ord"),
        _sql("select doc_id, idx, case when parent_idx is null then row_number() over (partition by doc_id, parent_idx order by idx) else row_number() over (partition by doc_id, parent_idx order by start_index nulls last, idx) end as ord from p", _PARENT),
    ),
    "tree_type_counts": (
        lambda s, d: T.type_counts(_full(s, d)),
        _sql("select w.doc_id, count(*) as nodes, max(depth) as max_depth, count(*) filter (node_type is null) as n_section, count(*) filter (node_type = 'semantic_unit') as n_semantic_unit, count(*) filter (node_type = 'figure') as n_figure, count(*) filter (node_type = 'table') as n_table, count(*) filter (node_type = 'keyword') as n_keyword from w join t using (doc_id, idx) group by w.doc_id", _PATHS),
    ),
    "tree_depth_histogram": (lambda s, d: T.depth_histogram(_full(s, d)), _sql("select depth, count(*) as nodes from w group by depth", _PATHS)),
    "tree_granularity_rollup": (
        lambda s, d: _full(s, d).rollup("level", "node_type").agg(F.count("*").alias("nodes"), F.grouping_id().alias("gid")),
        _sql("select level, node_type, count(*) as nodes, cast(grouping(level, node_type) as bigint) as gid from t group by rollup (level, node_type)"),
    ),
    "tree_node_count": (lambda s, d: _tree(s, d).agg(F.count("*").alias("nodes"), F.count_if(F.col("node_type").isNotNull()).alias("granular")), _sql("select count(*) as nodes, count(node_type) as granular from t")),
    "tree_validate": (
        lambda s, d: T.issues(_parents(s, d).withColumn("title", F.when(F.col("num") % 13 != 0, F.col("title"))).withColumn("end_index", F.when(F.col("num") % 17 != 0, F.col("end_index")))),
        _sql(
            "select doc_id, idx, issue from (select p.doc_id, p.idx, unnest([case when p.num % 13 = 0 then 'missing title' end, case when p.start_index is null then 'missing start_index' end, case when p.num % 17 = 0 then 'missing end_index' end, case when p.start_index > case when p.num % 17 <> 0 then p.end_index end then 'start after end' end, case when p.start_index < q.start_index or case when p.num % 17 <> 0 then p.end_index end > case when q.num % 17 <> 0 then q.end_index end then 'outside parent' end]) as issue from p left join p q on q.doc_id = p.doc_id and q.idx = p.parent_idx) z where issue is not null",
            _PARENT,
        ),
    ),
    "tree_duplicate_texts": (
        lambda s, d: T.duplicate_texts(_parents(s, d).withColumn("text", F.when(F.col("num") % 6 != 0, F.concat(F.lit("t"), (F.col("parent_idx") % 4 == 0).cast("int") * (F.col("num") % 3))))),
        _sql("select doc_id, parent_idx, count(x) as with_text, count(distinct x) as texts from (select doc_id, parent_idx, case when num % 6 <> 0 then 't' || cast(cast(parent_idx % 4 = 0 as int) * (num % 3) as varchar) end as x from p where parent_idx is not null) z group by all having count(x) > 1 and count(distinct x) = 1", _PARENT),
    ),
    "tree_cycles": (
        lambda s, d: T.cycles(_parents(s, d).select("doc_id", "idx", F.when(F.col("num") % 29 == 0, F.col("idx")).otherwise(F.col("parent_idx")).alias("parent_idx"))),
        _sql("select distinct doc_id, idx from bad", f"{_PARENT}, e as (select doc_id, idx, case when num % 29 = 0 then idx else parent_idx end as up from p), bad as (select doc_id, idx from e where idx = up union select e.doc_id, e.idx from e join bad on e.doc_id = bad.doc_id and e.up = bad.idx)"),
    ),
    "tree_nested_json": (
        _json_rows,
        _sql("select t.doc_id, n, titles, length('[' || j || ']') as size, md5('[' || j || ']') as structure from (select doc_id, count(*) as n, md5(string_agg(title, '|' order by idx)) as titles from t group by doc_id) t join (select doc_id, string_agg(j, ',' order by idx) as j from j1 group by doc_id) q using (doc_id)", _NESTED),
    ),
    "tree_outline": (lambda s, d: writers.outline(_full(s, d)), _sql("select w.doc_id, w.idx, repeat('  ', depth) || title as line from w join t using (doc_id, idx)", _PATHS)),
    "tree_outline_pages": (
        lambda s, d: writers.outline(T.sequential_ids(_full(s, d)), 1),
        _sql("select w.doc_id, w.idx, repeat('  ', depth) || '├─ ' || title || ' (' || lpad(cast(w.idx - 1 as varchar), 4, '0') || ', p.' || cast(start_index as varchar) || ')' as line from w join t using (doc_id, idx) where depth <= 1", _PATHS),
    ),
    "tree_sidebar": (
        lambda s, d: writers.sidebar(T.sequential_ids(_full(s, d))),
        _sql(
            f"select doc_id, idx, '<li data-id=\"' || lpad(cast(idx - 1 as varchar), 4, '0') || '\">' || icon || ' ' || title || case when nd > depth then '<ul>' else '</li>' || repeat('</ul></li>', cast(depth - nd as int)) end as fragment from (select w.doc_id, w.idx, depth, title, {_ICON} as icon, coalesce(lead(depth) over (partition by w.doc_id order by w.idx), 0) as nd from w join t using (doc_id, idx)) z",
            _PATHS,
        ),
    ),
    "nodes_for_search": (
        lambda s, d: N.for_search(T.sequential_ids(_tree(s, d))),
        _sql("select doc_id, idx, lpad(cast(idx - 1 as varchar), 4, '0') as node_id, title, summary, start_index, end_index, coalesce(node_type, 'section') as node_type, nullif(semantic_type, '') as semantic_type from t"),
    ),
    "nodes_of_type": (lambda s, d: N.of_semantic_type(T.sequential_ids(_tree(s, d)), "methods"), _sql("select doc_id, lpad(cast(idx - 1 as varchar), 4, '0') as node_id, title, summary, start_index, end_index from t where semantic_type = 'methods'")),
    "nodes_need_summary": (
        lambda s, d: N.needs_summary(_parents(s, d).withColumn("text", F.when(F.col("num") % 9 != 0, F.expr("repeat(text, cast(num % 20 as int))")))).select("doc_id", "idx", "children", F.round("summarised", 6).alias("summarised"), "needed"),
        _sql(
            "select doc_id, idx, children, round(share, 6) as summarised, case when length(su) > 50 and node_type in ('semantic_unit', 'figure', 'table') then false when body = '' then false when node_type = 'semantic_unit' then su = '' and length(body) > 200 when node_type in ('figure', 'table') then false when children > 0 then su = '' else su = '' and length(body) > 200 end as needed from z",
            f"{_PARENT}, z as (select p.*, case when num % 9 <> 0 then repeat(text, cast(num % 20 as int)) else '' end as body, coalesce(summary, '') as su, (select count(*) from p q where q.doc_id = p.doc_id and q.parent_idx = p.idx) as children, (select coalesce(avg(cast(coalesce(q.summary, '') <> '' as int)), 0) from p q where q.doc_id = p.doc_id and q.parent_idx = p.idx) as share from p)",
        ),
    ),
    "nodes_over_limit": (lambda s, d: N.over_limit(_tree(s, d).withColumn("text", F.expr("repeat(text, cast(num % 40 as int))")), _FULL).select("doc_id", "idx", "tokens"), _sql(f"select doc_id, idx, cast(floor(length(text) * (num % 40) / 4) as int) as tokens from t where floor(length(text) * (num % 40) / 4) > {_FULL}")),
    "nodes_without_fields": (lambda s, d: N.without(_tree(s, d), "text", "summary", "num"), _sql("select doc_id, idx, level, title, start_index, end_index, node_type, semantic_type from t")),
    "nodes_for_description": (
        lambda s, d: N.for_description(T.sequential_ids(_parents(s, d)).withColumn("prefix_summary", F.upper("summary"))),
        _sql("select doc_id, idx, parent_idx, title, lpad(cast(idx - 1 as varchar), 4, '0') as node_id, summary, upper(summary) as prefix_summary from p", _PARENT),
    ),
}
