"""Queries over pages and tables of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import nodes as N
from ..operators import pages as P
from ..operators import toc as C
from .inputs import DOCS, PAGES, TOC, of, oracle

#: Ranges of pages of each conversation, some beyond its end, some empty.
RANGES = f"select doc_id, page_no as idx, cast(page_no - page_no % 2 as int) as start_index, cast(page_no + doc_id % 3 - 1 as int) as end_index from ({PAGES}) p"
#: Contents lists as printed, one a conversation with dot leaders.
PRINTED = f"select doc_id, page_no, case when page_no = 1 and doc_id % 2 = 0 then concat('Contents', chr(10), '1. First part ', repeat('.', 8), ' 3', chr(10), '1.1 Second part ', repeat('. ', 7), '5', chr(10), 'Third one  7') when page_no = 2 and doc_id % 4 = 0 then concat('a ..... 1', chr(10), 'b ...... 2', chr(10), 'c ....... 3') else text end as text, token_count from ({PAGES}) p"
#: Documents with page markers between their lines.
MARKED = "select doc_id, n_pages, concat('intro', chr(10), '<!-- Page 1 -->', chr(10), coalesce(text, ''), chr(10), case when doc_id % 3 = 0 then '<!-- page 2 -->' else '<!--Page 1-->' end, chr(10), 'last ', lang) as text from (select doc_id, lang, text, cast(1 + doc_id % 7 as int) as n_pages from {documents}) d"
#: Strings as models return them.
NOISY = "select event_id, case when event_id % 4 = 0 then concat('```json', chr(10), '{{\"a\": ', cast(user_id as string), ', \"b\": [1, 2, ], }}', chr(10), '```') when event_id % 4 = 1 then concat('{{\"a\": None,  \"b\": [', cast(user_id as string), ']}}') when event_id % 4 = 2 then props else concat('<physical_index_', cast(event_id as string), '>') end as s from {events}"


def _o(tail: str, **inputs: str) -> str:
    return oracle(tail, **{k: v.replace("{{", "{").replace("}}", "}") if k == "j" else v for k, v in inputs.items()})


def _pages(s: SparkSession, d: str) -> DataFrame:
    return of(s, d, PAGES)


def _toc(s: SparkSession, d: str) -> DataFrame:
    return of(s, d, TOC)


def _noisy(s: SparkSession, d: str) -> DataFrame:
    return of(s, d, NOISY)


def _range_sql(text: str, sep: str) -> str:
    return _o(f"select r.doc_id, r.idx, coalesce(string_agg({text}, {sep} order by p.page_no), '') as text from r left join p on p.doc_id = r.doc_id and p.page_no between r.start_index and r.end_index group by r.doc_id, r.idx", r=RANGES, p=PAGES)


_LABEL = "'<physical_index_' || cast(p.page_no as varchar) || '>' || chr(10) || p.text || chr(10) || '<physical_index_' || cast(p.page_no as varchar) || '>' || chr(10)"
_NORM = "regexp_replace(lower({}), '\\s+', '', 'g')"
_APPEARS = f"a as (select c.*, coalesce(contains({_NORM.format('p.text')}, {_NORM.format('c.title')}), false) as hit, coalesce(starts_with({_NORM.format('p.text')}, {_NORM.format('c.title')}), false) as starts from c left join p on p.doc_id = c.doc_id and p.page_no = c.physical_index)"
_FLAT = "regexp_replace(regexp_replace(replace(trim(regexp_replace(case when contains(s, '```json') then regexp_extract(s, '(?s)```json(.*)```', 1) else s end, '^\\s+|\\s+$', '', 'g')), 'None', 'null'), '[\\r\\n]+', ' ', 'g'), '\\s+', ' ', 'g')"

_LISTED = "^\\s*((?:\\d+\\.)*\\d+)?\\.?\\s*(.+?)\\s*(?::|\\s{2,}|\\s)\\s*(\\d+)\\s*$"
_LEADERS = "regexp_replace(regexp_replace(text, '\\.{5,}', ': ', 'g'), '(?:\\. ){5,}\\.?', ': ', 'g')"


_OF_MARKDOWN = r"""
, l as (select doc_id, n_pages as n, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as size from m),
k as (select *, try_cast(nullif(regexp_extract(line, '(?i)^<!--\s*Page\s+(\d+)\s*-->', 1), '') as int) as mark from l),
g as (select a.*, (select max(b.i) from k b where b.doc_id = a.doc_id and b.i <= a.i and b.mark is not null) as since from k a),
s as (select g.doc_id, g.n, coalesce(since, 0) as since, coalesce((select b.mark from k b where b.doc_id = g.doc_id and b.i = g.since), 0) as page, string_agg(line, chr(10) order by i) as text from g where mark is null group by all),
u as (select doc_id, n, page, arg_max(text, since) as text from s group by all),
f as (select doc_id, n from u group by all having max(page) > 0 and count(*) >= 0.5 * n),
a as (select f.doc_id, z.page, coalesce(u.text, '') as text from (select doc_id, n, unnest(generate_series(0, n - 1)) as page from f) z join f using (doc_id) left join u on u.doc_id = z.doc_id and u.page = z.page),
e as (select doc_id, case when size // n = 0 then n - 1 else least((i - 1) // nullif(size // n, 0), n - 1) end as page, string_agg(line, chr(10) order by i) as text from l where doc_id not in (select doc_id from f) group by all)
select doc_id, count(*) as pages, cast(sum(floor(length(text) / 4)) as bigint) as tokens from (select doc_id, page, text from a union all select doc_id, page, text from e) q group by doc_id
"""
_REPAIRED = f"""
, {_APPEARS}, n as (select doc_id, count(*) as n from p group by doc_id),
b as (select a.doc_id, a.list_index, a.title, coalesce((select arg_max(g.physical_index, g.list_index) from a g where g.doc_id = a.doc_id and g.list_index < a.list_index and g.hit), 0) as low,
  coalesce((select arg_min(g.physical_index, g.list_index) from a g where g.doc_id = a.doc_id and g.list_index > a.list_index and g.hit), n.n) as high from a join n using (doc_id) where not hit),
w as (select b.doc_id, b.list_index, min(p.page_no) as found from b join p on p.doc_id = b.doc_id and b.low <= b.high and p.page_no between greatest(b.low, 1) and greatest(b.high, 1) and contains({_NORM.format('p.text')}, {_NORM.format('b.title')}) group by all),
r as (select a.doc_id, a.list_index, a.title, case when a.hit then a.physical_index else coalesce(w.found, a.physical_index) end as physical_index from a left join w using (doc_id, list_index)),
v as (select r.*, coalesce(contains({_NORM.format('p.text')}, {_NORM.format('r.title')}), false) as hit from r left join p on p.doc_id = r.doc_id and p.page_no = r.physical_index where r.physical_index is not null),
x as (select doc_id, count(*) as checked, avg(cast(hit as int)) as share, arg_max(physical_index, list_index) as last from v group by doc_id)
select n.doc_id, coalesce(checked, 0) as checked, case when last is null or last < n.n / 2 then 0.0 else round(share, 6) end as accuracy from n left join x using (doc_id)
"""


def _ranges(name: str, **kw):
    return lambda s, d: P.range_text(of(s, d, RANGES), _pages(s, d), **kw).select("doc_id", "idx", "text")


FOUND = {
    "pages_range_text": (_ranges("t"), _range_sql("p.text", "''")),
    "pages_blank_line_text": (_ranges("t", sep="\n\n"), _range_sql("p.text", "chr(10) || chr(10)")),
    "pages_labelled_text": (_ranges("t", label=True), _range_sql(_LABEL, "''")),
    "pages_document_text": (lambda s, d: P.document_text(_pages(s, d)), _o("select doc_id, string_agg(text, '' order by page_no) as text, count(*) as page_count from p group by doc_id", p=PAGES)),
    "pages_tagged": (lambda s, d: P.tagged(_pages(s, d)).select("doc_id", "page_no", "text"), _o(f"select doc_id, page_no, {_LABEL.replace('p.', '')} || chr(10) as text from p", p=PAGES)),
    "pages_grouped": (
        lambda s, d: P.grouped(_pages(s, d), 300, 1),
        _o(
            ", f as (select doc_id, list(struct_pack(page := page_no, n := token_count) order by page_no) as p, sum(token_count) as total from p group by doc_id), g as (select *, case when total <= 300 then total else ceil((total / ceil(total / 300) + 300) / 2) end as target from f), "
            "w as (select doc_id, p, target, 1 as i, cast(0 as bigint) as held, 0 as grp, [[0, 0]] as out from g union all "
            "select doc_id, p, target, i + 1, case when held + p[i].n > target then coalesce(p[i - 1].n, 0) + p[i].n else held + p[i].n end, case when held + p[i].n > target then grp + 1 else grp end, "
            "case when held + p[i].n > target then case when i > 1 then out || [[grp + 1, i - 1], [grp + 1, i]] else out || [[grp + 1, i]] end else out || [[grp, i]] end from w where i <= len(p)), "
            "e as (select doc_id, p, unnest(out[2:]) as x from w where i = len(p) + 1) select doc_id, x[1] as grp, p[x[2]].page as page_no from e",
            p=PAGES,
        ),
    ),
    "pages_split_even": (
        lambda s, d: P.split_evenly(of(s, d, DOCS)),
        _o(
            ", l as (select doc_id, n_pages, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i, len(string_split(coalesce(text, ''), chr(10))) as n from d) select doc_id, cast(1 + case when n // n_pages = 0 then n_pages - 1 else least((i - 1) // (n // n_pages), n_pages - 1) end as int) as page_no, string_agg(line, chr(10) order by i) as text from l group by 1, 2",
            d=DOCS,
        ),
    ),
    "pages_split_markers": (
        lambda s, d: P.split_at_markers(of(s, d, MARKED)),
        _o(
            "select doc_id, 0 as page, 'intro' as text from m union all select doc_id, 1, case when doc_id % 3 = 0 then regexp_extract(text, '(?s)<!-- Page 1 -->\n(.*)\n<!--', 1) else regexp_extract(text, '(last \\w+)$', 1) end from m union all select doc_id, 2, regexp_extract(text, '(last \\w+)$', 1) from m where doc_id % 3 = 0",
            m=MARKED,
        ),
    ),
    "pages_of_markdown": (lambda s, d: P.markdown_pages(of(s, d, MARKED)).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("token_count").alias("tokens")), _o(_OF_MARKDOWN, m=MARKED)),
    "pages_of_nodes": (
        lambda s, d: P.pages_of_nodes(of(s, d, RANGES).withColumnRenamed("idx", "pos")),
        _o("select doc_id, g as page_no, min(idx) as pos from (select doc_id, idx, unnest(generate_series(start_index, end_index)) as g from r where start_index <= end_index) z group by all", r=RANGES),
    ),
    "pages_token_sum": (lambda s, d: _pages(s, d).groupBy("doc_id").agg(F.sum("token_count").alias("tokens"), F.count("*").alias("pages")), _o("select doc_id, sum(token_count) as tokens, count(*) as pages from p group by doc_id", p=PAGES)),
    "nodes_large": (
        lambda s, d: N.large(of(s, d, RANGES), _pages(s, d), 0, 60).select("doc_id", "idx", "tokens"),
        _o("select r.doc_id, r.idx, sum(p.token_count) as tokens from r join p on p.doc_id = r.doc_id and p.page_no between r.start_index and r.end_index where r.end_index - r.start_index > 0 and exists (select 1 from p q where q.doc_id = r.doc_id and q.page_no = r.end_index) group by all having sum(p.token_count) >= 60", r=RANGES, p=PAGES),
    ),
    "toc_section_bounds": (
        lambda s, d: C.section_bounds(_toc(s, d), _pages(s, d)).select("doc_id", "list_index", "start_index", "end_index"),
        _o(
            "select doc_id, list_index, physical_index as start_index, case when lead(list_index) over w is null then (select max(page_no) from p where p.doc_id = c.doc_id) else lead(physical_index) over w - cast(coalesce(lead(appear_start) over w, false) as int) end as end_index from c window w as (partition by doc_id order by list_index)",
            c=TOC, p=PAGES,
        ),
    ),
    "toc_preface": (
        lambda s, d: C.with_preface(_toc(s, d).select("doc_id", "list_index", "structure", "title", "physical_index")),
        _o("select doc_id, list_index, structure, title, physical_index from c union all select doc_id, min(list_index) - 1, '0', 'Preface', 1 from c group by doc_id having arg_min(physical_index, list_index) > 1", c=TOC),
    ),
    "toc_truncated": (
        lambda s, d: N.truncated_indices(_toc(s, d), _pages(s, d)).select("doc_id", "list_index", "physical_index", "truncated"),
        _o("select doc_id, list_index, case when physical_index > n then null else physical_index end as physical_index, coalesce(physical_index > n, false) as truncated from c join (select doc_id, count(*) as n from p group by doc_id) q using (doc_id)", c=TOC, p=PAGES),
    ),
    "toc_present": (lambda s, d: _toc(s, d).where("physical_index is not null").select("doc_id", "list_index", "physical_index"), _o("select doc_id, list_index, physical_index from c where physical_index is not null", c=TOC)),
    "toc_matching_pairs": (
        lambda s, d: C.matching_pairs(_toc(s, d).drop("physical_index"), _toc(s, d).select("doc_id", "title", "physical_index"), 2),
        _o("select c.doc_id, c.list_index as pos, c.title, c.page, e.physical_index from c join c e on e.doc_id = c.doc_id and e.title is not distinct from c.title and e.physical_index >= 2", c=TOC),
    ),
    "toc_page_offset": (
        lambda s, d: C.page_offset(_toc(s, d).withColumn("pos", F.col("list_index"))),
        _o("select doc_id, o as \"offset\" from (select doc_id, o, row_number() over (partition by doc_id order by n desc, first) as k from (select doc_id, physical_index - page as o, count(*) as n, min(list_index) as first from c where physical_index is not null group by all) z) y where k = 1", c=TOC),
    ),
    "toc_apply_offset": (
        lambda s, d: C.apply_offset(_toc(s, d), C.page_offset(_toc(s, d).withColumn("pos", F.col("list_index")))).select("doc_id", "list_index", "physical_index"),
        _o("select c.doc_id, c.list_index, c.page + y.o as physical_index from c left join (select doc_id, o, row_number() over (partition by doc_id order by n desc, first) as k from (select doc_id, physical_index - page as o, count(*) as n, min(list_index) as first from c where physical_index is not null group by all) z) y on y.doc_id = c.doc_id and y.k = 1", c=TOC),
    ),
    "toc_appears": (
        lambda s, d: C.appears(_toc(s, d).drop("appear_start"), _pages(s, d)).select("doc_id", "list_index", "found", "appear_start"),
        _o(f", {_APPEARS} select doc_id, list_index, hit as found, starts as appear_start from a", c=TOC, p=PAGES),
    ),
    "toc_accuracy": (
        lambda s, d: C.accuracy(_toc(s, d), _pages(s, d)),
        _o(
            f", {_APPEARS}, n as (select doc_id, count(*) as n from p group by doc_id), v as (select doc_id, count(*) as checked, avg(cast(hit as int)) as share, arg_max(physical_index, list_index) as l from a where physical_index is not null group by doc_id) select n.doc_id, coalesce(checked, 0) as checked, case when l is null or l < n / 2 then 0.0 else round(share, 6) end as accuracy from n left join v using (doc_id)",
            c=TOC, p=PAGES,
        ),
    ),
    "toc_bounds_of_bad": (
        lambda s, d: C.bounds_of_bad(_toc(s, d).withColumn("ok", F.col("list_index") % 3 == 1), _pages(s, d)),
        _o(
            "select doc_id, list_index, coalesce((select arg_max(b.physical_index, b.list_index) from c b where b.doc_id = c.doc_id and b.list_index < c.list_index and b.list_index % 3 = 1 and b.physical_index is not null), 0) as low, coalesce((select arg_min(b.physical_index, b.list_index) from c b where b.doc_id = c.doc_id and b.list_index > c.list_index and b.list_index % 3 = 1 and b.physical_index is not null), (select count(*) from p where p.doc_id = c.doc_id)) as high from c where list_index % 3 <> 1",
            c=TOC, p=PAGES,
        ),
    ),
    "toc_located": (
        lambda s, d: C.located(_toc(s, d).select("doc_id", "list_index", "title", F.lit(1).alias("low"), F.lit(8).alias("high")), _pages(s, d)),
        _o(f"select c.doc_id, c.list_index, min(p.page_no) as physical_index from c left join p on p.doc_id = c.doc_id and p.page_no between 1 and 8 and contains({_NORM.format('p.text')}, {_NORM.format('c.title')}) group by c.doc_id, c.list_index", c=TOC, p=PAGES),
    ),
    "toc_repaired": (lambda s, d: C.accuracy(C.repaired(_toc(s, d).drop("appear_start"), _pages(s, d)), _pages(s, d)), _o(_REPAIRED, c=TOC, p=PAGES)),
    "toc_page_run": (
        lambda s, d: C.toc_run(_pages(s, d).withColumn("yes", F.length("text") % 3 != 0), 3),
        _o("select p.doc_id, p.page_no from p join (select doc_id, min(page_no) as f from p where length(text) % 3 <> 0 and page_no <= 3 group by doc_id) f using (doc_id) where p.page_no >= f and not exists (select 1 from p q where q.doc_id = p.doc_id and q.page_no between f and p.page_no and length(q.text) % 3 = 0)", p=PAGES),
    ),
    "toc_pages": (
        lambda s, d: of(s, d, PRINTED).select("doc_id", "page_no", C.is_toc_page(F.col("text")).alias("yes")),
        _o("select doc_id, page_no, (page_no = 1 and doc_id % 2 = 0) or (page_no = 2 and doc_id % 4 = 0) as yes from p", p=PAGES),
    ),
    "toc_lines": (
        lambda s, d: C.toc_lines(of(s, d, PRINTED)),
        _o(
            f"select doc_id, page_no, k - 1 as line_num, nullif(regexp_extract(line, '{_LISTED}', 1), '') as structure, regexp_replace(regexp_extract(line, '{_LISTED}', 2), '[\\s:]+$', '') as title, try_cast(regexp_extract(line, '{_LISTED}', 3) as int) as page "
            f"from (select doc_id, page_no, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from (select doc_id, page_no, {_LEADERS} as t from p) y) z where regexp_matches(line, '{_LISTED}')",
            p=PRINTED,
        ),
    ),
    "text_dot_leaders": (lambda s, d: of(s, d, PRINTED).select("doc_id", "page_no", X.dot_leaders(F.col("text")).alias("text")), _o("select doc_id, page_no, regexp_replace(regexp_replace(text, '\\.{{5,}}', ': ', 'g'), '(?:\\. ){{5,}}\\.?', ': ', 'g') as text from p".replace("{{", "{").replace("}}", "}"), p=PRINTED)),
    "text_physical_index": (lambda s, d: _noisy(s, d).select("event_id", X.physical_index(F.col("s")).alias("physical_index")), _o("select event_id, case when event_id % 4 = 3 then event_id end as physical_index from events", e="select 1 as one")),
    "text_repaired_json": (
        lambda s, d: _noisy(s, d).select("event_id", X.repaired_json(F.col("s")).alias("json")),
        _o(f"select event_id, regexp_replace({_FLAT}, ',\\s*([\\]}}])', '\\1', 'g') as json from j", j=NOISY.replace("{events}", "events")),
    ),
    "text_object_slice": (lambda s, d: _noisy(s, d).select("event_id", X.object_slice(F.col("s")).alias("json")), _o("select event_id, regexp_extract(s, '(?s)\\{.*\\}', 0) as json from j", j=NOISY.replace("{events}", "events"))),
    "text_tokens": (lambda s, d: of(s, d, DOCS).select("doc_id", X.count_tokens(F.col("text")).alias("tokens")), _o("select doc_id, cast(floor(length(coalesce(text, '')) / 4) as int) as tokens from d", d=DOCS)),
    "text_shortened": (lambda s, d: of(s, d, DOCS).select("doc_id", X.shortened(F.col("text"), 40).alias("text")), _o("select doc_id, case when length(text) > 40 then left(text, 40) || '...' else text end as text from d", d=DOCS)),
    "text_collapsed": (lambda s, d: of(s, d, DOCS).select("doc_id", X.collapse(F.col("text")).alias("text")), _o("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from d", d=DOCS)),
    "text_names": (
        lambda s, d: of(s, d, "select page_id, url from {pages}").select("page_id", X.base_name(F.col("url")).alias("base"), X.safe_name(F.col("url")).alias("safe"), X.html_escape(F.col("url")).alias("html"), F.md5("url").alias("key")),
        "select page_id, string_split(url, '/')[-1] as base, replace(url, '/', '-') as safe, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as html, md5(url) as key from pages",
    ),
    "text_tags": (
        lambda s, d: _pages(s, d).select("doc_id", "page_no", F.concat(F.lit("x<start_index_"), F.col("page_no").cast("string"), F.lit(">a<end_index_1>b<start_index_"), (F.col("page_no") + 4).cast("string"), F.lit(">c<end_index_9>")).alias("t")).select("doc_id", "page_no", X.first_tag(F.col("t")).alias("first"), X.last_tag(F.col("t")).alias("last"), X.without_first_section(F.col("t")).alias("rest"), X.first_tag(F.lit("none")).alias("none")),
        _o("select doc_id, page_no, page_no as first, page_no + 4 as last, 'xb<start_index_' || cast(page_no + 4 as varchar) || '>c<end_index_9>' as rest, -1 as none from p", p=PAGES),
    ),
    "text_geometry": (
        lambda s, d: of(s, d, "select event_id, value from {events}").select("event_id", X.vertical_place(F.col("value") % 100, F.col("value") % 100 + 5).alias("place"), X.crop(F.col("value") % 100, F.lit(640)).alias("px"), P.estimated_page(F.col("event_id") % 90, F.lit(90), F.lit(7)).alias("page")),
        "select event_id, case when (value % 100 + value % 100 + 5) / 2 < 33 then 'top' when (value % 100 + value % 100 + 5) / 2 > 67 then 'bottom' else 'middle' end as place, cast(floor(value % 100 * 640 / 100) as int) as px, cast(least(floor(event_id % 90 / (90 / 7)) + 1, 7) as int) as page from events",
    ),
}
