"""Queries of tree search, context assembly and document choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import tree as T
from ..plans import pipelines
from .inputs import PAGES, of, oracle

#: Questions: all benchmark passages, whole.
QUESTIONS = "select item_id as qid, text as question from {benchmark}"
#: Turns as nodes to search.
NODES = f"select doc_id, page_no as idx, substring(text, 1, 40) as title, text as summary, text, page_no as start_index from ({PAGES}) p"
#: Documents with all their text as description.
DESCRIBED = f"select doc_id, cast(0 as int) as idx, concat('Conversation ', cast(doc_id as string)) as title, string_agg(text, ' ') as summary from ({PAGES}) p group by doc_id"
#: Lists of node ids with repeats, unknown ids and order.
CHOSEN = f"select doc_id as qid, page_no as pos, doc_id, lpad(cast(case when page_no % 4 = 0 then 99 when page_no % 3 = 0 then 0 else page_no - 1 end as string), 4, '0') as node_id from ({PAGES}) p"

_W = "w as (select doc_id, idx, unnest(regexp_extract_all(lower(title), '[a-z0-9]+', 0)) as term, 3.0 as w from n union all select doc_id, idx, unnest(regexp_extract_all(lower(summary), '[a-z0-9]+', 0)), 1.0 from n), f as (select doc_id, idx, term, sum(w) as tf from w group by all), l as (select doc_id, idx, sum(tf) as len from f group by all), g as (select term, count(*) as df from f group by term), q as (select distinct qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+', 0)) as term from a), s as (select qid, f.doc_id, f.idx, round(sum(ln(1 + ((select count(*) from l) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (select avg(len) from l)))), 6) as score from q join g using (term) join f using (term) join l on l.doc_id = f.doc_id and l.idx = f.idx group by all)"
_VEC = "c as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), q as (select vec_id as qid, v as qv from c where vec_id % 50 = 0), s as (select qid, label as doc_id, vec_id as chunk, round(list_dot_product(v, qv) / sqrt(list_dot_product(v, v) * list_dot_product(qv, qv)), 6) as score from c, q), r as (select *, row_number() over (partition by qid order by score desc, chunk) as rank from s)"


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return T.sequential_ids(of(s, d, NODES))


def _questions(s: SparkSession, d: str) -> DataFrame:
    return of(s, d, QUESTIONS)


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id divides by 50, against all rows."""
    rows = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("vector").alias("query"))
    return S.top_chunks(rows.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk"), "vector"), queries)


FOUND = {
    "search_bm25": (lambda s, d: S.bm25(_nodes(s, d), _questions(s, d), 10), oracle(f", {_W}, r as (select *, row_number() over (partition by qid order by score desc, doc_id, idx) as rank from s where score > 0) select * from r where rank <= 10", n=NODES, a=QUESTIONS)),
    "search_bm25_preferences": (
        lambda s, d: S.bm25(_nodes(s, d), _questions(s, d), 5, s.createDataFrame([("th", "on", 2.0), ("en", "^d", 1.5)], "query_pattern string, title_pattern string, boost double")),
        oracle(
            f", {_W}, b as (select s.qid, s.doc_id, s.idx, round(score * coalesce(greatest(case when regexp_matches(lower(question), 'th') and regexp_matches(lower(title), 'on') then 2.0 end, case when regexp_matches(lower(question), 'en') and regexp_matches(lower(title), '^d') then 1.5 end), 1.0), 6) as score from s join a on a.qid = s.qid join n on n.doc_id = s.doc_id and n.idx = s.idx), r as (select *, row_number() over (partition by qid order by score desc, doc_id, idx) as rank from b where score > 0) select * from r where rank <= 5",
            n=NODES, a=QUESTIONS,
        ),
    ),
    "search_context": (
        lambda s, d: S.context(of(s, d, CHOSEN), _nodes(s, d)),
        oracle("select h.qid, string_agg('[' || n.title || ' (p.' || cast(n.start_index as varchar) || ')]' || chr(10) || n.text, chr(10) || chr(10) order by h.pos) as context from h join n on n.doc_id = h.doc_id and h.node_id = lpad(cast(n.idx - 1 as varchar), 4, '0') where n.text <> '' group by h.qid", h=CHOSEN, n=NODES),
    ),
    "search_retrieved": (
        lambda s, d: of(s, d, CHOSEN).join(_nodes(s, d).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select("qid", "pos", "node_id"),
        oracle("select qid, pos, node_id from h where exists (select 1 from n where n.doc_id = h.doc_id and lpad(cast(n.idx - 1 as varchar), 4, '0') = h.node_id)", h=CHOSEN, n=NODES),
    ),
    "search_answers": (
        lambda s, d: pipelines.answer(_nodes(s, d), _questions(s, d)).select("qid", "question", "answer", "thinking", F.size("node_list").alias("n_nodes"), "context"),
        oracle(
            f", {_W}, r as (select *, row_number() over (partition by qid order by score desc, doc_id, idx) as rank from s where score > 0), k as (select * from r where rank <= 5), c as (select qid, string_agg('[' || n.title || ' (p.' || cast(n.start_index as varchar) || ')]' || chr(10) || n.text, chr(10) || chr(10) order by rank) as context from k join n on n.doc_id = k.doc_id and n.idx = k.idx where n.text <> '' group by qid), "
            "t as (select qid, string_agg('node ' || cast(idx as varchar) || ' of ' || cast(doc_id as varchar) || ': ' || printf('%.6f', score), chr(10) order by rank) as thinking, count(*) as n_nodes from k group by qid), "
            "u as (select qid, generate_subscripts(x, 1) as pos, unnest(x) as sentence from (select qid, regexp_extract_all(context, '[^.!?]+[.!?]*', 0) as x from c) z), h as (select u.*, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+', 0)), list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+', 0)))) as hits from u join a using (qid)), "
            "b as (select qid, trim(string_agg(sentence, '' order by pos)) as answer from (select *, row_number() over (partition by qid order by hits desc, pos) as k from h) z where k <= 2 group by qid) "
            "select a.qid, question, answer, thinking, n_nodes, context from a left join t using (qid) left join c using (qid) left join b using (qid)",
            n=NODES, a=QUESTIONS,
        ),
    ),
    "search_documents": (
        lambda s, d: S.bm25(of(s, d, DESCRIBED), _questions(s, d), 3),
        oracle(f", {_W}, r as (select *, row_number() over (partition by qid order by score desc, doc_id, idx) as rank from s where score > 0) select * from r where rank <= 3", n=DESCRIBED, a=QUESTIONS),
    ),
    "search_metadata": (lambda s, d: s.sql("select doc_id, lang, quality from {documents} join {labels} using (doc_id) where toxic = 0 and lang = 'en'", documents=s.read.parquet(f"{d}/documents.parquet"), labels=s.read.parquet(f"{d}/labels.parquet")), "select doc_id, lang, quality from documents join labels using (doc_id) where toxic = 0 and lang = 'en'"),
    "vector_topk": (_chunks, f"with {_VEC} select qid, doc_id, chunk, score, rank from r where rank <= 10"),
    "vector_document_scores": (lambda s, d: S.document_scores(_chunks(s, d)), f"with {_VEC} select qid, doc_id, round(sum(score) / sqrt(count(*) + 1), 6) as doc_score from r where rank <= 10 group by all"),
}
