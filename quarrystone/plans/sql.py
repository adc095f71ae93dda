"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ..functions.text import STOP_WORDS

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '\\S+')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def content(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: not list_contains({STOPS}, w))"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(cast({a} as double[]), cast({b} as double[]))"


PAPERS = """papers as (
  select doc_id as ix, 'P' || doc_id as paper_id, substr(regexp_extract(text, '^[^\\n.]*'), 1, 80) as title, text as abstract,
         case when doc_id % 11 <> 0 then cast(1990 + doc_id % 35 as integer) end as year,
         case when doc_id % 13 <> 0 then doc_id * 7919 % 5000 end as citation_count, doc_id * 31 % 300 as influential_citation_count,
         case when doc_id % 4 <> 0 then 'https://papers.example.org/' || doc_id || '.pdf' end as pdf_url, source as venue, lang
  from documents)"""
QUESTIONS = f"questions as (select item_id as query_id, array_to_string({tok('text')}, ' ') as query from benchmark)"
HITS = "hits as (select q.query_id, p.*, e.embedding from questions q join papers p on p.venue = 'src' || (q.query_id % 20) left join embeddings e on e.vec_id = p.ix)"
BASE = f"{PAPERS},\n{QUESTIONS},\n{HITS}"

LUCENE = f"""lt as (select query_id, ix, {content("coalesce(title, '') || ': ' || coalesce(abstract, '')")} as t from hits),
ls as (select query_id, count(*) as n, avg(len(t)) as avg_len from lt group by query_id),
lq as (select query_id, w, count(*) as qtf from (select query_id, unnest({content('query')}) as w from questions) group by all),
lp as (select query_id, ix, len(t) as dl, w, count(*) as tf from (select query_id, ix, t, unnest(t) as w from lt) group by all),
lm as (select p.*, qtf from lp p join lq q using (query_id, w)),
ld as (select query_id, w, count(*) as df from lm group by all),
lsc as (select query_id, ix, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_len))) as s
        from lm join ld using (query_id, w) join ls using (query_id) group by all),
lucene as (select query_id, ix, coalesce(s, 0) as score, dense_rank() over (partition by query_id order by round(coalesce(s, 0), 9) desc) as bm25_rank
           from hits left join lsc using (query_id, ix))"""

TFIDF = f"""fd as (select query_id, ix, {content('title')} as t from hits union all
       select query_id, -1, {content('query')} from questions where query_id in (select query_id from hits)),
fn as (select query_id, count(*) as n from fd group by query_id),
ft as (select query_id, ix, w, count(*) as tf from (select query_id, ix, unnest(t) as w from fd) group by all),
ff as (select query_id, w, count(*) as df from ft group by all),
fw as (select query_id, ix, w, tf * (ln((1.0 + n) / (1.0 + df)) + 1) as x from ft join ff using (query_id, w) join fn using (query_id)),
fl as (select query_id, ix, sqrt(sum(x * x)) as l from fw group by all),
fs as (select a.query_id, a.ix, sum(a.x * b.x) as s from fw a join fw b on a.query_id = b.query_id and a.w = b.w and b.ix = -1 where a.ix >= 0 group by all),
fc as (select fs.query_id, fs.ix, s / (a.l * b.l) as c from fs join fl a on a.query_id = fs.query_id and a.ix = fs.ix join fl b on b.query_id = fs.query_id and b.ix = -1),
tfidf as (select query_id, ix, coalesce(c, 0) as score, dense_rank() over (partition by query_id order by round(coalesce(c, 0), 9) desc) as tfidf_rank
          from hits left join fc using (query_id, ix))"""

CENTROID = f"""ct as (select query_id, ix, embedding, row_number() over (partition by query_id order by bm25_rank, ix) as k
       from hits join lucene using (query_id, ix) where embedding is not null and len(embedding) > 0),
cm as (select query_id, list(m order by pos) as mean from (
         select query_id, pos, avg(cast(x as double)) as m from (select query_id, unnest(embedding) as x, unnest(range(len(embedding))) as pos from ct where k <= 5) group by all) group by query_id),
cs as (select query_id, ix, {cosine('embedding', 'mean')} as c from ct join cm using (query_id)),
centroid as (select query_id, ix, c as score, dense_rank() over (partition by query_id order by round(c, 9) desc nulls last) as centroid_rank
             from hits left join cs using (query_id, ix))"""

PRIORS = """priors as (
  select query_id, ix, dense_rank() over (partition by query_id order by round(authority, 9) desc) as authority_rank, authority,
         dense_rank() over (partition by query_id order by round(recency, 9) desc) as recency_rank, recency
  from (select query_id, ix, log10(greatest(cast(influential_citation_count as double), coalesce(citation_count, 0) * 0.3) + 1) as authority,
               coalesce(exp((year - 2025) * 0.1), 0) as recency from hits))"""

SIGNALS = f"{BASE},\n{LUCENE},\n{TFIDF},\n{CENTROID},\n{PRIORS}"

RELEVANCE = """rrf as (
  select query_id, ix, bm25_rank, tfidf_rank, centroid_rank, authority_rank, recency_rank,
         1.0::double / (60 + bm25_rank) + 1.0::double / (60 + tfidf_rank) + 1.0::double / (60 + centroid_rank) as rrf_score
  from lucene join tfidf using (query_id, ix) join centroid using (query_id, ix) join priors using (query_id, ix)),
rel as (select *, dense_rank() over (partition by query_id order by round(rrf_score, 9) desc) as rrf_rank from rrf)"""


def spread(c: str) -> str:
    w = "over (partition by query_id)"
    return f"1 - case when max({c}) {w} = min({c}) {w} then 0.5::double else ({c} - min({c}) {w})::double / (max({c}) {w} - min({c}) {w}) end"


SPREADS = f"spreads as (select *, {spread('rrf_rank')} as relevance_score, {spread('authority_rank')} as authority_score, {spread('recency_rank')} as recency_score from rel)"


def composite(weights: str = "0.60::double as wr, 0.35::double as wa, 0.05::double as wc", k: int = 50) -> str:
    return f"""weighed as (select *, {weights} from spreads),
final as (select *, wr * relevance_score + wa * authority_score + wc * recency_score as final_score from weighed),
top as (select *, row_number() over (partition by query_id order by round(final_score, 9) desc, ix) as final_rank from final)
select query_id, ix, round(final_score, 6) as final_score, final_rank from top where final_rank <= {k}"""


OKAPI = f"""ot as (select doc_id as doc, {tok('text')} as t from documents),
os as (select count(*) as n, avg(len(t)) as avg_len from ot),
op as (select doc, len(t) as dl, w, count(*) as tf from (select doc, t, unnest(t) as w from ot) group by all),
odf as (select w, count(*) as df from op group by w),
oraw as (select w, ln(n - df + 0.5) - ln(df + 0.5) as raw from odf, os),
oidf as (select w, case when raw < 0 then 0.25 * (select avg(raw) from oraw) else raw end as idf from oraw),
oq as (select query_id, w, count(*) as qtf from (select query_id, unnest({tok('query')}) as w from questions) group by all),
osc as (select query_id, doc, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_len))) as s
        from op join oq using (w) join oidf using (w), os group by all),
oall as (select q.query_id, d.doc_id as doc, coalesce(s, 0) as score from questions q cross join documents d left join osc o on o.query_id = q.query_id and o.doc = d.doc_id)"""


def okapi(k: int) -> str:
    return f"""{OKAPI},
okapi as (select * from (select query_id, doc, score, row_number() over (partition by query_id order by round(score, 9) desc, doc) as rank from oall) where rank <= {k})"""


def knn(k: int) -> str:
    """For each query the vector whose id is the query's stands for the query."""
    return f"""kq as (select query_id, embedding as q from questions join embeddings on vec_id = query_id),
ks as (select query_id, vec_id as doc, round({cosine('q', 'embedding')}, 12) as score from kq cross join embeddings),
knn as (select * from (select *, row_number() over (partition by query_id order by score desc, doc) as rank from ks) where rank <= {k})"""
