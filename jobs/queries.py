"""The jobs as queries: each runs twice into one new folder and gives what stands there then, with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.lineage import shared_dir
from quarrystone.plans import catalog, sql as S

from . import evidence_packs, ingest_passages
from .common import config_of


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for every question, after two runs into the same folder."""
    output, settings = _folder(spark, "evidence"), config_of(evidence_packs.__file__)
    for _ in range(2):
        evidence_packs.run(spark, sf_dir, output, settings)
    return evidence_packs.read(spark, output)


def job2_ingest_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage store, after two runs over all documents with the same checkpoint; the second finds nothing new."""
    output, settings = _folder(spark, "passages"), config_of(ingest_passages.__file__)
    # As a pattern, for the table may be one file or a folder of files.
    for _ in range(2):
        ingest_passages.run(spark, f"{sf_dir}/documents.parquet*", f"{output}/store", f"{output}/checkpoint", settings)
    return ingest_passages.read(spark, f"{output}/store")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_evidence_packs, job2_ingest_passages)}
ORACLE: dict[str, str] = {
    "job1_evidence_packs": f"""with {S.PAPERS}, {catalog.FUSED}, {catalog.METRICS},
grouped as (select placed.*, source, row_number() over (partition by query_id, source order by rank) as k from placed join documents on doc_id = doc where rank <= 10),
chosen as (select *, row_number() over (partition by query_id order by k > 3, rank) as final_rank from grouped)
select query_id, final_rank, doc, p.venue, title, abstract as text, round(score, 9) as rrf_score, paper_count >= 25 and abstract_coverage >= 0.6 as venue_passed, lang
from chosen join papers p on p.ix = doc left join m on m.venue = p.venue where final_rank <= 6""",
    "job2_ingest_passages": f"""with {S.PAPERS}, keyed as (select paper_id, ix, venue, abstract as text, substr(trim(lower(title)), 1, 50) as k, length(regexp_replace(coalesce(abstract, ''), '\\s', '', 'g')) = 0 as blank from papers),
owners as (select k, min(ix) as owner from keyed where not blank and k <> '' group by k),
judged as (select keyed.*, case when blank then 'empty' when ix > owner then 'repeat_title' when length(text) < 500 then 'too_short' else 'ok' end as status from keyed left join owners using (k)),
w as (select paper_id, regexp_extract_all(text, '\\S+') as t from judged where status = 'ok'),
parts as (select paper_id, t, unnest(range(0, greatest(len(t) - 1 - 50, 0) + 1, 462)) as i from w),
cut_ as (select paper_id, i // 462 as chunk_index, array_to_string(t[i + 1 : i + 512], ' ') as text from parts union all select paper_id, 0, text from judged where status = 'too_short')
select paper_id, venue, status, coalesce(n, 0) as n_passages, chunk_index::integer as chunk_index, cut_.text as text
from judged left join cut_ using (paper_id) left join (select paper_id, count(*) as n from cut_ group by paper_id) using (paper_id)""",
}
