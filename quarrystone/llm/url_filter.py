"""URL filters: a blocked Bloom filter of listed keys in front of an exact hash join.

A list has rules (host, path, verdict), which cover the host with its subdomains and all paths that
begin with the rule's, and single canonical URLs (host + path), which are blocked. A URL can only be
covered by one of a few keys: each suffix of its host with as many labels as some rule's host, joined
with each prefix of its path that is as long as some rule's path, and its own canonical form (``canonical``,
applied to the list too). The keys pass a blocked Bloom filter (one 256-bit block per key, 8 bits set
in it); what passes meets the list in an exact hash join, so the filter's false positives vanish. The
filter has about 16 bits per listed key and at most MAX_BLOCKS blocks (16 MB) whatever the list's size:
beyond a million keys it passes more, the join is still exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..lineage import BROADCAST_ROWS
from ._common import cut, join_weighed

MAX_BLOCKS = 1 << 19
BITS_PER_KEY, PROBES = 16, 8

#: (host, path, verdict) of the rules that production uses.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The stand-in for a list of single URLs: for each number below LISTED, one page of these hosts and languages.
LISTED, LISTED_LANGS = 160_000, ("en", "fr", "de", "es")
LISTED_HOSTS = tuple(f"{sub}{name}.example.{top}" for name in ("cheap-pills", "adult-x", "free-bets") for sub in ("", "www.", "m.", "blog.") for top in ("com", "net", "org")) + ("blog.tionsh.example.net", "thther.example.org", "blog.tiontion.example.com", "www.ththhe.example.com")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host without a default port or final dot, A-Z lower-cased; path at least ``/``, without dot segments, escapes in capitals."""
    host = F.regexp_replace(F.regexp_replace(F.translate(host, UPPER, LOWER), ":(80|443)?$", ""), r"\.$", "")
    parts = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.array_append(a, x)))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    plain = F.when(F.contains(path, F.lit("/.")), F.array_join(ends, "/")).otherwise(F.array_join(parts, "/"))
    pieces = F.split(plain, "%")
    raised = F.transform(pieces, lambda x, i: F.when((i > 0) & x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substr(x, F.lit(1), F.lit(2))), F.substr(x, F.lit(3)))).otherwise(x))
    return host, F.when(F.contains(plain, F.lit("%")), F.array_join(raised, "%")).otherwise(plain)


def listed_urls(spark: SparkSession) -> DataFrame:
    """(host, path): the stand-in list."""
    i = F.col("id")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by + 1).cast("int"))
    host = pick(LISTED_HOSTS, i % len(LISTED_HOSTS))
    lang = pick(LISTED_LANGS, F.floor(i / len(LISTED_HOSTS)) % len(LISTED_LANGS))
    number = F.floor(i / (len(LISTED_HOSTS) * len(LISTED_LANGS)))
    return spark.range(LISTED).select(host.alias("host"), F.concat(F.lit("/"), lang, F.lit("/"), number.cast("string")).alias("path"))


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """(block, second hash) of a key; the second hash has 8 bits for each probe."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.xxhash64(key, F.lit("bits"))


def bloom_filter(keys: DataFrame, count: int | None = None) -> np.ndarray:
    """The filter of (key) as blocks of four 64-bit words; built where the keys are, only blocks come to the driver."""
    count = keys.count() if count is None else count
    blocks = int(min(MAX_BLOCKS, max(1, -(-count * BITS_PER_KEY // 256))))
    block, bits = _bits(F.col("key"), blocks)
    hit = "if((shiftrightunsigned(b, {0}) & 192) = {1}, shiftleft(1L, cast(shiftrightunsigned(b, {0}) & 63 as int)), 0L)"
    word = lambda w: F.bit_or(F.expr(" | ".join(hit.format(8 * i, 64 * w) for i in range(PROBES)))).alias(f"w{w}")
    rows = keys.select(block.alias("block"), bits.alias("b")).groupBy("block").agg(*(word(w) for w in range(4))).toPandas()
    out = np.zeros((blocks, 4), np.uint64)
    out[rows["block"].to_numpy()] = rows[[f"w{w}" for w in range(4)]].to_numpy(np.int64).view(np.uint64)
    return out


def _passing(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = table.value
        for batch in batches:
            block = batch.column("block").to_numpy()
            bits = batch.column("b").to_numpy().view(np.uint64)
            ok = np.ones(len(block), bool)
            for i in range(PROBES):
                at = (bits >> np.uint64(8 * i)) & np.uint64(255)
                ok &= (blocks[block, (at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(ok))

    return run


def possible_hits(candidates: DataFrame, filter_: np.ndarray) -> DataFrame:
    """The rows of ``candidates`` (url, key, ...) whose key passes the filter."""
    hashed = candidates.select("*", *(c.alias(n) for c, n in zip(_bits(F.col("key"), len(filter_)), ("block", "b"))))
    table = candidates.sparkSession.sparkContext.broadcast(filter_)  # at most MAX_BLOCKS blocks
    return hashed.mapInArrow(_passing(table), hashed.schema).drop("block", "b")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (boolean) of each row of ``pages`` (page_id, url).

    ``rules`` has (host, path, verdict), ``listed`` has (host, path) of canonical URLs. The longest
    rule that covers a URL decides; equally long ones are the same rule, of whose verdicts ``block``
    wins. Without a rule, URLs whose canonical form is that of a listed one are blocked and all others allowed. A null url, or one without
    ``://``, has an empty host and path and is allowed unless a rule or list entry is itself empty;
    null page_ids and repeated rows are returned as they come; nulls in the lists are ignored;
    other columns are left out. Every URL is judged once, however many pages have it.
    """
    entries = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    single_host, single_path = canonical(F.col("host"), F.col("path"))
    singles = listed.where("host is not null and path is not null").select(F.concat(F.lit("="), single_host, single_path).alias("key")).distinct()
    rows = entries.select(F.concat("host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    keyed = cut(rows.unionByName(singles.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))))
    count = keyed.count()
    shapes = entries.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect()  # bounded by what URLs look like
    sizes, lengths = (sorted({r[i] for r in shapes}) for i in (0, 1))
    numbers = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    host, path = host_and_path(F.col("url"))
    # Dealt out again, for the few bytes of distinct URLs would be coalesced into few tasks.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col("url").cast("string").alias("url")).where("url is not null").groupBy("url").agg(F.count("*").alias("n")).repartition(tasks).select("url", "n", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    # One key per shape of rule: few, so the explosion is linear in the URLs.
    suffixes = F.transform(F.filter(numbers(sizes), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter(numbers(lengths), lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = urls.select("url", "n", F.explode(F.concat(keys, F.array(F.concat(F.lit("="), *canonical(F.col("host"), F.col("path")))))).alias("key"))
    possible = possible_hits(asked, bloom_filter(keyed.select("key"), count))
    hits = possible.join(F.broadcast(keyed) if count <= BROADCAST_ROWS else keyed.hint("shuffle_hash"), "key")
    best = cut(hits.groupBy("url", "n").agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best"), F.max(F.col("rule").isNull()).alias("listed")))
    out = join_weighed(pages.select("page_id", F.col("url").cast("string").alias("url")), best, "url", "n", "left")
    own = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(own, "block").otherwise("allow"))
    return out.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), own.alias("listed"))


def production_rules(spark: SparkSession) -> DataFrame:
    """RULES as a table."""
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


def oracle() -> str:
    """DuckDB SQL for ``judge`` with the production lists."""
    fits = " union all ".join(f"select '{h}' as rh, '{p}' as rp, '{v}' as rv" for h, p, v in RULES)
    hosts, langs = (", ".join(f"'{x}'" for x in xs) for xs in (LISTED_HOSTS, LISTED_LANGS))
    nh, nl = len(LISTED_HOSTS), len(LISTED_LANGS)
    return f"""
with r as ({fits}),
l as (select [{hosts}][i % {nh} + 1] as lh, '/' || [{langs}][(i // {nh}) % {nl} + 1] || '/' || cast(i // {nh * nl} as varchar) as lp from range({LISTED}) t(i)),
u as (select row_number() over () as rid, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select rid, page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
p as (select rid, page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
s as (select rid, regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '\\.$', '') as ch, path, string_split(case when path[1] = '/' then path else '/' || path end, '/') as parts from p),
k as (select rid, ch, case when contains(path, '/.') then array_to_string(list_reduce(list_transform(parts, lambda x: [x]), lambda a, x: case when x = ['.'] then a when x = ['..'] then (case when len(a) > 1 then a[1:len(a) - 1] else a end) else list_concat(a, x) end)
        || case when parts[-1] in ('.', '..') then [''] else []::varchar[] end, '/') else array_to_string(parts, '/') end as plain from s),
c as (select rid, ch, array_to_string(list_transform(string_split(plain, '%'), lambda x, i: case when i > 1 and regexp_matches(x, '^[0-9A-Fa-f]{{2}}') then upper(x[1:2]) || substr(x, 3) else x end), '%') as cp from k),
m as (select rid, rh || rp as rule, rv, row_number() over (partition by rid order by length(rh || rp) desc) as k
      from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(rv, case when lh is not null then 'block' else 'allow' end) as verdict, lh is not null as listed
from p join c using (rid) left join m on m.rid = p.rid and m.k = 1 left join l on ch = lh and cp = lp"""
