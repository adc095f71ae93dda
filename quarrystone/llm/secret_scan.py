"""Secret scans with a trigram inverted index, in DataFrame expressions only.

Each rule's regular expression is reduced to a Boolean query over trigrams: an OR of clauses, each
an AND of trigrams that every match of that alternative holds. Which of the queries' trigrams a text
holds, exploded, are the postings (trigram, text). Intersecting the
postings of each clause gives the candidates, which alone are verified with the full expression.
Rules without mandatory trigrams scan every text. Texts are known by a 64-bit hash in the postings,
so copies share their postings; a hash collision could only add a candidate, never lose one.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut, join_weighed

#: Alternatives and characters of a class beyond which a part of an expression is left open.
SPREAD, CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


# The base rules, in their order, then those that the method adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED

GAP = "\0"  # stands for "anything" in an alternative


def _ways(parsed) -> set[str]:
    """The alternatives of a parsed expression as literal runs with gaps; {GAP} where there are too many."""
    ways = {""}
    for op, arg in parsed:
        if op is rc.LITERAL:
            part = {chr(arg)}
        elif op is rc.IN and len(arg) <= CLASS and all(x[0] is rc.LITERAL for x in arg):
            part = {chr(x[1]) for x in arg}
        elif op is rc.SUBPATTERN:
            part = _ways(arg[3])
        elif op is rc.BRANCH:
            part = set().union(*map(_ways, arg[1]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, body = arg
            once = _ways(body)
            part = {""} | once if (low, high) == (0, 1) else {GAP} if low == 0 else once if (low, high) == (1, 1) else {f"{w}{GAP}" for w in once}
        elif op is rc.AT:
            part = {""}
        else:
            part = {GAP}
        if len(ways) * len(part) > SPREAD:
            part = {GAP}
        ways = {a + b for a, b in product(ways, part)}
    return ways


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """The rule's clauses, smallest needed set; None if some alternative has no mandatory trigram."""
    clauses = set()
    for way in _ways(rp.parse(rule.pattern)):
        way = way.lower() if rule.any_case else way
        grams = frozenset(run[i : i + 3] for run in way.split(GAP) for i in range(len(run) - 2))
        if not grams:
            return None
        clauses.add(grams)
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def postings(docs: DataFrame, grams: dict[str, bool]) -> DataFrame:
    """(gram, key) for the given trigrams (True: in either case) over all texts; ``key`` is the text's hash.

    Each of the few trigrams that the queries need is looked for in the text or its lower-case form, so
    a text of any length brings at most one posting for each. Lower case is that of A-Z, as in the rules.
    """
    low = docs.select("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("low"))
    held = F.array(*(F.when(F.contains("low" if either else "text", F.lit(g)), F.lit(g)) for g, either in sorted(grams.items())))
    return low.select(F.xxhash64("text").alias("key"), F.explode(F.array_compact(held)).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds, rows): the texts that satisfy the Boolean query of each indexed rule, and at least how many rows have them."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r))}
    either = {g: r.any_case for r in sorted(rules, key=lambda r: r.any_case) for c in queries.get(r.kind, ()) for g in c}
    if not either:
        return docs.select(F.xxhash64("text").alias("key"), F.array().cast("array<string>").alias("kinds"), F.lit(0).cast("long").alias("rows")).limit(0)
    clauses = [(kind, n, sorted(c)) for kind, q in queries.items() for n, c in enumerate(q)]
    entry = lambda kind, n, bit, full: F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("clause"), F.lit(bit).cast("long").alias("bit"), F.lit(full).cast("long").alias("full"))
    uses = {g: F.array(*(entry(kind, n, 1 << c.index(g), (1 << len(c)) - 1) for kind, n, c in clauses if g in c)) for g in either}
    # The queries' side of the join is this constant: gram -> clauses that need it.
    table = F.create_map(*(x for g, u in uses.items() for x in (F.lit(g), u)))
    needed = postings(docs, either).where(F.col("gram").isin(*uses)).select("key", F.inline(F.element_at(table, F.col("gram"))))
    met = needed.groupBy("key", "kind", "clause", "full").agg(F.bit_or("bit").alias("has"), F.count("*").alias("n")).where("has = full")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"), F.max("n").alias("rows"))  # at most one entry per rule


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of the rule's matches, leftmost and not overlapping, in code points."""
    p = F.lit(rule.java)
    found, checked = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(rule.group))
    gaps = F.split(text, rule.java, -1)  # as many as matches, and one
    steps = F.transform(F.arrays_zip(found.alias("m"), checked.alias("c"), F.slice(gaps, 1, F.size(found)).alias("g")), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["c"]).alias("check")))
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    span = lambda a, x: F.struct((a["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (a["at"] + x["gap"] + x["len"]).alias("end"), F.lit(rule.kind).alias("kind"))
    step = lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.when(x["check"] >= rule.least, F.array_append(a["out"], span(a, x))).otherwise(a["out"]).alias("out"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 200_000) -> DataFrame:
    """Adds ``secrets`` to a struct ``row`` of all columns of ``docs``: array<struct<start, rank, end, kind>> by start, then rule.

    Every whole text is covered; null texts count as empty and have none. Offsets count code points,
    ends are exclusive. Repeated rows are scanned each; ids may be null; column names cannot clash,
    for the input's columns stay inside ``row``. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = cut(candidates(rows.select("text"), rules))
    # 24 bytes and up to seven short names a row; a text that many rows share is broadcast in any case.
    marked = join_weighed(rows.withColumn("key", F.xxhash64("text")), chosen, "key", "rows", "left", rows=broadcast_rows)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    text = F.col("text")
    parts = []
    for rank, rule in enumerate(rules):
        likely = F.array_contains("kinds", rule.kind) if trigram_query(rule) else F.lit(True)
        parts.append(F.when(F.coalesce(likely, F.lit(False)) & text.rlike(rule.java), _spans(text, rule, rank)).otherwise(none))
    return marked.select("row", "text", F.array_sort(F.concat(*parts)).alias("secrets"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of the result of ``scan``."""
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("row.doc_id", *(count(r.kind) for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in brackets; overlapping ones by the first's.

    ``n_chars``, if there is such a column, follows the text; all other columns, null texts and texts
    without secrets stay as they are. Repeated rows are redacted each; texts of any length are read
    whole; empty in, empty out.
    """
    text = F.col("text")
    piece = lambda a, s: F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], piece(a, s)).otherwise(a["out"]).alias("out"))
    clean = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = scan(docs, rules).withColumn("clean", F.when(F.size("secrets") > 0, clean).otherwise(F.col("row.text")))
    own = {"text": F.col("clean"), "n_chars": F.when(F.size("secrets") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return new.select(*(own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns))


def oracle() -> str:
    """DuckDB SQL for ``digest(scan(documents))``, without the index."""
    either = lambda p: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in p)
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern
        if r.any_case:
            head, tail = p.split(")", 1)
            p = either(head) + ")" + tail
        q = "'" + p.replace("'", "''") + "'"
        parts.append(f"""
  select rid, {rank} as rank, '{r.kind}' as kind, i, length(g[i]) as gap, length(m[i]) as len, length(c[i]) as chk, {r.least} as least
  from (select rid, m, c, g, unnest(range(1, len(m) + 1)) as i from (
    select rid, regexp_extract_all(t, {q}, 0) as m, regexp_extract_all(t, {q}, {r.group}) as c, regexp_split_to_array(t, {q}) as g from d))""")
    union = "\n  union all".join(parts)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
hits as ({union}
),
placed as (
  select rid, rank, kind, chk, least,
         sum(gap + len) over (partition by rid, rank order by i) - len as s,
         sum(gap + len) over (partition by rid, rank order by i) as e
  from hits),
kept as (select rid, rank, kind, s, kind || ':' || cast(s as bigint) || ':' || cast(e as bigint) as x from placed where chk >= least),
lists as (
  select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
         count(*) filter (where kind = 'hex') as n_hex,
         string_agg(x, ',' order by s, rank) filter (where rank < {len(BASE)}) as base, string_agg(x, ',' order by s, rank) as spans
  from kept group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join lists using (rid)"""
