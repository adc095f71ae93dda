import hashlib
import random
import re

import pytest

from quarrystone.llm import secret_scan as S
from tests.comparing import connection, rows_of, rows_of_sql

#: The contract's expressions, written for Python.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_of(text):
    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, pattern, ok) in enumerate(KINDS) for m in pattern.finditer(text or "") if ok(m)]
    return [x for _, _, x in sorted(found)]


def tricky():
    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apikey", ":", "=", " ", '"', "'", "abc", "abcdef", "deadbeef" * 3, "0123456789abcdef", "AKIA", "AKIA" + "Z9" * 8, "é", "😀", "\n", "x=y", "==", "ghp_" + "A1b2" * 9, "xoxb-1234567890-ab", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIi.abc_-"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(800)] + ["secret=token: abcdefgh", "token=" + "a" * 300_000, "pass word = x", None, "", "ſecret=abcdefgh", "toKen=abcdefgh"]


def test_base_spans_equal_python(spark):
    rows = list(enumerate(tricky()))
    got = {r.doc_id: r for r in S.digest(S.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        want = base_of(t)
        own = [s for s in got[i].spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert own == want, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))


def test_no_candidate_is_missed(spark):
    """The index only leaves out texts without a match."""
    rows = list(enumerate(tricky()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as text")
    found = {r.key: set(r.kinds) for r in S.candidates(docs).collect()}
    keys = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(text) as k").collect()}
    for rule in S.RULES:
        if S.trigram_query(rule):
            pattern = re.compile(rule.pattern, (re.I if rule.any_case else 0) | re.A)
            assert all(rule.kind in found.get(keys[i], ()) for i, t in rows if pattern.search(t or ""))


def test_trigram_queries():
    by = {r.kind: S.trigram_query(r) for r in S.RULES}
    assert by["hex"] is None and sum(q is None for q in by.values()) == 1 and frozenset(("ghp", "hp_")) in by["github"]
    assert frozenset(("tok", "oke", "ken")) in by["assign"] and by["access"] == [frozenset(("AKI", "KIA"))]


def test_native_plan(spark, messy):
    plan = S.scan(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sql(spark, sf_dir):
    con = connection(sf_dir)
    assert rows_of(S.digest(S.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))) == rows_of_sql(con, S.oracle())


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token=abcdef123456 end", 9), (2, "clean", 5), (3, None, None), (4, "secret=" + "ab12" * 8 + " x", 1)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in S.redact(docs).collect()}
    assert got[1].text == "é [assign] end" and got[1].n_chars == 14
    assert got[2].text == "clean" and got[3].text is None and got[3].n_chars is None
    assert got[4].text == "[assign] x"


def test_messy_rows(messy, no_docs):
    got = S.digest(S.scan(messy)).collect()
    assert len(got) == messy.count() and all(r.spans == "" for r in got)
    again = S.redact(messy)
    assert again.columns == messy.columns and sorted(map(str, again.collect())) == sorted(map(str, messy.collect()))
    assert S.digest(S.scan(no_docs)).count() == 0 and S.redact(no_docs).count() == 0


@pytest.mark.parametrize("rule,text,spans", [(S.Rule("k", "ab+c"), "abbc abc", ["k:0:4", "k:5:8"]), (S.Rule("q", "[xyz]{3}"), "xyzxyz", ["q:0:3", "q:3:6"])])
def test_own_rules(spark, rule, text, spans):
    row = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), (rule,)).first()
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in row.secrets] == spans
