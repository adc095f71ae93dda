import random
import re

import pytest

from quarrystone.llm import url_filter as U
from tests.comparing import connection, rows_of, rows_of_sql


def judged(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut].translate(str.maketrans(U.UPPER, U.LOWER)), rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "block" if canonical(host, path) in {canonical(h, p) for h, p in listed if h is not None} else "allow"


def canonical(host, path):
    host = re.sub(r"\.\Z", "", re.sub(r":(80|443)?\Z", "", host.translate(str.maketrans(U.UPPER, U.LOWER))))
    out = []
    parts = (path if path.startswith("/") else "/" + path).split("/")
    for x in parts:
        if x == "..":
            out = out[:-1] if len(out) > 1 else out
        elif x != ".":
            out.append(x)
    out += [""] if parts[-1] in (".", "..") else []
    return host, re.sub("%[0-9A-Fa-f]{2}", lambda m: m[0].upper(), "/".join(out))


def urls():
    rng = random.Random(1)
    hosts = ["m.example.org:443", "M.example.org.", "notexample.com:80", "notexample.com:8080", "notexample.com:", "a.net", "NET", "x.example.net", "Example.COM", "notexample.com", "m.Example.org", "org", "a..net", ".net", "net.", "É.net", ""]
    paths = ["", "/de/./x", "/a/../de/x", "/..", "/de/x/..", "/%c3%Aa%zz%4", "/", "/en/", "/en", "/de/x", "/fr/y?z=/en/", "#/en/", "?q", "/en/?a#b", "/EN/", "/en//"]
    out = [f"{rng.choice(['http', 'https', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    return out + [None, "", "no scheme/en/", "http://", "a://b://c.net/d", "http://h.net\n/x", "http://" + "a." * 20_000 + "net/" + "p" * 50_000]


def test_equals_python(spark):
    listed = [("m.example.org", "/de/x"), ("notexample.com.", ""), ("notexample.com", "/%C3%aa%zz%4"), ("m.example.org", "/de/"), ("", "/nothing"), (None, "/x")]
    pages = spark.createDataFrame([*enumerate(urls()), (None, "http://a.net/"), (0, urls()[0])], "page_id long, url string")
    got = U.judge(pages, U.production_rules(spark), spark.createDataFrame(listed, "host string, path string")).collect()
    assert len(got) == pages.count()
    by = {r.page_id: r for r in got}
    for i, u in enumerate(urls()):
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == judged(u, U.RULES, set(listed)), u
    assert by[None].rule == "net/" and by[None].verdict == "block"


def test_sql(spark, sf_dir):
    sf_dir = f"{sf_dir}/../sf0.01"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = U.judge(pages, U.production_rules(spark), U.listed_urls(spark))
    assert rows_of(judged) == rows_of_sql(connection(sf_dir), U.oracle())
    assert judged.where("listed and rule is null and verdict = 'block'").count() > 0


def test_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) as key")
    table = U.bloom_filter(keys)
    assert U.possible_hits(keys, table).count() == 20_000
    others = spark.range(20_000).selectExpr("concat('o', id) as key")
    assert U.possible_hits(others, table).count() < 400


@pytest.mark.parametrize("empty", ["pages", "rules", "listed"])
def test_empty(spark, empty):
    pages = spark.createDataFrame([] if empty == "pages" else [(1, "http://a.net/")], "page_id long, url string, host string, path string, rule string, verdict string, key string" if empty == "pages" else "page_id long, url string")
    rules = spark.createDataFrame([] if empty == "rules" else list(U.RULES), "host string, path string, verdict string")
    listed = spark.createDataFrame([] if empty == "listed" else [("a.net", "/")], "host string, path string")
    got = U.judge(pages, rules, listed).collect()
    assert [r.verdict for r in got] == ([] if empty == "pages" else ["block"])


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "h", "p", "r", "v", "k", "b", True)], "page_id long, url string, host string, path string, rule string, verdict string, key string, block string, listed boolean")
    r = U.judge(pages, U.production_rules(spark), spark.createDataFrame([], "host string, path string")).first()
    assert (r.host, r.path, r.rule, r.verdict, r.listed) == ("a.net", "/", "net/", "block", False)
