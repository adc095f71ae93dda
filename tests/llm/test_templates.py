import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import templates
from quarrystone.llm.queries import ORACLE, op11_html_extraction
from tests.comparing import connection, rows_of, rows_of_sql

SCHEMA = "page_id long, url string, html string"
WORDS = [a + b for a in "ka lo mi ne pu ra si to ve zu".split() for b in "ban dar fel gim hor jun kes lam".split()]


def prose(rng, least=20, most=60):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))).capitalize() + "."


def layouts(rng, i, title, paragraphs):
    """The same article in pages of different make, by name."""
    body = "".join(f"<p>{p}</p>\n" for p in paragraphs)
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 6))
    comments = "".join(f"<div class='c'><b>{rng.choice(WORDS)}</b><p>{prose(rng, 5, 30)}</p></div>" for _ in range(rng.randint(0, 4)))
    return {
        "article": f"<html><head><title>{title}</title><script>var t='</p><article>';</script></head><body><header><a href='/'>Logo</a></header><nav><ul>{menu}</ul></nav><!-- <article> --><article><h1>{title}</h1>{body}<aside>{prose(rng)}</aside></article><section id='comments'>{comments}</section><footer>&copy; x {prose(rng, 3, 9)}</footer></body></html>",
        "plain": f"<body><div class=top><ul>{menu}</ul></div><div id=wrap><div class='col-a'><h1>{title}</h1>{body}<p>Sign up for our weekly letter and never miss a story again.</p></div><div class='col-b'><ul>{menu}</ul><p>{prose(rng, 3, 8)}</p></div></div><div class='legal'><p>{'All rights reserved by the owners of this site. ' * 12}</p></div>",
        "named": f"<html><body class='has-sidebar'><div class='cookie-notice'>We use cookies. {prose(rng, 30, 40)}</div><div class='sidebar'>{prose(rng, 60, 90)}</div><div class='entry-content'><div class='entry-header'><h1>{title}</h1></div>{body.replace('</p>', '', 1)}<div class='ad-slot'>{prose(rng)}</div></div><form><label>Name</label><input name=q><button>Send</button></form><ol class='commentlist'><li>{comments}</li></ol></body></html>",
    }


def site(kind, n, seed=1):
    rng, rows, truth = random.Random(seed), [], {}
    for i in range(n):
        title, paragraphs = prose(rng, 3, 8), [prose(rng) for _ in range(rng.randint(2, 6))]
        rows.append((i, f"https://{kind}.example.org/{i}", layouts(rng, i, title, paragraphs)[kind]))
        truth[i] = " ".join([title, *paragraphs])
    return rows, truth


@pytest.mark.parametrize("kind", ["article", "plain", "named"])
def test_articles_come_out_whole_and_alone(spark, kind):
    rows, truth = site(kind, 12)
    out = {r["page_id"]: r for r in templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r["text"] for i, r in out.items()} == truth
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


@pytest.mark.parametrize("kind", ["article", "named"])
def test_hosts_of_one_page_are_read_by_their_own_structure(spark, kind):
    rows, truth = site(kind, 2)
    out = templates.extract(spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, _, h in rows], SCHEMA))
    assert {r["page_id"]: r["text"] for r in out.collect()} == truth


def test_the_template_tells_a_long_notice_from_a_short_article(spark):
    """Alone, the notice is the longest text of the page; over the host's pages it is part of the template."""
    rng = random.Random(5)
    legal = "Terms of use apply to everything on these pages and nothing here is advice. " * 10
    rows = [(i, "http://a.example/x", f"<body><div class=k><p>{prose(rng, 10, 15)} n{i}</p></div><div class=z><p>{legal}</p></div></body>") for i in range(8)]
    out = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(t.endswith(f" n{i}") and "Terms" not in t for i, t in out.items())


def test_repeated_pages_keep_their_text(spark):
    text = "One page that many addresses of a host return, and all of its words are the same everywhere."
    rows = [(i, f"http://a.example/{i}", f"<body><article><h1>T</h1><p>{text}</p></article></body>") for i in range(10)]
    assert {r["text"] for r in templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"T " + text}


def test_references_white_space_and_broken_markup(spark):
    cases = {
        "<article><p>a &amp;amp; b &lt;i&gt; &#233;&#x1F600;</p><p> x\n\t y<br>z</p></article>": "a &amp; b <i> é😀 x y z",
        "<article><p><b>bo<i>ld</b> on<p>two": "bold on two",
        "<article>a < b and <em>c</em>d</article>": "a < b and cd",
        "<p>no box</p><p class='x'>at all": "no box at all",
        "plain words only": "plain words only",
        "<script>var a='<p>no</p>'</script>": "",
        "<article><script>never closed <p>gone": "",
        "<article><p>kept<!-- open comment <p>gone": "kept",
        "<article><header><h1>Title</h1><span>by someone</span></header><p>Body text</p><footer>tags</footer></article>": "Title Body text",
    }
    rows = [(i, None if i % 2 else f"x://h{i}/", h) for i, h in enumerate(cases)]
    out = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i] for i in range(len(cases))] == list(cases.values())


def test_messy_rows(spark):
    long = "<article>" + "".join(f"<p>word{i % 977} tail</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "http://a/x", None), (1, "http://a/x", None), (2, "http://a/y", ""), (None, None, "<p>x</p>"), (3, "no scheme", "  \n "), (4, "http://a/z", long), (4, "http://a/z", long), (5, "http://a/w", "<div>" * 3000 + "deep"), (6, "http:///", "<<<>>>")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("c") for c in ("host", "text", "boxes", "token", "n", "row", "_html")})
    out = templates.extract(docs).collect()
    assert len(out) == len(rows)
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in out)
    n = len(" ".join(f"word{i % 977} tail" for i in range(30_000)))
    assert got == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 0), (4, n), (4, n), (5, 4), (6, 6)]
    assert templates.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_classes(rows):
    """Tokens by host with equal vectors of counts over all pages, as plain lists."""
    pages = defaultdict(list)
    for _, url, html in rows:
        pages[url.split("/")[2]].append(templates.Page(html))
    out = set()
    for host, own in pages.items():
        counts = [Counter(p.tokens) for p in own]
        part = {t: x for p in own for t, x in zip(p.tokens, p.parts)}
        vectors = defaultdict(list)
        for t in part:
            vectors[tuple(c[t] for c in counts)].append(t)
        for vector, tokens in vectors.items():
            on = sum(v > 0 for v in vector)
            if len(tokens) > 1 and on >= max(templates.LEAST, templates.SHARE * len(own)):
                groups = defaultdict(list)
                for t in tokens:
                    groups[part[t]].append(t)
                out |= {(host, frozenset(g)) for g in groups.values()}
    return out


def test_classes_equal_plain_occurrence_vectors(spark):
    rows = site("plain", 9)[0] + site("article", 7, 3)[0] + site("named", 4, 4)[0]
    pages = spark.createDataFrame(rows, SCHEMA).select(templates.host_of(F.col("url")).alias("host"), "html").repartition(5)
    listed = templates.classes(pages).mapInPandas(templates._ordered, templates.LISTED).collect()
    got = set()
    for r in listed:
        groups = defaultdict(list)
        for t, c in zip(r["token"], r["class"]):
            groups[c].append(t)
        got |= {(r["host"], frozenset(g)) for g in groups.values()}
    assert got == brute_classes(rows)


def test_classes_nest_in_one_gap_of_their_parents(spark):
    rows, _ = site("plain", 10)
    template, _ = templates.deduce(spark.createDataFrame(rows, SCHEMA).select(templates.host_of(F.col("url")).alias("host"), "html"))
    found = {r["class"]: r for r in template.collect()}
    assert any(r["parent"] == 0 and len(r["tokens"]) > 10 for r in found.values())
    assert all(r["parent"] == 0 or r["parent"] in found for r in found.values())
    # The letter's words are template text below the tags.
    page = templates.Page(rows[0][2])
    letter = next(r for r in page.runs if "weekly" in r.text)
    assert set(page.tokens[letter.first : letter.last]) <= {t for r in found.values() if r["parent"] for t in r["tokens"]}


def test_order_and_nesting_by_hand():
    a, b, c, x, y = 1, 2, 3, 10, 11
    known = {a: (7, 0, 3), b: (7, 1, 3), c: (7, 2, 3), x: (8, 0, 2), y: (8, 1, 2)}
    bad, crossing, at, slots = templates.place([a, x, y, b, x, y, c], known)
    assert not bad and not crossing and at == {(7, 0, 0): 1, (8, 7, 0): 1, (8, 7, 1): 1} and slots[1] == (7, 0) and slots[4] == (7, 1)
    assert templates.place([a, x, b, y, c], known)[1] == {8}
    assert templates.place([b, a, c], known)[0] == {a}


def test_query_equals_sql(spark, sf_dir):
    assert rows_of(op11_html_extraction(spark, sf_dir)) == rows_of_sql(connection(sf_dir), ORACLE["op11_html_extraction"])
