"""Main text of web pages by deducing each host's template.

Tokens of a page are its tags, told apart by their path, and its text: words of short runs, longer runs
whole. Tokens of a host that occur equally often on each of its pages, that is with equal occurrence
vectors, form an equivalence class. A class that is frequent, keeps one order on every page and nests in
the classes around it is part of the template; gaps between its tokens are the slots, which hold what
differs from page to page. The main text is what the slots of one container hold: the container with
most text outside links and outside elements that are marked as menus, notices and the like.

Vectors of any length are compared by sums of a hash of (page, count) over the pages, so they are
aggregated like counts, and no host's pages ever meet in one task. Every page is parsed three times:
for its counts, for order and nesting with the text of each slot, and for the text itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._common import mix, text_batches, written

#: Pages of a host that a template token is on at least, as a number and as a share; runs of up to SHORT words are split into words.
LEAST, SHARE, SHORT = 3, 0.2, 12
#: Text is left out as part of the template if it is on so many pages, a number and a share of the host's ...
CONSTANT_LEAST, CONSTANT_SHARE = 5, 0.5
#: ... and if no more than this share of the page's main text would go: a page whose whole text is repeated keeps it.
CONSTANT_MOST = 0.2
#: Entries of hosts' token lists that are broadcast at most (about 24 bytes each).
ENTRIES = 1_000_000

# Elements by what they do in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tr td th", "table")}
CLOSES = {t: (frozenset(a.split()), frozenset(b.split())) for t, (a, b) in CLOSES.items()}
NONE: tuple[frozenset, frozenset] = (frozenset(), frozenset())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = "script style textarea title xmp".split()
DROPPED = frozenset("head script style title noscript template nav aside footer form button select option textarea label legend fieldset dialog menu svg canvas iframe object audio video map".split())
BOXES = frozenset("article main div section td center body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# Words in names of classes and ids that mark what is not the article, and those that mark it.
ASIDE = frozenset("ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
NAMES = frozenset("article articlebody body content entry main post story text".split())
MODIFIERS = frozenset("has is js no with without".split())

_INSIDE = r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
#: A comment or declaration; an element whose content is no markup, up to its end; any other tag.
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<({'|'.join(RAW)})(?![^\s/>]){_INSIDE}.*?(?:</\1(?![^\s/>])[^>]*>|\Z)|<(/?)([A-Za-z][^\s/>]*){_INSIDE}", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
DIGITS = re.compile(r"\d+")
M64 = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash_of(text: str, seed: int) -> int:
    return signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & M64))


class Run:
    """Text between two tags: its tokens, where it stands, and whether it belongs to the article at all."""

    __slots__ = ("first", "last", "text", "box", "boxes", "weight", "linked", "hard", "soft", "breaks", "heading")

    def __init__(self, first: int, last: int, text: str, inside: Element, hard: bool, breaks: bool):
        self.first, self.last, self.text, self.hard, self.breaks = first, last, text, hard, breaks
        self.box, self.boxes, self.weight, self.linked, self.soft, self.heading = inside.box, inside.boxes, inside.weight, inside.linked, inside.soft, inside.heading


class Element:
    __slots__ = ("tag", "path", "hard", "soft", "boxes", "box", "weight", "linked", "heading", "head_only", "end", "below")


class Page:
    """Tokens and text runs of a page. Unclosed and stray tags are read as browsers do, near enough.

    ``tokens`` are 64-bit numbers in page order, ``parts`` the element that a text token stands in, 0
    for tags. A run's ``box`` is the container it counts for: the outermost article, else main, else the
    innermost box named as content, else the innermost box. Without ``words`` text gives runs but no tokens.
    """

    def __init__(self, source: str, words: bool = True):
        self.words = words
        self.tokens: list[int] = []
        self.parts: list[int] = []
        self.runs: list[Run] = []
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.breaks, self.articles = True, 0
        self._push("", {}, 0)
        at = 0
        for m in TAG.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            raw, _, end, tag, attributes = m.groups()
            if tag is not None:
                if end:
                    self._end(tag.lower())
                else:
                    self._start(tag.lower(), attributes)
            elif raw is not None:
                path = hash_of(raw.lower(), self.stack[-1].path)
                self.tokens += [path, hash_of("/", path)]
                self.parts += [0, 0]
                self.breaks = True
        if at < len(source):
            self._text(source[at:])

    def _push(self, tag: str, found: dict[str, str], path: int) -> None:
        up = self.stack[-1] if self.stack else None
        e = Element()
        e.tag, e.path, e.end, e.below = tag, path, hash_of("/", path), {}
        inside = bool(self.open.get("article") or self.open.get("main"))
        e.hard = bool(up and up.hard) or tag in DROPPED or tag == "header" and not inside
        if found:
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            e.hard = e.hard or hidden or found.get("role", "").lower() in ROLES
        e.head_only = bool(up and up.head_only) or tag == "header" and inside
        e.heading = tag if tag in HEADINGS else up.heading if up else ""
        e.linked = bool(up and up.linked) or tag == "a"
        e.soft = up.soft if up else ()
        e.boxes, e.box, e.weight = (up.boxes, up.box, up.weight) if up else (frozenset(), path, 1)
        if tag == "main" or tag == "article" and not self.articles:
            for flag in e.soft:
                flag[0] = False
        words = []
        if found and tag not in ("html", "body"):
            words = [[p.lower() for p in PARTS.findall(n)] for n in (found.get("class", "") + " " + found.get("id", "")).split()]
            if any(_marks_aside(w) for w in words):
                e.soft = e.soft + ([True],)
        if tag in BOXES or not up:
            e.boxes = e.boxes | {path}
            weight = 10 if tag == "article" else 5 if tag == "main" else 3 if any(NAMES & set(w) for w in words) else 1
            # The outermost article, else the innermost main, named or other box.
            if e.weight < 10 and (weight >= e.weight or e.weight == 1):
                e.box, e.weight = path, weight
        self.articles += tag == "article"
        self.stack.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.breaks = True
        close, stop = CLOSES.get(tag, NONE)
        if self.open.get("p") and tag in CLOSES_P:
            close, stop = close | {"p"}, stop | BOXES | {"table", "button", "object"}
        if close and any(self.open.get(t) for t in close):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in stop:
                    break
                if self.stack[i].tag in close:
                    while len(self.stack) > i:
                        self._pop()
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        found: dict[str, str] = {}
        if attributes and TELLING.search(attributes):
            for m in ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        up = self.stack[-1]
        known = up.below.get(tag) if not found else None
        if known is not None:
            # The same element again: a paragraph or item after another.
            self.tokens.append(known.path)
            self.parts.append(0)
            self.stack.append(known)
            self.open[tag] += 1
            return
        named = DIGITS.sub("0", found.get("class", "") + " " + found.get("id", "")) if found else ""
        path = hash_of(f"{tag} {named}", up.path)
        self.tokens.append(path)
        self.parts.append(0)
        if tag not in VOID and not (attributes.endswith("/") and tag in ("path", "circle", "rect", "use")):
            self._push(tag, found, path)
            if not found and tag not in ("article", "main", "header"):
                up.below[tag] = self.stack[-1]

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self.breaks = True
        if not self.open.get(tag):
            self.tokens.append(hash_of("/" + tag, self.stack[-1].path))
            self.parts.append(0)
            return
        i = len(self.stack) - 1
        while self.stack[i].tag != tag:
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return
            i -= 1
        self.tokens.append(self.stack[i].end)
        self.parts.append(0)
        while len(self.stack) > i:
            self._pop()

    def _text(self, text: str) -> None:
        if text.isspace():
            self.breaks = True
            return
        e, first = self.stack[-1], len(self.tokens)
        if self.words:
            words = text.split(None, SHORT)
            self.tokens += [hash_of(w, e.path) for w in words] if len(words) <= SHORT else [hash_of(text.strip(), e.path)]
            self.parts += [e.path] * (len(self.tokens) - first)
        dropped = e.hard or e.head_only and not e.heading
        self.runs.append(Run(first, len(self.tokens), text, e, dropped, self.breaks))
        self.breaks = False


def _marks_aside(words: list[str]) -> bool:
    """Whether the words of one class or id mark an element that is not part of an article."""
    if not words or words[0] in MODIFIERS or len(words) > 4:
        return False
    hit = ASIDE & set(words)
    return bool(hit - {"header"}) or "header" in hit and not NAMES & set(words)


def is_out(run: Run) -> bool:
    """Whether a run stands in an element that is no part of the article."""
    return run.hard or any(flag[0] for flag in run.soft)


def place(tokens: list[int], known: dict[int, tuple[int, int, int]]) -> tuple[set[int], set[int], dict[tuple[int, int, int], int], list[tuple[int, int]]]:
    """How the classes of ``known`` (token: class, place in it, its size) lie on a page.

    Returns tokens out of order, classes that cross others, how often each (class, parent, gap) occurs,
    and for every token, and the page's end, the slot (class, gap) that it stands in or closes; (0, 0) outside all.
    """
    bad, crossing, at, slots = set(), set(), {}, []
    stack: list[list[int]] = []
    depth: dict[int, int] = {}
    for t in tokens:
        slots.append((stack[-1][0], stack[-1][1]) if stack else (0, 0))
        hit = known.get(t)
        if hit is None:
            continue
        c, order, size = hit
        if depth.get(c):
            i = len(stack) - 1
            while stack[i][0] != c:
                i -= 1
            if order <= stack[i][1]:
                bad.add(t)
                continue
            while len(stack) > i + 1:
                over = stack.pop()
                depth[over[0]] -= 1
                crossing.add(over[0])
            stack[i][1] = order
        else:
            key = (c, *slots[-1])
            at[key] = at.get(key, 0) + 1
            stack.append([c, order, size])
            depth[c] = 1
        if order == size - 1:
            stack.pop()
            depth[c] -= 1
    slots.append((stack[-1][0], stack[-1][1]) if stack else (0, 0))
    return bad, crossing, at, slots


def host_of(url: Column) -> Column:
    """The host of an address, A-Z lower-cased; null without one."""
    found = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    return F.when(F.length(found) > 0, F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _summed(rows: list[tuple], keys: int) -> list[tuple]:
    """Rows with equal first ``keys`` fields added up over the others, so that less is shuffled."""
    out: dict[tuple, list[int]] = {}
    for r in rows:
        held = out.get(r[:keys])
        if held is None:
            out[r[:keys]] = list(r[keys:])
        else:
            for i, x in enumerate(r[keys:]):
                held[i] += x
    return [k + tuple(v) for k, v in out.items()]


COUNTS = ["host", "token", "part", "low", "high", "pages", "uses", "first"]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per host and token: the sums that stand for its vector, pages, uses and first places, over a batch."""
    for batch in batches:
        out: dict[str, list[np.ndarray]] = {}
        for host, row, source in zip(batch["host"], batch["row"], batch["html"]):
            page = Page(source)
            if not page.tokens:
                continue
            token, first, count = np.unique(np.array(page.tokens, np.int64), return_index=True, return_counts=True)
            h = mix(np.full(len(token), row, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(count.astype(np.uint64)))
            part = np.array(page.parts, np.int64)[first]
            ones = np.ones(len(token), np.int64)
            out.setdefault(host, []).append(np.stack([token, part, (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64), ones, count, first]))
        for host, parts in out.items():
            x = np.concatenate(parts, axis=1)
            x = x[:, np.argsort(x[0], kind="stable")]
            at = np.flatnonzero(np.concatenate(([True], x[0][1:] != x[0][:-1])))
            sums = [np.add.reduceat(x[i], at) for i in range(2, 7)]
            yield pd.DataFrame(dict(zip(COUNTS, [np.full(len(at), host, object), x[0][at], x[1][at], *sums])))


def _with_rows(pages: DataFrame, rows: DataFrame, entries: str) -> DataFrame:
    """``pages`` with their host's row of ``rows`` (host, n and lists whose length is ``entries``), null where there is none.

    Rows are broadcast where all lists together have at most ENTRIES entries. Else only those of the
    largest hosts are, as many as fit, and other pages are joined by a shuffle.
    """
    total, most = rows.agg(F.coalesce(F.sum(entries), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if total <= ENTRIES:
        return pages.join(F.broadcast(rows), "host", "left")
    least = max(1000, most // 10_000)
    while rows.where(F.col("n") > least).agg(F.coalesce(F.sum(entries), F.lit(0))).first()[0] > ENTRIES:
        least *= 4
    hot, cold = rows.where(F.col("n") > least), rows.where(F.col("n") <= least)
    first = pages.join(F.broadcast(hot), "host")
    rest = pages.join(F.broadcast(hot.select("host")), "host", "left_anti")
    return first.unionByName(rest.where("host is not null").join(cold.hint("merge"), "host", "left")).unionByName(rest.where("host is null"), allowMissingColumns=True)


def classes(pages: DataFrame) -> DataFrame:
    """Equivalence classes by host, of pages (host, html): a row (host, n, listed, entries) with the tokens of all frequent classes.

    ``listed`` holds (token, class, place, size, pages): the class by its vector, tags together and text
    by the element it stands in; the token's place in the class's order, and its pages. Kept are tokens
    on LEAST pages and a SHARE of the host's pages or more that share their vector with another token, so
    a host lists at most 1 / SHARE times the distinct tokens of its mean page.
    """
    rows = pages.where("host is not null and html is not null").withColumn("row", F.monotonically_increasing_id())
    sizes, _ = written(pages.where("host is not null").groupBy("host").agg(F.count("*").alias("n")))
    counted = rows.select("host", "row", "html").mapInPandas(_counts, "host string, token long, part long, low long, high long, pages long, uses long, first long")
    sums = counted.groupBy("host", "token", "part").agg(*(F.sum(c).alias(c) for c in COUNTS[3:])).where(F.col("pages") >= LEAST)
    few = sizes.count() <= 100_000
    frequent = sums.join(F.broadcast(sizes) if few else sizes, "host").where(F.col("pages") >= F.col("n") * SHARE)
    vector = F.struct("low", "high", "pages", "uses")
    entry = F.struct("token", F.xxhash64("part", "low", "high", "pages", "uses").alias("class"), "part", vector.alias("vector"), "first", "pages")
    held = frequent.groupBy("host").agg(F.collect_list(entry).alias("t"), F.max("n").alias("n"))  # at most 1 / SHARE times the tokens of a page
    return held.select("host", "n", "t")


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gives the tokens of each host their places in their classes; vectors that only one token has go."""
    for batch in batches:
        out = []
        for host, n, tokens in zip(batch["host"], batch["n"], batch["t"]):
            sharing: dict[tuple, int] = {}
            groups: dict[int, list] = {}
            for t in tokens:
                vector = tuple(t["vector"].values()) if isinstance(t["vector"], dict) else tuple(t["vector"])
                sharing[vector] = sharing.get(vector, 0) + 1
                groups.setdefault(t["class"], []).append((t["first"], t["token"], t["part"], vector, t["pages"]))
            listed = []
            for c, members in groups.items():
                if sharing[members[0][3]] > 1:
                    members.sort()
                    listed += [(t, c, i, len(members), pages, part != 0) for i, (_, t, part, _, pages) in enumerate(members)]
            out.append((host, n, [list(x) for x in zip(*listed)] if listed else [[]] * 6, len(listed)))
        yield pd.DataFrame(
            {"host": [o[0] for o in out], "n": [o[1] for o in out], **{c: [o[2][i] for o in out] for i, c in enumerate(("token", "class", "place", "size", "pages", "is_text"))}, "entries": [o[3] for o in out]}
        )


LISTED = "host string, n long, token array<long>, class array<long>, place array<int>, size array<int>, pages array<long>, is_text array<boolean>, entries int"
BAD, CROSSING, PLACED, SLOT = range(4)


def _layout(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a batch's pages say about order and nesting, and how much text of each container lies in each slot."""
    names = ["host", "kind", "a", "b", "c", "d", "weight", "n", "chars"]
    for batch in batches:
        known: dict[str, dict[int, tuple[int, int, int]]] = {}
        texts: dict[str, dict[int, int]] = {}
        rows: list[tuple] = []
        for host, source, token, cls, order, size, is_text in zip(batch["host"], batch["html"], batch["token"], batch["class"], batch["place"], batch["size"], batch["is_text"]):
            if host not in known:
                known[host] = {} if token is None else {int(t): (int(c), int(o), int(s)) for t, c, o, s in zip(token, cls, order, size)}
                texts[host] = {} if token is None else {int(t): int(c) for t, c, x in zip(token, cls, is_text) if x}
            text = texts[host]
            page = Page(source, bool(text))
            bad, crossing, placed, slots = place(page.tokens, known[host])
            rows += [(host, BAD, t, 0, 0, 0, 0, 1, 0) for t in bad]
            rows += [(host, CROSSING, c, 0, 0, 0, 0, 1, 0) for c in crossing]
            rows += [(host, PLACED, c, parent, gap, 0, 0, n, 0) for (c, parent, gap), n in placed.items()]
            own: dict[tuple, int] = {}
            for r in page.runs:
                if is_out(r) or r.linked:
                    continue
                found = {text.get(t) for t in page.tokens[r.first : r.last]} if text else ()
                cls_of = found.pop() if len(found) == 1 else None
                key = (r.box, cls_of or 0, *slots[r.first], r.weight)
                own[key] = own.get(key, 0) + len(r.text)
            seen = set()
            for (box, c, slot, gap, weight), chars in own.items():
                rows.append((host, SLOT, box, c, slot, gap, weight, int(box not in seen), chars))
                seen.add(box)
        yield pd.DataFrame(_summed(rows, 7), columns=names)


LAYOUT = "host string, kind int, a long, b long, c long, d long, weight int, n long, chars long"


def deduce(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates of the hosts of ``pages`` (host, html), and what extraction needs of them.

    The first table has (host, class, parent, gap, tokens, pages): every class that keeps its order and
    lies in one gap of one parent (0: in none) on all pages. The second has (host, n, boxes, constant,
    entries): containers by falling score, on a SHARE of the pages or more, and the text tokens of
    the template that are on CONSTANT_SHARE of the pages.
    """
    listed, _ = written(classes(pages).mapInPandas(_ordered, LISTED))
    usable = pages.where("host is not null and html is not null").select("host", "html")
    laid = _with_rows(usable, listed.select("host", "n", "token", "class", "place", "size", "is_text", "entries"), "entries")
    seen, _ = written(laid.mapInPandas(_layout, LAYOUT).groupBy("host", "kind", "a", "b", "c", "d", "weight").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")))
    tokens = listed.select("host", "n", F.explode(F.arrays_zip("token", "class", "pages", "is_text")).alias("t")).select("host", "n", "t.*")
    good = tokens.join(seen.where(F.col("kind") == BAD).select("host", F.col("a").alias("token")), ["host", "token"], "left_anti")
    crossing = seen.where(F.col("kind") == CROSSING).select("host", F.col("a").alias("class"))
    # A class lies in one gap of one parent, or it is no part of the template.
    nested = seen.where(F.col("kind") == PLACED).groupBy("host", F.col("a").alias("class")).agg(F.count("*").alias("_places"), F.first("b").alias("parent"), F.first("c").alias("gap")).where("_places = 1")
    valid = good.join(nested.drop("_places"), ["host", "class"]).join(crossing, ["host", "class"], "left_anti")
    held, _ = written(valid)
    while True:  # as often as classes nest in ones that are not valid, level by level
        stands = held.select("host", F.col("class").alias("parent")).distinct()
        orphans = held.where("parent <> 0").join(stands, ["host", "parent"], "left_anti").select("host", "class").distinct()
        if orphans.isEmpty():
            break
        held, _ = written(held.join(orphans, ["host", "class"], "left_anti"))
    template = held.groupBy("host", "class", "parent", "gap").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.max("pages").alias("pages"))
    constant = held.where(F.col("is_text") & (F.col("parent") != 0) & (F.col("pages") >= CONSTANT_LEAST) & (F.col("pages") >= F.col("n") * CONSTANT_SHARE))
    texts = constant.groupBy("host").agg(F.collect_list("token").alias("constant"))
    sizes = usable.groupBy("host").agg(F.count("*").alias("n"))
    # Text of a valid class is the template's; the rest is what the slots hold.
    slots = seen.where(F.col("kind") == SLOT).join(held.select("host", F.col("class").alias("b")).distinct().withColumn("_template", F.lit(1)), ["host", "b"], "left").where("_template is null")
    boxes = slots.groupBy("host", F.col("a").alias("box")).agg((F.max("weight") * F.sum("chars")).alias("score"), F.sum("n").alias("pages"))
    kept = boxes.join(sizes, "host").where((F.col("pages") >= F.col("n") * SHARE) & (F.col("score") > 0))
    best = kept.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "box"))), lambda x: x["box"]).alias("boxes"))
    none = F.array().cast("array<long>")
    rules = sizes.join(best, "host", "left").join(texts, "host", "left").select("host", "n", F.coalesce("boxes", none).alias("boxes"), F.coalesce("constant", none).alias("constant"))
    return template, written(rules.withColumn("entries", F.size("boxes") + F.size("constant")))[0]


def main_text(source: str, boxes: list[int], constant: set[int]) -> str:
    """The main text of one page: its runs in the best of ``boxes`` that it has, without the template's text.

    Where the page has none of them, its own container with most text is taken; a page of which nothing
    is left that way gives all text outside scripts, forms and the like. Character references are decoded,
    white space becomes one space, blocks are joined by one.
    """
    page = Page(source, bool(constant))
    inside = [r for r in page.runs if not is_out(r)]
    if not inside:
        inside = [r for r in page.runs if not r.hard]
    score: dict[int, int] = {}
    for r in inside:
        if not r.linked:
            score[r.box] = score.get(r.box, 0) + r.weight * len(r.text)
    if not score:
        return ""
    box = next((b for b in boxes if b in score), None)
    if box is None:
        box = max(score, key=lambda b: score[b])  # of equal ones the first
    chosen = [r for r in inside if box in r.boxes]
    if not any(r.heading == "h1" for r in chosen):
        # A title that stands before its text, in an element around it.
        chosen = [r for r in inside if r.heading == "h1" and r.first < chosen[0].first and r.boxes < chosen[0].boxes and not r.linked] + chosen
    whole = sum(len(r.text) for r in chosen)
    fixed = [r for r in chosen if all(t in constant for t in page.tokens[r.first : r.last])] if constant else []
    if fixed and sum(len(r.text) for r in fixed) <= CONSTANT_MOST * whole:
        gone = {id(r) for r in fixed}
        chosen = [r for r in chosen if id(r) not in gone]
    # Inline tags alone between two runs do not part words; anything else does.
    out = [(" " if r.breaks else "") + html.unescape(r.text) for r in chosen]
    return " ".join("".join(out).split())


def _texts(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[str | None, tuple[list[int], set[int]]] = {}
            out = []
            for host, source, boxes, constant in zip(batch["_host"], batch["_html"], batch["boxes"], batch["constant"]):
                if host not in held:
                    held[host] = ([], set()) if boxes is None else ([int(b) for b in boxes], {int(t) for t in constant})
                out.append(main_text(source or "", *held[host]))
            yield batch[names].assign(text=out, n_chars=[len(t) for t in out])

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (code points) of every row of ``pages`` (url, html and others).

    Templates are deduced from all pages of each host. Pages without a host, and those of hosts of less
    than LEAST pages, are read by their own structure. Null and empty pages give an empty text; repeated
    rows and ids count and come out each; other columns are not read. Empty in, empty out.
    """
    text_batches(pages.sparkSession)
    hosted = pages.select(host_of(F.col("url")).alias("host"), "html")
    _, rules = deduce(hosted)
    rows = pages.select(*keep, host_of(F.col("url")).alias("host"), F.col("html").alias("_html"))
    joined = _with_rows(rows, rules, "entries").withColumnRenamed("host", "_host").select(*keep, "_host", "_html", "boxes", "constant")
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    return joined.mapInPandas(_texts(list(keep)), schema)


def oracle() -> str:
    """The same rows of the test tables as DuckDB SQL: there every page's main text is its article element."""
    x = "regexp_extract(html, '(?is)<article[^>]*>(.*?)(</article|$)', 1)"
    x = f"regexp_replace(regexp_replace({x}, '(?i)</?b>', '', 'g'), '<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return f"select page_id, url, text, length(text) as n_chars from (select page_id, url, coalesce(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '') as text from pages)"
