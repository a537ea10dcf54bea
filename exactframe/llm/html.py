"""Operator 2, main text of web pages: site template removal.

Each page is parsed into elements. Every block element of the body is hashed with all below it, in up to three ways: as
text (names, classes, texts), and, without texts, as a frame where its class hints that it is not the article, or as a
list of links where most of its text is links. Spark counts, for each host, on how many different page bodies each
hash occurs; subtrees that recur on many of them are the site's template and are deleted. A body here is the page's
remaining text, so that copies of one page, which share everything, make nothing recur.

What HTML itself says is not the article (menus, page headers, footers, asides, forms, scripts, hidden elements and such
roles) goes without counting. A class that hints so decides alone only on hosts with fewer than LEAST_BODIES bodies, or
for the plainest of such classes (adverts, reader comments, cookie notices); elsewhere its frame must recur. No hint
counts on an element that holds the article or most of the page's text. Inside an article, paragraphs, headings, lists,
tables, quotes and code are mostly the author's, and copied text recurs too: they are template only if they recur on
half of the bodies.

If a page has exactly one article (else main) element outside what is deleted, the text is read there. What is left is
cut into blocks at block elements. Character references are decoded, white space inside a block becomes one space, and
blocks are joined by two line breaks.

Sizes: a shuffle of 20 bytes for each block element. A host's template comes to the pages by a join on the host: sent
along while it is small, else by a sorted join in which Spark splits the pages of a frequent host.

Defined results: a null or empty page has empty text; a null or odd address is a host of its own, the empty one;
broken markup is read as far as it goes: unclosed elements end with their parent, a tag whose quote never closes ends at
the next >, one without > at the page's end; repeated rows get equal results and count as one body; an empty table gives
an empty table; the caller's columns are kept, and the one added can be named.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored, unused
from .urls import host_of

#: A subtree is template if it occurs in so many bodies of its host at least, and in this share of them; or, by the
#: number of them, in MANY_BODIES and a smaller share, which bounds a host's template.
LEAST_BODIES, SHARE = 5, 0.3
MANY_BODIES, MANY_SHARE = 50, 0.05
#: The share for prose inside an article, where many bodies alone say nothing: license lines are on many, at the ends too.
PROSE_SHARE = 0.5
#: The share for frames whose class hints that they are not the article.
HINT_SHARE = 0.05
#: What is counted: text, prose inside an article, hinted frames, lists of links.
TEXT, PROSAIC, HINTED, LINKS = range(4)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Elements that a slash closes; it means nothing on others.
FOREIGN = frozenset("svg path circle rect line polygon polyline ellipse g use defs".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that are never part of the article.
DROPPED = frozenset(
    "head script style noscript template iframe object embed applet svg math canvas audio video map nav header footer aside form button select "
    "textarea input option fieldset dialog menu title link meta xmp noembed noframes".split()
)
#: Elements that inside an article are mostly the author's own.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ol ul li dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class and id names that hint that an element is not the article.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:navbar|navigation|menu|menus|breadcrumbs?|masthead|footer|copyright|sidebar|banner|widget|widgets|modal|overlay|popup|"
    r"signup|login|social|sharing|related|recommended|recirc|pagination|pager|toolbar|paywall|promo|promos)(?=$|[\s_-])|"
    r"(?:^|\s)(?:ad|nav|header|foot|side|share|search|skip|notice|comment)[_-]"
)
#: Whole names that do.
_NAMES = frozenset(
    "ad ads nav navi header foot side aside alert notices notification share search skip legal disclaimer respond reply replies comment comments "
    "subscribe subscription promo promos promotion sponsor".split()
)
#: Those parts of names that say so plainly, on an article or a paragraph too.
_STRONG = re.compile(
    r"(?:^|[\s_-])(?:ads|advert(?:s|isement|ising)?|adsense|adbox|sponsored|cookies?|consent|gdpr|newsletter|commentlist|disqus|comments)(?=$|[\s_-])"
)
_PLAIN = frozenset("ad ads comment comments notice promo replies".split())
#: Start tags that end an open element of these names.
CLOSES = {
    **dict.fromkeys(BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, frozenset(["p"])),
    "li": frozenset(["li", "p"]), "dd": frozenset(["dd", "dt", "p"]), "dt": frozenset(["dd", "dt", "p"]), "option": frozenset(["option"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody", "p"]), "tfoot": frozenset(["tr", "td", "th", "tbody", "p"]),
}
#: What such a start tag does not reach across.
FENCE = frozenset("table ul ol dl div section article main body html blockquote td th form nav aside header footer button object select".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
#: A tag's pairs of name and value, one after the other, so that no value is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>]+))?|["'][^"']*""")
_SPACE = re.compile(r"\s+")


class Node:
    """``dropped``: not the article, whatever recurs: 1 by its name, 2 for other reasons. ``hint``: 1 if a class hints so, 2 if it says so plainly."""

    __slots__ = ("name", "mark", "dropped", "hint", "main", "children")

    def __init__(self, name: str, mark: str = "", dropped: int = 0, hint: int = 0, main: bool = False):
        self.name, self.mark, self.dropped, self.hint, self.main = name, mark, dropped, hint, main
        self.children: list[Node | str] = []


def _node(name: str, text: str) -> Node:
    drop, main = int(name in DROPPED), name in ("article", "main")
    if not text or not text.strip(" /\n"):
        return Node(name, "", drop, 0, main)
    got: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if m[1]:
            got.setdefault(m[1].lower(), entities.unescape((m[2] or "").strip("\"'")))
    mark = f"{got.get('class', '')} {got.get('id', '')}".strip()
    role = got.get("role", "").lower().strip()
    main = main or role in ("main", "article") or got.get("itemprop", "").lower() == "articlebody"
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", ""), re.I)
    if hidden or role in ROLES:
        drop = 2
    hint = 0
    if mark and name not in ("body", "html", "main"):
        low = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", mark).lower()
        names = low.split()
        if _STRONG.search(low) or not _PLAIN.isdisjoint(names):
            hint = 2
        elif not main and name != "p" and (_MARKS.search(low) or not _NAMES.isdisjoint(names)):
            hint = 1
    return Node(name, mark, drop, hint, main and hint < 2)


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose attributes begin at ``at``: its >, or the page's end."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if page[:m.start()][-1:] == "=" or page[max(0, m.start() - 16) : m.start()].rstrip()[-1:] == "=":
            close = page.find(m[0], at)
            if close < 0:
                end = page.find(">", at)
                return end if end >= 0 else len(page)
            at = close + 1
    return len(page)


def parse(page: str) -> Node:
    """The element tree; text as written, with character references."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    opened: Counter[str] = Counter()
    ends = {">": page.rfind(">"), "-->": page.rfind("-->")}  # past the last one a search need not be made

    def after(mark: str, start: int) -> int:
        if ends.setdefault(mark, page.rfind(mark)) < start:
            return n
        return page.find(mark, start) + len(mark)

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.name] -= 1
        del stack[k:]

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            stack[-1].children.append(page[at:begin])
        if begin == n:
            break
        follows = page[begin + 1 : begin + 2]
        if follows in ("!", "?"):
            if page.startswith("<!--", begin):
                at = begin + 5 if page.startswith("<!-->", begin) else after("-->", begin + 4)
            elif page.startswith("<![CDATA[", begin):
                at = after("]]>", begin + 9)
                stack[-1].children.append(entities.escape(page[begin + 9 : at].removesuffix("]]>")))
            else:
                at = after(">", begin + 2)
            continue
        if follows == "/":
            m = _NAME.match(page, begin + 2)
            at = after(">", begin + 2)
            name = m[0].lower() if m else ""
            if name == "br":
                stack[-1].children.append(Node("br"))
            if opened[name] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        close(k)
                        break
                    if name not in BLOCK and stack[k].name in BLOCK:
                        break
            continue
        m = _NAME.match(page, begin + 1)
        if not m:
            stack[-1].children.append("&lt;")
            at = begin + 1
            continue
        name = m[0].lower()
        end = _tag_end(page, m.end())
        inside, at = page[m.end() : end], end + 1
        if name in ("html", "body"):
            continue
        if (closed := CLOSES.get(name)) and any(opened[c] > 0 for c in closed):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closed:
                    close(k)
                elif stack[k].name in FENCE:
                    break
        node = _node(name, inside)
        stack[-1].children.append(node)
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = found.end() if found else n
        elif name not in VOID and not (inside.endswith("/") and name in FOREIGN):
            stack.append(node)
            opened[name] += 1
    return root


class Facts:
    """What is known of a page's elements, by their identity: as text, as frame, sizes of texts and of links; and what goes."""

    def __init__(self, root: Node):
        self.root = root
        self.order: list[Node] = []  # parents before children
        inside: dict[int, bool] = {id(root): False}
        todo = [root]
        while todo:
            x = todo.pop()
            self.order.append(x)
            within = inside[id(x)] or x.name in ("article", "main") or x.main
            for c in x.children:
                if isinstance(c, Node):
                    if c.name == "header" and within and c.dropped == 1:  # an article's own
                        c.dropped = 0
                    inside[id(c)] = within
                    todo.append(c)
        self.inside = inside
        self.holds: set[int] = set()  # elements with an article or main element in them
        self.size: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        for x in reversed(self.order):
            size = linked = 0
            for c in x.children:
                if isinstance(c, str):
                    size += len(c.strip())
                else:
                    if (c.main and not c.dropped) or id(c) in self.holds:
                        self.holds.add(id(x))
                    if not c.dropped or id(c) in self.holds:
                        size += self.size[id(c)]
                        linked += self.linked[id(c)]
            self.size[id(x)], self.linked[id(x)] = size, size if x.name == "a" else linked
        for x in self.order:
            if x.name in ("form", "header") and x.dropped == 1 and id(x) in self.holds:
                x.dropped = 0
            if x.hint == 1 and (x.main or id(x) in self.holds or 2 * (self.size[id(x)] - self.linked[id(x)]) > self.size[id(root)]):
                x.hint = 0

    def _hashes(self, nodes: list[Node], texts: bool) -> dict[int, int]:
        """Of names and classes with all texts, or without them and equal neighbours once; without what goes anyway. Children come before parents."""
        own: dict[int, bytes] = {}
        for x in nodes:
            h, last = hashlib.blake2b(f"{x.name}\0{x.mark}".encode("utf-8", "replace"), digest_size=8), b""
            for c in x.children:
                if isinstance(c, str):
                    if texts:
                        h.update(_SPACE.sub(" ", c).strip().encode("utf-8", "replace"))
                elif not c.dropped and c.hint < 2 and (texts or own[id(c)] != last):
                    h.update(last := own[id(c)])
            own[id(x)] = h.digest()
        return {k: int.from_bytes(v, "big", signed=True) for k, v in own.items()}

    def seen(self) -> list[tuple[Node, int, int]]:
        """(element, hash, kind) of what may be template."""
        left: list[Node] = []
        todo = [c for c in self.root.children if isinstance(c, Node)]
        while todo:
            x = todo.pop()
            if not x.dropped and x.hint < 2:
                left.append(x)
                todo += [c for c in x.children if isinstance(c, Node)]
        left.reverse()
        lists = [
            x for x in left
            if 2 * self.linked[id(x)] > self.size[id(x)] and x.name in LISTS and not self.inside[id(x)] and id(x) not in self.holds
        ]
        text = self._hashes(left, True)
        frame = self._hashes(left, False) if lists or any(x.hint for x in left) else {}
        out = [(x, text[id(x)], PROSAIC if self.inside[id(x)] and x.name in PROSE else TEXT) for x in left if x.name in BLOCK and self.size[id(x)]]
        out += [(x, frame[id(x)], HINTED) for x in left if x.hint]
        return out + [(x, frame[id(x)], LINKS) for x in lists]


#: What can hold a list of links.
LISTS = frozenset("ul ol dl div section table p menu dir center".split())
#: Told apart in a host's template, where one number stands for a subtree.
_SALT = (0, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x1A85EC53D2E5A7B9)


def _article(root: Node, gone: set[int]) -> Node:
    """The page's article or main element if it has exactly one outside what goes, else the page."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.name == wanted:
                found.append(x)
            else:
                todo += [c for c in x.children if isinstance(c, Node) and id(c) not in gone]
        if len(found) == 1:
            return found[0]
    return root


def read(facts: Facts, template: frozenset[int] | None = None) -> list[str]:
    """Text blocks in page order. ``template``: of a host with enough bodies; None: hints decide."""
    gone = {id(x) for x in facts.order if x.dropped or x.hint == 2 or (x.hint and template is None)}
    if template and len(template) > 1:
        gone |= {id(x) for x, h, kind in facts.seen() if h ^ _SALT[kind] in template}
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [_article(facts.root, gone)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif id(x) in gone:
            if x.name in BLOCK or x.name in RAW:
                flush()
        elif x.name == "br":
            parts.append(" ")
        else:
            if x.name in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, bodies, trees, kinds = [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            facts = Facts(parse(page.as_py() or ""))
            body = int.from_bytes(hashlib.blake2b("\n".join(read(facts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
            for s, kind in {(0, TEXT), *((h, kind) for _, h, kind in facts.seen())}:  # 0 for the page itself
                hosts.append(host)
                bodies.append(body)
                trees.append(s)
                kinds.append(kind)
        arrays = [pa.array(hosts, pa.string()), pa.array(trees, pa.int64()), pa.array(kinds, pa.int32()), pa.array(bodies, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "tree", "kind", "body"])


def site_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, tree, kind, n, bodies): the subtrees that are template; and, for every host with enough bodies, a row with tree 0."""
    given = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    counts = given.mapInArrow(_subtrees, "host string, tree long, kind int, body long").distinct().groupBy("host", "tree", "kind").agg(F.count("*").alias("n"))
    counts = stored(counts, "subtrees")
    bodies = counts.filter("tree = 0").select("host", F.col("n").alias("bodies"))
    kind, n = F.col("kind"), F.col("n")
    share = F.when(kind == PROSAIC, PROSE_SHARE).when(kind == HINTED, HINT_SHARE).otherwise(SHARE)
    many = (kind != PROSAIC) & (n >= MANY_BODIES) & (n >= F.col("bodies") * MANY_SHARE)
    often = counts.filter(n >= LEAST_BODIES).join(bodies, "host").filter((n >= F.col("bodies") * share) | many)
    return often.select("host", "tree", "kind", "n", "bodies")


def main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``out``: the main text."""
    x = unused(pages)
    # at most (elements of a page) / MANY_SHARE hashes for a host, as each is on that share of its bodies at least
    salt = F.element_at(F.array(*(F.lit(s) for s in _SALT)), F.col("kind") + 1)
    told = site_templates(pages, url, html).groupBy("host").agg(F.collect_list(F.col("tree").bitwiseXOR(salt)).alias(x + "template"))
    template = stored(told.withColumnRenamed("host", x + "host"), "template")

    @pandas_udf("string")
    def extract(texts: pd.Series, templates: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(read(Facts(parse(t or "")), None if h is None else frozenset(h.tolist()))) for t, h in zip(texts, templates, strict=True)])

    joined = pages.join(template, host_of(F.col(url)) == F.col(x + "host"), "left")
    return joined.withColumn(out, extract(F.col(html), F.col(x + "template"))).select(*(pages[c] for c in pages.columns if c != out), F.col(out))
