"""Main text of web pages, by removing what a site repeats.

Every page is parsed into a tree; each element's subtree (tag, attributes of style left out, text and children) is hashed.
Spark counts in how many different pages of its host a subtree occurs; those on at least MANY pages are
templates and are deleted, however large the host is. Inside the article, prose (paragraphs, headings, list items,
quotations, table cells) and whatever holds some (lists, tables, sections) is never a template: a passage that an author repeats
stays. Other subtrees there are counted over different articles, so copies of one under different menus count once.

What is left once templates are gone is the article, if an element says so, else the page. Elements that are never text of an
article (scripts, menus, forms and the like) go by their tag. Names that pages give to adverts, notices or comments are only a
fallback for what a site didn't repeat: a class or id counts if all words of it are such names or neutral ones, inside an
article only for elements that are no prose and for the names of INSIDE.

The counts are a partial aggregate over (host, hash), so a host with a third of all pages is many keys; pages meet the templates
of their host under SALTS numbers, so that a menu on all pages of a large host is no single task, and rows meet what their page loses
under COPIES numbers, so that copies of one page aren't either. Pages are parsed twice, to count and to travel as packed trees:
keeping the trees of the first pass took more disk than the second pass takes time.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import kept

MANY, SALTS, COPIES = 8, 16, 4

# Fixed values of HTML: elements without an end tag, with raw text, and those that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dd dt figcaption b i em strong a span code br q cite".split())
#: Inside an article, what holds one of these is no template.
PASSAGES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
DROPPED = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select input textarea dialog menu title noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names of what isn't the article, as a class or id or a word of one. FIRM ones say so of any element that bears them, also inside an article.
FIRM = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors cookie cookies consent gdpr notice notices newsletter subscribe subscription signup comment comments disqus respond "
    "sidebar sidebars breadcrumb breadcrumbs nav navbar pagination pager footer popup popups paywall".split()
)
#: Those that lead a name, whatever comes after; and those that say so of a paragraph or a few words as well.
LEADING = frozenset("ad ads adv advert advertisement adsense cookie cookies consent gdpr comment comments disqus newsletter sponsored footer".split())
ANYWHERE = frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsored cookie cookies comment comments".split())
#: What may also name a part of an article's text: they count there for an element without prose, or of more links than prose.
SOFT = frozenset("promo promotion promotions related recommended recommendations share sharing social".split())
NAMES = FIRM | SOFT | frozenset("banner notification alert modal overlay aside widget widgets menu menus navigation header masthead topbar reply replies toolbar login search skip".split())
#: Words that may stand beside a name in one class or id.
NEUTRAL = frozenset("main site page left right top bottom container wrapper wrap box block section area list inner outer bar buttons button links link items item global primary secondary sub mini content form icon icons row col group text message policy slot unit zone thread bubble".split())
_KEPT_OPEN = frozenset({"html", "body", "article", "main"})
#: A start tag of these ends an open p; one of the second kind ends an open one of its own kind.
_ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dialog"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = frozenset("ul ol dl table article section div main body html blockquote td th nav footer header aside form".split())
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: The words of a name: split at signs, digits and changes to capitals.
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element. hash: of its subtree; key: the same, signed, if the subtree may be a template, else None; passages: it holds prose;
    named: 1 if its names say that it isn't the article, 2 if they say so inside an article as well, 3 if there only of what is no prose, else 0."""

    __slots__ = ("tag", "named", "children", "hash", "key", "passages")

    def __init__(self, tag: str, named: int = 0, key: int | None = None) -> None:
        self.tag, self.named, self.children, self.hash, self.key, self.passages = tag, named, [], 0, key, False


def parse(source: str) -> Node:
    """A tree of elements and texts from any string; tags that don't fit are repaired or passed over."""
    root = Node("html")
    stack, at = [root], 0

    def close(tags, scope) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    while at < len(source):
        m = _TOKEN.search(source, at)
        start = m.start() if m else len(source)
        if start > at:
            stack[-1].children.append(source[at:start])
        if not m:
            break
        at = m.end()
        if not m[2] or not m[4]:  # a comment or the like, or a tag that the page's end cuts off
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p":
                close({"p"}, _SCOPE)
            elif tag not in VOID:
                close({tag}, frozenset({"table", "article", "main"} - {tag}) if tag not in _KEPT_OPEN else frozenset())
            continue
        if tag == "html" or (tag == "body" and any(n.tag == "body" for n in stack)):
            continue
        if tag == "body":
            close({"head"}, frozenset())
        if tag in _ENDS_P:
            close({"p"}, _SCOPE)
        if tag in _SIBLINGS:
            close(_SIBLINGS[tag], _SCOPE - {"td", "th"} if tag == "tr" else _SCOPE - {tag})
        node = Node(tag, _named(tag, m[3]) if m[3] else 0)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            if tag == "title" or tag == "textarea":
                node.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _named(tag: str, attributes: str) -> int:
    out = 0
    if tag in ("html", "body", "main"):
        return out
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.strip().lower()
            out = max(out, (2 if role in ("search", "navigation", "form", "complementary", "contentinfo") else 1) * (role in ROLES and tag not in PROSE))
            continue
        for name in value.split():
            words = [w for w in (x.lower() for x in _WORD.findall(name)) if w not in NEUTRAL]
            # a name is told by all of its words, or by the word that leads it or that it ends with
            if not words or not (NAMES.issuperset(words) or words[0] in LEADING or words[-1] in FIRM):
                continue
            telling = [w for w in words if w in FIRM]
            if tag in PROSE:
                out = max(out, 2 if ANYWHERE.intersection(words) else 1) if tag != "article" else out
            else:
                out = max(out, 2 if telling else 3 if SOFT.intersection(words) else 1, key=(0, 1, 3, 2).index)
    return out


def _is_noise(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED or (node.tag == "header" and not in_article):
        return True
    if node.named == 3 and (in_article or node.tag == "article"):
        return not _is_prose(node)
    return node.named == 2 or (node.named in (1, 3) and not in_article)


def _is_prose(node: Node) -> bool:
    """It holds a paragraph or the like, and less than half of its letters are links."""
    passage, letters, linked, todo = False, 0, 0, [(node, False)]
    while todo:
        n, link = todo.pop()
        passage, link = passage or n.tag in PASSAGES, link or n.tag in ("a", "button")
        for c in n.children:
            if isinstance(c, Node):
                todo.append((c, link))
            else:
                size = len("".join(c.split()))
                letters, linked = letters + size, linked + size * link
    return passage and 2 * linked < letters


def prune(root: Node) -> Node:
    """Takes out of a hashed tree the elements that go by their tag in any case."""
    todo = [root]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if not (isinstance(c, Node) and c.tag in DROPPED)]
        todo += [c for c in n.children if isinstance(c, Node)]
    return root


def pack(root: Node) -> bytes:
    """A tree's tags, keys, names and texts (white space in runs of one) in page order, compressed."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n is None:
            out.append(">")
        elif isinstance(n, str):
            out.append("t" + _SPACE.sub(" ", n))
        else:
            out.append(f"<{n.tag} {'' if n.key is None else n.key} {n.named or ''}")
            todo.append(None)
            todo += reversed(n.children)
    return zstandard.ZstdCompressor(level=3).compress(json.dumps(out, ensure_ascii=False).encode("utf-8", "surrogatepass"))


def unpack(data: bytes) -> Node:
    root = Node("")
    stack = [root]
    for x in json.loads(zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")):
        if x == ">":
            stack.pop()
        elif x[0] == "t":
            stack[-1].children.append(x[1:])
        else:
            tag, key, named = x[1:].split(" ")
            node = Node(tag, int(named or 0), int(key) if key else None)
            stack[-1].children.append(node)
            stack.append(node)
    return root.children[0]


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements from the leaves up, each with whether it lies in an article."""
    todo, out = [(root, False)], []
    while todo:
        n, inside = todo.pop()
        out.append((n, inside))
        inside = inside or n.tag in ("article", "main")
        todo += [(c, inside) for c in n.children if isinstance(c, Node)]
    return reversed(out)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashed(root: Node) -> Node:
    """Sets the hash of every subtree, and the key of those that may be templates."""
    for n, inside in _walk(root):
        h = xxhash.xxh64(n.tag.encode())
        for c in n.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little"))
            else:
                h.update(b"\x00" + " ".join(c.split()).encode())
        n.hash = h.intdigest()
        n.passages = n.tag in PASSAGES or any(isinstance(c, Node) and c.passages for c in n.children)
        if n.tag not in _KEPT_OPEN and n.tag not in VOID and not (inside and (n.passages or n.tag in PROSE)):
            n.key = _signed(n.hash)
    return root


def subtree_hashes(source: str | None) -> tuple[list[int], list[int], int]:
    """The distinct hashes (signed 64 bits) of a page's subtrees that may be templates: outside its articles, only inside, and a hash of all its articles."""
    outside, inside, articles = set(), set(), xxhash.xxh64()
    root = hashed(parse(source or ""))
    for n, within in _walk(root):
        if n.key is not None:
            (inside if within else outside).add(n.key)
        elif not within and n.tag in ("article", "main"):
            articles.update(n.hash.to_bytes(8, "little"))
    return sorted(outside), sorted(inside - outside), _signed(articles.intdigest())


def main_text(source: str | None, templates=(), names: bool = True) -> str:
    """The article's blocks, joined by blank lines, without the subtrees whose hashes are in templates."""
    return article_text(hashed(parse(source or "")), templates, names)


def article_text(root: Node, templates=(), names: bool = True) -> str:
    """The main text of a hashed tree: templates go first, then the article is chosen; names may be left unused."""
    gone = frozenset(templates)
    if gone:
        todo = [root]
        while todo:
            n = todo.pop()
            # where a template was, a block still ends
            n.children = [c if not (isinstance(c, Node) and c.key in gone) else "\x00" if c.tag in BLOCKS else "" for c in n.children]
            todo += [c for c in n.children if isinstance(c, Node)]
    articles, lesser, todo = [], [], [(root, False)]
    while todo:  # outermost articles in page order, and those that a name keeps apart; an article that is named as a comment or the like is none
        n, apart = todo.pop()
        if n.tag == "article" or (n.tag == "main" and not _holds(n, "article")):
            if not (names and n.named == 2):
                (lesser if apart or (names and n.named) else articles).append(n)
        elif n.tag not in DROPPED and n.tag != "header":
            todo += [(c, apart or (names and c.named > 0)) for c in reversed(n.children) if isinstance(c, Node)]
    if articles or not lesser:
        return _rendered(articles, root, names)
    # the page without what names keep apart, unless more text is there
    return max(_rendered([], root, names), _rendered(lesser, root, names), key=len)


def _rendered(articles: list[Node], root: Node, names: bool) -> str:
    blocks, line = [], []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    for top in articles or [root]:
        todo2: list = [top]
        while todo2:
            n = todo2.pop()
            if n is None or n == "\x00":
                end()
            elif isinstance(n, str):
                line.append(entities.unescape(n.replace("\x00", "\ufffd")))
            elif n is not top and (_is_noise(n, bool(articles)) if names else n.tag in DROPPED or (n.tag == "header" and not articles)):
                if n.tag in BLOCKS:
                    end()
            else:
                if n.tag == "br":
                    line.append("\n")
                elif n.tag in BLOCKS:
                    end()
                    todo2.append(None)
                todo2 += reversed(n.children)
        end()
    return "\n\n".join(blocks)


def _holds(node: Node, tag: str) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag == tag:
            return True
        todo += [c for c in n.children if isinstance(c, Node)]
    return False


def host(url: Column) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, url: str = "url", source: str = "html", many: int = MANY, keep_html: bool = True) -> DataFrame:
    """pages (without their html where keep_html is false) with text (main text, empty if none) and n_chars (its code points).

    A null page is an empty one; pages without a host are one site; copies of a page count once and get the same text;
    an empty table gives no rows. Existing columns text and n_chars are replaced, others pass through, whatever their names.
    """

    @F.pandas_udf("outside array<long>, inside array<long>, articles long")
    def hashes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([subtree_hashes(x) for x in part], columns=["outside", "inside", "articles"])

    @F.pandas_udf("binary")
    def trees(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([pack(prune(hashed(parse(x or "")))) for x in part], dtype=object)

    @F.pandas_udf("string")
    def texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tree, gone in parts:
            yield pd.Series([article_text(unpack(t), () if g is None else g.tolist()) for t, g in zip(tree, gone, strict=True)], dtype=object)

    # hosts are counted by a hash of their name, which keeps the many rows of subtrees small
    site, columns = F.xxhash64(host(F.col(url))), [c for c in pages.columns if (keep_html or c != source) and c not in ("text", "n_chars")] or pages.columns
    page = F.struct(F.xxhash64(F.lit(1), F.col(source)), F.xxhash64(F.lit(2), F.col(source)), site)
    seen = pages.select(site.alias("site"), page.alias("page"), hashes(F.col(source)).alias("of")).groupBy("page").agg(F.first("site").alias("site"), F.first("of").alias("of"))
    seen = kept(seen.select("page", "site", "of.*"), "pages")
    # a subtree outside articles counts once a page, one inside once for each different article; counts are partial before they travel
    outside = seen.select("site", F.explode("outside").alias("h")).groupBy("site", "h").agg(F.count(F.lit(1)).alias("n"))
    inside = seen.select("site", "articles", F.explode("inside").alias("h")).distinct().groupBy("site", "h").agg(F.count(F.lit(1)).alias("n"))
    templates = outside.unionByName(inside).groupBy("site", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= many)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt")
    each = seen.select("page", "site", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.concat("outside", "inside")).alias("h"))
    own = each.join(templates.select("site", "h", numbers(SALTS)), ["site", "h", "salt"]).groupBy("page").agg(F.collect_list("h").alias("gone"))
    # rows travel to their templates with packed trees; html itself is only moved if the caller keeps it
    rows = pages.select(F.struct(*columns).alias("row"), page.alias("page"), F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)).cast("int").alias("salt"), trees(F.col(source)).alias("tree"))
    got = rows.join(own.select("page", "gone", numbers(COPIES)), ["page", "salt"], "left").select("row", texts(F.col("tree"), F.col("gone")).alias("text"))
    return got.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in ("text", "n_chars")], "text", F.char_length("text").cast("long").alias("n_chars"))
