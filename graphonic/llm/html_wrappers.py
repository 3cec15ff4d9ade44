"""Main text of web pages by union-free wrapper inference.

A page becomes a tree of elements with text slots.  The wrapper of a host is
found by aligning its pages one after another: children that agree are
aligned in order (longest common subsequence of their keys: tag, id and whole
class names); what one side lacks becomes optional, what recurs becomes
repeated (a run of one element, or a span of elements as a repeated group of
optionals), and text slots whose text differs become variable.  Where names go
on differing (numbered posts), the keys of a tag become one.  So a wrapper is a
regular expression without unions whose size is bounded below each element,
however many pages it has seen, and merging two wrappers is the same operation
as merging a page into one.  Each task merges its own pages per host first, and
the tasks' wrappers are merged in two rounds, so a host with a third of all
pages is not gathered in one task.

The wrapper then says where the article is.  Text that is the same on all of
several pages is template.  An article-like element with a fair part of the
host's variable text is the article; else the element that holds most of the
variable text is, without the blocks in it that are template.  Menus, headers,
adverts and comments differ from page to page too: these are known by their
tags, roles and class words.  The wrapper overrules class words: an element
that holds most of the host's variable text stays, unless an article stands
beside it (see ``overruled``).

Defined results: a null or empty page gives an empty text; pages without a
host share one wrapper; unclosed tags close with their parents; elements
nested more than DEEPEST deep are read but not aligned; very long pages are
read whole; a page in which the wrapper's article is missing is read without
the parts that are boilerplate by name; of several equally good elements the
first in page order holds the article; repeated rows are pages of their own;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

WRAPPER_BYTES = 32_000_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tfoot"), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
LIMIT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

#: Elements that are never part of an article.
DROPPED_TAGS = frozenset("head nav footer aside form menu dialog button select input label fieldset legend datalist search audio video map".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar tablist status".split())
#: Words of class and id that name boilerplate.
DROPPED_WORDS = frozenset("ad ads adbox adslot adsense advert adverts advertisement advertising advertorial banner billboard breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright discussion disqus dialog footer footnav gdpr header masthead login menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay paginate pagination pager paywall popup promo promos promoted promotion recommended related replies reply respond rail share sharing sidebar sidebars sidenav signup skip skiplink social sponsor sponsored sponsors subscribe subscription taboola toast toolbar topbar widget widgets".split())
ARTICLE_WORDS = frozenset("article articlebody post postbody entry story content maincontent bodytext main".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Pages from which on a text that never differs is template.
LEAST_PAGES = 3
#: Share of the host's variable text from which on an article-like element is the article.
FAIR = 0.2
#: Keys below one element that differ in digits only, and of one tag, from which on they become one.
MANY, MANY_OF_TAG = 16, 64
#: Groups in which a host's wrappers are merged first.
SALTS = 64
#: How an element is boilerplate: by a part of a class name, by a whole class name, by tag, role or attribute.
PART, NAME, FIRM = 1, 2, 3
#: Share of an element's variable text from which article-like text beside it lets its name stand.
BESIDE = 0.1


class Node:
    """An element of a page: its key (tag and names), its children, or a text."""

    __slots__ = ("key", "kids", "tag", "dropped", "article", "own", "whole")

    def __init__(self, tag: str, key: str, dropped: int, article: bool):
        self.tag, self.key, self.dropped, self.article, self.kids = tag, key, dropped, article, []
        self.own = self.whole = ""


def digested(node: Node) -> Node:
    """Fill in own and whole: digests of an element's own text and of all text in it."""
    mine, all_ = [], []
    for kid in node.kids:
        if isinstance(kid, str):
            if text := kid.strip():
                mine.append(text)
                all_.append(text)
        elif kid.tag not in RAW:
            all_.append(f"<{kid.key}{digested(kid).whole}")
    node.own = xxhash.xxh64_hexdigest("\n".join(mine)) if mine else ""
    node.whole = xxhash.xxh64_hexdigest("\n".join(all_)) if any(all_) else ""
    return node


_SEEN: dict[tuple[str, str], tuple[str, int, bool]] = {}


def described(tag: str, attributes: str) -> tuple[str, int, bool]:
    """The key of an element, how it is boilerplate (0: not), and whether it is article-like but for that."""
    found = _SEEN.get((tag, attributes))
    if found is None:
        words, other, names, named, role, hidden, prop = set(), set(), set(), 0, "", False, ""
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = html.unescape(a or b or c), name.lower()
            if name in ("class", "id"):
                mark = "#" if name == "id" else "."
                for name in value.split():
                    names.add(mark + name.lower().replace("~", "-"))
                    parts = {w.lower() for w in (*_WORDS.findall(name), *re.split(r"[^A-Za-z-]+", name)) if w}
                    words |= parts
                    if parts & DROPPED_WORDS:
                        named = max(named, NAME if name.lower() in DROPPED_WORDS else PART)
                    else:
                        other |= parts
            elif name == "role":
                role = value.lower()
            elif name == "itemprop":
                prop = value.lower()
            else:
                hidden = hidden or name == "hidden" or value.lower() == "true"
        firm = tag in DROPPED_TAGS or role in DROPPED_ROLES or hidden
        dropped = FIRM if firm else 0 if tag in ("html", "body", "article", "main") else named
        article = not firm and (tag in ("article", "main") or role in ("article", "main") or prop == "articlebody" or bool((other if dropped else words) & ARTICLE_WORDS and tag in ("div", "section", "td")))
        key = tag + "".join(sorted(names)) if tag not in INLINE else tag
        found = key, dropped, article
        if len(_SEEN) > 50_000:
            _SEEN.clear()
        _SEEN[tag, attributes] = found
    return found


def forms(key: str, dropped: int, article: bool) -> tuple[str, str]:
    """What an element's key becomes where names differ: without digits, and the tag alone."""
    kind = f"~{dropped}{int(article)}"
    return re.sub(r"\d+", "0", key) + kind, re.split("[.#~]", key, maxsplit=1)[0] + "~" + kind


def tag_of(key: str) -> str:
    return re.split("[.#~]", key, maxsplit=1)[0]


def parse(source: str) -> Node:
    """The tree of a page."""
    root = Node("", "", 0, False)
    stack, at, low = [root], 0, None
    search = TOKEN.search

    def close(tags: tuple[str, ...], limit: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in limit:
                return

    while True:
        m = search(source, at)
        if m is None:
            if at < len(source):
                stack[-1].kids.append(source[at:])
            return root
        if m.start() > at:
            stack[-1].kids.append(source[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" or any(x.tag == tag for x in stack):
                close((tag,), ())
            continue
        key, dropped, article = described(tag, m[3])
        if tag in CLOSES_P:
            close(("p",), ("button", "td", "th", "table", "body"))
        elif tag in CLOSES_OWN:
            close(CLOSES_OWN[tag], LIMIT[tag])
            if tag == "tr":
                close(("tr",), LIMIT[tag])
        elif tag == "body":
            close(("head",), ())
        node = Node(tag, key, dropped, article)
        stack[-1].kids.append(node)
        if tag in RAW:
            low = source.lower() if low is None else low
            end = low.find(f"</{tag}", at) if len(low) == len(source) else -1
            if end < 0:
                found = re.compile(f"</{tag}", re.I).search(source, at)
                end = found.start() if found else len(source)
            at = end
            stack.append(node)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)


# A wrapper is [key, kids, chars, pages, article, dropped, own, whole]: kids is a list of
# [wrapper, optional, repeated, group]; elements of one repeated group share its number (0: none).
# own is the digest of the element's own text, whole that of all text in it, or None where it differs.


def of_page(node: Node) -> list:
    """The wrapper of a single page's element, whose digests are known."""
    kids: list[list] = []
    chars = 0
    for kid in node.kids:
        if isinstance(kid, str):
            chars += len(kid.strip())
        else:
            kids.append([of_page(kid), False, False, 0])
            chars += 0 if kid.dropped else kids[-1][0][2]
    return [node.key, folded(generalised(kids)), chars, 1, node.article, node.dropped, node.own, node.whole]


def merged(a: list, b: list) -> list:
    """The wrapper of what either of two wrappers of one key stands for."""
    return [a[0], folded(aligned(*alike(a[1], b[1]))), a[2] + b[2], a[3] + b[3], a[4], a[5], a[6] if a[6] == b[6] else None, a[7] if a[7] == b[7] else None]


def general_keys(keys: dict[str, tuple[str, str]]) -> dict[str, str]:
    """The general key of those keys, given with their forms, of which there are too many, or that became general before."""
    if len(keys) <= MANY and not any("~" in k for k in keys):
        return {}
    out: dict[str, str] = {}
    for form, most in ((0, MANY), (1, MANY_OF_TAG)):
        by: dict[str, set[str]] = {}
        for key, both in keys.items():
            by.setdefault(both[form], set()).add(key)
        for general, found in by.items():
            if len(found) > most or general in keys:
                out |= dict.fromkeys(found, general)
    return out


def alike(*sides: list[list]) -> tuple[list[list], ...]:
    """The sides' children with general keys where they are needed."""
    keys = {key: (key, key) if "~~" in key else forms(key.split("~")[0], dropped, article) for side in sides for (key, _, _, _, article, dropped, _, _), *_ in side}
    if general := general_keys(keys):
        return tuple([[[general.get(kid[0][0], kid[0][0]), *kid[0][1:]], *kid[1:]] for kid in side] for side in sides)
    return sides


def generalised(kids: list[list]) -> list[list]:
    return alike(kids)[0]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two sequences of children as one: what agrees is merged, the rest is optional."""
    ka, kb = [x[0][0] for x in a], [x[0][0] for x in b]
    if ka == kb:
        return [[merged(x[0], y[0]), x[1] or y[1], x[2] or y[2], max(x[3], y[3])] for x, y in zip(a, b)]
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [[merged(x[0], y[0]), x[1] or y[1], x[2] or y[2], max(x[3], y[3])] for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [[x[0], True, x[2], x[3]] for x in (*a[i:j], *b[k:m])]
    return out


def folded(kids: list[list]) -> list[list]:
    """Make repeated what recurs: every key is left once; a span of recurring keys is one group."""
    first: dict[str, int] = {}
    spans: list[list[int]] = []
    for i, kid in enumerate(kids):
        if (at := first.setdefault(kid[0][0], i)) != i:
            spans.append([at, i])
    if not spans:
        return kids
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, at = [], 0
    for n, (a, b) in enumerate(joined, 1):
        out += kids[at:a]
        by: dict[str, list] = {}
        for kid in kids[a : b + 1]:
            x = by.get(kid[0][0])
            by[kid[0][0]] = [merged(x[0], kid[0]), True, True, 0] if x else list(kid)
        several = len(by) > 1
        out += [[x[0], several or x[1], True, n if several else 0] for x in by.values()]
        at = b + 1
    return out + kids[at:]


def overruled(wrapper: list) -> set[str]:
    """Keys of elements that stay although a class word names them boilerplate; the wrapper is changed accordingly.

    Such an element holds most of the host's variable text, and no article
    stands beside it; or only a part of a class name is a listed word, and an
    article-like element holds most of the text in it.
    """
    known: dict[int, int] = {}

    def variable(w: list) -> int:
        if id(w) not in known:
            own = w[2] - sum(k[2] for k, _, _, _ in w[1] if not k[5])
            known[id(w)] = 0 if constant(w, 7) else (0 if constant(w, 6) else own) + sum(variable(k) for k, _, _, _ in w[1] if k[5] < FIRM)
        return known[id(w)]

    def articles(w: list, without: list | None = None) -> int:
        """Variable text in the largest article-like element below, without one element's."""
        most = 0
        for k, _, _, _ in w[1]:
            if k is not without and not k[5]:
                mine = variable(k) - (variable(without) if without is not None and any(k is x for x in chain) else 0)
                most = max(most, mine if k[4] else 0, articles(k, without))
        return most

    total, now, chain, keys = variable(wrapper), wrapper, [wrapper], set()
    while True:
        most = next((k for k, _, _, _ in now[1] if k[5] < FIRM and 2 * variable(k) > total), None)
        if most is None:
            return keys
        if most[5]:
            inside = most[5] == PART and (most[4] or 2 * articles(most) > variable(most))
            if not inside and articles(wrapper, most) >= BESIDE * variable(most):
                return keys
            keys.add(most[0])
            most[5] = 0
            for w in chain:
                w[2] += most[2]
        chain.append(most)
        now = most


def constant(w: list, slot: int) -> bool:
    """Whether a text (6: the element's own, 7: all in it) is known to be the same on all of several pages."""
    return w[slot] is not None and w[3] >= LEAST_PAGES


def variable_text(wrapper: list) -> dict[int, int]:
    """Characters that differ from page to page, without dropped elements, by id of wrapper element."""
    known: dict[int, int] = {}

    def walk(w: list) -> int:
        below = [(kid[2], walk(kid)) for kid, _, _, _ in w[1] if not kid[5]]
        own = w[2] - sum(all_ for all_, _ in below)
        known[id(w)] = 0 if constant(w, 7) else (0 if constant(w, 6) else own) + sum(x for _, x in below)
        return known[id(w)]

    if not walk(wrapper):  # all pages are the same: nothing can be told apart

        def all_text(w: list) -> None:
            known[id(w)] = w[2]
            for kid, _, _, _ in w[1]:
                all_text(kid)

        all_text(wrapper)
    return known


def article_path(wrapper: list) -> tuple[list[str], set[tuple[tuple[str, ...], str]]]:
    """Keys from the root's child to the element that holds the article, and the template blocks in it.

    These are given as (keys from the article on, digest); an article-like
    element has none.
    """
    variable = variable_text(wrapper)
    best: tuple[int, int, list[str]] = (0, 0, [])

    def named(w: list, path: list[str]) -> None:
        nonlocal best
        for kid, _, _, _ in w[1]:
            if kid[5]:
                continue
            here = [*path, kid[0]]
            # An article element counts before an element that only has an article's name; more text wins.
            if kid[4] and kid[2]:
                rank = kid[2] * (3 if tag_of(kid[0]) == "article" else 1)
                if rank > best[0]:
                    best = rank, variable.get(id(kid), 0), here
            named(kid, here)

    named(wrapper, [])
    if best[2] and best[1] >= FAIR * variable[id(wrapper)]:
        return best[2], set()
    path, now = [], wrapper
    while True:
        blocks = [k for k, _, _, _ in now[1] if not k[5] and tag_of(k[0]) not in INLINE]
        top = max(blocks, key=lambda k: variable[id(k)], default=None)
        headed = any(k is not top and variable[id(k)] and tag_of(k[0]) in ("h1", "h2", "h3") for k in blocks)  # a title beside its text
        if top is None or headed or variable[id(top)] < 0.6 * max(variable[id(now)], 1) or tag_of(top[0]) in ("p", "ul", "ol", "table", "pre", "blockquote", "h1", "h2"):
            break
        path, now = [*path, top[0]], top
    found: set[tuple[tuple[str, ...], str]] = set()

    def template(w: list, at: tuple[str, ...]) -> None:
        for kid, _, repeated, _ in w[1]:
            if not repeated and tag_of(kid[0]) not in INLINE:
                if constant(kid, 7) and kid[7]:
                    found.add(((*at, kid[0]), kid[7]))
                else:
                    template(kid, (*at, kid[0]))

    if variable[id(wrapper)] < wrapper[2]:
        template(now, ())
    return path, found


def is_at(node: Node, key: str) -> bool:
    """Whether a wrapper's key stands for an element."""
    return node.key == key or "~" in key and key in forms(node.key, node.dropped, node.article)


def text_of(root: Node, path: list[str], template: set[tuple[tuple[str, ...], str]], stays: set[str] = frozenset()) -> str:
    """The article's text: blocks in page order, joined by one space; ``stays`` are the keys that the wrapper overrules."""
    tops = [root]
    dropped = lambda kid: kid.dropped == FIRM or kid.dropped and not any(is_at(kid, key) for key in stays)
    for key in path:
        below = [kid for node in tops for kid in node.kids if not isinstance(kid, str) and is_at(kid, key) and not dropped(kid)]
        if not below:
            tops, template = [root], set()
            break
        tops = below
    out: list[str] = []

    def walk(node: Node, at: tuple[str, ...]) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                out.append(kid)
            elif not dropped(kid):
                here = (*at, kid.key) if template else at
                if template and (here, kid.whole) in template:
                    continue
                inline = kid.tag in INLINE
                if not inline:
                    out.append("\n")
                walk(kid, here)
                if not inline:
                    out.append("\n")

    for top in tops:
        out.append("\n")
        walk(top, ())
    return " ".join(html.unescape("".join(out)).split())


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _deep(f):
    """Run with room for deeply nested pages."""
    import sys

    def run(*args):
        if sys.getrecursionlimit() < 20_000:
            sys.setrecursionlimit(20_000)
        return f(*args)

    return run


DEEPEST = 400


def tree(source: str) -> Node:
    """The tree of a page; what lies deeper than DEEPEST elements is hung at that depth."""
    root = parse(source)
    queue = [(root, 0)]
    while queue:
        node, depth = queue.pop()
        if depth >= DEEPEST:
            flat: list = []
            todo = list(reversed(node.kids))
            while todo:
                kid = todo.pop()
                if isinstance(kid, str):
                    flat.append(kid)
                elif not kid.dropped:
                    todo += ["\n", *reversed(kid.kids), "\n"] if kid.tag not in INLINE else reversed(kid.kids)
            node.kids = flat
        else:
            queue += [(kid, depth + 1) for kid in node.kids if not isinstance(kid, str)]
    return _deep(digested)(root)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each host over one task's pages."""
    known: dict[str, list] = {}
    work = _deep(lambda a, b: merged(a, b) if a else b)
    for batch in batches:
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host = host_of(url)
            known[host] = work(known.get(host), _deep(of_page)(tree(source or "")))
            if len(known) > 20_000:
                yield _wrappers(known)
                known.clear()
    if known:
        yield _wrappers(known)


def _wrappers(known: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": list(known), "wrapper": [_deep(json.dumps)(w) for w in known.values()]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of all hosts; ``pages`` has url and html."""
    import pandas as pd

    def gathered(frame: pd.DataFrame) -> pd.DataFrame:
        now = None
        for text in sorted(frame["wrapper"]):
            w = _deep(json.loads)(text)
            now = w if now is None else _deep(merged)(now, w)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [_deep(json.dumps)(now)]})

    partial = pages.select("url", F.col("html").cast("string").alias("html")).mapInArrow(_infer, "host string, wrapper string")
    salted = partial.groupBy("host", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).applyInPandas(gathered, "host string, wrapper string")
    return salted.groupBy("host").applyInPandas(gathered, "host string, wrapper string")


def extract(pages: DataFrame, wrapper_bytes: int = WRAPPER_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    found = written(wrappers(pages), "wrappers")
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= wrapper_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in found.collect()})
        lookup = lambda host, _: shared.value.get(host, "null")
    else:
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        pages = pages.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "wrapper")
        lookup = lambda _, wrapper: wrapper or "null"
    with_wrapper = "wrapper" in pages.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[str, tuple[list[str], set, set[str]]] = {}
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = []
                given = batch.column(3).to_pylist() if with_wrapper else [None] * batch.num_rows
                for url, source, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), given):
                    host = host_of(url)
                    if host not in plans:
                        if len(plans) > 20_000:
                            plans.clear()
                        w = _deep(json.loads)(lookup(host, own))
                        stays = _deep(overruled)(w) if w else set()
                        plans[host] = (*(_deep(article_path)(w) if w else ([], set())), stays)
                    texts.append(_deep(text_of)(tree(source or ""), *plans[host]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(kernel, "page_id bigint, url string, text string, n_chars bigint")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
