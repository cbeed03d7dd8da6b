"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags (name, class, id, role) and the text
runs between them. For every host, tokens with the same occurrence vector
(how often on which page of the host) form an equivalence class; the vector
is compared by its length and two additive hashes, so it is aggregated with
partial sums and never gathered, however many pages a host has. Classes of
tokens on at least ``SUPPORT`` of a host's pages are valid if they nest:
between two neighbouring tokens of one class, by mean position, another class
lies whole or not at all. Nested, the classes of the tags are the host's
template; its containers cut each page into slots.

A slot is judged by what it holds: text counts the less, the more of the
host's other pages have the same run, and links do not count. The main slot
is the innermost container of the template that holds most of what counts on
the page; a slot with less than that never wins, whatever it is called. All
runs inside the main slot are put out. A host with one page goes the same way:
its runs stand on no other page, its tags are all its template.

The lists of element names and of class, id and role words (``lists``) only
keep menus, adverts, reader comments and the like inside the main slot out of
the text, and out of the count.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat.llm.common import written

SUPPORT = 0.9
#: runs are told from the host's other pages from this share on; share of the
#: page's counted text that a container (an article or main element) must hold
REPEATED, HOLDS, HOLDS_MAIN = 0.5, 0.66, 0.5
#: template rows are broadcast up to this many tokens (8 bytes each)
BROADCAST_TOKENS = 4_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Names of HTML elements and of usual class, id and role words.
RAW = {"script", "style", "textarea", "noscript", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em",
          "font", "i", "img", "ins", "kbd", "mark", "q", "ruby", "s", "samp", "small", "span",
          "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SKIP_TAGS = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "header", "input",
             "label", "menu", "nav", "object", "option", "select", "svg", "title"}
SKIP_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner",
              "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "cookie",
              "cookies", "consent", "disqus", "footer", "form", "gdpr", "header", "login", "masthead",
              "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification",
              "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "search",
              "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
              "subscribe", "toolbar", "widget", "complementary", "contentinfo", "dialog", "alert"}
# words that a skip word may stand beside in one name (comment-list, left-sidebar)
BESIDE = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "group",
          "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel",
          "primary", "right", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper", "wide"}
COMMENT = {"comment", "comments", "commentlist", "disqus", "replies", "reply"}
# elements that hold a part of a text, never the whole
PART = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure",
        "figcaption", "caption", "tr", "td", "th", "thead", "tbody", "tfoot", "hr"}
MAIN = {"article", "main"}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def tokens(page: str):
    """(kind, name, words, text): kind "open", "close" or "text"; ``words``
    are the names in class, id and role. Comments, scripts and styles are left out."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", "", (), page[at:]
            return
        if m.start() > at:
            yield "text", "", (), page[at:m.start()]
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            yield "close", tag, (), ""
            continue
        attrs = m["attrs"]
        words = ()
        if "=" in attrs:
            words = tuple(w for a in ATTR.finditer(attrs) for w in (a[2] or a[3] or a[4] or "").lower().split())
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        yield "open", tag, words, ""
        if attrs.endswith("/") and tag not in VOID:
            yield "close", tag, (), ""


def flat(text: str) -> str:
    return " ".join(html.unescape(text).split())


def token_key(kind: str, name: str, words: tuple, text: str) -> int | None:
    if kind == "text":
        text = flat(text)
        if not text:
            return None
        name = "text:" + text
    else:
        name = f"{kind}:{name}:{' '.join(words)}"
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) - (1 << 63)


def occurrences(pages: DataFrame) -> DataFrame:
    """_host (64 hash bits), token, run (a text run, not a tag), n (pages),
    s1, s2 (hashes of the vector), at (sum of first positions); written."""
    def run(batches):
        for batch in batches:
            row, key, text, first, mark = [], [], [], [], []
            for i, t in enumerate(batch.column("html")):
                seen: dict[int, list] = {}
                for at, token in enumerate(tokens(t.as_py() or "")):
                    k = token_key(*token)
                    if k is not None:
                        if k in seen:
                            seen[k][1] += 1
                        else:
                            seen[k] = [at, 1, token[0] == "text"]
                page = batch.column("_page")[i].as_py()
                for k, (at, c, is_text) in seen.items():
                    row.append(i)
                    key.append(k)
                    text.append(is_text)
                    first.append(at)
                    mark.append(xxhash.xxh64_intdigest(f"{page}:{c}"))
            hosts = batch.column("_host").take(pa.array(row, pa.int64()))
            low = pa.array([m & 0x7FFFFFFF for m in mark], pa.int64())
            high = pa.array([m >> 33 for m in mark], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [hosts, pa.array(key, pa.int64()), pa.array(text, pa.bool_()), pa.array(first, pa.int64()), low, high],
                ["_host", "token", "run", "at", "s1", "s2"])

    schema = "_host long, token long, run boolean, at long, s1 long, s2 long"
    return written(pages.select("_host", "_page", "html").mapInArrow(run, schema)
                   .groupBy("_host", "token", "run")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
                        F.sum("at").alias("at")).filter("n > 1"), "occurrences")


def nested(classes: list[tuple[float, float, list[tuple[float, int]]]]) -> set[int]:
    """Tokens of the classes that nest; each class is its (position, token)
    list. Larger classes come first; one that would straddle the gaps of a
    class already in the template is left out."""
    template: list[list[float]] = []
    out: set[int] = set()
    for _, _, members in classes:
        places = sorted(p for p, _ in members)
        fits = True
        for other in template:
            inside = [sum(q < p for q in other) for p in places]
            around = {sum(p < q for p in places) for q in other}
            if len(set(inside)) > 1 and len(around) > 1:
                fits = False
                break
        if fits:
            template.append(places)
            out.update(t for _, t in members)
    return out


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """_h, template (array<long>: the tags of the host's template), runs
    (array<struct<token, share>>: text runs that many of the host's pages
    have), for the hosts of several pages. Only tokens on half of a host's
    pages are gathered, at most twice as many as on a page, so a host's row
    is bounded by the length of its pages."""
    sizes = (pages.groupBy(F.col("_host").alias("_h")).agg(F.count(F.lit(1)).alias("pages"))
             .filter("pages > 1"))
    common = (occurrences(pages).join(sizes, F.col("_host") == F.col("_h"))
              .filter(F.col("n") >= F.when(F.col("run"), REPEATED).otherwise(support) * F.col("pages")))
    share = (F.col("n") - 1) / (F.col("pages") - 1)
    runs = (common.filter("run").groupBy("_h")
            .agg(F.collect_list(F.struct("token", share.alias("share"))).alias("runs")))
    classes = (common.filter(~F.col("run")).groupBy("_h", "n", "s1", "s2")
               .agg(F.collect_list(F.struct((F.col("at") / F.col("n")).alias("place"), "token")).alias("members"))
               .groupBy("_h").agg(F.collect_list(F.struct("n", "members")).alias("classes")))

    def run(batches):
        for batch in batches:
            out = []
            for found in batch.column("classes").to_pylist():
                ranked = sorted(((-c["n"], -len(c["members"]), sorted((m["place"], m["token"]) for m in c["members"]))
                                 for c in found or ()))
                out.append(sorted(nested(ranked)))
            yield pa.RecordBatch.from_arrays([batch.column("_h"), pa.array(out, pa.list_(pa.int64()))],
                                             ["_h", "template"])

    valid = classes.mapInArrow(run, "_h long, template array<long>")
    return sizes.select("_h").join(valid, "_h", "left").join(runs, "_h", "left")


class Element:
    """A node of a page: its tag, its token, its parent and what was found of it."""

    __slots__ = ("name", "words", "key", "parent", "main", "link", "closed", "soft", "hard", "mass")

    def __init__(self, name, words, key, parent):
        self.name, self.words, self.key, self.parent = name, words, key, parent
        self.main = name in MAIN or parent is not None and parent.main      # it or an ancestor
        self.link = name == "a" or parent is not None and parent.link
        self.closed, self.soft, self.hard, self.mass = False, False, False, 0.0


def skipped_name(word: str) -> bool:
    """A class, id or role name that is a skip word, alone or beside words of
    place and form (``left-sidebar``, not ``no-sidebar`` or ``social-science``)."""
    parts = [w for w in re.split(r"[_-]+", word) if w]
    own = [w for w in parts if w in SKIP_WORDS]
    return bool(own) and all(w in SKIP_WORDS or w in BESIDE or w.isdigit() for w in parts)


def parsed(page: str, lists: bool = True):
    """(elements, items): the page's elements, parents first, and its sequence
    of ("text", element, text, inside a link) and ("block", None, "", False).

    With ``lists``, elements that hold no main text are marked: ``hard`` if
    they are closed (or reader comments), else ``soft``: an article that comes
    after an unclosed one is not held by it."""
    root = Element("", (), None, None)
    elements, items, stack = [root], [], [root]
    for kind, name, words, text in tokens(page):
        if kind == "text":
            items.append(("text", stack[-1], text, stack[-1].link))
            continue
        if name not in INLINE:
            items.append(("block", None, "", False))
        elif name == "br" and kind == "open":
            items.append(("text", stack[-1], " ", False))
        if kind == "open":
            if name in VOID:
                continue
            if name == "p":     # a paragraph ends the open one
                while stack[-1].name == "p" or stack[-1].name in INLINE:
                    stack.pop().closed = True
            stack.append(Element(name, words, token_key(kind, name, words, text), stack[-1]))
            elements.append(stack[-1])
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    stack[i].closed = True
                    del stack[i:]
                    break
    if lists:
        for e in elements[1:]:
            comment = any(w in COMMENT for x in e.words for w in re.split(r"[_-]+", x))
            own = ((e.name in SKIP_TAGS and not (e.name == "header" and e.parent.main))
                   or e.name not in ("body", "html", *MAIN) and any(map(skipped_name, e.words)) or
                   e.name in MAIN and comment)
            e.hard = e.parent.hard or own and (e.closed or comment)
            e.soft = (e.parent.soft and e.name not in MAIN) or own and not e.closed
    return elements, items


def main_slot(elements, items, template: frozenset | None, shares: dict) -> Element:
    """The innermost container that holds most of the page's counted text: an
    article or main element if one holds ``HOLDS_MAIN`` of it, else a container
    of the template (None: any) that holds ``HOLDS``."""
    for kind, e, text, linked in items:
        if kind == "text" and not linked and not (e.soft or e.hard):
            flat_text = flat(text)
            if flat_text:
                share = shares.get(token_key("text", "", (), text), 0.0) if shares else 0.0
                e.mass += len(flat_text) * (1.0 - share)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.mass += e.mass
    total = elements[0].mass
    best = elements[0]
    if total > 0:
        for e in elements[1:]:          # parents first: the innermost wins
            if e.soft or e.hard or e.name in INLINE or e.name in PART:
                continue
            if e.name in MAIN:
                if e.mass >= HOLDS_MAIN * total:
                    best = e
            elif e.mass >= HOLDS * total and (template is None or e.key in template) and not best.main:
                best = e
    return best


def main_text(page: str, template: frozenset | None = None, shares: dict | None = None, lists: bool = True) -> str:
    """The blocks of the page's main slot, by page order. ``template``: the
    tags of the host's template (None: the page is the host's only one);
    ``shares``: for text runs, the share of the host's other pages with them."""
    elements, items = parsed(page, lists)
    slot = main_slot(elements, items, template, shares or {})
    whole = slot.main
    within = {id(slot)}
    for e in elements:
        if e.parent is not None and id(e.parent) in within:
            within.add(id(e))
    blocks, run, linked, plain = [], [], 0, 0

    def flush():
        nonlocal run, linked, plain
        text = flat("".join(run))
        if text and (whole or plain or not linked):
            blocks.append(text)
        run, linked, plain = [], 0, 0

    for kind, e, text, in_link in items:
        if kind == "block":
            flush()
        elif id(e) in within and not (e.soft or e.hard):
            run.append(text)
            if text.strip():
                linked, plain = linked + in_link, plain + (not in_link)
    flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, support: float = SUPPORT, lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    A null html counts as empty (text empty); a null url, or one without
    "://", belongs to the host "". Repeated rows are pages each; a null
    page_id is kept; other columns are ignored; an empty table gives an empty
    result. Without ``lists`` the template alone decides.

    The templates are few against the pages; they are broadcast if they have
    at most ``BROADCAST_TOKENS`` tokens, so that the html does not move, and
    joined on the host otherwise (a join that can be split).
    """
    own = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("_host"),
                       F.xxhash64("page_id", "url").alias("_page"))
    found = written(templates(own, support), "templates")
    size = found.agg(F.sum(F.coalesce(F.size("template"), F.lit(0)) + 2 * F.coalesce(F.size("runs"), F.lit(0)))).first()[0]
    if (size or 0) <= BROADCAST_TOKENS:
        found = F.broadcast(found)
    both = (own.join(found, F.col("_host") == F.col("_h"), "left")
            .select("page_id", "url", "html", "_h", "template", "runs"))
    kinds = [pages.schema[c] for c in ("page_id", "url")]
    schema = T.StructType([*kinds, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = []
            for i, (page, h) in enumerate(zip(batch.column("html"), batch.column("_h").to_pylist())):
                if h is None:
                    template, shares = None, {}
                else:
                    if h not in known:
                        if len(known) > 256:
                            known.clear()
                        known[h] = (frozenset(batch.column("template")[i].as_py() or ()),
                                    {r["token"]: r["share"] for r in batch.column("runs")[i].as_py() or ()})
                    template, shares = known[h]
                texts.append(main_text(page.as_py() or "", template, shares, lists))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, schema)
