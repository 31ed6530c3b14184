"""Main text of web pages by equivalence-class template deduction.

Tokens are the structural containers of a page, named by their path, so they
nest, and the texts of its blocks with the path they stand at. For every host,
tokens that occur equally often on the same pages (equal occurrence vectors,
compared by a sum of hashes, so no vector is ever gathered) form a class;
classes of enough tokens on enough of the host's pages are valid and make up
the host's template. Extraction leaves out the blocks that belong to it, in
article and main too. Before that, tags and whole names decide: boilerplate by
what a block is nested in, and article or main where a page has them.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

#: A class is valid from so many tokens, pages, and share of the host's pages.
MIN_TOKENS, MIN_PAGES, MIN_SHARE = 3, 3, 0.5
#: Templates up to this many bytes are broadcast; larger ones are joined by host.
BROADCAST_BYTES = 8 << 20

# HTML element names by how they are read.
RAW = frozenset("script style textarea title noscript template iframe svg select object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html head body div section article main nav header footer aside ul ol dl table form menu dialog button fieldset details".split())
#: Closed by the next of their kind, and all of them by the end of what they stand in.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
BOILERPLATE_TAGS = frozenset("head nav footer aside form menu dialog button".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice alert popup modal newsletter subscribe "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer copyright comment comments reply replies discussion disqus share social "
    "related recommended widget search login signup form".split()
)
MAIN = frozenset(["article", "main"])
#: Never boilerplate by name; boilerplate unless the page is wrapped in them.
NEVER, WRAPPER_TAGS = frozenset(["html", "body", "article", "main"]), frozenset(["form", "menu", "dialog"])

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split("[/?#]", rest, maxsplit=1)[0].lower()


def names_in(attributes: str) -> str:
    """Values of class, id and role, in fixed order."""
    named = ((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes))
    return " ".join(sorted(value for name, value in named if value and name in ("class", "id", "role")))


def is_boilerplate_name(word: str) -> bool:
    """Names count as wholes: has-sidebar and search-results name what a container has or lists, ad-banner what it is."""
    return all(x in BOILERPLATE_NAMES for x in re.split(r"[_\-]+", word))


class Container:
    __slots__ = ("tag", "path", "parent", "own", "soft", "boilerplate", "main")

    def __init__(self, tag: str, names: str, parent: Container | None):
        self.tag = tag
        self.path = (parent.path + ">" if parent else "") + tag + ("." + names if names else "")
        self.parent = parent
        words = names.lower().split()
        self.main = bool(parent and parent.main) or tag in MAIN or "main" in words
        named = tag not in NEVER and any(w == "header" and not self.main or is_boilerplate_name(w) for w in words)
        hard = (tag in BOILERPLATE_TAGS and tag not in WRAPPER_TAGS) or (tag == "header" and not self.main)
        self.soft = not hard and (named or tag in WRAPPER_TAGS)
        self.own = hard or self.soft
        self.boilerplate = bool(parent and parent.boilerplate) or self.own

    def ancestors(self):
        """The container and those around it."""
        c = self
        while c:
            yield c
            c = c.parent


def unwrap(blocks: list[tuple[Container | None, str]], opened: list[Container]) -> None:
    """Takes the mark of names and forms off containers that the page itself is wrapped in.

    These are forms around more than half of the text, containers around the
    only articles and more than half of the text, and, where nothing else is
    left, the outermost ones. Text in boilerplate by its tag doesn't count.
    """
    if not any(c.soft for c in opened):
        return
    inside: dict[Container, int] = {}
    whole = 0
    for c, t in blocks:
        around = list(c.ancestors()) if c else []
        if not any(x.own and not x.soft for x in around):
            whole += len(t)
            for x in around:
                inside[x] = inside.get(x, 0) + len(t)

    def lift(some):
        for c in some:
            c.own = c.soft = False
        for c in opened:  # parents open before their children
            c.boilerplate = bool(c.parent and c.parent.boilerplate) or c.own

    lift([c for c in opened if c.soft and c.tag in WRAPPER_TAGS and 2 * inside.get(c, 0) > whole])
    if not any(c and c.main and not c.boilerplate for c, _ in blocks):
        holding = {x for c, _ in blocks if c and c.main for x in c.ancestors()}
        lift([c for c in opened if c.soft and c in holding and 2 * inside.get(c, 0) > whole])
    while whole and not any(not (c and c.boilerplate) for c, _ in blocks):
        lift([c for c in opened if c.soft and inside.get(c) and not (c.parent and c.parent.boilerplate)])


def blocks_of(page: str) -> tuple[list[tuple[Container | None, str]], list[Container]]:
    """(container, text) of every block in page order, and every container that opens."""
    stack: list[Container] = []
    opened, blocks, parts = [], [], []

    def end_block():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((stack[-1] if stack else None, text))
            parts.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing = m[1] or m[4]
        if not tag:
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            # What it holds is no text; without an end only the tag itself goes, and the code that follows it.
            if not closing and not (m[3] or m[6] or "").rstrip().endswith("/") and not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = page.find("<", at) if "<" in page[at:] else size
            continue
        end_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in OPEN_ENDED and stack[k].tag not in OPEN_ENDED:
                    break
            continue
        if tag in VOID:
            continue
        while stack and stack[-1].tag in OPEN_ENDED and (stack[-1].tag == tag or stack[-1].tag == "p"):
            stack.pop()
        names = names_in(m[3] if m[2] else m[6] or "")
        # Elements that only hold a block open a container where their own name says that they are boilerplate.
        if tag in CONTAINERS or any(map(is_boilerplate_name, names.lower().split())):
            stack.append(Container(tag, names, stack[-1] if stack else None))
            opened.append(stack[-1])
    end_block()
    unwrap(blocks, opened)
    return blocks, opened


def text_token(c: Container | None, text: str) -> str:
    """A block's words with their path as one token."""
    return f"{c.path if c else ''}\0{xxhash.xxh3_64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def content(page: str, template: frozenset[str] | set[str] = frozenset()) -> str:
    """Text of the content slots. ``template``: the text tokens of the host's template.

    Content is all of article and main, or everything on pages without these,
    less boilerplate and less the blocks that belong to the template. A page
    whose blocks all do keeps them: it repeats as a whole.
    """
    blocks, _ = blocks_of(page)
    blocks = [(c, t) for c, t in blocks if not (c and c.boilerplate)]
    blocks = [(c, t) for c, t in blocks if c and c.main] or blocks
    own = [t for c, t in blocks if text_token(c, t) not in template]
    return " ".join(own or [t for _, t in blocks])


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token (path, or path and text of a block), page (hash), times, is_text."""

    def make():
        def step(batch):
            out = {k: [] for k in ("host", "token", "page", "times", "is_text")}
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, opened = blocks_of(page)
                key = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) >> 1
                seen = Counter((c.path, False) for c in opened)
                seen.update((text_token(c, t), True) for c, t in blocks if not (c and c.boilerplate))
                for (token, is_text), times in seen.items():
                    for name, value in zip(out, (host_of(url), token, key, times, is_text), strict=True):
                        out[name].append(value)
            return out

        return step

    return map_rows(pages, "host string, token string, page long, times long, is_text boolean", make)


def templates(pages: DataFrame) -> DataFrame:
    """host, texts: the text tokens of the valid classes of each host.

    Pages of equal html count once in a vector. Tokens of fewer than MIN_PAGES
    pages can't be in a valid class and are left out early.
    """
    seen = occurrences(pages).dropDuplicates(["host", "token", "page"])
    vector = F.sum(F.xxhash64("page", "times").cast("decimal(38,0)")).alias("vector")
    tokens = seen.groupBy("host", "token", "is_text").agg(vector, F.count("*").alias("pages"))
    tokens = written(tokens.where(F.col("pages") >= MIN_PAGES), "tokens")
    total = tokens.groupBy("host").agg(F.max("pages").alias("of"))
    classes = tokens.groupBy("host", "vector").agg(F.count("*").alias("size"), F.max("pages").alias("support")).join(total, "host")
    valid = classes.where((F.col("size") >= MIN_TOKENS) & (F.col("support") >= MIN_SHARE * F.col("of")))
    kept = tokens.where("is_text").join(valid.select("host", "vector"), ["host", "vector"])
    return kept.groupBy("host").agg(F.collect_list("token").alias("texts"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: ``id_col``, ``url_col``, text, n_chars.

    Null and empty html give an empty text; null URLs share the empty host.
    Pages of any length are read whole, repeated rows each, and regions of
    equal weight are all content; columns other than the three are ignored,
    whatever their names; an empty table gives no rows. A host's template has
    only texts of half of its pages, so its size is bounded by that of a page.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = written(templates(rows.select("url", "html")), "templates")
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length(F.to_json("texts"))).alias("n")).first()["n"] or 0
    rest = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    hosted = rows.withColumn("host", F.lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)))
    joined = hosted.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left").select("id", "url", "html", "texts")

    def make():
        def step(batch):
            texts = []
            for page, template in zip(batch.column("html").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                texts.append(content(page, set(template or ())))
            return {"id": batch.column("id"), "url": batch.column("url"), "text": texts}

        return step

    kind = pages.schema[id_col].dataType.simpleString()
    out = map_rows(joined, f"id {kind}, url string, text string", make)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
