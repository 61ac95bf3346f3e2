"""Main text of web pages, by removing what a site's pages share.

A single pass over a page's tags keeps a stack of open elements. When a block element closes, its subtree's digest is
made of its name, its texts (white space collapsed, attributes left out) and its children's digests, with the
host; one that holds nothing but links has a second digest, of its structure alone, as menus keep their form while labels change.
Spark counts on how many different articles of the host a subtree
occurs, and on how many of them outside of article and main; joined by that digest, a second pass deletes subtrees that recur.
Tags, roles and class names that say that an element isn't article come on top of it, as most pages have
subtrees of their own, too. What is left of the article (else of main, else of the page) is joined block by block.
The time is linear in the page's length, whatever it holds.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, scratch, stash

#: A subtree is template if it occurs with so many different articles of the host, mostly apart from their text, or outside the article with so many.
LEAST_PAGES, LEAST_OUTSIDE = 4, 2
#: Pages with templates whose hashes (8 bytes each) may be broadcast; beyond, the pages are shuffled and joined.
BROADCAST = 500_000

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""=\s*(["'])""")
_ATTRS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)

#: Fixed values of HTML and ARIA.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption legend option optgroup tbody td tfoot th thead tr li dd dt".split()) | frozenset("li dd dt".split())
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_TAGS = frozenset("script style noscript template nav footer aside form button select textarea input title iframe noembed noframes svg canvas object menu dialog head search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar comment comments "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended footer pagination pager "
    "widget toolbar login signup disqus respond reply replies alert skip".split()
)
#: Ends of compound class names that keep the meaning of their beginning, and beginnings that say that something else has it.
_SHELLS = frozenset("area bar block box button buttons container content form inner item items link links list message module section text title wrap wrapper".split())
_STATES = frozenset("has have with without no not is js show hide".split())
_KEPT_WHOLE = frozenset("html body article main".split())
#: Elements of running text, which in an article stay whatever their class.
_RUNNING = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dt dd td th figcaption".split())
_PARTS = re.compile(r"[^a-z0-9]+")
#: Of the page's text an article, or main, must have this share to stand for it.
LEAST_SHARE = 0.2


def says_not_article(name: str) -> bool:
    """Whether a class or id, lower-cased, names something else than article: by its last part, or the first one if the last only says that it holds it."""
    parts = [x for x in _PARTS.split(name) if x]
    if not parts or parts[0] in _STATES:
        return False
    return parts[-1] in DROPPED_WORDS or parts[0] in DROPPED_WORDS and parts[-1] in _SHELLS


class Frame:
    """An open element."""

    __slots__ = ("name", "first", "dropped", "by_class", "within_dropped", "articles", "mains", "saved", "texts", "parts", "shape", "plain", "linked")

    def __init__(self, name: str, first: int, dropped: bool, by_class: bool, within_dropped: bool, articles: int, mains: int, saved: list | None, texts: int) -> None:
        self.name, self.first, self.dropped, self.by_class, self.within_dropped = name, first, dropped, by_class, within_dropped
        self.articles, self.mains, self.saved, self.texts = articles, mains, saved, texts
        self.parts: list[str] = []
        self.shape: list[str] = []
        self.plain = self.linked = False


class Page:
    """One pass over a page: text blocks, and of block subtrees the digest, whether in article or main, whether apart from the text there, and whether what tags and class names drop has it."""

    def __init__(self, html: str, recurring: frozenset[int] = frozenset(), host: str = "") -> None:
        self.html, self.recurring, self.host = html, recurring, host.encode("utf-8", "surrogatepass") + b"\0"
        self.out: list[str] = []
        self.found: list[list] = []
        self.articles: list[list[str]] = []
        self.spare: list[list[str]] = []  # articles in elements that a class name drops
        self.mains: list[list[str]] = []
        self.stack: list[Frame] = []
        self.heads: list[Frame] = []
        self.depth = {"article": 0, "main": 0, "a": 0}
        self.begun: list[int] = []  # texts before each open article or main
        self.open_names: dict[str, int] = defaultdict(int)
        self.scopes: list[dict[str, int]] = [defaultdict(int)]  # the same since the last element that other end tags don't reach beyond
        self.texts = self.last = 0
        self.none_left = {'"': len(html) + 1, "'": len(html) + 1}
        self.run()

    def tag_end(self, at: int) -> int:
        """Place after the tag whose name ends at `at`; -1 without an end. A quote that never closes is none."""
        html, end = self.html, -1
        while True:
            if end < at:
                end = html.find(">", at)
                if end < 0:
                    return -1
            quote = _QUOTED.search(html, at, end) if end > at else None
            if not quote:
                return end + 1
            mark = quote[1]
            close = html.find(mark, quote.end()) if quote.end() < self.none_left[mark] else -1
            if close < 0:
                self.none_left[mark] = min(self.none_left[mark], quote.end())
                at = quote.end()
            else:
                at = close + 1

    def run(self) -> None:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            i = html.find("<", at)
            if i < 0:
                break
            if html.startswith(("<!", "<?"), i):
                self.text(html[at:i])
                comment = html.startswith("<!--", i)
                end = html.find("-->" if comment else ">", i + (4 if comment else 2))
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            m = _NAME.match(html, i)
            if not m:
                self.text(html[at : i + 1])
                at = i + 1
                continue
            after = m.end()
            end = after + 1 if html[after : after + 1] == ">" else self.tag_end(after)
            if end < 0:
                break
            if i > at:
                self.text(html[at:i])
            at = end
            closes, name = m.groups()
            name = name.lower()
            self.tag(name, bool(closes), html[after : end - 1])
            if not closes and name in RAW and self.stack and name == self.stack[-1].name:
                stop = re.compile(rf"</{re.escape(name)}[\s/>]|</{re.escape(name)}\Z", re.I).search(html, at)
                at = stop.start() if stop else n
        self.text(html[at:])
        while self.stack:
            self.close()

    def tag(self, name: str, ends: bool, attrs: str) -> None:
        if ends:
            self.end(name)
            return
        if name in CLOSES_P or name in PEERS:
            self.imply(name)
        if name in BLOCK:
            self.out.append("\n")
        if name in VOID:
            self.out.append("\n" if name == "hr" else " " if name == "br" else "")
        elif not (attrs.endswith("/") and name in ("svg", "path")):
            self.open(name, attrs)

    def text(self, raw: str) -> None:
        if not raw or self.stack and self.stack[-1].name in RAW:
            return
        text = unescape(raw) if "&" in raw else raw
        self.out.append(text)
        bare = " ".join(text.split())
        if bare:
            self.texts += 1
            if self.stack:
                own = self.stack[-1]
                own.parts.append(bare)
                if self.depth["a"]:
                    own.linked = True
                else:
                    own.plain = True

    def imply(self, name: str) -> None:
        """Closes an open p, or the open peers, that this start tag ends."""
        peers, scope = PEERS.get(name, ()), SCOPE.get(name, ())
        if peers and any(map(self.open_names.__getitem__, peers)):
            at = None
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name in scope:
                    break
                if self.stack[i].name in peers:
                    at = i
            while at is not None and len(self.stack) > at:
                self.close()
        if name in CLOSES_P and self.open_names["p"]:
            for i in range(len(self.stack) - 1, -1, -1):
                own = self.stack[i].name
                if own == "p":
                    while len(self.stack) > i:
                        self.close()
                    break
                if own in BLOCK or own in ("button", "object"):
                    break

    def open(self, name: str, attrs: str) -> None:
        by_tag, by_class, head = name in DROPPED_TAGS, False, name == "header"
        within = bool(self.depth["article"] or self.depth["main"])
        if attrs and name not in _KEPT_WHOLE:
            for key, *values in _ATTRS.findall(attrs):
                key, value = key.lower(), "".join(values).lower()
                if key in ("class", "id"):
                    by_class |= not (within and name in _RUNNING) and any(map(says_not_article, value.split()))
                    head |= "header" in value.split()
                elif key == "role":
                    by_tag |= value.strip() in DROPPED_ROLES
                elif key == "style":
                    by_tag |= "display:none" in value.replace(" ", "")
                else:
                    by_tag |= value != "false" and (key == "hidden" or value == "true")
        above = self.stack[-1] if self.stack else None
        frame = Frame(name, len(self.out), by_tag or by_class, by_class and not by_tag, above is not None and (above.dropped or above.within_dropped), len(self.articles), len(self.mains), [] if head else None, self.texts)
        self.stack.append(frame)
        self.open_names[name] += 1
        self.scopes[-1][name] += 1
        if name in _BARS:
            self.scopes.append(defaultdict(int))
        if head:
            self.heads.append(frame)
        if name in self.depth:
            self.depth[name] += 1
            if name != "a":
                self.begun.append(self.texts)

    def end(self, name: str) -> None:
        """Closes the innermost element of that name; end tags of most names don't reach out of article, main, table or body."""
        far = name in _FAR
        if not (self.open_names if far else self.scopes[-1])[name] and not (name in _BARS and self.open_names[name]):
            return
        while self.stack[-1].name != name:
            self.close()
        self.close()

    def close(self) -> None:
        own = self.stack.pop()
        name = own.name
        if name in _BARS:
            self.scopes.pop()
        self.scopes[-1][name] -= 1
        self.open_names[name] -= 1
        if own.saved is not None:
            self.heads.pop()
        digest = xxhash.xxh3_64_hexdigest(f"{name}\0{chr(31).join(own.parts)}".encode("utf-8", "surrogatepass"))
        # only links have use for it, and what holds plain text is in no such subtree
        shape = "" if own.plain else xxhash.xxh3_64_hexdigest(f"{name}\0{''.join(own.shape)}")
        dropped = own.dropped
        if name in BLOCK:
            self.out.append("\n")
            if name not in _KEPT_WHOLE and name != "head" and self.texts > own.texts:
                keys = [self.key(b"t", digest)]
                within = bool(self.depth["article"] or self.depth["main"])
                if own.linked and not own.plain:
                    keys.append(self.key(b"s", shape))
                if self.recurring:
                    dropped |= any(k in self.recurring for k in keys[: 1 if within else 2])
                else:
                    # first, or no text outside of links; those that are last turn out when the article closes
                    apart = not within or own.texts == self.begun[-1] or not own.plain
                    for k in keys[: 1 if within else 2]:
                        self.found.append([k, within, apart, dropped or own.within_dropped, self.texts])
        if self.stack:
            above = self.stack[-1]
            above.parts.append(f"<{digest}>")
            above.shape.append(shape)
            above.plain |= own.plain
            above.linked |= own.linked
        if own.saved is not None and not dropped:
            self.out[own.first :] = own.saved if self.depth["article"] or self.depth["main"] else []
            self.out.append("\n")
        if dropped:
            if own.by_class:
                self.spare += self.articles[own.articles :]
            del self.out[own.first :], self.articles[own.articles :], self.mains[own.mains :]
            self.out.append("\n" if name in BLOCK else "")
        elif name in HEADINGS and self.heads:
            self.heads[0].saved.extend(["\n", *self.out[own.first :], "\n"])
        if name in self.depth:
            self.depth[name] -= 1
            if name != "a":
                self.begun.pop()
                for k in range(len(self.found) - 1, self.last - 1, -1):
                    if self.found[k][4] != self.texts or not self.found[k][1]:
                        break
                    self.found[k][2] = True
                self.last = len(self.found)
                if not self.depth[name] and not dropped:
                    (self.articles if name == "article" else self.mains).append(self.out[own.first :])

    def key(self, kind: bytes, digest: str) -> int:
        return xxhash.xxh3_64_intdigest(self.host + kind + digest.encode()) - (1 << 63)

    def main(self) -> str:
        """Of articles, articles that a class name's drop had taken, mains and the whole the first that has enough of the text."""
        whole = _blocks(self.out)
        for pieces in (sum(self.articles, []), sum(self.spare, []), sum(self.mains, [])):
            text = _blocks(pieces)
            if text and len(text) >= LEAST_SHARE * len(whole):
                return text
        return whole


#: Elements that other elements' end tags don't reach beyond, and those whose end tags reach anywhere.
_BARS = frozenset("article main table body".split())
_FAR = frozenset("html body article main table div section".split())


def _blocks(pieces: list[str]) -> str:
    blocks = (" ".join(b.split()) for b in re.split("\n(?<=\n)", _joined(pieces)))
    return "\n".join(b for b in blocks if b)


def _joined(pieces: list[str]) -> str:
    """Block bounds are pieces of their own; line feeds inside texts are white space."""
    return "".join(p if p == "\n" else p.replace("\n", " ") for p in pieces)


def host_of(url: str):
    """Lower-case host of a URL column; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def page_templates(pages: DataFrame) -> DataFrame:
    """(page, template): for each page (page, host, html) with any the hashes of its subtrees that recur on its host and aren't dropped anyway.

    Occurrences count once for each different text that tags and class names leave of a page, so that
    copies of one article don't make its paragraphs template, and a long block doesn't make pages one. On a page without article and main
    nothing is outside of them, and all is apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, host, source in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                page = Page(source or "", host=host)
                mark = xxhash.xxh3_64_intdigest(page.main().encode("utf-8", "surrogatepass")) - (1 << 63)
                bare = not (page.articles or page.mains)
                outside: dict[int, bool] = {}
                beside: dict[int, bool] = {}
                live: dict[int, bool] = {}
                for own, within, apart, dropped, _ in page.found:
                    live[own] = live.get(own, False) or not dropped
                    outside[own] = outside.get(own, False) or not (within or bare)
                    beside[own] = beside.get(own, False) or apart
                for column, values in zip(out, ([key] * len(outside), [mark] * len(outside), outside, outside.values(), beside.values(), (live[x] for x in outside)), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.bool_()) for x in out[3:])], names=["page", "mark", "subtree", "outside", "apart", "live"])

    # read twice: a few numbers for each subtree cost less than parsing again
    seen = stash(pages.sparkSession, mapped(pages, run, "page bigint, mark bigint, subtree bigint, outside boolean, apart boolean, live boolean"))
    counts = seen.groupBy("subtree", "mark").agg(*[F.max(c).cast("int").alias(c) for c in ("outside", "apart")]).groupBy("subtree").agg(F.count("*").alias("n"), F.sum("outside").alias("out"), F.sum("apart").alias("apart"))
    often = counts.where(f"n >= {LEAST_PAGES} and 2 * apart >= n or out >= {LEAST_OUTSIDE}").select("subtree")
    return seen.where("live").select("page", "subtree").join(often, "subtree").groupBy("page").agg(F.collect_set("subtree").alias("template"))


def extract_main(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars. Null html is empty and gives an empty text; a null url is the host ''.

    Character references are decoded, white space inside a block becomes one blank (br too), blocks are
    joined by one line feed in page order.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = frozenset([0])  # so that hashes aren't gathered
        for batch in batches:
            texts = [Page(source or "", frozenset(known) if known else none, host).main() for source, known, host in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    own = pages.select(F.col(key), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host")).withColumn("page", F.xxhash64("host", "html"))
    with scratch(pages.sparkSession) as keep:
        templates = keep(stash(pages.sparkSession, page_templates(own.select("page", "host", "html"))))
    if templates.count() <= BROADCAST:
        templates = F.broadcast(templates)
    joined = own.drop("host").join(templates, "page", "left").select(key, "url", "html", host_of("url").alias("host"), "template")
    return mapped(joined, run, f"`{key}` {kind}, url string, text string, n_chars bigint")
