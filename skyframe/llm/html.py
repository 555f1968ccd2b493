"""HTML extraction by site templates.

Pass 1 reads each page once into its text blocks and the hashes of its element subtrees (a subtree's hash is that of its
tag and of the hashes of what is in it), and writes both to the shared folder. Spark counts on how many pages of a host
each subtree is found; pages with the same article text (copies of one article; without such text, the same title) count
once. Pass 2 deletes every subtree that recurs on `min_pages` pages of the host; paragraphs, headings and the like within
an article, and articles, only if pages of so many different titles hold them, and `safe_share` of the host's titles. Pages that hold no such subtree are
found by a bitmap of fixed size and skip the join.

Elements whose tag or role says what they are (navigation, forms and their controls, scripts, drawings ...) are passed by,
blocks or not, even where they don't recur. Those with a class or id that says so (NAMED) go unless they hold an article
or main part, or half of the text: of the main parts where they stand in one, of the page where no main part has a tenth
of it. Of an article or main element its own class decides nothing but that it is a comment, and names never empty it.

Blocks: block-level elements part the text, inline ones don't, dropped or not; white space in a block, line breaks
included, becomes one space; blocks are joined by one newline. If the article and main elements hold MAIN_SHARE of the
text, only theirs is the page's; else that of the body. Character references are decoded. Damaged markup is read as
browsers would, in time linear in its length: missing end tags are implied, stray ones are ignored, an unfinished tag ends the
page, what is in scripts, styles and comments is not markup.

Edge cases: a null or empty html, or a page without text, gives an empty text; a null or odd url has the host ''; rows
that repeat a page_id are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import id_text, small_batches, table, with_long, written

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = set("script style textarea title xmp iframe noembed noframes noscript template head nav footer aside form button select option optgroup datalist input label fieldset svg math canvas object embed applet audio video map dialog menu".split())
BLOCK = set("html body article main section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption form fieldset address details summary hgroup center dialog menu search head title script style template noscript hr".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption".split())
CLOSES_P = BLOCK - set("html body head title script style template noscript".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name something else than the article.
NAMED = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments commentlist disqus discussion discussions reactions responses respond reply replies widget widgets pagination pager search skip copyright legal disclaimer".split())
#: Of these, those that even half of the text doesn't save.
COMMENTS = set("comment comments commentlist disqus discussion discussions reactions responses respond reply replies".split())
NOT_NAMED = set("no not has had with without is".split())  # a class that begins so says what the page has, not the element
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PAGE = "row long, page_id string, url string, host string, identity long, title long, blocks array<string>, keep array<boolean>, hashes array<long>, begins array<int>, ends array<int>, safe array<boolean>"
SLOTS = 1 << 19
MAIN_SHARE = 0.5  # of the text that main parts hold at least where they alone are the page's


def _signed(data: str) -> int:
    n = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def named(value: str) -> set[str]:
    """The words of NAMED in a class or id."""
    out = set()
    for token in value.split():
        words = re.split(r"[^a-z]+", token)
        if words[0] not in NOT_NAMED:
            out |= NAMED & set(words)
    return out


def unwanted(tag: str, attrs: str, in_main: bool) -> tuple[bool, int, bool]:
    """Whether an element is dropped by its tag, role or style; whether its names say so too (1, or 2 if they say that it
    is a comment); whether it is a main part."""
    main = tag in ("article", "main")
    if tag in DROPPED or tag == "header" and not in_main:
        return True, 0, False
    words: set[str] = set()
    for m in ATTR.finditer(attrs) if attrs else ():
        key = m[1].lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "role":
            if value in ROLES:
                return True, 0, False
            main |= value == "main"
        elif key in ("class", "id"):
            if main and {"comment", "comment-body", "reply"} & set(value.split()):
                return True, 0, False
            words |= named(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, 0, False
    if main or tag in ("html", "body") or not words:
        return False, 0, main
    return False, 2 if words & COMMENTS else 1, False


class Scanner:
    """Tags and the texts between them, in one pass: what damaged markup lacks is looked for once and remembered."""

    MARK = re.compile(r"""[>"']""")
    NAME = re.compile(r"[a-zA-Z][^\s/>]*")
    ENDS_COMMENT = re.compile(r"--!?>")

    def __init__(self, html: str) -> None:
        self.html = html
        self.at = 0
        self.lost: set[str] = set()  # quotes that don't occur any more
        self.plain = False  # quotes are out of step: tags end at the next >

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, outside of quotes if there is one; -1 if there is none."""
        k = at
        while not self.plain:
            m = self.MARK.search(self.html, k)
            if not m:
                self.plain = True
            elif m[0] == ">":
                return m.start()
            else:
                end = -1 if m[0] in self.lost else self.html.find(m[0], m.end())
                if end < 0:
                    self.lost.add(m[0])
                k = m.end() if end < 0 else end + 1
        return self.html.find(">", at)

    def __iter__(self):
        """(text,) or (end tag?, name, attributes)."""
        html, n = self.html, len(self.html)
        while self.at < n:
            at = html.find("<", self.at)
            if at < 0:
                yield (html[self.at :],)
                return
            shut = html.startswith("/", at + 1)
            name = self.NAME.match(html, at + 1 + shut)
            bogus = not name and (shut or html[at + 1 : at + 2] in ("!", "?"))
            if not name and not bogus or shut and at + 2 == n:
                yield (html[self.at : at + 1],)
                self.at = at + 1
                continue
            if at > self.at:
                yield (html[self.at : at],)
            if name:
                end = self.tag_end(name.end())
                self.at = end + 1 if end >= 0 else n  # an unfinished tag ends the page
                if end >= 0:
                    yield shut, name[0].lower(), html[name.end() : end]
            elif html.startswith("<!--", at):
                m = re.compile(r"-?>").match(html, at + 4) or self.ENDS_COMMENT.search(html, at + 4)
                self.at = m.end() if m else n
            else:
                end = html.find(">", at)
                self.at = end + 1 if end >= 0 else n


class Stack:
    """Open elements: (tag, dropped, in a main part, innermost element of unwanted name, first block, parts of the hash).
    Where each tag is open, and the innermost block, are known without a search."""

    def __init__(self) -> None:
        self.items: list[tuple] = [("", False, False, -1, 0, [])]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, *rest) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        if tag in BLOCK:
            self.blocks.append(len(self.items))
        self.items.append((tag, *rest))

    def pop(self) -> tuple:
        item = self.items.pop()
        self.places[item[0]].pop()
        if item[0] in BLOCK:
            self.blocks.pop()
        return item

    def top(self) -> tuple:
        return self.items[-1]

    def nearest(self, tags: set[str]) -> int:
        """The place of the innermost open element of tags, or 0."""
        if tags is BLOCK:
            return self.blocks[-1] if self.blocks else 0
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def read(html: str) -> tuple[str, list[str], list[bool], list[tuple[int, int, int, bool]]]:
    """Title; blocks; whether each is the article's so far; elements: hash, first block, block after the last, safe.

    What stands in a dropped element is passed by, wherever it stands: an inline one leaves the block around it whole. An
    inline element of unwanted name is a piece of its block until it is known which names decide."""
    pieces: list[list[tuple[str, int]]] = []  # of each block: texts, each with its innermost element of unwanted name
    mains: list[bool] = []
    elements: list[tuple[int, int, int, bool]] = []
    stack = Stack()
    buffer: list[tuple[str, int]] = []
    soft: list[Named] = []
    title = ""

    def flush() -> None:
        if buffer:
            text = joined(buffer)
            if text:
                _, _, in_main, _, _, parts = stack.top()
                pieces.append(list(buffer))
                mains.append(in_main)
                parts.append(text)
            buffer.clear()

    def pop() -> None:
        tag, dropped, in_main, _, first, parts = stack.top()
        if tag in BLOCK and not dropped:
            flush()
            stack.pop()
            if tag not in ("html", "body") and first < len(pieces):
                h = _signed(tag + "\x00" + "\x00".join(parts))
                elements.append((h, first, len(pieces), in_main and tag in TEXTUAL or tag in ("article", "main")))
                parts = [f"\x01{h}"]
            stack.top()[5].extend(parts)
        else:
            stack.pop()  # an inline element's parts are those of the one around it

    def close(tags: set[str], stop: set[str]) -> None:
        """Ends the nearest open element of tags, unless one of stop stands above it."""
        k = stack.nearest(tags)
        if k and k >= stack.nearest(stop):
            while len(stack.items) > k:
                pop()

    scanner = Scanner(html)
    for token in scanner:
        dropped = stack.top()[1]
        if len(token) == 1:
            if not dropped:
                buffer.append((token[0], stack.top()[3]))
            continue
        shut, tag, attrs = token
        if shut:
            if tag in BLOCK:
                if tag == "p" and not dropped:
                    flush()  # also where none is open
                close({tag}, set())
            elif tag in ("td", "th"):
                buffer.append((" ", -1))
                close({tag}, {"table"})
            else:
                close({tag}, BLOCK)
            continue
        if tag in VOID:
            if tag == "hr" and not dropped:
                flush()
            if tag in ("br", "hr"):
                buffer.append((" ", -1))
            continue
        if tag in CLOSES_P and not dropped:
            close({"p"}, {"table", "button", "article", "div", "section", "body"})
        if tag in ENDS:
            close(ENDS[tag], SCOPE[tag])
        _, dropped, in_main, around, _, parts = stack.top()
        if tag in BLOCK and not dropped:
            flush()
        elif tag in ("td", "th"):
            buffer.append((" ", -1))
        bad, doubt, main = (True, 0, False) if dropped else unwanted(tag, attrs, in_main)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, scanner.at)
            if tag == "title" and not title:
                title = " ".join(unescape(html[scanner.at : end.start() if end else len(html)]).split())
            scanner.at = end.end() if end else len(html)
            continue
        if main and around >= 0:
            soft[around].main |= tag == "main"
            soft[around].article = True
        if doubt:
            soft.append(Named(around, doubt, in_main))
            around = len(soft) - 1
        stack.push(tag, dropped or bad, in_main or main, around, len(pieces), [] if tag in BLOCK else parts)
    while len(stack.items) > 1:
        pop()
    flush()
    texts = _kept(pieces, mains, soft)
    return title, [t or joined(p) for t, p in zip(texts, pieces, strict=True)], [t != "" for t in texts], elements


def joined(pieces: list[tuple[str, int]]) -> str:
    return " ".join(unescape("".join(t for t, _ in pieces)).split())


class Named:
    """An element of unwanted name."""

    def __init__(self, around: int, strength: int, in_main: bool) -> None:
        self.around, self.strength, self.in_main = around, strength, in_main
        self.main = self.article = False  # whether it holds such parts
        self.size = 0  # characters in it
        self.out = False


def _kept(pieces: list[list[tuple[str, int]]], mains: list[bool], soft: list[Named]) -> list[str]:
    """What stays of each block."""
    whole = {True: 0, False: 0}  # characters of main parts, and of the rest
    for block, in_main in zip(pieces, mains, strict=True):
        for text, k in block:
            n = len(text.strip())
            whole[in_main] += n
            if k >= 0:
                soft[k].size += n
    for s in reversed(soft):  # inner ones come last
        if s.around >= 0:
            o = soft[s.around]
            o.size, o.main, o.article = o.size + s.size, o.main or s.main, o.article or s.article
    total = sum(whole.values())
    for s in soft:
        holds = s.main or s.article and s.strength < 2  # comments may be articles themselves
        # beside a main part that holds a tenth of the text, nothing of unwanted name is the page's
        most = 2 * s.size >= whole[True] if s.in_main else 2 * s.size >= total > 10 * whole[True]
        s.out = s.around >= 0 and soft[s.around].out or not holds and (s.strength == 2 or not most)

    def chosen() -> list[str]:
        return [joined([(t, k) for t, k in block if k < 0 or not soft[k].out]) for block in pieces]

    texts = chosen()
    if whole[True] and not any(t for t, m in zip(texts, mains, strict=True) if m):  # names don't empty a main part
        for s in soft:
            s.out = s.strength == 2 and s.out or s.around >= 0 and soft[s.around].out and soft[s.around].strength == 2
        texts = chosen()
    left = sum(map(len, texts))
    main = sum(len(t) for t, m in zip(texts, mains, strict=True) if m)
    return [t if m or MAIN_SHARE * left > main else "" for t, m in zip(texts, mains, strict=True)]


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> PAGE; texts of dropped blocks are not kept, only their hashes."""
    small_batches(pages.sparkSession)

    def blocks(batches):
        for pdf in batches:
            out = []
            for row, page_id, url, html in zip(pdf["row"], pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                title, texts, keep, elements = read(html if isinstance(html, str) else "")
                host = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url) if isinstance(url, str) else None
                identity = _signed("\n".join(t for t, k in zip(texts, keep, strict=True) if k) or title)
                before = [0, *itertools.accumulate(map(bool, keep))]
                elements = [e for e in elements if before[e[2]] > before[e[1]]]  # others hold nothing that is left
                out.append((row, page_id, url, host[1].lower() if host else "", identity, _signed(title), [t if k else "" for t, k in zip(texts, keep, strict=True)], keep, [e[0] for e in elements], [e[1] for e in elements], [e[2] for e in elements], [e[3] for e in elements]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGE.split(", ")])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), id_text("page_id"), F.col("url").cast("string").alias("url"), "html")
    return with_long(rows.mapInPandas(blocks, PAGE), "page_id")


def extract(pages: DataFrame, min_pages: int = 5, safe_share: float = 0.5) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    parsed = written(parse_pages(pages), "pages")
    # one key for a host's subtree, odd for a safe one
    site = lambda host, h, safe: F.shiftleft(F.xxhash64(host, h), 1).bitwiseOR(safe.cast("long"))
    is_safe = F.col("key").bitwiseAND(F.lit(1)) == 1
    kind = F.arrays_zip("hashes", "safe")
    seen = parsed.select("identity", "title", "host", F.explode(F.array_distinct(kind)).alias("x"))
    seen = seen.select(site(F.col("host"), F.col("x.hashes"), F.col("x.safe")).alias("key"), F.when(F.col("x.safe"), F.col("title")).otherwise(F.col("identity")).alias("identity"), F.when(F.col("x.safe"), F.xxhash64("host")).alias("at"))
    counts = seen.distinct().groupBy("at", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    sizes = parsed.select(F.xxhash64("host").alias("at"), "title").distinct().groupBy("at").agg(F.count("*").alias("pages"))
    often = counts.filter(~is_safe).select("key").union(counts.filter(is_safe).join(sizes, "at").filter(F.col("n") >= safe_share * F.col("pages")).select("key"))
    templates = written(often, "templates")
    slot = lambda key: F.pmod(key, F.lit(SLOTS)).cast("int")
    bitmap = bytearray(b"0" * SLOTS)
    for (k,) in templates.select(slot(F.col("key"))).distinct().collect():  # SLOTS at most
        bitmap[k] = ord("1")
    # of a page's elements, what the bitmap doesn't rule out needs an answer
    each = F.transform(F.arrays_zip("hashes", "begins", "ends", "safe"), lambda e: F.struct(site(F.col("host"), e["hashes"], e["safe"]).alias("key"), F.struct(e["begins"].alias("b"), e["ends"].alias("e")).alias("at")))
    maybe = F.filter(each, lambda e: F.substring(F.lit(bytes(bitmap)), slot(e["key"]) + 1, F.lit(1)) == F.lit(b"1"))
    asked = parsed.select("row", F.explode(maybe).alias("e")).select("row", "e.key", "e.at")
    gone = asked.join(templates, "key").groupBy("row").agg(F.collect_list("at").alias("gone"))
    done = parsed.filter(F.size(maybe) == 0).select("page_id", "url", F.array_join(F.filter("blocks", lambda t, i: F.get("keep", i)), "\n").alias("text"))
    left = F.filter("blocks", lambda t, i: F.get("keep", i) & ~F.coalesce(F.exists("gone", lambda g: (g["b"] <= i) & (i < g["e"])), F.lit(False)))
    rest = parsed.filter(F.size(maybe) > 0).select("row", "page_id", "url", "blocks", "keep").join(gone, "row", "left").select("page_id", "url", F.array_join(left, "\n").alias("text"))
    out = done.union(rest)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html": op1_html}
ORACLE: dict[str, str] = {}
