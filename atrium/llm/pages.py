"""Main text of web pages by deducing each host's template from equivalence classes of tokens."""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: A class of tokens is template if its tokens occur in this share of a host's distinct pages, in
#: so many of them at least, and the class has so many tokens.
SUPPORT, LEAST_PAGES, LEAST_TOKENS = 0.5, 5, 2
#: The article's element is sought downwards as long as one element of the template holds this share of the text.
DOMINANT = 0.5
#: An element of the template is a menu if this share of its text is in links.
LINKS = 0.5
#: Pages of a host whose longest article blocks are the same, up to this share of the article's characters, count once.
SAME_ARTICLE = 0.8

#: Names of HTML elements, and words of class, id and role that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("aside button canvas dialog footer form head header iframe math menu nav noscript object script select style svg template textarea title".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
MAIN = frozenset("article main".split())
NOISE = frozenset(
    """ad ads adv advert advertisement advertorial alert banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies dialog
    disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion related
    replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget""".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = frozenset("li dt dd option tr td th p".split())

#: Class names that begin with these say what the page has or lacks, not what the element is.
STATES = frozenset("no not has have with without is hide show".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[\"'>]")
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
CLOSING = frozenset(" \t\n\r\f/>")
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def named(tag: str, attributes: str) -> tuple[bool, str]:
    """(whether element and class names mark what isn't main text, the class without digits)."""
    noise, kind = tag in DROPPED, ""
    for name, *values in ATTR.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role") and tag not in ("html", "body"):
            for one in value.split():
                parts = PARTS.split(one)
                noise |= parts[0] not in STATES and not NOISE.isdisjoint(parts)
        if name == "class":
            kind = DIGITS.sub("", value)
        noise |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(re.search(r"display\s*:\s*none", value))
    return noise, kind


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def token(parent: int, text: str) -> int:
    """A token for an element or a text inside the element of the token ``parent``."""
    return digest(f"{parent}\x00{text}")


START = digest("")


def markup(page: str):
    """The pieces of a page in order, in one pass: (text, None, "") or ("", tag, attributes).

    A tag ends at the first > outside a quoted value; a quote is one after = if its pair ends the value. A tag
    that the page ends in, comments and declarations are left out; a < before no name is text.
    """
    at, unpaired = 0, set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield page[at:], None, ""
            return
        if start > at:
            yield page[at:start], None, ""
        at = start
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else len(page)
        elif page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            yield entities.escape(page[at + 9 : stop if stop >= 0 else len(page)]), None, ""
            at = stop + 3 if stop >= 0 else len(page)
        elif page[at + 1 : at + 2] in ("!", "?"):
            stop = page.find(">", at)
            at = stop + 1 if stop >= 0 else len(page)
        else:
            end = page.startswith("</", at)
            name = NAME.match(page, at + 1 + end)
            if not name:
                yield "<", None, ""
                at += 1
                continue
            here = name.end()
            while True:
                m = STOP.search(page, here)
                if not m:
                    return
                here = m.end()
                if m[0] == ">":
                    break
                if m[0] not in unpaired and page[here - 2] == "=":
                    pair = page.find(m[0], here)
                    if pair < 0:
                        unpaired.add(m[0])
                    elif page[pair + 1 : pair + 2] in CLOSING:
                        here = pair + 1
            yield "", ("/" if end else "") + name[0].lower(), page[name.end() : here - 1]
            at = here
            if not end and name[0].lower() in RAW:
                stop = ENDS[name[0].lower()].search(page, at)
                at = stop.end() if stop else len(page)


class Element:
    """A block element of a page: its token, its parent, and the characters of text and links in it."""

    __slots__ = ("token", "parent", "tag", "chars", "links", "inner")

    def __init__(self, token_: int, parent: "Element | None", tag: str):
        self.token, self.parent, self.tag, self.chars, self.links, self.inner = token_, parent, tag, 0, 0, False


class Block:
    """A block of text: its element, whether names mark it or an element around it as no main text,
    whether it is in an article or main element, and in the element that was asked for."""

    __slots__ = ("element", "text", "noise", "main", "inside")

    def __init__(self, element: Element, text: str, noise: bool, main: bool, inside: bool):
        self.element, self.text, self.noise, self.main, self.inside = element, text, noise, main, inside


def parse(page: str, container: int | None = None, dropped=frozenset()) -> tuple[list, Element]:
    """(block elements and blocks of text in page order, the root element).

    White space is one space; character references are decoded; empty blocks are left out. Names
    count from the element with the token ``container`` on, if one is given; elements whose tokens
    are in ``dropped`` count as marked.
    """
    root = Element(START, None, "")
    out: list = [root]
    # stack: tag, element around, noise, main, inside
    stack: list[tuple] = [("", root, False, False, False)]
    open_: Counter = Counter()
    parts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            _, element, noise, main, inside = stack[-1]
            out.append(Block(element, text, noise, main, inside))
            element.chars += len(text)
            element.links += min(linked, len(text))
        linked = 0

    def close(k: int) -> None:
        if any(t not in INLINE for t, *_ in stack[k:]):
            end_block()
        while len(stack) > k:
            tag, element, *_ = stack.pop()
            open_[tag] -= 1
            if tag not in INLINE and element.parent:
                element.parent.chars += element.chars
                element.parent.links += element.links
                element.parent.inner = True

    for text, tag, attributes in markup(page):
        if tag is None:
            parts.append(text)
            if open_["a"]:
                linked += len(text)
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:  # an inline end doesn't close blocks
                        break
            continue
        if tag not in INLINE:
            if tag in CLOSES_P and open_["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in SAME_ENDS and open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] not in INLINE and stack[k][0] not in SAME_ENDS:
                        break
            end_block()
        if tag in VOID or tag in RAW or attributes.endswith("/") and tag not in CLOSES_P:
            continue
        marked, kind = named(tag, attributes)
        _, element, noise, main, inside = stack[-1]
        if tag not in INLINE:
            element = Element(token(element.token, f"<{tag} {kind}>"), element, tag)
            out.append(element)
            marked |= element.token in dropped
            if element.token == container:
                marked, noise, inside = False, False, True
        stack.append((tag, element, noise or marked, main or tag in MAIN and not marked and not noise, inside))
        open_[tag] += 1
    end_block()
    close(1)
    return out, root


def host_of(column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(column, r"^\w+://([^/?#]*)", 1), F.lit("")))


def page_mark(page: str, found: list[Block]) -> int:
    """A mark that near copies of a page share: of its longest article blocks that make SAME_ARTICLE of
    the article; of all blocks that aren't noise where there is no article, else of the page."""
    shown = [b for b in found if not b.noise]
    texts = sorted((b.text for b in shown if b.main), key=lambda t: (-len(t), t))
    if not texts:
        return digest("\n".join(["blocks", *(b.text for b in shown)]) if shown else page)
    left, kept = SAME_ARTICLE * sum(map(len, texts)), ["article"]
    for text in texts:
        if left <= 0:
            break
        kept.append(text)
        left -= len(text)
    return digest("\n".join(kept))


def nested(order: list[int], classes: list[list[int]]) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """(orders, slots) of the classes of tokens that a page holds, given its tokens in page order.

    orders: a mark of the one order that all repetitions of the class keep, or 0 if there is none.
    slots[c, p]: the slot of class p, from 1, that holds every repetition of class c, or 0.
    """
    of = {t: c for c, tokens in enumerate(classes) for t in tokens}
    at: dict = defaultdict(list)
    for k, t in enumerate(order):
        if t in of:
            at[of[t]].append(k)
    orders, slots = {}, {}
    for c, places in at.items():
        first = [order[k] for k in places[: len(classes[c])]]
        kept = len(set(first)) == len(classes[c]) and len(places) % len(first) == 0 and all(order[k] == first[n % len(first)] for n, k in enumerate(places))
        orders[c] = digest(" ".join(map(str, first))) or 1 if kept else 0
    for c in at:
        for p in at:
            if c == p or not orders[c] or not orders[p]:
                continue
            m, size, root = len(classes[c]), len(classes[p]), order[0] in classes[p]
            held = set()
            for k in range(0, len(at[c]), m):
                a, b = bisect(at[p], at[c][k]), bisect(at[p], at[c][k + m - 1])
                held.add(size if root and a == b == size else a % size if a == b else 0)  # the root's last slot ends with the page
            slots[c, p] = held.pop() if len(held) == 1 else 0
    return orders, slots


TOKEN = pa.struct([("token", pa.int64()), ("times", pa.int32()), ("parent", pa.int64()), ("kind", pa.int32()), ("chars", pa.int64()), ("links", pa.int64())])
#: Kinds of tokens.
TEXT, LEAF, INNER, HEADING = 0, 1, 2, 3


def tokens_of(found: list) -> tuple[list[dict], list[int]]:
    """(the distinct tokens of a page with what they hold, the tokens' places in page order)."""
    rows: dict[int, dict] = {}
    order = []
    for x in found:
        if isinstance(x, Block):
            t, parent, kind, chars, links = token(x.element.token, x.text), x.element.token, TEXT, 0, 0
        else:
            t, parent, chars, links = x.token, x.parent.token if x.parent else 0, x.chars, x.links
            kind = HEADING if x.tag in ("h1", "h2") else INNER if x.inner else LEAF
        row = rows.setdefault(t, {"token": t, "times": 0, "parent": parent, "kind": kind, "chars": 0, "links": 0, "nth": len(rows)})
        row["times"] += 1
        row["kind"], row["chars"], row["links"] = max(row["kind"], kind), row["chars"] + chars, row["links"] + links
        order.append(row["nth"])
    for row in rows.values():
        del row["nth"]
    return list(rows.values()), order


def article_of(valid: set[int], stats: dict[int, dict]) -> tuple[int | None, list[int]]:
    """(token of the element that holds the article, tokens of menus), from the elements of a template.

    From the root downwards, the element with most text in the one before is taken, as long as it
    holds DOMINANT of that one's text, has block elements of its own and leaves no heading outside.
    """
    def above(t: int) -> int | None:
        t = stats[t]["parent"]
        while t in stats and t not in valid:
            t = stats[t]["parent"]
        return t if t in stats else None

    inside: dict = defaultdict(list)
    for t in valid:
        if t in stats and stats[t]["kind"] != TEXT and t != START:
            inside[above(t)].append(t)

    def headings(t: int) -> int:
        found, left = 0, [t]
        while left:
            own = inside.get(left.pop(), [])
            found += sum(stats[x]["kind"] == HEADING for x in own)
            left += own
        return found

    here = START
    while True:
        own = [t for t in inside[here] if stats[t]["kind"] == INNER]
        best = max(own, key=lambda t: (stats[t]["chars"], t), default=None)
        if best is None or stats[best]["chars"] < DOMINANT * stats[here]["chars"] or headings(best) < headings(here):
            break
        here = best
    menus = [t for t in valid if t in stats and stats[t]["kind"] in (INNER, LEAF) and t != here and stats[t]["links"] > LINKS * max(1, stats[t]["chars"])]
    return (here if here != START else None), sorted(menus)


TEMPLATE = "host string, tokens array<long>, container long, menus array<long>"


def template_tokens(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(host, tokens, container, menus): each host's template: the tokens of its texts, the element
    that holds the article, and elements that are lists of links.

    A token is a block element, by tag, class and the elements around it, or a block's text in its
    element. Its occurrence vector holds how often each distinct page of the host has it; tokens with
    equal vectors are an equivalence class. A class is valid if it is frequent and large enough, its
    tokens keep one order on all its pages, and it nests: it lies in one and the same slot of an
    already valid class on each of its pages. The outermost class holds the page's root; where that
    class keeps no order, the root alone is outermost. Near copies of a page count once (page_mark),
    so an article that was crawled often doesn't become template. The vectors are compared by sums of
    hashes of (page, times): they are added up before the shuffle.
    """

    def count(batches):
        for batch in batches:
            rows: dict = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                found, _ = parse(page)
                mark, own = page_mark(page, [b for b in found if isinstance(b, Block)]), digest(page)
                if (host, mark) not in rows or rows[host, mark][0] > own:
                    rows[host, mark] = own, *tokens_of(found)
            own, tokens, order = zip(*rows.values()) if rows else ((), (), ())
            columns = [pa.array([h for h, _ in rows], pa.string()), pa.array([m for _, m in rows], pa.int64()), pa.array(own, pa.int64()), pa.array(tokens, pa.list_(TOKEN)), pa.array(order, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "mark", "own", "tokens", "seen"])

    kind = "array<struct<token:long,times:int,parent:long,kind:int,chars:long,links:long>>"
    counted = pages.select("host", "html").mapInArrow(count, f"host string, mark long, own long, tokens {kind}, seen array<int>")
    distinct = counted.groupBy("host", "mark").agg(F.min_by(F.struct("tokens", "seen"), "own").alias("p")).select("host", "mark", "p.*")
    distinct = materialise(distinct, "distinct-pages")
    each = distinct.select("host", "mark", F.explode("tokens").alias("t")).select("host", "t.*", F.xxhash64("mark", "t.times").cast("decimal(20,0)").alias("part"))
    per = each.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("part").alias("vector"), F.max("parent").alias("parent"), F.max("kind").alias("kind"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    per = materialise(per.where(F.col("pages") >= least_pages), "page-tokens")
    root = per.where(F.col("token") == START).select("host", F.col("pages").alias("of"))
    frequent = per.join(root, "host").where(F.col("pages") >= support * F.col("of"))
    stats = frequent.where(F.col("kind") != TEXT).groupBy("host").agg(F.collect_list(F.struct("token", "parent", "kind", "chars", "links")).alias("stats"))
    classes = frequent.groupBy("host", "vector").agg(F.count("*").alias("size"), F.max("pages").alias("pages"), F.array_sort(F.collect_set("token")).alias("tokens"))
    classes = classes.where(F.col("size") >= least_tokens).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("tokens", "pages"))).alias("classes"))
    classes = materialise(classes.join(stats, "host"), "page-classes")

    def place(batches):
        for batch in batches:
            rows: Counter = Counter()
            for host, tokens, seen, own in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "seen", "classes"))):
                orders, slots = nested([tokens[k] for k in seen], [c["tokens"] for c in own])
                rows.update((host, c, -1, x) for c, x in orders.items())
                rows.update((host, c, p, x) for (c, p), x in slots.items() if own[p]["pages"] >= own[c]["pages"])
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(x, t) for x, t in zip([*columns[1:], tuple(rows.values())], (pa.int32(), pa.int32(), pa.int64(), pa.int64())))], names=["host", "class", "parent", "value", "n"])

    slim = distinct.select("host", F.col("tokens.token").alias("tokens"), "seen")
    placed = slim.join(classes.select("host", "classes"), "host").select("host", "tokens", "seen", "classes").mapInArrow(place, "host string, class int, parent int, value long, n long")
    # One value, an order or a slot, on all pages that were counted.
    placed = placed.groupBy("host", "class", "parent").agg(F.min("value").alias("low"), F.max("value").alias("value"), F.sum("n").alias("n")).where("low = value and value <> 0")
    placed = placed.groupBy("host").agg(F.collect_list(F.struct("class", "parent", "n")).alias("placed")).join(classes, "host")

    def nest(batches):
        for batch in batches:
            out, containers, menus = [], [], []
            for own, rows, stats in zip(*(batch.column(c).to_pylist() for c in ("classes", "placed", "stats"))):
                whole = {(r["class"], r["parent"]) for r in rows if r["n"] == own[r["class"]]["pages"]}
                ordered = {c for c, p in whole if p == -1}
                valid = {c for c in ordered if START in own[c]["tokens"]}
                if not valid:
                    valid = set(ordered)
                while more := {c for c, p in whole if p in valid and c in ordered and c not in valid}:
                    valid |= more
                tokens = {t for c in valid for t in own[c]["tokens"]}
                elements = {s["token"]: s for s in stats}
                article, lists = article_of(tokens, elements)
                out.append(sorted(tokens - elements.keys()))
                containers.append(article)
                menus.append(lists)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.int64())), pa.array(containers, pa.int64()), pa.array(menus, pa.list_(pa.int64()))], names=["host", "tokens", "container", "menus"])

    return placed.mapInArrow(nest, TEMPLATE)


def main_text(page: str, template: set[int], container: int | None = None, menus=frozenset()) -> str:
    """Text of the slots that the template leaves.

    With a container, that is what it holds but for the template's texts and menus and for elements
    inside it whose names mark them; a page where it holds less than DOMINANT of the text isn't made
    from the template. Without one, only the names decide.
    """
    fresh = lambda found: [b for b in found if isinstance(b, Block) and not b.noise and token(b.element.token, b.text) not in template]
    plain = None
    if container is not None:
        found, _ = parse(page, container, menus)
        own = [b.text for b in fresh(found) if b.inside]
        plain = fresh(parse(page)[0]) if not own else [b for b in fresh(found) if not b.inside]
        if own and sum(map(len, own)) >= DOMINANT * (sum(map(len, own)) + sum(len(b.text) for b in plain)):
            return "\n".join(own)
    return "\n".join(b.text for b in fresh(parse(page)[0]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``; other columns are ignored.

    A null or empty html gives an empty text. Pages without a host share a template of their own; a
    host of fewer than LEAST_PAGES distinct pages has none. Rows that repeat a page each come back, no
    rows give none, and a long page is read whole, in one pass.
    """
    hosted = pages.select("page_id", "url", host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    # Written, so that its size is known: while it is small Spark broadcasts it, else pages move to their host.
    template = materialise(template_tokens(hosted), "templates")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "tokens", "container", "menus")))
            text = [main_text(page, set(t or ()), c, frozenset(m or ())) for page, t, c, m in rows]
            new = [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *new], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return hosted.join(template, "host", "left").select("page_id", "url", "html", "tokens", "container", "menus").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages."""
    return extract(table(spark, sf_dir, "pages"))
