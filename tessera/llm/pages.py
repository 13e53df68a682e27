"""Main text of web pages by template deduction: tokens with equal occurrence vectors over the pages of a host.

A page is a sequence of tokens: tags with their path (names, classes and ids of
the open elements), and blocks of text with theirs. Tokens of a host that occur
equally often in each of its pages are an equivalence class. Classes of enough
tokens and pages, whose tokens come in one order and always in the same gap of
the classes above them, nest into the host's template. What a page holds
between the template's tokens are its slots, and the text is what remains of
the slots that hold the article.

Occurrence vectors are compared by hashes that add up over pages, so that a
host's pages may lie anywhere and are counted where they lie.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_counts, mix, slices

#: Pages of a host and tokens that a class needs, and pages in which a text must be the same to be the template's.
LEAST_PAGES, LEAST_TOKENS, LEAST_SAME = 3, 3, 5
#: Template tokens that may be sent to all workers; beyond, templates go to the pages of their hosts by a join.
MOST_SENT = 2_000_000

# Fixed values of HTML: names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select object canvas audio video math".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDER = frozenset("article body center div main section table tbody td tr ul ol dl blockquote".split())
#: Elements that are no part of an article; a header is one inside of it.
APART = frozenset("nav footer aside form button menu dialog head search label fieldset".split())
ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids that say so.
SAYING = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations trending widget widgets comment comments disqus replies reply respond toolbar skip".split()
)
TOP = frozenset("header masthead topbar".split())

_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS: dict[str, re.Pattern] = {n: re.compile(f"</{n}(?=[\\s/>])[^>]*>?", re.I) for n in RAW}
#: Elements that end where one of these begins, and elements beyond which nothing is ended.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}


def signature(attributes: str) -> tuple[str, bool, bool, int]:
    """Class and id (numbers of three digits and more as 0), whether they say that this is no article, whether that it is a page's top, and 2 for an article's body or 1 for a main part."""
    sig, apart, top, level = [], False, False, 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            sig.append(re.sub(r"\d{3,}", "0", f"{name}={value}"))
            for item in value.split():
                words = {w.lower() for w in _WORD.findall(item)}
                if not words & {"no", "has", "with", "without", "is"}:
                    apart |= bool(words & SAYING)
                    top |= bool(words & TOP)
        elif name == "role":
            apart |= value.lower() in ROLES
            top |= value.lower() == "banner"
            level = {"main": 1, "article": 2}.get(value.lower(), level)
        elif name == "itemprop":
            level = 2 if value == "articleBody" else level
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            apart = True
        else:
            apart |= bool(re.search(r"display\s*:\s*none", value))
    return " ".join(sig), apart, top, level


class Element:
    __slots__ = ("apart", "form", "holders", "level", "link", "name", "path")

    def __init__(self, name: str, path: int, apart: bool, form: bool, level: int, link: bool, holders: tuple[int, ...]):
        self.name, self.path, self.apart, self.form, self.level, self.link, self.holders = name, path, apart, form, level, link, holders


class Block:
    __slots__ = ("apart", "holders", "level", "linked", "text", "token")

    def __init__(self, text: str, linked: int, element: Element, token: int):
        self.text, self.linked, self.token = text, linked, token
        self.apart, self.level, self.holders = element.apart or element.form, element.level, element.holders


def token_hash(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, path)


def parsed(page: str) -> tuple[list[int], list[Block]]:
    """The tokens of a page, and its blocks of text in order.

    Elements that HTML lets stay open (p, li, cells) are ended by what follows
    them; an end without its beginning is passed over.
    """
    root = Element("", 0, False, False, 0, False, ())
    stack, tokens, blocks = [root], [0], []
    words: list[str] = []
    linked, pos, end = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if words:
            if text := " ".join("".join(words).split()):
                block = next((e for e in reversed(stack) if e.name in BLOCK or not e.name))
                token = token_hash(block.path, "#" + text)
                tokens.append(token)
                blocks.append(Block(text, min(linked, len(text)), block, token))
            words.clear()
        linked = 0

    while pos < end:
        found = _TAG.search(page, pos)
        stop = found.start() if found else end
        if stop > pos:
            words.append(text := html.unescape(page[pos:stop]))
            if stack[-1].link:
                linked += len(text)
        if not found:
            break
        pos = found.end()
        closing, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if depth:
                tokens.append(token_hash(stack[depth].path, "/"))
                del stack[depth:]
            continue
        if name in BLOCK and name != "br":
            names = [e.name for e in stack]
            if "p" in names:
                del stack[names.index("p") :]
            elif name in _CLOSES:
                other, bounds = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in bounds:
                        break
                    if stack[k].name in (name, other):
                        del stack[k:]
                        break
        up = stack[-1]
        sig, apart, top, level = signature(attributes) if len(attributes) > 3 else ("", False, False, 0)
        path = token_hash(up.path, f"{name} {sig}")
        tokens.append(path)
        if name in RAW:  # whatever is inside is no text of the page
            pos = (found := _ENDS[name].search(page, pos)) and found.end() or end
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ("html", "body", "main", "article"):
            apart, top = apart and name == "article", False
        own = {"main": 1, "article": 2}.get(name, level)
        form = (up.form or name == "form") and not own
        gone = up.apart or apart or (name in APART and name != "form") or ((top or name == "header") and not up.level)
        stack.append(Element(name, path, gone, form, max(up.level, own), up.link or name == "a", (*up.holders, path) if name in HOLDER else up.holders))
    flush()
    return tokens, blocks


class Template:
    """What is known of a host: the class of its tokens and their ranks, texts that are the template's, and how much text its slots hold."""

    def __init__(self) -> None:
        self.classes: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.same: set[int] = set()
        self.slots: dict[int, tuple[int, int]] = {}


def packed(columns: dict[str, np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def slot_of(block: Block, template: Template) -> int:
    """The innermost holder of a block that the template has; without a template, of the page."""
    if not template.classes:
        return block.holders[-1] if block.holders else 0
    return next((h for h in reversed(block.holders) if h in template.classes), 0)


def slot_sums(blocks: list[Block], template: Template) -> dict[int, list[int]]:
    """Characters, and those of links, of each slot: a block counts whole for its own slot and half for the one around it."""
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in blocks:
        if b.apart or b.token in template.same:
            continue
        chain = [h for h in b.holders if not template.classes or h in template.classes][-2:] or [0]
        for share, h in zip((2, 1), reversed(chain), strict=False):
            sums[h][0] += share * len(b.text)
            sums[h][1] += share * b.linked
    return sums


def article(blocks: list[Block], template: Template) -> str:
    """The text of the slots that hold the article."""
    kept = [b for b in blocks if not b.apart]
    level = max((b.level for b in kept), default=0)
    if level:
        kept = [b for b in kept if b.level == level]
    else:
        sums = template.slots or {k: tuple(v) for k, v in slot_sums(blocks, template).items()}
        own = {h for b in kept for h in b.holders} | {0}
        dense = {h for h, (n, linked) in sums.items() if 2 * linked > n}
        if main := max((h for h in sums if h in own and h not in dense), key=lambda h: (sums[h][0], h), default=None):
            kept = [b for b in kept if main in b.holders]
        kept = [b for b in kept if slot_of(b, template) not in dense]
    # A text that is the same in all pages is the template's, unless most of the article is: then the pages are copies.
    size, same = sum(len(b.text) for b in kept), sum(len(b.text) for b in kept if b.token in template.same)
    if same and 2 * same <= size:
        kept = [b for b in kept if b.token not in template.same]
    return " ".join(b.text for b in kept)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every host and token: pages, occurrences and the hash of the vector, of a run of pages."""
    for part in slices(batches, "html", 8 << 20):
        hosts = part.column("host").dictionary_encode()
        found, pages = [], []
        for page in part.column("html").to_pylist():
            tokens = np.array(parsed(page or "")[0], np.uint64)
            found.append(np.unique(tokens, return_counts=True))
            pages.append(len(found[-1][0]))
        token, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        weight = np.repeat(part.column("weight").to_numpy().view(np.uint64), pages)
        host = np.repeat(hosts.indices.to_numpy(), pages)
        with np.errstate(over="ignore"):
            vector = mix(weight + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((token, host))
        host, token, n, vector = host[order], token[order], n[order], vector[order]
        first = np.flatnonzero(np.concatenate([[True], (host[1:] != host[:-1]) | (token[1:] != token[:-1])])) if len(host) else np.zeros(0, np.int64)
        if len(first):
            yield pa.RecordBatch.from_arrays(
                [hosts.dictionary.take(pa.array(host[first])), pa.array(token[first].view(np.int64)), pa.array(np.diff(np.append(first, len(host)))), pa.array(np.add.reduceat(n, first)), pa.array(np.bitwise_xor.reduceat(vector, first).view(np.int64))],
                ["host", "token", "pages", "total", "vector"],
            )


def ordered(tokens: list[int], template: Template) -> dict[int, int]:
    """For each class in a page: a hash of the order of its tokens and of the gap they are in; -1 where there is no one order or gap."""
    there = [(template.classes[t], t) for t in tokens if t in template.classes]
    out: dict[int, int] = {}
    places: dict[int, list[int]] = defaultdict(list)
    for k, (c, _) in enumerate(there):
        places[c].append(k)
    for c, at in places.items():
        size, rank = template.rank[c] >> 32, template.rank[c]
        seen = [there[k][1] for k in at]
        if len(seen) % size or seen != seen[:size] * (len(seen) // size) or len(set(seen[:size])) < size:
            out[c] = -1
            continue
        gaps = set()
        for k in at[::size]:
            while k >= 0 and template.rank[there[k][0]] & 0xFFFFFFFF >= rank & 0xFFFFFFFF:
                k -= 1
            gaps.add(there[k][1] if k >= 0 else 0)
        out[c] = -1 if len(gaps) > 1 else token_hash(gaps.pop(), ",".join(map(str, seen[:size]))) >> 1
    return out


def looked_up(part: pa.RecordBatch, sent: dict[str, Template] | None, cache: dict[bytes, Template]) -> list[Template]:
    """The template of each page's host: of those sent, or else from the row."""
    none = Template()
    if sent is not None:
        return [sent.get(h, none) for h in part.column("host").to_pylist()]
    found = []
    for blob in part.column("template").to_pylist():
        if blob is not None and blob not in cache:
            if len(cache) > 200:
                cache.clear()
            rows = pa.ipc.open_stream(blob).read_all()
            cache[blob] = templates_of(rows.append_column("host", pa.array([""] * rows.num_rows)))[""]
        found.append(none if blob is None else cache[blob])
    return found


def templates_of(rows: pa.Table) -> dict[str, Template]:
    """Templates by host, of rows with host, kind (0: a token, 1: a text that is the template's, 2: a slot), key, a and b: class and rank, or characters and those of links."""
    out: dict[str, Template] = defaultdict(Template)
    for host, kind, key, a, b in zip(*[rows[c].to_pylist() for c in ("host", "kind", "key", "a", "b")], strict=True):
        t, key = out[host], key & 0xFFFFFFFFFFFFFFFF
        if kind == 2:
            t.slots[key] = (a, b)
        else:
            t.classes[key] = a
            t.rank[a] = b
            if kind == 1:
                t.same.add(key)
    return out


_CLASSES = "host string, kind int, key long, a long, b long"


def with_templates(pages: DataFrame, templates: DataFrame, step, schema: str) -> DataFrame:
    """step(batches, lookup) over pages with the templates of their hosts: sent to all workers up to MOST_SENT tokens, else joined by host, hosts with many pages by broadcast."""
    n = templates.count()
    if n <= MOST_SENT:
        # At most MOST_SENT rows of 40 bytes and a host's name.
        shared = pages.sparkSession.sparkContext.broadcast(templates.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = templates_of(shared.value)
            return step(batches, lambda part: looked_up(part, sent, {}))

        return pages.mapInArrow(run, schema)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        blob = packed({c: rows[c].to_numpy() for c in ("kind", "key", "a", "b")})
        return pa.table({"host": [key[0].as_py()], "template": [blob]})

    # A host's template has no more rows than LEAST_PAGES of its pages have tokens: it is bounded by a page, not by the host.
    rows = templates.groupBy("host").applyInArrow(pack, "host string, template binary")
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    known = sizes.join(rows, "host", "left")
    placed = join_counts(pages, "host", known, "host_pages", pages.count())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, Template] = {}
        return step(batches, lambda part: looked_up(part, None, cache))

    return placed.mapInArrow(join, schema)


def deduce(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """The templates of all hosts, as rows for templates_of; pages have host, weight and html."""
    stats = pages.select("host", "weight", "html").mapInArrow(counted, "host string, token long, pages long, total long, vector long")
    # token 0 begins each page: its vector is the host's
    stats = stats.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector")).where(f"pages >= {LEAST_PAGES}")
    stats = scratch.keep(stats, "stats")
    vector = ["host", "pages", "total", "vector"]
    classes = stats.groupBy(*vector).agg(F.count(F.lit(1)).alias("size"), F.max(F.col("token") == 0).alias("whole")).where(f"size >= {LEAST_TOKENS}")
    classes = classes.withColumn("class", F.xxhash64(*vector))
    # A class's rank: more pages first, then fewer occurrences.
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "total", "vector"))
    classes = classes.withColumn("rank", F.shiftleft("size", 32) + rank)
    named = classes.select(*vector, F.col("class").alias("a"), F.col("rank").alias("b"), (F.col("whole") & (F.col("pages") >= LEAST_SAME)).alias("whole"))
    candidates = scratch.keep(stats.join(named, vector).selectExpr("host", "cast(if(whole, 1, 0) as int) kind", "token key", "a", "b"), "candidates")

    def judge(batches: Iterator[pa.RecordBatch], lookup) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 8 << 20):
            orders: dict[tuple[str, int], tuple[int, int]] = {}
            slots: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
            for host, page, template in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), lookup(part), strict=True):
                tokens, blocks = parsed(page or "")
                for c, h in ordered(tokens, template).items():
                    lo, hi = orders.get((host, c), (h, h))
                    orders[host, c] = min(lo, h), max(hi, h)
                if template.classes:
                    for slot, (n, linked) in slot_sums(blocks, template).items():
                        slots[host, slot][0] += n
                        slots[host, slot][1] += linked
            rows = [(host, 0, c, lo, hi) for (host, c), (lo, hi) in orders.items()] + [(host, 2, slot - (1 << 64 if slot >> 63 else 0), n, k) for (host, slot), (n, k) in slots.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "kind", "key", "a", "b"])

    judged = with_templates(pages.select("host", "html"), candidates, judge, _CLASSES)
    both = [F.when(F.col("kind") == 0, F.col("lo")).otherwise(F.col("a")).alias("a"), F.when(F.col("kind") == 0, F.col("hi")).otherwise(F.col("b")).alias("b")]
    judged = judged.groupBy("host", "kind", "key").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.sum(F.when(F.col("kind") == 2, F.col("a"))).alias("a"), F.sum(F.when(F.col("kind") == 2, F.col("b"))).alias("b")).select("host", "kind", "key", *both)
    judged = scratch.keep(judged, "judged")
    valid = judged.where("kind = 0 and a = b and a >= 0").select("host", F.col("key").alias("a"))
    tokens = candidates.join(valid, ["host", "a"], "left_semi").select("host", "kind", "key", "a", "b")
    return scratch.keep(tokens.unionByName(judged.where("kind = 2")), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page: the article without what surrounds it.

    Left out are scripts, styles, comments, menus, headers outside of the
    article, footers, asides, forms, elements whose role, class or id says
    that they are adverts, notices, sidebars, reader comments and the like,
    texts that a host's template repeats in all pages, and, where no element
    says which is the article, slots that consist of links or lie apart from
    the slot with most text. Character references are decoded; white space in
    a block becomes one space; blocks are joined by one.

    Pages of one host share a template; so do those without a url. A host of
    fewer than LEAST_PAGES pages has none, and its pages are judged by their
    elements alone. A null or empty html gives an empty text. Rows are rows:
    ids may repeat or be null. Other columns are not read; an empty table
    gives an empty result.

    Pages are read three times (tokens, order and slots, text) and don't move
    unless templates have over MOST_SENT rows; what is shuffled is a row for
    each distinct token of a host in a run of pages.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    host = F.coalesce(F.regexp_extract(F.lower(F.col("url").cast("string")), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("weight", F.xxhash64("page_id", "url", "html"))
    templates = deduce(rows, scratch)

    def write(batches: Iterator[pa.RecordBatch], lookup) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 8 << 20):
            texts = [article(parsed(page or "")[1], template) for page, template in zip(part.column("html").to_pylist(), lookup(part), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_templates(rows.drop("weight"), templates, write, "page_id long, url string, text string, n_chars long")
