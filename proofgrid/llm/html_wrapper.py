"""Main text of web pages by wrappers inferred from pages of the same host.

A page's token stream (tags and texts, with scripts, styles and comments left out and
unclosed tags closed) is folded into a union-free regular expression: neighbours of one
label, and sequences of labels that repeat, become repeated groups, texts become slots.
The expressions of a host's pages are aligned one after the other, in an order set by
their content; tags that only one side has become optional groups, and slots gather how
often they were filled, how much text and link text they held, and the texts that they
held most often. The result is the host's wrapper. Wrappers of a host are aligned within
tasks, then across tasks in a tree.

Each page is read again with its host's wrapper, its tags matched to the wrapper's. A text
counts if its slot isn't mostly links and doesn't hold the very same text on half of the
host's pages or more. That goes for a notice, too, that stands among paragraphs which share
its slot, unless such texts are a third of the page: then it is a near copy of others. The
page's region is where its counting text lies: its article elements if nine tenths of it are
there, else its main elements (or blocks named so), else its article elements, else its blocks
named content, if half of it is there, else the lowest block that holds nine tenths of it and has no heading, paragraph, list or table with
counting text beside it. The region's counting texts and its headings are kept, but for those
in menus, asides, forms and footers and in blocks whose every class name says as much.

Expressions are aligned from both ends; between, the k-th blocks of one label are partners,
and the longest run of partners in order is kept, in time n log n and memory n.

Defined results: null or empty html gives an empty text; pages without a host share a
wrapper; a page of which no text counts is one of copies, and all its texts do; a page
without any text gives an empty one. Whole pages are read, however deep or long (beyond 200
levels, deeper blocks count as parts of the last one); other columns are ignored, whatever
their names; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage
from .url_cascade import url_parts

#: A comment; a tag with attributes, their values quoted or (then with quotes inside) not; a declaration.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|$)|'[^']*+(?:'|$)|[^\s>"'][^\s>]*+)?)?|=)*+)(?:>|$)|<[!?][^>]*(?:>|$)""", re.S
)
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WHITE = re.compile(r"\s+")

# HTML's elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Blocks that end an open paragraph.
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Blocks within which an unclosed p, li or cell of an outer block stays open.
SCOPE = set("ul ol dl table article section main div aside nav form td th body html".split())
LEFT_TAGS = set("nav aside form footer header menu dialog button select fieldset head".split())
LEFT_WORDS = set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead comment comments respond reply replies discussion disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay toolbar widget skip pagination pager copyright".split()
)
#: Words that say nothing beside those.
PLAIN_WORDS = set("area bar block body bottom box col column container content group inner item items left list main module outer panel pane right row section site slot top unit wrap wrapper zone".split())
REGIONS = ("article", "main", "content")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are texts themselves or rows of such.
ROWS = HEADINGS | set("p ul ol li dl dt dd table tbody thead tr td th pre blockquote".split())
#: The part of the counting text, in percent, that a region holds; that elements of REGIONS hold.
NEARLY, HALF = 90, 50
#: Levels of blocks that are told apart; texts that a slot counts.
MAX_DEPTH, TEXTS = 200, 48
#: Hosts with at least this part (one in HOT) of all pages are split.
HOT = 1000

# A node is [label, repeated, optional, kids, slot]; a slot is [filled, characters, link characters, {checksum: times} of the most frequent texts], the root's counts pages.
TEXT = "#"
SOLE, SHARED = 1, 2


def _label(tag: str, attrs: str) -> str:
    """The tag and its class, id and role names, without digits."""
    names = set()
    for m in NAMED.finditer(attrs):
        value = next(g for g in m.groups()[1:] if g is not None).lower()
        names |= {n for n in (re.sub(r"[^a-z]+", "-", v).strip("-") for v in value.split()) if n}
    return ".".join([tag, *sorted(names)])


def _left_out(parts: list[str]) -> bool:
    """Whether every name of a block says that it is no main text."""
    said = [set(n.split("-")) for n in parts[1:]]
    return any(w & LEFT_WORDS for w in said) and all(w <= LEFT_WORDS | PLAIN_WORDS for w in said)


def read_page(html: str | None) -> list:
    """The page as a tree of blocks [label, kids] with text leaves [TEXT, text, link characters]."""
    root: list = ["", []]
    stack = [("", root)]
    run: list[str] = []
    link = in_link = 0

    def flush() -> None:
        nonlocal link
        text = WHITE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            stack[-1][1][1].append([TEXT, text, link])
        run.clear()
        link = 0

    def close(names: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    pos, html = 0, html or ""
    while pos < len(html):
        m = TOKEN.search(html, pos)
        if m is None:
            run.append(html[pos:])
            break
        if m.start() > pos:
            part = html[pos : m.start()]
            run.append(part)
            link += len(part) if in_link else 0
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|$)", re.I).search(html, pos)
                pos = end.end() if end else len(html)
            continue
        if tag in INLINE or tag in VOID:
            if tag in ("br", "hr"):
                run.append(" ")
            in_link = (not m[1]) if tag == "a" else in_link
            continue
        in_link = False
        if m[1]:
            close({tag}, {"td", "th"} - {tag} if tag not in ("table", "tr", "tbody") else set())
            flush()
        else:
            flush()
            if tag in CLOSES:
                close(CLOSES[tag], SCOPE - CLOSES[tag])
            if tag in ENDS_P:
                close({"p"}, SCOPE)
            if len(stack) < MAX_DEPTH:
                node = [_label(tag, m[3]), []]
                stack[-1][1][1].append(node)
            else:  # tags keep their balance, texts go to the last block told apart
                node = stack[-1][1]
            stack.append((tag, node))
    flush()
    return root


def checksum(text: str) -> str:
    return format(zlib.crc32(text.encode("utf-8", "surrogatepass")), "x")


def fold(page: list) -> list:
    """A page's tree as an expression, with its repeats folded; a text counts once, however often the page has it."""
    out = _fold(page)
    todo = [out]
    while todo:
        n = todo.pop()
        if n[4] and n[4][3]:
            n[4][3] = dict.fromkeys(n[4][3], 1)
        todo += n[3]
    return out


def _fold(page: list) -> list:
    if page[0] == TEXT:
        return [TEXT, 0, 0, [], [1, len(page[1]), page[2], {checksum(page[1]): 1}]]
    return [page[0], 0, 0, _fold_repeats([_fold(k) for k in page[1]]), None if page[0] else [1, 0, 0, {}]]


def frequent(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    """Counts of both sides; beyond TEXTS texts the rarest are taken off all (a text with more than a TEXTS-th of all never goes)."""
    out = dict(a)
    for k, n in b.items():
        out[k] = out.get(k, 0) + n
    if len(out) > TEXTS:
        cut = sorted(out.values(), reverse=True)[TEXTS]
        out = {k: n - cut for k, n in out.items() if n > cut}
    return out


def _fold_repeats(kids: list) -> list:
    for period in range(1, 5):
        out: list = []
        at = 0
        while at < len(kids):
            head = kids[at : at + period]
            n = 1
            while period + at <= len(kids) and [k[0] for k in kids[at + n * period : at + (n + 1) * period]] == [k[0] for k in head]:
                n += 1
            if n == 1 or (period > 1 and len({k[0] for k in head}) == 1):
                out.append(kids[at])
                at += 1
                continue
            for r in range(1, n):
                head = [align(a, b) for a, b in zip(head, kids[at + r * period : at + (r + 1) * period])]
            out.append([head[0][0], 1, head[0][2], head[0][3], head[0][4]] if period == 1 else ["()", 1, int(all(k[2] for k in head)), head, None])
            at += n * period
        kids = out
    return kids


def align(a: list, b: list) -> list:
    """The expression that covers two expressions of one label."""
    slot = a[4] or b[4]
    if a[4] and b[4]:
        slot = [a[4][0] + b[4][0], a[4][1] + b[4][1], a[4][2] + b[4][2], frequent(a[4][3], b[4][3])]
    return [a[0], a[1] | b[1], a[2] | b[2], _align_lists(a[3], b[3]), slot]


def _key(x: list) -> tuple:
    return (x[0], *(k[0] for k in x[3])) if x[0] == "()" else (x[0],)


def _partners(x: list[tuple], y: list[tuple]) -> list[tuple[int, int]]:
    """Places of equal keys in x and y, rising in both: the k-th of a key with the k-th, the longest run of these."""
    n, m, lo, hi = len(x), len(y), 0, 0
    while lo < min(n, m) and x[lo] == y[lo]:
        lo += 1
    while hi < min(n, m) - lo and x[n - 1 - hi] == y[m - 1 - hi]:
        hi += 1
    places: dict[tuple, list[int]] = {}
    for j in range(m - hi - 1, lo - 1, -1):
        places.setdefault(y[j], []).append(j)
    ends: list[int] = []  # the smallest place in y that a run of each length ends at
    runs: list[tuple] = []
    for i in range(lo, n - hi):
        if places.get(x[i]):
            j = places[x[i]].pop()
            k = bisect_left(ends, j)
            run = (i, j, runs[k - 1] if k else None)
            ends[k : k + 1], runs[k : k + 1] = [j], [run]
    middle = []
    run = runs[-1] if runs else None
    while run:
        middle.append(run[:2])
        run = run[2]
    return [(i, i) for i in range(lo)] + middle[::-1] + [(n - k, m - k) for k in range(hi, 0, -1)]


def _align_lists(x: list, y: list) -> list:
    out, i, j = [], 0, 0
    for p, q in [*_partners([_key(k) for k in x], [_key(k) for k in y]), (len(x), len(y))]:
        out += [[k[0], k[1], 1, *k[3:]] for k in (*x[i:p], *y[j:q])]
        if p < len(x):
            out.append(align(x[p], y[q]))
        i, j = p + 1, q + 1
    return out if len(x) == len(y) == len(out) else _fold_repeats(out)


class Wrapper:
    """A host's expression, ready to say which texts of a page are its main text."""

    def __init__(self, root: list):
        self.root = root
        self.pages = root[4][0] if root[4] else 0

    def texts(self, page: list) -> list[str]:
        """The page's kept texts in order."""
        tree = self._judged(page, self.root, SHARED)
        if 3 * tree[3] > tree[2] + tree[3]:  # many texts are others' too: a near copy
            tree = self._judged(page, self.root, SOLE)
        if not tree[2]:  # nothing counts: a copy
            tree = self._judged(page, self.root, None)
        out: list[str] = []
        for region in self._regions(tree):
            self._collect(region, out)
        return out

    def _judged(self, page: list, node: list | None, fixed: int | None) -> list:
        """The page as blocks [names, kids, weight, shared] and texts [TEXT, text, weight, shared, kept].

        Weights are characters that count, shared those of texts that go though their slot
        holds others, too; fixed says which texts go (SHARED includes SOLE).
        """
        kids = []
        for k in node[3] if node else []:
            kids += k[3] if k[0] == "()" else [k]
        places: dict[str, list[int]] = {}
        for j, k in enumerate(kids):
            places.setdefault(k[0], []).append(j)
        parts = page[0].split(".")
        heading = parts[0] in HEADINGS
        out: list = [parts, [], 0, 0]
        at = 0
        for child in page[1]:
            found = places.get(child[0])
            if found:  # the next one, else the first
                at = found[bisect_left(found, at) % len(found)]
            match = kids[at] if found else None
            if child[0] == TEXT:
                links = self._links(match, child)
                gone = self._fixed(match, child[1])
                counts = not links and not (fixed and gone and gone <= fixed)
                shared = len(child[1]) if not links and not counts and gone == SHARED else 0
                new = [TEXT, child[1], len(child[1]) if counts else 0, shared, counts or heading]
            else:
                new = self._judged(child, match, fixed)
                if new[0][0] in LEFT_TAGS - {"header"} or _left_out(new[0]):
                    new[2:4] = 0, 0
            out[1].append(new)
            out[2] += new[2]
            out[3] += new[3]
        return out

    @staticmethod
    def _links(slot: list | None, child: list) -> bool:
        """Whether a text's slot held mostly links (the text itself, where the wrapper has no slot for it)."""
        if slot and slot[4]:
            return slot[4][2] > slot[4][1] / 2
        return child[2] > len(child[1]) / 2

    def _fixed(self, slot: list | None, text: str) -> int | None:
        """SOLE or SHARED if a slot held the text, and nothing else or others, too, on half of the pages or more, and more than twice."""
        n = slot[4][3].get(checksum(text), 0) if slot and slot[4] else 0
        return None if n <= 2 or 2 * n < self.pages else SOLE if len(slot[4][3]) == 1 else SHARED

    @staticmethod
    def _regions(tree: list) -> list[list]:
        """The blocks that hold the main text."""
        found = {}
        for tag in REGIONS:
            found[tag], todo = [], [tree]
            while todo:
                n = todo.pop()
                if n[2] and (n[0][0] == tag or (tag != "article" and tag in n[0][1:])):
                    found[tag].append(n)
                elif n is tree or n[2]:
                    todo += [k for k in reversed(n[1]) if k[0] != TEXT]
        for tag, least in (("article", NEARLY), ("main", HALF), ("article", HALF), ("content", HALF)):
            if found[tag] and 100 * sum(n[2] for n in found[tag]) >= least * tree[2]:
                return found[tag]
        node = tree
        while True:
            best = max((k for k in node[1] if k[0] != TEXT), key=lambda k: k[2], default=None)
            if best is None or not best[2] or 100 * best[2] < NEARLY * node[2] or best[0][0] in ROWS:
                return [node]
            beside = [k for k in node[1] if k is not best]
            if any(k[2] if k[0] == TEXT else k[0][0] in ("h1", "h2") or (k[2] and k[0][0] in ROWS) for k in beside):
                return [node]
            node = best

    def _collect(self, node: list, out: list[str]) -> None:
        for k in node[1]:
            if k[0] == TEXT:
                if k[4]:
                    out.append(k[1])
            elif k[0][0] not in LEFT_TAGS - {"header"} and not _left_out(k[0]):
                self._collect(k, out)


def infer(pages: DataFrame, html_col: str = "html", flush: int = 4000) -> DataFrame:
    """(host, wrapper as JSON, pages) from a table with columns host and html_col."""
    pack = lambda found: {"host": list(found), "wrapper": [json.dumps(w, separators=(",", ":")) for w in found.values()], "pages": [seen.pop(h) for h in found], "salt": [None] * len(found)}
    seen: Counter[str] = Counter()

    def learn(batches: Iterator[pa.RecordBatch]):
        found: dict[str, list] = {}
        for batch in batches:
            hosts, pages = batch.column(0).to_pylist(), [h.as_py() or "" for h in batch.column(1)]
            for i in sorted(range(len(pages)), key=lambda i: (hosts[i], zlib.crc32(pages[i].encode("utf-8", "surrogatepass")), pages[i])):
                host, new = hosts[i], fold(read_page(pages[i]))
                found[host] = align(found[host], new) if host in found else new
                seen[host] += 1
                if len(found) > flush:
                    yield pack(found)
                    found.clear()
        if found:
            yield pack(found)

    def unite(table):
        whole = None
        for text in sorted(table["wrapper"].to_pylist()):  # not as they arrive
            new = json.loads(text)
            whole = new if whole is None else align(whole, new)
        return pa.table({"host": table["host"][:1], "wrapper": pa.array([json.dumps(whole, separators=(",", ":"))]), "pages": pa.array([sum(table["pages"].to_pylist())], pa.int64()), "salt": pa.array([None], pa.int32())})

    schema = "host string, wrapper string, pages long, salt int"
    parts = map_arrow(pages.select("host", F.col(f"`{html_col}`").alias("html")), learn, schema)
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    for keys in (("host", "salt"), ("host",)):
        parts = parts.groupBy(*keys).applyInArrow(unite, schema)
    return parts.select("host", "wrapper", "pages")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep with text (kept blocks joined by two line ends) and n_chars (code points) for every row."""
    host = url_parts(F.col(f"`{url_col}`"))[0]
    rows = pages.select(*(F.col(f"`{k}`") for k in keep), host.alias("__host"), F.col(f"`{html_col}`").alias("__html"))
    wrappers = stage(infer(rows.select(F.col("__host").alias("host"), "__html"), "__html"), "wrappers")
    # hosts with a thousandth of all pages or more (a thousand at most) are dealt out in as many parts
    total = wrappers.agg(F.sum("pages")).first()[0] or 1
    hot = wrappers.where(F.col("pages") * HOT >= total).select(F.col("host").alias("__host"), F.ceil(F.col("pages") * HOT / total).cast("int").alias("__parts"))
    hot = F.broadcast(hot)
    rows = rows.join(hot, "__host", "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__html", *keep), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    wrappers = wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper")).join(hot, "__host", "left")
    wrappers = wrappers.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    both = rows.join(wrappers.hint("shuffle_hash"), ["__host", "__part"], "left")
    kept = [f for f in rows.schema if not f.name.startswith("__")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = []
                for html, wrapper in zip(part.column("__html"), part.column("__wrapper")):
                    w = wrapper.as_py()
                    if w not in known:
                        if len(known) > 2000:
                            known.clear()
                        known[w] = Wrapper(json.loads(w))
                    texts.append("\n\n".join(known[w].texts(read_page(html.as_py()))))
                yield {f.name: part.column(f.name) for f in kept} | {"text": texts}

    return map_arrow(both, run, schema).withColumn("n_chars", F.length("text").cast("long"))
