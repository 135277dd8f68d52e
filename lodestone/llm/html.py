"""Main text of web pages by wrapper induction.

The pages of one host and layout are aligned with an exemplar by simple tree matching. A slot (a run of text in a block)
that reads the same on most aligned pages is template. Text that varies tells where the article stands: from the root
the wrapper goes down to the block that holds most of the varying text outside links, as long as no paragraph or heading
of varying text is left beside it. A page's main text is the slots in its block that matches this one, without the
template and without parts that by element, role, class or id are forms, asides, comments and the like.

Where a host has too few pages of a layout, or no block holds most of the text, a page's own marks decide: its article
or main part if it has one. All pages vote, by counts that are summed before the shuffle, and each is aligned with one
exemplar, so that a host may hold any share of the pages. Inline elements belong to the text of their block.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, batches_of, joined, stored, unused

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
# fixed values: elements by what they do
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head textarea select title".split())
BOILERPLATE = frozenset("nav header footer aside form dialog menu button fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Words of a class or id that mark a container which is no part of the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments disqus respond share sharing social related recommended widget toolbar login".split())
SPACES = re.compile(r"\s+")
CUTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Pages that must be aligned with a slot before it can be template, and the share of them that reads alike: elsewhere,
#: and in the block of the article.
LEAST, LEAST_INSIDE = (3, 0.5), (8, 0.8)
#: Pages needed before a layout tells where the article stands, and the share of the varying text it must hold.
LEAST_PAGES, MOST = 3, 0.6
#: Depth of blocks that make the layout of a page.
LAYOUT = 3
FLOW = frozenset("p h1 h2 h3 h4 h5 h6".split())


class Page:
    """Blocks of a page in order: label, parent, children, and the text runs (slots) with the block they stand in."""

    __slots__ = ("labels", "parents", "children", "outside", "inside", "slots", "links", "signatures", "sizes")

    def __init__(self, source: str):
        self.labels, self.parents, self.children = ["#"], [-1], [[]]
        self.outside, self.inside = [False], [False]
        self.slots: list[tuple[int, int, str]] = []
        #: Characters of each slot that stand in links.
        self.links: list[int] = []
        self._read(source)

    def _open(self, parent: int, label: str, outside: bool, inside: bool) -> int:
        at = len(self.labels)
        self.labels.append(label)
        self.parents.append(parent)
        self.children.append([])
        self.children[parent].append(at)
        self.outside.append(outside or self.outside[parent])
        self.inside.append(inside or self.inside[parent])
        return at

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        text: list[str] = []
        runs: dict[int, int] = {}
        linked, in_link = 0, False

        def flush() -> None:
            nonlocal linked
            if text:
                whole = SPACES.sub(" ", entities.unescape("".join(text))).strip()
                text.clear()
                linked, in_links = 0, linked
                if whole:
                    self.links.append(min(len(whole), in_links))
                    block = stack[-1][1]
                    runs[block] = run = runs.get(block, -1) + 1
                    self.slots.append((block, run, whole))

        def close(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
            """Closes the innermost open block of these names, if none of stop is nearer."""
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    flush()
                    del stack[i:]
                    return
                if stack[i][0] in stop:
                    return

        at, n = 0, len(source)
        while at < n:
            found = TOKEN.search(source, at)
            if not found:
                text.append(source[at:])
                linked += in_link * (n - at)
                break
            if found.start() > at:
                text.append(source[at : found.start()])
                linked += in_link * (found.start() - at)
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            closing, rest = found[1] or found[4], found[3] or found[6] or ""
            if name in RAW and not closing:
                if name == "head":
                    end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(source, at)
                    at = (end.end() if end[0].startswith("</") else end.start()) if end else at
                elif not rest.endswith("/"):
                    end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
                    at = end.end() if end else n
                text.append(" ")
                continue
            if name in INLINE:
                if name in ("br", "img"):
                    text.append(" ")
                elif name == "a":
                    in_link = not closing
                continue
            if closing:
                close((name,), () if name not in ("p", "li") else ("td", "th", "article", "body"))
                continue
            if name in ("html", "body"):
                flush()
            if name in CLOSES_P:
                close(("p",), ("td", "th", "article", "li", "div", "section"))
            if name in SIBLINGS:
                close(SIBLINGS[name], ("ul", "ol", "dl", "table", "select"))
            flush()
            marks, label, outside = self._attributes(rest) if rest else ((), name, False)
            label = f"{name}.{label}" if rest and label else name
            outside = outside or name in BOILERPLATE
            inside = name in ("article", "main") or "#main" in marks
            if name in VOID or rest.endswith("/"):
                continue
            stack.append((name, self._open(stack[-1][1], label, outside, inside and not outside)))
        flush()

    @staticmethod
    def _attributes(rest: str) -> tuple[tuple, str, bool]:
        marks, label, outside = [], "", False
        for key, *values in ATTRIBUTE.findall(rest):
            key, value = key.lower(), "".join(values)
            if key == "role":
                outside |= value.lower() in ROLES
                marks += ["#main"] * (value.lower() in ("main", "article"))
            elif key in ("hidden", "aria-hidden"):
                outside |= value.lower() != "false"
            else:
                words = [w.lower() for w in CUTS.split(value) if w]
                outside |= any(w in MARKS for w in words)
                if key == "class" and words:
                    label = words[0]
        return tuple(marks), label, outside

    def layout(self) -> bytes:
        """The kinds of blocks near the root that hold other blocks, as a digest."""
        paths, deep = {0: ("",)}, set()
        for i in range(1, len(self.labels)):
            above = paths.get(self.parents[i])
            if above and len(above) <= LAYOUT:
                paths[i] = (*above, self.labels[i])
                if self.children[i]:
                    deep.add(paths[i])
        return _digest(repr(sorted(deep)))

    def prepare(self) -> None:
        """Numbers for equal subtrees, and their sizes."""
        n = len(self.labels)
        self.signatures, self.sizes = [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            self.signatures[i] = _signature((self.labels[i], tuple(self.signatures[c] for c in self.children[i])))
            self.sizes[i] += sum(self.sizes[c] for c in self.children[i])


_signatures: dict[tuple, int] = {}
_matches: dict[tuple[int, int], int] = {}


def _signature(key: tuple) -> int:
    return _signatures.setdefault(key, len(_signatures))


def _trimmed(a: Page, xs: list[int], b: Page, ys: list[int]) -> tuple[int, int]:
    """How many subtrees at the begin and at the end of two rows are equal."""
    lo, hi, n, m = 0, 0, len(xs), len(ys)
    while lo < n and lo < m and a.signatures[xs[lo]] == b.signatures[ys[lo]]:
        lo += 1
    while hi < n - lo and hi < m - lo and a.signatures[xs[n - 1 - hi]] == b.signatures[ys[m - 1 - hi]]:
        hi += 1
    return lo, hi


def _match(a: Page, i: int, b: Page, j: int) -> int:
    """Simple tree matching: blocks of the largest common order-keeping alignment of two subtrees with equal labels.

    Depth first with a stack of its own, since pages may be nested deeper than calls may.
    """
    if a.signatures[i] == b.signatures[j]:
        return a.sizes[i]
    stack = [(i, j)]
    while stack:
        x, y = stack[-1]
        key = a.signatures[x], b.signatures[y]
        if key in _matches:
            stack.pop()
            continue
        xs, ys = a.children[x], b.children[y]
        lo, hi = _trimmed(a, xs, b, ys)
        labels: dict[str, list[int]] = {}
        for v in ys[lo : len(ys) - hi]:
            labels.setdefault(b.labels[v], []).append(v)
        wanted = {(a.signatures[u], b.signatures[v]): (u, v) for u in xs[lo : len(xs) - hi] for v in labels.get(a.labels[u], ())}
        missing = [pair for k, pair in wanted.items() if k[0] != k[1] and k not in _matches]
        if missing:
            stack += missing
        else:
            _matches[key] = 1 + _children(a, xs, b, ys, None)
            stack.pop()
    return _matches[a.signatures[i], b.signatures[j]]


def _children(a: Page, xs: list[int], b: Page, ys: list[int], pairs: list | None) -> int:
    """The best alignment of two rows of subtrees; equal ones at both ends need no table. pairs gets the children."""
    lo, hi = _trimmed(a, xs, b, ys)
    n, m = len(xs), len(ys)
    total = sum(a.sizes[x] for x in (*xs[:lo], *xs[n - hi :]))
    if pairs is not None:
        pairs += [*zip(xs[:lo], ys[:lo], strict=True), *zip(xs[n - hi :], ys[m - hi :], strict=True)]
    xs, ys = xs[lo : n - hi], ys[lo : m - hi]
    if not xs or not ys:
        return total
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row, label = table[-1], [0], a.labels[x]
        for k, y in enumerate(ys):
            best = above[k + 1] if above[k + 1] > row[k] else row[k]
            if label == b.labels[y]:
                best = max(best, above[k] + _match(a, x, b, y))
            row.append(best)
        table.append(row)
    if pairs is not None:
        i, j = len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
    return total + table[-1][-1]


def align(a: Page, b: Page) -> dict[int, int]:
    """Blocks of b to the blocks of a that they are matched with."""
    if len(_signatures) > 200_000 or len(_matches) > 200_000:
        _signatures.clear()
        _matches.clear()
    a.prepare()
    b.prepare()
    out, open_ = {0: 0}, [(0, 0)]
    while open_:
        i, j = open_.pop()
        pairs: list[tuple[int, int]] = []
        _children(a, a.children[i], b, b.children[j], pairs)
        for x, y in pairs:
            out[y] = x
        open_ += pairs
    return out


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def skeleton(page: Page) -> bytes:
    """An exemplar without its texts: blocks and the digests of its slots."""
    return pickle.dumps((page.labels, page.parents, {(block, run): _digest(text) for block, run, text in page.slots}))


_skeletons: dict[bytes, tuple] = {}


def _load(data: bytes) -> tuple[Page, dict]:
    found = _skeletons.get(data)
    if found is None:
        if len(_skeletons) > 2000:
            _skeletons.clear()
        page = Page("")
        page.labels, page.parents, slots = pickle.loads(data)
        page.children = [[] for _ in page.labels]
        for i, p in enumerate(page.parents[1:], 1):
            page.children[p].append(i)
        found = _skeletons[data] = (page, slots)
    return found


def extract(source: str | None, wrappers: dict[bytes, tuple[bytes, frozenset | set, int]] | None = None, marks: bool = True) -> tuple[str, int]:
    """(main text of a page, how many of its slots the wrapper of its layout leaves out).

    wrappers holds for each layout the exemplar, its slots (block, run) that are template, and its block of the article
    or -1. Without marks elements, roles, classes and ids play no part.
    """
    page = Page(source or "")
    kept, dropped = page.slots, 0
    exemplar_data, constant, region = (wrappers or {}).get(page.layout(), (b"", (), -1))
    matched = align(_load(exemplar_data)[0], page) if exemplar_data and (constant or region >= 0) else {}
    within = next((b for b, x in matched.items() if x == region), None) if region >= 0 else None
    if within is not None:
        inside = [False] * len(page.labels)
        inside[within] = True
        for i in range(within + 1, len(page.labels)):
            inside[i] = inside[page.parents[i]]
        kept = [s for s in kept if inside[s[0]]]
    varying = [s for s in kept if (matched.get(s[0]), s[1]) not in constant] if constant else kept
    if varying:
        # a page that is nothing but template tells no template from content
        kept, dropped = varying, len(page.slots) - len(varying)
    if marks:
        kept = [s for s in kept if not page.outside[s[0]]]
    if marks and within is None and any(page.inside[s[0]] for s in kept):
        kept = [s for s in kept if page.inside[s[0]]]
    return "\n\n".join(text for _, _, text in kept), dropped


def article_block(exemplar: Page, votes: dict[tuple[int, int], tuple[int, int]], loose: dict[int, int], own: dict[int, int], pages: int) -> int:
    """The exemplar's block of the article, or -1.

    votes has (pages, same) of each slot; own the varying text outside links that stands in a block itself, loose that
    in blocks of other pages below it that match none.
    """
    if pages < LEAST_PAGES:
        return -1
    mass = [own.get(i, 0) + loose.get(i, 0) for i in range(len(exemplar.labels))]
    for i in range(len(mass) - 1, 0, -1):
        mass[exemplar.parents[i]] += mass[i]
    flow = {b for (b, _), (n, same) in votes.items() if exemplar.labels[b].split(".")[0] in FLOW and 2 * (n - same) >= pages}
    at = 0
    while not any(c in flow for c in exemplar.children[at]):
        best = max(exemplar.children[at], key=lambda c: mass[c], default=None)
        if best is None or mass[best] < MOST * mass[0] or mass[best] < 2 * own.get(best, 0):
            break
        at = best
    return at if at and mass[at] >= MOST * mass[0] and exemplar.labels[at].split(".")[0] not in ("html", "body") else -1


VOTE = "host string, layout binary, block int, run int, pages long, same long, own long, loose long"


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrappers): for each layout of a host the exemplar, its slots that are template, and its article's block."""
    batches_of(pages.sparkSession, 500)
    hosted = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).where("host <> '' and html is not null")

    def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first page of each layout in a task, by the order of digests."""
        best: dict[tuple, tuple] = {}

        def out() -> pa.RecordBatch:
            rows = [(*key, *value) for key, value in best.items()]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), *[pa.binary()] * 3), strict=True)], names=["host", "layout", "order", "wrapper"])

        for batch in batches:
            for host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(source)
                key, order = (host, page.layout()), _digest(source)
                if key not in best or order < best[key][0]:
                    best[key] = order, skeleton(page)
            if len(best) > 5_000:
                yield out()
        yield out()

    first = hosted.mapInArrow(layouts, "host string, layout binary, order binary, wrapper binary").groupBy("host", "layout").agg(F.min(F.struct("order", "wrapper")).alias("one"))
    wrappers = stored(first.select("host", "layout", "one.order", "one.wrapper"), "wrappers")
    of_host = stored(wrappers.groupBy("host").agg(F.collect_list(F.struct("layout", "order", "wrapper")).alias("wrappers")), "exemplars")

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(*key, *n) for key, n in counts.items()]
            counts.clear()
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names=["host", "layout", "block", "run", "pages", "same", "own", "loose"])

        for batch in batches:
            for host, source, known in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("host", "html", "wrappers")), strict=True):
                page = Page(source)
                layout = page.layout()
                wrapper, order = next((w["wrapper"], w["order"]) for w in known if w["layout"] == layout)
                if order == _digest(source):
                    continue  # the exemplar itself or a copy of it: no evidence
                exemplar, slots = _load(wrapper)
                matched = align(exemplar, page)
                counts.setdefault((host, layout, 0, -1), [0] * 4)[0] += 1
                for (block, run, text), links in zip(page.slots, page.links, strict=True):
                    x = matched.get(block)
                    same = False
                    if x is not None and (x, run) in slots:
                        same = slots[x, run] == _digest(text)
                        n = counts.setdefault((host, layout, x, run), [0] * 4)
                        n[0] += 1
                        n[1] += same
                    if not same and links < len(text):
                        direct = x is not None
                        while x is None:
                            block = page.parents[block]
                            x = matched.get(block)
                        counts.setdefault((host, layout, x, -1), [0] * 4)[2 if direct else 3] += len(text) - links
            if len(counts) > 50_000:
                yield out()
        yield out()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("layout", pa.binary()), ("wrapper", pa.binary()), ("constant", pa.list_(pa.struct([("block", pa.int32()), ("run", pa.int32())]))), ("region", pa.int32())]))
        for batch in batches:
            hosts, made = batch.column(0), []
            for rows in batch.column(1).to_pylist():
                made.append([])
                for w in rows:
                    exemplar, _ = _load(w["wrapper"])
                    seen = {(v["block"], v["run"]): (v["pages"], v["same"]) for v in w["votes"]}
                    loose, own = ({v["block"]: v[k] for v in w["votes"] if v["run"] < 0} for k in ("loose", "own"))
                    n = seen.get((0, -1), (0, 0))[0]
                    slots = {k: v for k, v in seen.items() if k[1] >= 0}
                    region = article_block(exemplar, slots, loose, own, n)
                    inside = [i == region for i in range(len(exemplar.labels))]
                    for i in range(1, len(inside)):
                        inside[i] = inside[i] or inside[exemplar.parents[i]]
                    least = {k: LEAST_INSIDE if inside[k[0]] or region < 0 and _marked(exemplar, k[0]) else LEAST for k in slots}
                    constant = [{"block": k[0], "run": k[1]} for k, (met, same) in slots.items() if met >= least[k][0] and same >= least[k][1] * met]
                    made[-1].append({"layout": w["layout"], "wrapper": w["wrapper"], "constant": constant, "region": region})
            yield pa.RecordBatch.from_arrays([hosts, pa.array(made, kind)], names=["host", "wrappers"])

    met = joined(hosted, of_host, ["host"], "inner", 64 + F.octet_length(F.to_json("wrappers")))
    voted = stored(met.mapInArrow(votes, VOTE).groupBy("host", "layout", "block", "run").agg(*(F.sum(c).alias(c) for c in ("pages", "same", "own", "loose"))), "votes")
    listed = voted.groupBy("host", "layout").agg(F.collect_list(F.struct("block", "run", "pages", "same", "own", "loose")).alias("votes"))
    told = listed.join(wrappers.hint("shuffle_hash"), ["host", "layout"]).groupBy("host").agg(F.collect_list(F.struct("layout", "wrapper", "votes")).alias("wrappers"))
    return stored(told.mapInArrow(decide, "host string, wrappers array<struct<layout: binary, wrapper: binary, constant: array<struct<block: int, run: int>>, region: int>>"), "templates")


def _marked(page: Page, block: int) -> bool:
    """Whether a block stands in an article or main part."""
    while block > 0:
        if page.labels[block].split(".")[0] in ("article", "main"):
            return True
        block = page.parents[block]
    return False


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """pages with main_text, n_main_chars (its code points) and n_left_out (slots that the wrapper leaves out).

    A null or empty page, and one without main text, has an empty one. Pages without a host, or of a host with too few
    pages to tell a template, are judged by their structure alone. Blocks are joined in page order by an empty line,
    with character references decoded and white space within a block made one space. Repeated rows and copies get
    equal texts. Pages may be of any length and nested to any depth. Columns named like the new ones are replaced,
    others pass through. With marks False the wrapper alone decides.
    """
    host, wrappers, page = unused(pages, "_host", "_wrappers", "_page")
    templates = induce(pages.select(url_col, html_col), url_col, html_col).toDF(host, wrappers)
    met = joined(pages.withColumn(host, _host(url_col)), templates, [host], "left", 96 + F.octet_length(F.to_json(wrappers)))
    packed = met.withColumn(page, F.struct(F.col(html_col).alias("html"), F.col(wrappers).alias("wrappers"))).drop(host, wrappers)

    def compute(rows: list) -> list[list]:
        found = [extract(r["html"], {w["layout"]: (w["wrapper"], {(c["block"], c["run"]) for c in w["constant"]}, w["region"]) for w in r["wrappers"] or ()}, marks) for r in rows]
        return [[t for t, _ in found], [len(t) for t, _ in found], [n for _, n in found]]

    new = [T.StructField("main_text", T.StringType()), T.StructField("n_main_chars", T.LongType()), T.StructField("n_left_out", T.LongType())]
    return append_columns(packed, page, new, compute).drop(page)
