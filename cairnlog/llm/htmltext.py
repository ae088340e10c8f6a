"""HTML extraction by union-free regular expressions, inferred host by host.

A page is a stream of block tags and text runs (inline tags are part of the text). From a bounded sample of a host's
pages one wrapper is inferred: repeats inside a stream fold into repeated groups, then streams are aligned one after
the other; text against text becomes a slot, what only some pages have an optional group. A text that a slot has on three
pages and on half of the sample is template and no main text. Headings are spared, and within an article or main element
all text that stands in no box of its own there (a div, list or the like with a class or id): a passage that a host's
articles share is theirs. A wrapper whose template texts would be over half of the sample's main text has none (a host of
copies of one article). Otherwise a slot is main text or boilerplate by the vote of the pages it was aligned from, where a page votes by the
elements that enclose the text. A page that its host's wrapper matches gets its text from the wrapper's main slots; one
that it doesn't match, or whose host has none, from its own elements by the same rules. Every text is whole, and no page
is too long to take part: nothing is cut by length.

Main text is what lies in article elements (else main, else the body), without menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments, as told by element names and class, id and role words. Such a word
is one of a class name's words ("site-footer"), not one of a name that only says what a page has ("has-sidebar",
"comments-open"); an article or main element that is the first of its page is no boilerplate by the words around it.

Defined results: null or empty html gives an empty text; rows keep their number, order aside, repeated ones too; a null
URL has host ''; of votes that tie the page's own elements decide; other columns than page_id, url and html are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, only, slices, stored
from .urlfilter import host_of

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v\xa0  -     　\x1c-\x1f\x85]+")

RAW = frozenset("script style noscript iframe template svg textarea title object xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table
    tbody td tfoot th thead tr ul button""".split()
)
LOOSE = frozenset("p li dt dd tr td th option".split())
BOXES = frozenset("div section ul ol dl table details figure fieldset address blockquote".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu button select option search head".split())
#: Words of class, id and role that mark boilerplate; header counts outside an article alone.
BOILER_WORDS = frozenset(
    """nav navs navbar navigation menu menus aside ad ads adv advert adverts advertisement advertising gdpr alert alerts modal popup
    overlay share sharing social related recommended recommendations reply replies discussion comment comments disqus pager
    pagination widget widgets search login signup form complementary contentinfo dialog skip copyright respond footer footers
    sidebar sidebars cookie cookies consent promo promos promotion sponsor sponsored sponsors newsletter subscribe subscription
    breadcrumb breadcrumbs banner notice notices""".split()
)
HEADER_WORDS = frozenset("header masthead topbar toolbar".split())
#: First and last words of names that say what a page has, not what an element is.
HAS = frozenset("has no with without is not js".split())
STATE = frozenset("open closed enabled disabled on off active visible hidden left right".split())
HEADING = re.compile(r"<h[1-6]\b")


def words_of(names: str) -> set[str]:
    """The words of class names, without those of names that are about the page."""
    out: set[str] = set()
    for name in names.lower().split():
        parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if len(parts) > 1 and (parts[0] in HAS or (parts[-1] in STATE and parts[0] in ("comments", "comment", "sidebar", "menu", "nav", "ads", "search", "form"))):
            # "sidebar-left" and the like are sidebars; "comments-open" tells of the page.
            if parts[0] in HAS or parts[-1] not in ("left", "right"):
                continue
        out.update(parts)
    return out


@dataclass(frozen=True)
class Settings:
    """pages bounds the sample of each host; cells is how many pairs of nodes one alignment table holds."""

    pages: int = 8
    cells: int = 60_000
    constant: int = 3
    broadcast_bytes: int = 16_000_000


def tokens(page: str) -> list[tuple[str, str, bool, str, bool]]:
    """(symbol, text, main, root, boxed): symbol '#' for a text run, else a block tag with its class words."""
    out: list[tuple[str, str, bool, str, bool]] = []
    # Open structural elements: (tag, boilerplate from here on, in article, in main, in a box of the article)
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    run: list[str] = []
    at, n = 0, len(page)
    rooted = False

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            boiler, article, main, boxed = stack[-1][1:] if stack else (False, False, False, False)
            out.append(("#", text, not boiler, "article" if article else "main" if main else "body", boxed or not (article or main)))

    while at < n:
        m = TAG.search(page, at)
        if not m:
            run.append(page[at:])
            break
        run.append(page[at : m.start()])
        at = m.end()
        close, name, attrs = m[1], m[2] or m[4], m[3] or m[5] or ""
        if close:
            close = close.lower()
            if close not in BLOCKS:
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == close:
                    del stack[k:]
                    break
                # A loose element's end tag does not close what encloses it.
                if close in LOOSE and stack[k][0] not in LOOSE:
                    break
            if close not in LOOSE:  # their end tags are optional, so they tell nothing of the template
                out.append((f"</{close}>", "", False, "", False))
            continue
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            run.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        words: set[str] = set()
        hidden = bool(re.search(r"\bhidden\b", attrs, re.I)) and bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", attrs, re.I))
        for key, value in NAMED.findall(attrs):
            if key.lower() in ("class", "id", "role"):
                words |= words_of(value.strip("\"'"))
        boiler, article, main, boxed = stack[-1][1:] if stack else (False, False, False, False)
        boxed |= (article or main) and bool(words) and name in BOXES
        root = name in ("article", "main") or (name == "div" and re.search(r"role\s*=\s*[\"']?main", attrs, re.I))
        if root and boiler and not rooted and not any(x[0] in BOILER_TAGS for x in stack):
            boiler = False
        boiler |= name in BOILER_TAGS or hidden or bool(words & BOILER_WORDS)
        rooted |= bool(root) and not boiler
        if name == "header" or words & HEADER_WORDS:
            boiler |= not (article or main)
        if name == "article":
            article = True
        if name == "main" or (words & {"main"} and re.search(r"role\s*=\s*[\"']?main", attrs, re.I)):
            main = True
        if name not in VOID and name not in ("html", "body"):
            if name in LOOSE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] not in LOOSE or (name == "li") != (stack[k][0] == "li"):
                        break
                boiler |= bool(stack and stack[-1][1])
            elif stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((name, boiler, article, main, boxed))
        out.append((f"<{name}{'.' + '.'.join(sorted(words - {''})) if words else ''}>", "", False, "", False))
    flush()
    root = next((r for r in ("article", "main") if any(t[2] and t[3] == r for t in out)), "body")
    return [(s, t, ok and (where == root or (root == "main" and where == "article")), where, boxed) for s, t, ok, where, boxed in out]


# A wrapper is a list of nodes: ("t", symbol), ("+", nodes), ("?", nodes) and ("#", main votes, all votes, texts, spared):
# texts has for the hash of each text that was met in the slot the pages that had it, as bits.


def shape(node: tuple) -> str:
    return node[1] if node[0] == "t" else "#" if node[0] == "#" else f"({''.join(map(shape, node[1]))}){node[0]}"


def merge(a: tuple, b: tuple) -> tuple:
    """Two nodes that stand for one: votes add up, groups are merged part by part."""
    if a[0] == "#":
        texts, more = (a[3], b[3]) if len(a[3]) >= len(b[3]) else (b[3], a[3])
        for mark, where in more.items():
            texts[mark] = texts.get(mark, 0) | where
        return ("#", a[1] + b[1], a[2] + b[2], texts, a[4] or b[4])  # spared once, spared for good
    if a[0] in "+?":
        return (a[0], align(a[1], b[1]))
    return a


def fold(nodes: list[tuple], longest: int = 12) -> list[tuple]:
    """Tandem repeats become repeated groups, short ones first."""
    for size in range(1, longest + 1):
        out: list[tuple] = []
        i, shapes = 0, [shape(x) for x in nodes]
        while i < len(nodes):
            k = 1
            while shapes[i + (k - 1) * size : i + k * size] == shapes[i + k * size : i + (k + 1) * size] and len(shapes[i + k * size : i + (k + 1) * size]) == size:
                k += 1
            if k > 1 and not (size == 1 and nodes[i][0] in "#+"):
                group = nodes[i : i + size]
                for r in range(1, k):
                    group = [merge(x, y) for x, y in zip(group, nodes[i + r * size : i + (r + 1) * size], strict=True)]
                out.append(("+", group))
                i += k * size
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def optional(nodes: list[tuple]) -> list[tuple]:
    if not nodes or (len(nodes) == 1 and nodes[0][0] == "?"):
        return list(nodes)
    # An optional part of an optional group is as well a part that is met or not by itself.
    return [("?", nodes)]


def same(a: tuple, b: tuple) -> bool:
    if a[0] == "?" or b[0] == "?":
        return a[0] == b[0] and shape(a) == shape(b)
    return a[0] == b[0] and (a[0] == "#" or (a[1] == b[1] if a[0] == "t" else shape(a[1][0]) == shape(b[1][0])))


def once(group: list[tuple], nodes: list[tuple], j: int) -> bool:
    """Whether nodes[j:] begins with one round of a repeated group."""
    return nodes[j : j + len(group)] != [] and [shape(x) for x in nodes[j : j + len(group)]] == [shape(x) for x in group]


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of shapes that stand once in either list, in the longest run that is in order in both."""
    ca, cb = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b) if cb[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a) if ca[x] == 1 and x in at]
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        tops[p : p + 1] = [j]
        ends[p : p + 1] = [k]
        back.append(ends[p - 1] if p else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[tuple], b: list[tuple], cells: int = Settings.cells) -> list[tuple]:
    """The regular expression of both: the alignment with the fewest unmatched nodes; those become optional groups.

    Lists too long for one table are cut where a shape is unique in both; a stretch without such a shape that is still
    too long is optional as a whole, on either side."""
    sa, sb = [shape(x) for x in a], [shape(x) for x in b]
    if sa == sb:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    if len(a) * len(b) <= cells:
        return align_table(a, b)
    head = 0
    while head < min(len(a), len(b)) and sa[head] == sb[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and sa[-1 - tail] == sb[-1 - tail]:
        tail += 1
    if head or tail:
        middle = align(a[head : len(a) - tail], b[head : len(b) - tail], cells)
        ends = [merge(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
        return [merge(x, y) for x, y in zip(a[:head], b[:head], strict=True)] + middle + ends
    cuts = anchors(sa, sb)
    if not cuts:
        return optional(a) + optional(b)
    out: list[tuple] = []
    i = j = 0
    for x, y in cuts:
        out += align(a[i:x], b[j:y], cells) + [merge(a[x], b[y])]
        i, j = x + 1, y + 1
    return out + align(a[i:], b[j:], cells)


def align_table(a: list[tuple], b: list[tuple]) -> list[tuple]:
    la, lb = len(a), len(b)
    cost = [[0] * (lb + 1) for _ in range(la + 1)]
    move = [[""] * (lb + 1) for _ in range(la + 1)]
    for i in range(la, -1, -1):
        for j in range(lb, -1, -1):
            if i == la and j == lb:
                continue
            best: tuple[int, str] = (1 << 30, "")
            if i < la and j < lb and same(a[i], b[j]):
                best = (cost[i + 1][j + 1], "m")
            if i < la and a[i][0] == "+" and j < lb and once(a[i][1], b, j):
                best = min(best, (cost[i + 1][j + len(a[i][1])], "a"))
            if j < lb and b[j][0] == "+" and i < la and once(b[j][1], a, i):
                best = min(best, (cost[i + len(b[j][1])][j + 1], "b"))
            if i < la:
                best = min(best, (cost[i + 1][j] + (a[i][0] != "?"), "x"))
            if j < lb:
                best = min(best, (cost[i][j + 1] + (b[j][0] != "?"), "y"))
            cost[i][j], move[i][j] = best
    out: list[tuple] = []
    left: list[tuple] = []
    kind, i, j = "", 0, 0
    while i < la or j < lb:
        m = move[i][j]
        if m in "xy":
            node = a[i] if m == "x" else b[j]
            if left and (m != kind or node[0] == "?" or left[-1][0] == "?"):
                out += optional(left)
                left = []
            left.append(node)
            kind = m
            i, j = i + (m == "x"), j + (m == "y")
            continue
        out += optional(left)
        left = []
        if m == "m":
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif m == "a":
            out.append(("+", [merge(x, y) for x, y in zip(a[i][1], b[j : j + len(a[i][1])], strict=True)]))
            i, j = i + 1, j + len(a[i][1])
        else:
            out.append(("+", [merge(x, y) for x, y in zip(b[j][1], a[i : i + len(b[j][1])], strict=True)]))
            i, j = i + len(b[j][1]), j + 1
    return out + optional(left)


def infer(pages: list[str], s: Settings = Settings()) -> list[tuple] | None:
    """The wrapper of the pages; None for fewer than two. Pages of the same texts count once.

    Its slots come out as ("#", main votes, all votes, hashes of template texts)."""
    wrapper, used, seen, main_chars = None, 0, set(), Counter()
    for page in pages:
        stream = tokens(page)
        same_texts = hash64("\0".join(t[1] for t in stream))
        if same_texts in seen:
            continue
        seen.add(same_texts)
        nodes, last = [], ""
        for sym, text, ok, _, boxed in stream:
            if sym == "#":
                mark = hash64(text)
                nodes.append(("#", int(ok), 1, {mark: 1 << used}, bool(HEADING.match(last)) or not boxed))
                if ok:
                    main_chars[mark] += len(text)
            else:
                nodes.append(("t", sym))
                last = sym
        nodes = fold(nodes)
        wrapper = nodes if wrapper is None else align(wrapper, nodes, s.cells)
        used += 1
    if used < 2:
        return None
    least = max(s.constant, (used + 1) // 2)
    template = lambda x: () if x[4] else tuple(sorted(m for m, where in x[3].items() if where.bit_count() >= least))
    lost = sum(main_chars[m] for m in {m for x in slots(wrapper) for m in template(x)})
    some = 2 * lost <= sum(main_chars.values())

    def plain(nodes: list[tuple]) -> list[tuple]:
        return [("#", x[1], x[2], template(x) if some else ()) if x[0] == "#" else x if x[0] == "t" else (x[0], plain(x[1])) for x in nodes]

    return plain(wrapper)


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def slots(nodes: list[tuple]) -> Iterator[tuple]:
    for x in nodes:
        if x[0] == "#":
            yield x
        elif x[0] != "t":
            yield from slots(x[1])


class Wrapper:
    """A wrapper as a regular expression over one character a token; its capturing groups are stretches that are all
    main, all boilerplate, or mixed (where each token's own enclosing elements decide)."""

    def __init__(self, nodes: list[tuple]):
        self.letters: dict[str, str] = {"#": "#"}
        parts: list[tuple[bool | None | str, str, set[int]]] = []
        for node in nodes:
            votes = [2 * yes > total for _, yes, total, _ in slots([node])]
            mixed = any(0 < yes < total for _, yes, total, _ in slots([node]))
            template = {m for x in slots([node]) for m in x[3]}
            flag = None if mixed or len(set(votes)) > 1 else votes[0] if votes else "any"
            if parts and (flag == "any" or parts[-1][0] in (flag, "any")):
                last, regex, known = parts[-1]
                parts[-1] = (last if flag == "any" else flag, regex + self._regex(node), known | template)
            else:
                parts.append((flag, self._regex(node), template))
        self.flags = [None if f == "any" else f for f, _, _ in parts]
        self.template = [t for _, _, t in parts]
        self.pattern = re.compile("".join(f"({p})" for _, p, _ in parts))

    def _regex(self, node: tuple) -> str:
        if node[0] == "#":
            return "#?"
        if node[0] == "t":
            return re.escape(self.letters.setdefault(node[1], chr(0x4E00 + len(self.letters))))
        return f"(?:{''.join(map(self._regex, node[1]))}){node[0]}+"

    def main(self, stream: list[tuple[str, str, bool, str, bool]]) -> list[bool] | None:
        """Which tokens are main text; None where the wrapper does not match."""
        m = self.pattern.fullmatch("".join(self.letters.get(t[0], "?") for t in stream))
        if not m:
            return None
        out = [t[2] for t in stream]
        for k, (flag, template) in enumerate(zip(self.flags, self.template, strict=True), 1):
            lo, hi = m.span(k)
            for i in range(lo, hi):
                if flag is not None:
                    out[i] = flag
                if template and out[i] and stream[i][4] and not (i and HEADING.match(stream[i - 1][0])) and hash64(stream[i][1]) in template:
                    out[i] = False
        return out


def text_of(page: str | None, wrapper: Wrapper | None) -> str:
    if not page:
        return ""
    stream = tokens(page)
    main = (wrapper.main(stream) if wrapper else None) or [t[2] for t in stream]
    return "\n\n".join(t[1] for t, ok in zip(stream, main, strict=True) if ok and t[0] == "#")


def infer_wrappers(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, wrapper) from at most ``pages`` pages of each host, by hash of the id; wrapper is a literal of nodes."""
    ids = pages.filter(F.col("html").isNotNull() & F.col("page_id").isNotNull()).select("page_id", "host")
    chosen = stored(hash_sample(ids, "page_id", s.pages, by="host").select(F.col("page_id").alias("_id")).distinct(), "html-sample")
    # Eight bytes a chosen page, their number checked: then no html is shuffled to find the sample's pages.
    if chosen.count() <= s.broadcast_bytes // 8:
        chosen = F.broadcast(chosen)
    sample = pages.join(chosen, F.col("page_id") == F.col("_id"), "left_semi").select("host", "page_id", "html")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("page_id").drop_duplicates("page_id")
        wrapper = infer(list(rows["html"])[: s.pages], s)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [repr(wrapper)]} if wrapper else {"host": [], "wrapper": []}, dtype=object)

    return sample.groupBy("host").applyInPandas(one, "host string, wrapper string")


def extract(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(page_id, url, host, text) for every row of pages."""
    from ast import literal_eval

    rows = only(pages, "page_id", "url", "html").withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    wrappers = stored(infer_wrappers(rows, s), "html-wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    small = size <= s.broadcast_bytes
    held = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()} if small else {})
    source = rows if small else rows.join(wrappers.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left").drop("_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Wrapper | None] = {}
        for batch in slices(batches):
            hosts = batch.column("host").to_pylist()
            written = [held.value.get(h) for h in hosts] if small else batch.column("wrapper").to_pylist()
            out = []
            for host, text, page in zip(hosts, written, batch.column("html").to_pylist(), strict=True):
                if host not in ready:
                    if len(ready) > 5000:
                        ready.clear()
                    ready[host] = Wrapper(literal_eval(text)) if text else None
                out.append(text_of(page, ready[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(out, pa.string())], names=["page_id", "url", "host", "text"])

    return source.mapInArrow(run, "page_id long, url string, host string, text string")
