"""Main text of web pages: structure as a prior, host suffix arrays for what it leaves open.

A page is parsed once, into blocks. Blocks inside an article (or main) element belong to the text, except for menus, forms,
asides, adverts and comments within it; blocks in navigation, header, footer, sidebar and form elements never do, nor does
text beside an article. Two kinds of blocks are open: those of pages without an article, and those that only a doubtful class
word marks (share, related, promo, notice ...). The token streams of a host's pages are concatenated, all blocks of every page of
every host, the article's too; runs of WINDOW or more tokens on distinct pages are boilerplate. An open block stays if less than
half of its tokens are covered, and each page has its number of covered tokens outside the article beside its text (the article
stays, covered or not). A token lies in a repeated run of at least WINDOW tokens exactly if it lies in a repeated one of WINDOW, so
windows of that length decide: a suffix order to that depth puts equal windows of a slice of pages side by side, and a 64-bit hash
of host and window brings the slices together. Hosts of any size lie in any slices and meet as classes of windows, so that no task
needs a whole host. A window inside an article matters only if it equals one that touches a word outside some article: one bit
for each hash of those (a bounded array that all tasks share) says which of all windows are exchanged. Pages are parsed once, and
their blocks stored. Inline elements belong to their block, whatever their class.

Defined results: null and empty html give the empty text; null page_id and url are carried along (pages without url are one
host); pages with the same stream are one page when repeats are sought, so mirrored pages keep their text; very long pages are
read whole in linear time; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import map_rows, materialise, table

#: Tokens from which a run that other pages of the host share is boilerplate.
WINDOW = 8
#: Pages, at most, whose streams are put into one suffix order, and characters of their texts; hashes of windows bring these slices together.
PART_PAGES, GROUP = 200, 1 << 22
#: Characters of texts whose words are numbered at once.
PIECE = 1 << 20
#: Bits for each window that touches a word outside the article, places of bits that one task joins and that there are at most (as powers of 2).
BITS, STRETCH, MOST_BITS = 16, 20, 30
#: Repeated windows up to which they are shared with all tasks (8 bytes each); beyond it their places are joined with the pages by shuffle.
SHARED_WINDOWS = 4_000_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|/)?)>"
    r"|</?[a-zA-Z][^<>]*>",
    re.S | re.I,
)
BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tfoot tr td th caption blockquote pre hr br dl dt dd figure figcaption header footer nav aside form fieldset address details summary body html head center menu dialog button label option".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
DROPPED = frozenset("nav footer aside form head menu dialog button label option fieldset".split())
CONTAINERS = frozenset("div section ul ol dl table details figure".split())
# Words of class, id and role. Containers named by the first list alone are dropped; what the second names is open.
SURE = frozenset("ad ads advert adverts advertisement advertisements comment comments disqus cookie cookies consent sidebar menu nav navbar navigation breadcrumb breadcrumbs footer popup modal login".split())
DOUBTFUL = frozenset("banner newsletter subscribe subscription share sharing social related promo promotion promoted sponsor sponsored notice widget reply replies skip".split())
PLAIN = frozenset("list box block wrap wrapper container item items area section site page top bottom left right inner content signup links".split())
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
ROOT = re.compile(r"""\b(?:role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b)""", re.I)


def marked(attributes: str) -> str:
    """What a tag's class, id and role say: sure, doubtful or nothing. A word counts if all its hyphenated parts are known."""
    found = ""
    for value in MARK.findall(attributes):
        for word in value.strip("\"'").lower().split():
            parts = [p for p in re.split(r"[-_]+", word) if p]
            if parts and all(p in SURE or p in DOUBTFUL or p in PLAIN for p in parts):
                if any(p in SURE for p in parts):
                    return "sure"
                if any(p in DOUBTFUL for p in parts):
                    found = "doubtful"
    return found


def blocks(page: str) -> list[tuple[str, str]]:
    """(state, text) of each non-empty block: main, doubtful (of an article), dropped or open."""
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # name, mark, main
    parts: list[str] = []
    at = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, mark, main = stack[-1] if stack else ("", "", False)
            found.append(("dropped" if mark == "sure" else "open" if not main else mark or "main", text))

    for m in MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name, attributes = (m["name"] or "").lower(), m["attributes"] or ""
        mark = marked(attributes) if attributes and not m["end"] else ""
        if m["end"]:
            if name not in BLOCKS:
                continue
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in BLOCKS:
            close()
            if stack and stack[-1][0] == "p":
                stack.pop()
        else:
            continue  # inline elements, whatever their class says, are part of their block
        if name in VOID:
            continue
        _, held, main = stack[-1] if stack else ("", "", False)
        root = name in ("article", "main") or bool(attributes and ROOT.search(attributes))
        if name in DROPPED or (name == "header" and not main) or (mark == "sure" and name in CONTAINERS and not root):
            mark = "sure"
        elif mark:
            mark = "" if root else "doubtful"
        stack.append((name, "sure" if "sure" in (held, mark) else held or mark, main or root))
    parts.append(page[at:])
    close()
    return found


def _host(url: str | None) -> str:
    return re.sub(r"^[a-z]+://|[/?#].*$|:\d+", "", (url or "").strip().lower(), flags=re.S)


HELD = "page_id long, url string, host long, page long, mirror long, kinds string, blocks array<string>, asked long"
#: One letter of `kinds` for the state of each block.
KINDS = {"main": "m", "doubtful": "q", "dropped": "d", "open": "o"}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def streams(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> a row for each page: hashes of its host, of its url and html and of its whole stream; all of its blocks, the article's too, in page order, with their states; asked: how many windows touch a word outside the article."""

    def work():
        def step(batch):
            rows = [[] for _ in range(6)]
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                own = blocks(page or "")
                kinds, texts = "".join(KINDS[s] for s, _ in own), [t for _, t in own]
                host = _host(url)
                for values, x in zip(rows, (_hash(host), _hash(f"{host}\n{page or ''}"), _hash("\n".join(texts)), kinds, texts, _asked(kinds, texts))):
                    values.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array(r, t) for r, t in zip(rows, types))], [c.split()[0] for c in HELD.split(", ")])

        return step

    return map_rows(pages.select("page_id", "url", "html"), work, HELD)


def _asked(kinds: str, texts: list[str]) -> int:
    """Windows of a page that touch a word outside the article: all but those inside runs of the article's blocks."""
    words = inside = run = 0
    for kind, text in zip(kinds, texts):
        n = text.count(" ") + 1
        words += n
        if kind == KINDS["main"]:
            run += n
        else:
            inside += max(0, run - WINDOW + 1)
            run = 0
    return max(0, words - WINDOW + 1) - inside - max(0, run - WINDOW + 1)


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` tokens by prefix doubling, and each one's common prefix (up to `depth`) with the one before it."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < depth:
        step = min(done, depth - done)
        later = np.full(len(rank), -1, np.int64)
        later[: len(rank) - step] = rank[step:] if step < len(rank) else []
        rank = np.unique(rank * (len(rank) + 2) + later + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    order = np.argsort(rank, kind="stable")
    common = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for j in range(depth):
        one, two = order[live] + j, order[live - 1] + j
        fits = np.maximum(one, two) < len(tokens)
        live, one, two = live[fits], one[fits], two[fits]
        live = live[tokens[one] == tokens[two]]
        common[live] = j + 1
    return order, common


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every number of 64 bits put to another one, all bits on all bits (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _tokens(texts: list[str]) -> np.ndarray:
    """Numbers of 63 bits for the words of single-spaced texts, in order: sums of a random number for each byte times one for its place."""
    letters = _mixed(np.arange(256, dtype=np.uint64)) | np.uint64(1)
    letters[32] = 0
    found, at = [np.empty(0, np.int64)], 0
    while at < len(texts):
        piece, size = at, 0
        while at < len(texts) and size < PIECE:
            size += len(texts[at])
            at += 1
        raw = np.frombuffer(" ".join(texts[piece:at]).encode("utf-8", "surrogatepass"), np.uint8)
        starts = np.r_[0, np.flatnonzero(raw == 32) + 1]
        sizes = np.diff(np.r_[starts, len(raw) + 1])
        place = np.arange(len(raw)) - np.repeat(starts, sizes)[: len(raw)]
        with np.errstate(over="ignore"):
            places = _mixed(np.arange(1 << 16, (1 << 16) + int(sizes.max()), dtype=np.uint64)) | np.uint64(1)
            sums = np.add.reduceat(letters[raw] * places[place], starts)
        found.append((_mixed(sums) >> np.uint64(1)).view(np.int64))
    return np.concatenate(found)


class Streams:
    """The streams of some pages, one after the other, each with a separator of its own at its end (-1, -2, ...).

    owner: the page of each place; outside: the word is not the article's; at: the places where whole windows start; asked: of these, those that touch a word outside.
    texts, kinds, sizes (in words), pages: of the blocks.
    """

    def __init__(self, kinds: list[str], texts: list[list[str]]):
        self.texts = [t for own in texts for t in own]
        self.sizes = np.array([t.count(" ") + 1 for t in self.texts], np.int64)
        self.kinds = np.array(list("".join(kinds)), "U1")
        self.pages = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
        words = np.bincount(self.pages, self.sizes, len(texts)).astype(np.int64)
        self.ends = np.cumsum(words + 1) - 1
        self.owner = np.repeat(np.arange(len(texts)), words + 1)
        said = np.ones(len(self.owner), bool)
        said[self.ends] = False
        self.tokens, self.outside = np.empty(len(said), np.int64), np.zeros(len(said), bool)
        self.tokens[self.ends] = -1 - np.arange(len(texts))
        self.tokens[said] = _tokens(self.texts)
        self.outside[said] = np.repeat(self.kinds != KINDS["main"], self.sizes)
        self.at = np.flatnonzero(self.ends[self.owner] - np.arange(len(said)) >= WINDOW)
        before = np.r_[0, np.cumsum(self.outside)]
        self.asked = self.at[before[self.at + WINDOW] > before[self.at]]

    def windows(self, at: np.ndarray, hosts: np.ndarray) -> np.ndarray:
        """A hash of 64 bits of the host and of the window at each start."""
        return _mixed((_digest(self.tokens, at) ^ hosts[self.owner[at]]).view(np.uint64)).view(np.int64)


def _groups(batch: pa.RecordBatch, most: int = 1 << 31):
    """Pages of a batch with their streams, at most so many and GROUP characters at a time (a longer page stands alone), so that what is sorted at once stays small."""
    kinds, texts = batch.column("kinds").to_pylist(), batch.column("blocks").to_pylist()
    first = size = 0
    for k, own in enumerate(texts):
        n = sum(map(len, own))
        if k > first and (size + n > GROUP or k - first >= most):
            yield batch.slice(first, k - first), Streams(kinds[first:k], texts[first:k])
            first, size = k, 0
        size += n
    if first < len(texts):
        yield batch.slice(first), Streams(kinds[first:], texts[first:])


def _digest(tokens: np.ndarray, at: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Order-dependent 64-bit hash of the window at each start."""
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(depth):
            h = (h ^ tokens[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _asked_bits(held: DataFrame) -> Broadcast:
    """One bit for each hash of a window that touches a word outside the article of its page: only windows that meet one can cover such a word."""
    n = held.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    width = min(MOST_BITS, max(STRETCH, (BITS * n).bit_length()))

    def marks():
        def step(batch):
            found = [np.unique(s.windows(s.asked, g.column("host").to_numpy()).view(np.uint64) >> np.uint64(64 - width)) for g, s in _groups(batch)]
            places = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
            parts, first = np.unique(places >> np.uint64(STRETCH), return_index=True)
            lists = np.split((places & np.uint64((1 << STRETCH) - 1)).astype(np.uint32), first[1:]) if len(first) else []
            return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array([x.tobytes() for x in lists], pa.binary())], ["part", "places"])

        return step

    def join():
        def step(batch):
            rows = []
            for lists in batch.column("lists").to_pylist():
                bits = np.zeros(1 << STRETCH, np.uint8)
                for x in lists:
                    bits[np.frombuffer(x, np.uint32)] = 1
                rows.append(np.packbits(bits, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([batch.column("part"), pa.array(rows, pa.binary())], ["part", "bits"])

        return step

    lists = map_rows(held.select("host", "kinds", "blocks"), marks, "part long, places binary").groupBy("part").agg(F.collect_list("places").alias("lists"))
    out = np.zeros(1 << width - 3, np.uint8)
    for row in map_rows(lists, join, "part long, bits binary").collect():  # 2**MOST_BITS bits at most
        out[row.part << STRETCH - 3 : row.part + 1 << STRETCH - 3] = np.frombuffer(row.bits, np.uint8)
    return held.sparkSession.sparkContext.broadcast((width, out))


def repeated_windows(held: DataFrame, asked: Broadcast, part: int) -> DataFrame:
    """window: hashes of host and window of all runs of WINDOW tokens that occur on at least two distinct pages of a host, if one of these runs touches a word outside an article (and of some others)."""

    def work():
        width, bits = asked.value

        def step(batch):
            out = [[], [], []]
            for g, s in _groups(batch, part):
                hosts, pages = g.column("host").to_numpy(), g.column("mirror").to_numpy()
                window = s.windows(s.at, hosts)
                place = window.view(np.uint64) >> np.uint64(64 - width)
                met = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                if not len(met):
                    continue
                at, window = s.at[met], window[met]
                order, common = suffix_array(s.tokens, WINDOW)
                cls = np.empty(len(order), np.int64)
                cls[order] = np.cumsum(common < WINDOW)  # suffixes with a common prefix of WINDOW tokens follow each other
                cls, host, page = cls[at], hosts[s.owner[at]], pages[s.owner[at]]
                by = np.lexsort((page, host, cls))  # the classes of one host side by side, pages ascending
                cls, host, page, window = cls[by], host[by], page[by], window[by]
                first = np.flatnonzero(np.r_[True, (cls[1:] != cls[:-1]) | (host[1:] != host[:-1])])
                last = np.r_[first[1:] - 1, len(by) - 1]
                for values, x in zip(out, (window[first], page[first], page[last])):
                    values.append(x)
            low, high = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out[1:])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]) if out[0] else low), pa.array(low), pa.array(high, mask=low == high)], ["window", "low", "high"])

        return step

    local = map_rows(held.select("host", "mirror", "kinds", "blocks"), work, "window long, low long, high long")
    return local.groupBy("window").agg(F.min("low").alias("low"), F.max(F.coalesce("high", "low")).alias("high")).where("low < high").select("window")


def _covers(held: DataFrame, repeats: DataFrame) -> DataFrame:
    """page, hits: places of the page's stream at which repeated windows start that touch a word outside the article."""

    def work():
        def step(batch):
            out = [[np.empty(0, np.int64)] for _ in range(3)]
            for g, s in _groups(batch):
                of = s.owner[s.asked]
                for values, x in zip(out, (g.column("page").to_numpy()[of], s.windows(s.asked, g.column("host").to_numpy()), s.asked - np.r_[0, s.ends + 1][of])):
                    values.append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["page", "window", "at"])

        return step

    spots = map_rows(held.select("host", "page", "kinds", "blocks"), work, "page long, window long, at long")
    return spots.join(repeats, "window", "left_semi").groupBy("page").agg(F.collect_set(F.col("at").cast("int")).alias("hits"))


def _settle(held: DataFrame, shared: Broadcast | None) -> DataFrame:
    """page_id, url, text: the sure blocks, and open ones of which repeats cover less than half; n_repeated: words outside the article that repeats cover. Repeated windows are shared as an ascending array, or else their places come with the pages (hits)."""

    def work():
        windows = shared.value if shared else None

        def step(batch):
            texts, repeated = [], []
            for g, s in _groups(batch):
                if windows is None:
                    at = np.concatenate([s.at[:0], *(first + np.array(x, np.int64) for first, x in zip(np.r_[0, s.ends + 1], g.column("hits").to_pylist()) if x)])
                else:
                    at = s.asked[_among(s.windows(s.asked, g.column("host").to_numpy()), windows)]
                covered = np.zeros(len(s.tokens), bool)
                for k in range(WINDOW):
                    covered[at + k] = True
                repeated += np.bincount(s.owner[covered & s.outside], minlength=g.num_rows).tolist()
                before = np.r_[0, np.cumsum(covered[s.tokens >= 0])]
                edges = np.r_[0, np.cumsum(s.sizes)]
                open_to = (s.kinds == KINDS["doubtful"]) | (s.kinds == KINDS["open"]) & (np.bincount(s.pages, s.kinds == KINDS["main"], g.num_rows) == 0)[s.pages]
                kept = (s.kinds == KINDS["main"]) | open_to & (2 * np.diff(before[edges]) < s.sizes)
                ends = np.cumsum(np.bincount(s.pages, minlength=g.num_rows))
                for first, last in zip(np.r_[0, ends], ends):
                    texts.append("\n".join(t for t, k in zip(s.texts[first:last], kept[first:last]) if k))
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(repeated, pa.int64())], ["page_id", "url", "text", "n_repeated"])

        return step

    return map_rows(held, work, "page_id long, url string, text string, n_repeated long")


def _among(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of the numbers stand in the ascending array."""
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x if len(ascending) else np.zeros(len(x), bool)


def extract_counted(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, n_repeated (words outside the article that runs repeated on the host cover)."""
    held = materialise(streams(pages), "streams", "zstd")
    asked = _asked_bits(held)
    repeats = materialise(repeated_windows(held, asked, PART_PAGES), "repeats")
    asked.unpersist()
    if repeats.count() <= SHARED_WINDOWS:
        settled = _settle(held, held.sparkSession.sparkContext.broadcast(np.sort(repeats.toArrow().column("window").to_numpy())))
    else:
        settled = _settle(held.join(_covers(held, repeats), "page", "left"), None)
    return settled.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    return extract_counted(pages).drop("n_repeated")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_counted(table(spark, sf_dir, "pages"))
