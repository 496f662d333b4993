"""Main text of web pages: what repeats within a host is boilerplate, but for what the structure protects.

A page is cut into blocks, streams of tokens; scripts, styles and other markup have
none.  Suffix arrays of the streams of all pages of a host, menus and articles
included, find the substrings of `MIN_TOKENS` or more tokens that occur on `MIN_PAGES`
or more distinct pages: those are boilerplate, and the unique runs are kept.

Repetition alone does not give right results here: articles quote passages that
other pages hold too, and menus differ from page to page; the README says so.  So a
check by structure follows.  Blocks inside menus, headers, footers, sidebars,
notices, adverts, forms and comments are boilerplate by their element, role, class
or id and go, unique or not.  Blocks inside the page's article (or main) element are
its text and stay, repeated or not; on such pages nothing else does.  On pages
without such an element the unique runs of the blocks that are left are the text.

A host's suffix array is dealt over the tasks, however many pages the host has.  A
task sorts the suffixes of some pages at a time by their first MIN_TOKENS tokens, as a
longer repeat is a chain of such windows; suffixes that share them are neighbours and
make one entry with its number of pages.  Entries are named by the hash of host and
window, and those of all tasks meet by it, sorted, and are added up.  A block of
fewer tokens is an entry as a whole.  Rows of an id that occurs more than once are
brought together before, so that each page is counted in one place.  `repeated` finds
the same in the memory of one task.

Entries are identified by 56-bit hashes, rows (id, url and html) by 64-bit ones.

Edge cases: null html is an empty page with empty text; repeated rows are pages
of their own (equal pages of one id count as one page for repetition); a null
url is a host of its own name ''; a page of any length is taken whole; columns other
than the three named are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import _words as W

# Names of elements.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param", "frame", "basefont", "bgsound", "keygen"}
DROPPED = {
    "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "template", "noscript", "svg", "canvas", "object", "audio", "video",
    "button", "select", "option", "optgroup", "datalist", "label", "fieldset", "legend", "applet", "frameset", "script", "style", "textarea", "title", "iframe",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
# Words in class or id that name boilerplate.
NAMED = re.compile(
    r"(?:^|(?<!has)(?<!no)(?<!with)(?<!without)[\s_-])(?:ads?|advert|adverts|advertisement|advertising|banner|breadcrumbs?|comments?|commentlist|respond|cookies?|consent|gdpr|disclaimer|disqus|footer|header|masthead|"
    r"menu|nav|navbar|navigation|newsletter|notice|notices|notification|pager|pagination|popup|modal|promo|promoted|related|recommended|share|sharing|sidebar|side-bar|signup|"
    r"social|sponsor|sponsored|subscribe|subscription|toolbar|topbar|widget|widgets|skip-link)(?:$|[\s_-]|\d)",
    re.I,
)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|respond|reply|replies)(?:$|[\s_-]|\d)", re.I)  # and those that an article may be a reader's by
# Elements that an opening tag closes if they are open: it, and up to which it looks.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

MIN_TOKENS = 8  # length of a substring that counts as repeated
MIN_PAGES = 3  # distinct pages it must be on
TOKEN = W.byte_set(" ", invert=True)
ARTICLE, OPEN, MARKED = 2, 1, 0  # what the structure says of a block: inside the article, nothing, boilerplate
HASH_BITS, BUCKET_BITS = 56, 10  # width of an entry's hash; how many of its bits say where it is counted
ENTRIES = 1 << 21  # that are held before they are sent

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


def _boilerplate(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and NAMED.search(value) or key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return name not in ("html", "body", "main") and (name != "article" or bool(COMMENT.search(value)))
    return False


def streams(html: str) -> list[tuple[str, int]]:
    """All blocks of the page in order, and what its structure says of each."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    marked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, inside an article
    at, end = 0, len(html)

    def put(parts: list[str], kind: int) -> None:
        s = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if s:
            out.append((s, kind))
        parts.clear()

    def flush() -> None:
        if marked:
            put(marked, MARKED)
        if text:
            put(text, ARTICLE if stack and stack[-1][2] else OPEN)

    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            if stack and stack[-1][1]:
                marked.append(html[at:stop])
            else:
                if marked:
                    put(marked, MARKED)
                text.append(html[at:stop])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCKS:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                # An inline element's end tag does not close blocks around it, and nothing closes an article from inside but its own kind of tag.
                if name not in BLOCKS and stack[k][0] in BLOCKS:
                    break
            continue
        dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in CLOSES:
            same, until = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in until:
                    break
                if stack[k][0] in same:
                    del stack[k:]
                    dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
        bad = _boilerplate(name, m[3])
        if bad and not dropped:
            flush()
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in VOID or m[0].endswith("/>") and name not in BLOCKS:
            continue
        if name == "p":  # an open paragraph ends where the next begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
            dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        stack.append((name, dropped or bad, inside or name in ("article", "main")))
    flush()
    return out


def blocks(html: str) -> list[tuple[str, bool]]:
    """The page's blocks in order, without what its structure marks as boilerplate; True: inside the article.

    If the page has an article (or main) element with text, only what is inside it.
    """
    out = [(s, kind == ARTICLE) for s, kind in streams(html) if kind != MARKED]
    return [x for x in out if x[1]] or out


def settled(found: list[tuple[str, bool]]) -> bool:
    """Whether the structure decides every block."""
    return all(inside for _, inside in found)


def _ranks(first: np.ndarray, least: int) -> np.ndarray:
    """Ranks of all suffixes by their first `least` tokens, from the ranks (1 and up) of single tokens, by prefix doubling."""
    rank, span = first.astype(np.int64), 1
    while span < least:  # rank of the first `span` tokens; the last step overlaps so that it ends at `least`
        step = min(span, least - span)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - step] = rank[step:]
        _, rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        span += step
    return rank


def repeated(streams: list[list[str]], pages: list, least: int = MIN_TOKENS, on: int = MIN_PAGES) -> list[np.ndarray]:
    """For each stream of tokens, which tokens a substring of `least` or more tokens covers that is on `on` or more distinct pages.

    A suffix array by prefix doubling over all streams put together; suffixes that share their
    first `least` tokens are neighbours in it, and a longer repeat is a chain of such windows.
    """
    flat = [w for s in streams for w in s]
    size = np.array([len(s) for s in streams])
    if not len(flat):
        return [np.zeros(0, bool) for _ in streams]
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(streams)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # tokens to the end of the stream
    _, page = np.unique(np.array([str(p) for p in pages]), return_inverse=True)
    page = page[owner]
    rank = _ranks(ids + 1, least)
    whole = np.flatnonzero(left >= least)
    suffixes = whole[np.argsort(rank[whole], kind="stable")]
    pairs = np.unique(np.stack([rank[suffixes], page[suffixes]]), axis=1)
    seen, count = np.unique(pairs[0], return_counts=True)
    common = seen[count >= on]
    edge = np.zeros(len(flat) + least + 1, np.int64)
    hit = suffixes[np.isin(rank[suffixes], common)]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + least, -1)
    return np.split(np.cumsum(edge)[: len(flat)] > 0, np.cumsum(size)[:-1])


def _text(found: list[tuple[str, bool]]) -> str:
    return " ".join(s for s, _ in found)


def _windows(texts: list[str], host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block, place of the first token, number of tokens and hash of each window of MIN_TOKENS tokens, and of each whole block that is shorter; host: a hash for each block."""
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for lo, t in W.parts(pa.array(texts, pa.string())):
        row, start, stop = t.words(TOKEN)
        h = t.hashes(start, stop)
        size = np.bincount(row, minlength=t.n)
        place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        at, window = W.grams(h, row, MIN_TOKENS)
        out.append((lo + row[at], place[at], np.full(len(at), MIN_TOKENS), W.mix(window + host[lo + row[at]])))
        short = np.flatnonzero(size[row] < MIN_TOKENS)
        total = size.astype(np.uint64)
        np.add.at(total, row[short], h[short] * W.GRAM[place[short]])
        whole = np.flatnonzero((size > 0) & (size < MIN_TOKENS))
        out.append((lo + whole, np.zeros(len(whole), np.int64), size[whole], W.mix(W.mix(total[whole]) + host[lo + whole])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _entries(texts: list[str], host: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the entries of the suffix array of these blocks, in order, and the number of pages (at most MIN_PAGES) of each.

    host, page: a hash and a number for each block.
    """
    _, t = next(W.parts(pa.array(texts, pa.large_string()), 1 << 62))
    row, start, stop = t.words(TOKEN)
    h = t.hashes(start, stop)
    size = np.bincount(row, minlength=t.n)
    left = np.cumsum(size)[row] - np.arange(len(row))  # tokens to the end of the block
    _, first = np.unique(W.mix(h + host[row]), return_inverse=True)
    rank = _ranks(first + 1, MIN_TOKENS)
    whole = np.flatnonzero(left >= MIN_TOKENS)
    array = whole[np.argsort(rank[whole], kind="stable")]
    new = np.diff(rank[array], prepend=0) > 0  # a suffix that differs from its neighbour before in the first MIN_TOKENS tokens
    entry, head = np.cumsum(new) - 1, array[new]
    name = np.zeros(len(head), np.uint64)
    for k in range(MIN_TOKENS):
        name += h[head + k] * W.GRAM[k]
    name = W.mix(W.mix(name) + host[row[head]])
    short = np.flatnonzero(size[row] < MIN_TOKENS)
    total = size.astype(np.uint64)
    np.add.at(total, row[short], h[short] * W.GRAM[(size[row] - left)[short]])
    alone = np.flatnonzero((size > 0) & (size < MIN_TOKENS))
    name = np.concatenate([name, W.mix(W.mix(total[alone]) + host[alone])]) >> np.uint64(64 - HASH_BITS)
    name, same = np.unique(name, return_inverse=True)
    entry = same[np.concatenate([entry, len(head) + np.arange(len(alone))])]
    _, number = np.unique(page, return_inverse=True)
    pairs = np.unique(entry * (number.max() + 1) + number[np.concatenate([row[array], alone])])
    return name, np.minimum(np.bincount(pairs // (number.max() + 1), minlength=len(name)), MIN_PAGES)


def _summed(names: list[np.ndarray], pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of several arrays merged, with sums of their pages (up to MIN_PAGES)."""
    name, n = np.concatenate(names), np.concatenate(pages)
    order = np.argsort(name, kind="stable")
    name = name[order]
    at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])[: len(name)])
    return name[at], np.minimum(np.add.reduceat(n[order].astype(np.int64), at) if len(at) else n, MIN_PAGES)


def _sent(name: np.ndarray, n: np.ndarray):
    """Entries in order, cut into buckets; each as planes of bytes of the differences of the names, and the pages."""
    bits = np.uint64(HASH_BITS - BUCKET_BITS)
    edge = np.searchsorted(name, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << bits)
    out = []
    for b in np.flatnonzero(np.diff(edge)).tolist():
        x = name[edge[b] : edge[b + 1]] & ((np.uint64(1) << bits) - np.uint64(1))
        planes = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-int(bits) // 8)].T
        out.append((b, len(x), pa.compress(planes.tobytes() + n[edge[b] : edge[b + 1]].astype(np.uint8).tobytes(), "zstd", asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["_bucket", "_n", "_coded"])


def _received(n: int, coded: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = -(-(HASH_BITS - BUCKET_BITS) // 8)
    planes = np.frombuffer(pa.decompress(coded, n * (wide + 1), "zstd", asbytes=True), np.uint8).reshape(wide + 1, n)
    x = np.zeros((n, 8), np.uint8)
    x[:, :wide] = planes[:wide].T
    return np.cumsum(x.view("<u8")[:, 0], dtype=np.uint64), planes[wide]


def _unique(texts: list[str], host: np.ndarray, page: np.ndarray, common: list) -> list[str]:
    """Blocks without the tokens of windows in their page's list of common ones."""
    block, place, size, h = _windows(texts, host)
    h = h >> np.uint64(64 - HASH_BITS)
    gone = [set() for _ in texts]
    sets = [set(c or ()) for c in common]
    for b, p, n, k in zip(block.tolist(), place.tolist(), size.tolist(), h.view(np.int64).tolist(), strict=True):
        if k in sets[page[b]]:
            gone[b].update(range(p, p + n))
    return [" ".join(w for i, w in enumerate(s.split(" ")) if i not in g) for s, g in zip(texts, gone, strict=True)]


def _rows(b: pa.RecordBatch, keep: list[int], texts: list[str], names: list[str]) -> pa.RecordBatch:
    at = pa.array(keep, pa.int64())
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, main text and its length in code points."""
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    names = [id_col, url_col, "text", "n_chars"]
    schema = f"`{id_col}` {kind}, `{url_col}` {url_kind}, text string, n_chars long"
    pages = pages.select(id_col, url_col, html_col)

    def plain(batches):
        for b in batches:
            found = [blocks(x) for x in W.text_of(b.column(2))]
            keep = [i for i, f in enumerate(found) if settled(f)]
            yield _rows(b, keep, [_text(found[i]) for i in keep], names)

    def open_blocks(batches):
        for b in batches:
            found = [blocks(x) for x in W.text_of(b.column(2))]
            keep = [i for i, f in enumerate(found) if not settled(f)]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), b.column(4).take(at), pa.array([[s for s, _ in found[i]] for i in keep], pa.list_(pa.string()))], [id_col, url_col, "_uid", "_host", "_blocks"])

    def flat(host, column):
        """All blocks of a batch, and for each its page and its host."""
        found = column.to_pylist()
        page = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return [s for f in found for s in f], page, host.to_numpy().view(np.uint64)[page]

    def windows(batches):
        for b in batches:
            texts, page, host = flat(b.column(1), b.column(2))
            block, _, _, h = _windows(texts, host)
            if len(h):
                pairs = np.unique(np.stack([page[block], (h >> np.uint64(64 - HASH_BITS)).view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[0])), pa.array(pairs[1])], ["_uid", "_h"])

    def unique(batches):
        for b in batches:
            texts, page, host = flat(b.column(3), b.column(2))
            out = [[] for _ in range(b.num_rows)]
            for p, x in zip(page.tolist(), _unique(texts, host, page, b.column(4).to_pylist()), strict=True):
                out[p].append(x)
            yield _rows(b, list(range(b.num_rows)), [" ".join(filter(None, x)) for x in out], names)

    def entries(batches):
        """Entries of the suffix arrays of pages (_page, _host, html), those of one page next to each other."""
        texts, host, page, size = [], [], [], 0
        names, pages_, held = [], [], 0
        for b in batches:
            for p, k, x in zip(b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64), W.text_of(b.column(2)), strict=True):
                if size >= W.CHUNK_BYTES and p != page[-1]:
                    name, n = _entries(texts, np.array(host, np.uint64), np.array(page))
                    names.append(name)
                    pages_.append(n.astype(np.uint8))
                    texts, host, page, size, held = [], [], [], 0, held + len(name)
                    if held >= ENTRIES:
                        yield _sent(*_summed(names, pages_))
                        names, pages_, held = [], [], 0
                for s, _ in streams(x):
                    texts.append(s)
                    host.append(k)
                    page.append(p)
                    size += len(s)
        if texts:
            name, n = _entries(texts, np.array(host, np.uint64), np.array(page))
            names.append(name)
            pages_.append(n.astype(np.uint8))
        if names:
            yield _sent(*_summed(names, pages_))

    def counted(key, t):
        """Entries of a bucket that are on enough pages."""
        found = [_received(n, x) for n, x in zip(t.column("_n").to_pylist(), t.column("_coded").to_pylist(), strict=True)]
        name, n = _summed(*map(list, zip(*found, strict=True)))
        name = name[n >= MIN_PAGES] | np.uint64(key[0].as_py() << HASH_BITS - BUCKET_BITS)
        return pa.table({"_h": pa.array(name.view(np.int64))})

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    # The suffix array over all pages.  Rows of one id are one page; those of ids with several are brought together.
    given = pages.select(F.xxhash64(F.col(id_col)).alias("_page"), F.xxhash64(host).alias("_host"), F.col(html_col).alias("_html"))
    several = _scratch.write(given.groupBy("_page").agg(F.count("*").alias("_n")).where("_n > 1").select("_page"), "several", small=True)
    once = _scratch.by_ids(given, "_page", several, "left_anti").select("_page", "_host", "_html")
    more = _scratch.by_ids(given, "_page", several, "left_semi").select("_page", "_host", "_html").repartition("_page").sortWithinPartitions("_page")
    coded = "_bucket int, _n long, _coded binary"
    sent = once.mapInArrow(W.lean(entries), coded).unionAll(more.mapInArrow(W.lean(entries), coded))
    common = _scratch.write(sent.groupBy("_bucket").applyInArrow(counted, "_h long"), "common", small=True)
    # The check by structure; what it leaves open on pages without an article is cut down to the unique runs.
    marked = pages.select(id_col, url_col, html_col, F.xxhash64(id_col, url_col, html_col).alias("_uid"), F.xxhash64(host).alias("_host"))
    left = _scratch.write(marked.mapInArrow(W.lean(open_blocks), f"`{id_col}` {kind}, `{url_col}` {url_kind}, _uid long, _host long, _blocks array<string>"), "open")
    found = left.select("_uid", "_host", "_blocks").mapInArrow(W.lean(windows), "_uid long, _h long").distinct()
    held = found.join(common, "_h").groupBy("_uid").agg(F.collect_set("_h").alias("_common"))
    decided = left.join(held, "_uid", "left").select(id_col, url_col, "_blocks", "_host", "_common")
    return pages.mapInArrow(W.lean(plain), schema).unionAll(decided.mapInArrow(W.lean(unique), schema))
