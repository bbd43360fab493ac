"""Main text of web pages: page structure, and a suffix array for each host.

A page becomes a stream of blocks of word tokens, each marked by where it
stands: in a part that markup names as menu, notice, advert, form, comment and
the like; in an ``article`` or ``main`` element; or in neither. The token streams
of a host's pages are concatenated and their suffixes sorted; runs of tokens
that many distinct pages share are boilerplate. Named parts are dropped. Where a
page has an article, that is its main text: copies and quotations on other pages
are text too, so only whole blocks go, and only those that most pages of the
host show. Otherwise the runs that a tenth of the pages share are cut out of the
blocks and the unique runs are kept.

Pages of equal html are parsed and sorted once; the texts are joined back to
their rows. Hosts of more than ``shard_bytes`` of different html are dealt over
several shards at random. There a run is known by a 64-bit hash, and its pages
are counted over the whole host, so the number of shards changes no result: what
a host's share asks for must reach that share in one of its shards, and only
such runs are counted everywhere (all runs, where they are more than
``MANY_RUNS``).

Defined results
    * null html: empty text; a null URL, or one without ``://``, belongs to the
      host '';
    * character references are decoded once, white space inside a block becomes
      one space, blocks are joined by two line feeds; a line break or table cell
      ends no block;
    * pages of equal html count as one page of a host, so repeated rows make
      nothing boilerplate; every row comes back;
    * only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.llm.common import written
from domsift.llm.url_filter import url_host

#: Shortest run of tokens that can be boilerplate; a power of two.
RUN_TOKENS = 8
#: Distinct pages a run must be on: at least so many, and at least this share.
RUN_PAGES, RUN_SHARE = 3, 0.1
#: The same for whole blocks inside an article.
ARTICLE_PAGES, ARTICLE_SHARE = 20, 0.6
SHARD_BYTES = 4 << 20
#: Runs of one host that are looked for in its shards as a list, at most.
MANY_RUNS = 1_000_000

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[a-zA-Z/!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^>]*>|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>])""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# element names fixed by HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea iframe object svg canvas video audio menu dialog datalist xmp".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
_CLOSES = {  # opening one of these ends an open element of the same family, up to its list or table
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Words in class, id or role names that name a part of a page that isn't main text.
NAMED = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promoted
    banner sidebar sidebars nav navbar navigation navigate menu menus menubar breadcrumb breadcrumbs header headers masthead topbar
    footer footers copyright notice notices cookie cookies consent gdpr disclaimer popup modal overlay newsletter subscribe
    subscription signup login comment comments reply replies respond disqus share sharing social related recommended
    recommendations pagination pager toolbar contentinfo complementary search alert skip""".split()
)
_SPACE = re.compile(r"\s+")
PLAIN, ARTICLE, NAMED_PART = 0, 1, 2


def _named(tag: str) -> bool:
    for name, value in _ATTRIBUTE.findall(tag):
        name = name.lower()
        value = value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and any(p.lower() in NAMED for p in _NAME_PARTS.findall(value)):
            return True
    return False


def _is_main(name: str, tag: str) -> bool:
    return name in ("article", "main") or bool(re.search(r"""\brole\s*=\s*["']?(?:main|article)\b""", tag, re.I))


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, where) of each non-empty block in page order."""
    out: list[tuple[str, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and where their content stands
    where = PLAIN

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append((text, where))

    def pop_to(depth: int) -> None:
        nonlocal where
        now = stack[depth - 1][1] if depth else PLAIN
        if now != where:
            flush()
        del stack[depth:]
        where = now

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.match(page, at)
        at, piece = m.end(), m[0]
        if piece[0] != "<" or piece == "<":
            pieces.append(_html.unescape(piece))
            continue
        if piece.startswith("<![CDATA["):
            pieces.append(piece[9:].removesuffix("]]>"))
            continue
        tag = _TAG.match(piece)
        if not tag:
            continue  # comment, doctype, processing instruction
        name = tag[2].lower()
        if tag[1]:
            if name in _BLOCK:
                flush()
            elif name in ("td", "th"):
                pieces.append(" ")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if stack[depth][0] in ("article", "main") and name not in ("body", "html"):
                    break  # a stray end tag does not close the article around it
            continue
        if name in _BLOCK:
            flush()
            _close(stack, pop_to, frozenset({"p"}), _BLOCK - {"p"})
        elif name in ("br", "td", "th"):
            pieces.append(" ")
        if name in _CLOSES:
            _close(stack, pop_to, *_CLOSES[name])
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = close.end() if close else end
            if at < end and page[at - 1] != ">":
                at = page.find(">", at) + 1 or end
            continue
        if name in _VOID or piece.endswith("/>"):
            continue
        inside = where
        if where != NAMED_PART and name not in ("html", "body"):
            if name in _DROPPED or (_named(piece) and not (_is_main(name, piece) and name == "main")):
                inside = NAMED_PART
            elif _is_main(name, piece):
                inside = ARTICLE
        if inside != where:
            flush()
        stack.append((name, inside))
        where = inside
    flush()
    return out


def _close(stack: list, pop_to, names: frozenset, limits: frozenset) -> None:
    for depth in range(len(stack) - 1, -1, -1):
        if stack[depth][0] in names:
            pop_to(depth)
            return
        if stack[depth][0] in limits:
            return


def pages_sharing(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """On how many distinct pages the run of ``run`` tokens from each position is found.

    ``tokens``: all pages' tokens one after the other, a number below zero that
    occurs once after each page; ``page``: the page of each position. Suffixes
    are sorted by prefix doubling to ``run`` tokens: suffixes of one rank then
    share that many, and neighbouring positions make up longer runs.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    width = 1
    while width < run:
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:]
        _, rank = np.unique(rank * np.int64(n + 1) + after + 1, return_inverse=True)
        width *= 2
    pairs = np.unique(rank * np.int64(n + 1) + page)
    return np.bincount(pairs // (n + 1))[rank]


def covered(sharing: np.ndarray, run: int, least_pages: int) -> np.ndarray:
    """Which positions lie in a run of ``run`` or more tokens found on so many pages."""
    n = len(sharing)
    starts = np.flatnonzero(sharing >= least_pages)
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + run, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _tokens(cut: list[list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """All pages' tokens, each page's ended by a number of its own below zero, and each position's page."""
    tokens: list[int] = []
    sizes = []
    for k, page in enumerate(cut):
        before = len(tokens)
        for text, _ in page:
            tokens += [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.split(" ")]
        tokens.append(-k - 1)
        sizes.append(len(tokens) - before)
    return np.array(tokens, dtype=np.int64), np.repeat(np.arange(len(cut)), sizes)


def _least(pages: int) -> tuple[int, int]:
    """On how many of a host's pages a run must be: anywhere, and as part of a whole block of an article."""
    return max(RUN_PAGES, int(np.ceil(RUN_SHARE * pages))), max(ARTICLE_PAGES, int(np.ceil(ARTICLE_SHARE * pages)))


def _texts(cut: list[list[tuple[str, int]]], shared: np.ndarray, notices: np.ndarray) -> list[str]:
    """Main texts, by which token positions are in runs of many pages."""
    texts, at = [], 0
    for page in cut:
        article = any(where == ARTICLE for _, where in page)
        kept = []
        for text, where in page:
            words = text.split(" ")
            here = slice(at, at + len(words))
            at += len(words)
            if article and where == ARTICLE and not notices[here].all():
                kept.append(text)
            elif not article and where == PLAIN and not shared[here].all():
                kept.append(" ".join(w for w, gone in zip(words, shared[here]) if not gone))
        at += 1
        texts.append("\n\n".join(kept))
    return texts


def _host_texts(cut: list[list[tuple[str, int]]]) -> list[str]:
    """Main texts of all different pages of one host."""
    sharing = pages_sharing(*_tokens(cut), RUN_TOKENS)
    return _texts(cut, *(covered(sharing, RUN_TOKENS, n) for n in _least(len(cut))))


def extract_pages(pages: list[str]) -> list[str]:
    """Main texts of one host's pages."""
    distinct = {p: k for k, p in enumerate(dict.fromkeys(pages))}
    texts = _host_texts([blocks(p) for p in distinct])
    return [texts[distinct[p]] for p in pages]


def run_hashes(tokens: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The same 64-bit hash for the same ``run`` tokens anywhere, and whether a page has them all, at each position."""
    n = len(tokens)
    hashes, whole = tokens.astype(np.uint64), tokens >= 0
    width = 1
    with np.errstate(over="ignore"):
        while width < run:
            after, more = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
            after[: max(0, n - width)], more[: max(0, n - width)] = hashes[width:], whole[width:]
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) + after
            hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            whole &= more
            width *= 2
    return hashes.view(np.int64), whole


def _page_counts(cut: list[list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(run hashes, on how many of these pages each is)."""
    tokens, page = _tokens(cut)
    hashes, whole = run_hashes(tokens, RUN_TOKENS)
    hashes, place = np.unique(hashes[whole], return_inverse=True)
    pairs = np.unique(place * np.int64(len(cut)) + page[whole])
    return hashes, np.bincount(pairs // len(cut), minlength=len(hashes))


def _shard_texts(cut: list[list[tuple[str, int]]], shared, notices) -> list[str]:
    """Main texts of a shard's pages, given the hashes of the host's runs of many pages."""
    hashes, whole = run_hashes(_tokens(cut)[0], RUN_TOKENS)
    found = (np.isin(hashes, np.asarray(runs, dtype=np.int64)) & whole for runs in (shared, notices))
    return _texts(cut, *(covered(f.astype(np.int64), RUN_TOKENS, 1) for f in found))


def _packed(group: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, group.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(group)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> tuple[pa.Table, list[list[tuple[str, int]]]]:
    """A shard's table and its pages' blocks."""
    table = pa.ipc.open_stream(data).read_all()
    return table, [_read_blocks(page) for page in table["blocks"].to_pylist()]


def _written_blocks(page: str) -> bytes:
    """White space inside a block is one space, so lines tell blocks apart."""
    return zlib.compress("\n".join(f"{where}{text}" for text, where in blocks(page)).encode("utf-8", "surrogatepass"))


def _read_blocks(data: bytes) -> list[tuple[str, int]]:
    return [(b[1:], int(b[0])) for b in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n") if b]


def extract(df: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``df`` (page_id, url, html)."""
    page = F.coalesce("html", F.lit(""))
    rows = df.select("page_id", "url", page.alias("html"), url_host(F.col("url")).alias("_host"), F.unhex(F.sha2(page, 256)).alias("_digest"))
    known = written(rows.groupBy("_host", "_digest").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.octet_length("html")).alias("_bytes")), "digests")
    large = written(
        known.groupBy("_host")
        .agg(F.count(F.lit(1)).alias("_pages"), F.sum("_bytes").alias("_bytes"))
        .select("_host", "_pages", F.ceil(F.col("_bytes") / shard_bytes).cast("int").alias("_shards"))
        .where("_shards > 1"),
        "large-hosts",
    )
    kind = df.schema["page_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a task gives each page of a host once
        for batch in batches:
            host, digest = batch.column("_host").to_pylist(), batch.column("_digest").to_pylist()
            new = [i for i, key in enumerate(zip(host, digest)) if not (key in seen or seen.add(key))]
            cut = [_written_blocks(batch.column("html")[i].as_py()) for i in new]
            given = batch.select(["page_id", "url", "_host", "_digest", "_shard", "_pages"]).take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([*given.columns, pa.array(cut, pa.binary())], names=[*given.schema.names, "blocks"])

    shard = F.pmod(F.xxhash64("_digest"), F.coalesce("_shards", F.lit(1))).cast("int")
    placed = rows.join(large, "_host", "left").select("page_id", "url", "html", "_host", "_digest", shard.alias("_shard"), F.coalesce("_pages", F.lit(0)).alias("_pages"))

    def distinct(some: DataFrame):
        """Groups of a shard's different pages; one exchange: copies that several tasks gave end before a group is formed."""
        parsed = some.mapInArrow(parse, f"page_id {kind}, url string, _host string, _digest binary, _shard int, _pages long, blocks binary")
        return parsed.repartition("_host", "_shard").dropDuplicates(["_host", "_shard", "_digest"]).groupBy("_host", "_shard")

    def named(table: pa.Table, host: str, texts: list[str]) -> pa.Table:
        columns = [table["page_id"], table["url"], pa.array([host] * len(texts), pa.string()), table["_digest"]]
        columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.table(columns, names=["page_id", "url", "_host", "_digest", "text", "n_chars"])

    def whole(group: pa.Table) -> pa.Table:
        return named(group, group["_host"][0].as_py(), _host_texts([_read_blocks(b) for b in group["blocks"].to_pylist()]))

    with_text = f"page_id {kind}, url string, _host string, _digest binary, text string, n_chars long"
    texts = distinct(placed.where("_pages = 0")).applyInArrow(whole, with_text)

    def pack(group: pa.Table) -> pa.Table:
        pages = group.select(["page_id", "url", "_digest", "blocks"])
        return pa.table({**{c: group[c][:1] for c in ("_host", "_shard", "_pages")}, "data": pa.array([_packed(pages)], pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                host, data, shared, notices = (batch.column(c)[i].as_py() for c in ("_host", "data", "shared", "notices"))
                table, cut = _unpacked(data)
                yield from named(table, host, _shard_texts(cut, shared or [], notices or [])).combine_chunks().to_batches()

    if not large.isEmpty():
        shards = written(distinct(placed.where("_pages > 0")).applyInArrow(pack, "_host string, _shard int, _pages long, data binary"), "shards")
        ready = shards.join(_common_runs(shards), "_host", "left").select("_host", "data", "shared", "notices")
        texts = texts.unionByName(ready.mapInArrow(finish, with_text))
    out = ["page_id", "url", "text", "n_chars"]
    repeated = written(known.where("_rows > 1").select("_host", "_digest"), "repeated")
    if repeated.isEmpty():
        return texts.select(out)
    key = ["_host", "_digest"]
    texts = written(texts, "texts")
    copied = written(texts.join(repeated, key, "left_semi").select(*key, "text", "n_chars"), "copied")
    again = rows.select("page_id", "url", *key).join(copied, key).select(out)
    return texts.join(repeated, key, "left_anti").select(out).unionByName(again)


def _common_runs(shards: DataFrame) -> DataFrame:
    """(_host, shared, notices): hashes of the runs on enough pages of each host, of its shards (_host, _pages, data)."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cut = _unpacked(batch.column("data")[i].as_py())[1]
                pages = batch.column("_pages")[i].as_py()
                runs, n = _page_counts(cut)
                runs = runs[n * pages >= _least(pages)[0] * len(cut)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("_host")[i].as_py()] * len(runs), pa.string()), pa.array(runs)], names=["_host", "run"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                host, pages, data, wanted = (batch.column(c)[i].as_py() for c in ("_host", "_pages", "data", "wanted"))
                runs, n = _page_counts(_unpacked(data)[1])
                if wanted is not None:
                    among = np.isin(runs, np.asarray(wanted, dtype=np.int64))
                    runs, n = runs[among], n[among]
                least = _least(pages)
                same = [pa.array([v] * len(runs), t) for v, t in ((host, pa.string()), (least[0], pa.int64()), (least[1], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(runs), pa.array(n, pa.int64())], names=["_host", "least", "most", "run", "n"])

    candidates = written(shards.select("_host", "_pages", "data").mapInArrow(frequent, "_host string, run long").distinct(), "candidates")
    numbers = candidates.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    few = candidates.join(numbers.where(F.col("_n") <= MANY_RUNS).select("_host"), "_host", "left_semi")
    lists = few.groupBy("_host").agg(F.collect_list("run").alias("wanted"))
    # a host without candidates has no such run; one of too many counts them all
    asked = written(numbers.join(lists, "_host", "left").select("_host", "wanted"), "wanted")
    counted = shards.select("_host", "_pages", "data").join(asked, "_host").select("_host", "_pages", "data", "wanted")
    totals = counted.mapInArrow(count, "_host string, least long, most long, run long, n long").groupBy("_host", "least", "most", "run").agg(F.sum("n").alias("n"))
    return written(
        totals.where("n >= least").groupBy("_host").agg(F.collect_list("run").alias("shared"), F.collect_list(F.expr("if(n >= most, run, null)")).alias("notices")),
        "runs",
    )
