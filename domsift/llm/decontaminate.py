"""Training texts that hold benchmark items: BM25 with block-max WAND, then overlap.

The benchmark is turned into an inverted index whose impacts are BM25 scores
divided by what the item's own best passage scores, so that one threshold fits
short and long items. Every text is cut into overlapping passages; each passage
is a query, and all items at or above the threshold are retrieved. Items are put
in an order that keeps like ones together and cut into ranges; a passage whose
terms' largest impacts add up to the threshold in no range is passed over (the
block-max test, made for all passages of a text at once), the others run through
block-max WAND. A retrieved item is then compared with the
text around the passage: n-grams of its question (all sentences but the last)
and of its answer (the last).

The index is made for a bounded part of the benchmark at a time; a larger
benchmark takes several passes over the texts, nothing is left out.

Defined results
    * words: white-space separated, lower-cased, stripped of punctuation;
    * a text holds an item if half of the question's n-grams and half of the
      answer's stand together in it, or four fifths of the question's alone;
    * one row for each text row and item_id, with its best passage; null or
      empty texts and items match nothing; repeated items count once;
    * only the named columns are read; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIDE = 32
PASSAGE = 2 * STRIDE
THRESHOLD = 0.5
K1, B = 1.2, 0.75
POSTING_BLOCK = 8
#: Ranges of items for which the largest impact of each term is kept, at most.
RANGES = 64
NGRAM = 5
QUESTION_SHARE, ANSWER_SHARE, QUESTION_ALONE = 0.5, 0.5, 0.8
#: Benchmark items, and characters of them, that one pass indexes at most.
PASS_ITEMS, PASS_CHARS = 20_000, 32_000_000

_EDGES = re.compile(r"^\W+|\W+$")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return [w for w in (_EDGES.sub("", c) for c in (text or "").lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a single sentence, its last third."""
    parts = [p for p in map(words, _SENTENCE_END.split(text)) if p]
    if not parts:
        return [], []
    if len(parts) == 1:
        cut = max(1, len(parts[0]) * 2 // 3)
        return parts[0][:cut], parts[0][cut:]
    return [w for p in parts[:-1] for w in p], parts[-1]


def overlap(part: list[str], around: list[str], n: int = NGRAM) -> float:
    """Share of the part's n-grams that stand in ``around``; 0 for an empty part."""
    n = min(n, len(part))
    if not n:
        return 0.0
    grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    there = {tuple(around[i : i + n]) for i in range(len(around) - n + 1)}
    return len(grams & there) / len(grams)


class Index:
    """Inverted index of items; impacts are normalised BM25 term scores."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_words: float, frequency: dict[str, int]):
        # items that share their commonest words stand together: that keeps the ranges' bounds tight
        order = {w: (-n, w) for w, n in frequency.items()}
        items = sorted(items, key=lambda item: (sorted(set(words(item[1])), key=order.__getitem__)[:4], item))
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.sizes = []
        for k, (_, text) in enumerate(items):
            tokens = words(text)
            self.sizes.append(len(tokens))
            count = Counter(tokens)
            norm = K1 * (1 - B + B * len(tokens) / mean_words) if mean_words else K1
            score = {
                w: math.log1p((n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in count.items()
            }
            best = max((sum(score[w] for w in set(tokens[i : i + PASSAGE])) for i in range(max(1, len(tokens) - PASSAGE + 1))), default=0.0)
            for w, s in score.items():
                postings[w].append((k, s / best))
        self.term = {w: i for i, w in enumerate(postings)}
        self.postings = []
        for found in postings.values():
            items_of = [k for k, _ in found]
            impacts = [s for _, s in found]
            blocks = [max(impacts[i : i + POSTING_BLOCK]) for i in range(0, len(impacts), POSTING_BLOCK)]
            self.postings.append((items_of, impacts, blocks))
        width = max(4, -(-len(items) // RANGES))
        self.range_most = np.zeros((len(self.postings) + 1, max(1, -(-len(items) // width))), dtype=np.float32)
        for t, (items_of, impacts, _) in enumerate(self.postings):
            np.maximum.at(self.range_most[t], np.array(items_of) // width, impacts)
        self.most = np.array([max(p[1]) for p in self.postings] + [0.0])  # the last: words that are in no item

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold, by block-max WAND."""
        lists = [[self.postings[t], 0, float(self.most[t])] for t in terms]  # postings, cursor, largest impact
        out = []
        while lists:
            lists.sort(key=lambda c: c[0][0][c[1]])
            upper, pivot = 0.0, -1
            for i, c in enumerate(lists):
                upper += c[2]
                if upper >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][0][lists[pivot + 1][1]] == item:
                pivot += 1
            within, ends = 0.0, []
            for c in lists[: pivot + 1]:
                (items_of, _, blocks), at, _ = c
                at = _seek(items_of, at, item, POSTING_BLOCK)
                if at < len(items_of):
                    within += blocks[at // POSTING_BLOCK]
                    ends.append(items_of[min(len(items_of), (at // POSTING_BLOCK + 1) * POSTING_BLOCK) - 1])
            if within >= threshold - 1e-9:
                score = 0.0
                for c in lists[: pivot + 1]:
                    c[1] = _seek(c[0][0], c[1], item)
                    if c[1] < len(c[0][0]) and c[0][0][c[1]] == item:
                        score += c[0][1][c[1]]
                        c[1] += 1
                if score >= threshold - 1e-9:
                    out.append((item, score))
            else:  # no item before the nearest block end, nor before the next list, can reach the threshold
                after = min(ends, default=item) + 1
                if pivot + 1 < len(lists):
                    after = min(after, lists[pivot + 1][0][0][lists[pivot + 1][1]])
                after = max(after, item + 1)
                for c in lists[: pivot + 1]:
                    c[1] = _seek(c[0][0], c[1], after)
            lists = [c for c in lists if c[1] < len(c[0][0])]
        return out


def _seek(items_of: list[int], at: int, item: int, block: int = 0) -> int:
    """First place from ``at`` with an item >= ``item``; with ``block``, the place's block is enough."""
    if block:
        while at < len(items_of) and items_of[min(len(items_of), (at // block + 1) * block) - 1] < item:
            at = (at // block + 1) * block
        return at
    while at < len(items_of) and items_of[at] < item:
        at += 1
    return at


class _Terms(dict):
    """White-space separated chunk -> term number, -1: in no item, -2: no word; bounded."""

    def __init__(self, term: dict[str, int]):
        super().__init__()
        self.term = term

    def __missing__(self, chunk: str) -> int:
        word = _EDGES.sub("", chunk)
        value = self.term.get(word, -1) if word else -2
        if len(self) >= 100_000:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = value
        return value


def _within_reach(index: Index, numbers: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The passages whose bound, over distinct terms, reaches the threshold in some range of items.

    A passage is two strides. A term adds to it where it stands for the first
    time: in the first stride if it was not yet there, in the second if it was
    in neither.
    """
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    same = np.concatenate(([False], numbers[order[1:]] == numbers[order[:-1]]))
    before = np.full(n, -1)
    before[order[same]] = order[np.flatnonzero(same) - 1]
    begin = np.arange(n) // STRIDE * STRIDE
    strides = np.arange(0, n, STRIDE)
    new_here, new_in_both = before < begin, before < begin - STRIDE
    out = []
    for at in range(0, len(strides), 64):  # bounded memory for texts of any length
        low, high = at * STRIDE, min(n, (at + 65) * STRIDE)
        bounds, cut = index.range_most[numbers[low:high]], strides[at : at + 65] - low
        reach = np.add.reduceat(bounds * new_here[low:high, None], cut, axis=0)
        reach[:-1] += np.add.reduceat(bounds * new_in_both[low:high, None], cut, axis=0)[1:]
        near = (reach >= threshold - 1e-4).any(axis=1)[:64]
        out += [(low + int(k) * STRIDE, min(n, low + int(k) * STRIDE + PASSAGE)) for k in np.flatnonzero(near)]
    return out


def matches(text: str, index: Index, terms: _Terms, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float, int]]:
    """(item_id, score, question_overlap, answer_overlap, first word of the passage), one per item_id."""
    chunks = text.lower().split()
    numbers = np.fromiter(map(terms.__getitem__, chunks), dtype=np.int64, count=len(chunks))
    real = np.flatnonzero(numbers != -2)
    numbers = numbers[real]
    if not len(numbers):
        return []
    best: dict[int, tuple] = {}
    for a, b in _within_reach(index, numbers, threshold):
        for item, score in index.retrieve([t for t in set(numbers[a:b].tolist()) if t >= 0], threshold):
            size = index.sizes[item]
            low, high = max(0, a - size), min(len(real), b + size)
            around = [_EDGES.sub("", chunks[i]) for i in real[low:high]]
            question, answer = index.parts[item]
            q, r = overlap(question, around), overlap(answer, around)
            if (q >= QUESTION_SHARE and r >= ANSWER_SHARE) or q >= QUESTION_ALONE:
                row = (q + r, score, -a, q, r)
                if index.ids[item] not in best or row > best[index.ids[item]]:
                    best[index.ids[item]] = row
    return [(i, score, q, r, -a) for i, (_, score, a, q, r) in sorted(best.items())]


def _indexes(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of the benchmark's parts, each of a bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [words(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(r) for r in rows], pa.int64()), pa.array([sorted(set(r)) for r in rows], pa.list_(pa.string()))], names=["n", "terms"]
            )

    terms = items.select("text").mapInArrow(cut, "n long, terms array<string>")
    n_items, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    mean_words = terms.agg(F.avg("n")).first()[0]
    passes = max(-(-n_items // PASS_ITEMS), -(-chars // PASS_CHARS))
    frequency = terms.select(F.explode("terms").alias("term")).groupBy("term").count()
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        rows = sorted((r.item_id, r.text) for r in part.collect())
        known = part.select("text").mapInArrow(cut, "n long, terms array<string>").select(F.explode("terms").alias("term")).distinct()
        counts = dict(frequency.join(known, "term", "left_semi").collect())
        yield spark.sparkContext.broadcast(Index(rows, n_items, mean_words, counts))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_start) of every text that holds an item."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start int"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared in _indexes(benchmark):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            numbers = _Terms(shared.value.term)
            for batch in batches:
                out = [(d.as_py(), *m) for d, t in zip(*batch.columns) for m in matches(t.as_py() or "", shared.value, numbers, threshold)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
                    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        found = found.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    at = docs.columns.index("text")
    for shared in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            numbers = _Terms(shared.value.term)
            for batch in batches:
                clean = [not matches(t.as_py() or "", shared.value, numbers, threshold) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
