r"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\x0A-\x0D]`` and into
words at blanks and tabs. Every word begins a suffix: its language and at most
``longest`` words up to its piece's end. Suffixes are routed globally by their
leading words, so that a task holds all suffixes of the phrases it counts, and
sorted there by multikey three-way quicksort: less, equal and greater word at one
depth, the equal part one word deeper, down to ``longest``. The size of an equal
part is the count of the phrase that it shares; parts below ``least`` are
abandoned, as no longer phrase in them can be frequent.

Routing. Suffixes are counted by hashes of their leading two, three and four
words in ``BUCKETS`` buckets each (a bounded table that the driver reads). A
suffix goes by the fewest leading words whose bucket fits a group of
``GROUP_SUFFIXES``, at worst by all its words, where equal suffixes of a batch
are one row; a group therefore never holds a hot word or pair as a whole. What
is shorter than a group's leading words is counted there in part and summed up
after.

A phrase's score is the lowest over its cuts of floor(1000 a n / (l r)), by
38-digit decimals; l and r are counts of frequent phrases or words and are joined.

Defined results
    * null text: no words; null language: ``und``;
    * repeated rows and ids count as often as they come; the id is not read;
    * ties: of equal cuts the shortest first part, of equal scores the larger
      count, then the phrase in UTF-8 byte order;
    * an empty table, or no frequent phrase, gives no rows; other columns are
      not read, whatever their names;
    * texts are taken whole; a text is cut into runs of words that one task
      handles one after the other, so long ones need no more memory than their
      own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from domsift.llm.common import written

LONGEST, LEAST, TOP, SCALE, COVERED_PCT = 5, 100, 2000, 1000, 100
BUCKETS = 1 << 16
GROUP_SUFFIXES = 1_000_000
#: Text handled at a time by a task.
CHUNK_BYTES = 4 << 20

_KIND = np.zeros(256, dtype=np.uint8)  # 0 word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts: ids into ``words``, the language of each, and how many follow in its piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
        kind = _KIND[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        spelt = pa.Array.from_buffers(
            pa.large_string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[kind == 0])]
        )
        coded = spelt.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int32)
        self.words = coded.dictionary.cast(pa.string())
        names, lang_of = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.langs = pa.array(names.tolist(), pa.string())
        text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
        self.lang = lang_of[text_of].astype(np.int32)
        piece = np.searchsorted(np.flatnonzero(kind == 2), begin)
        last = np.append(np.flatnonzero(piece[1:] != piece[:-1]), len(piece) - 1)
        self.left = (np.repeat(last, np.diff(np.append(-1, last))) - np.arange(len(piece)) if len(piece) else piece) + 1

    def counts(self) -> pa.Table:
        """Occurrences of each word of each language."""
        both, n = np.unique(self.lang.astype(np.int64) * len(self.words) + self.ids, return_counts=True)
        lang, word = np.divmod(both, max(1, len(self.words)))
        return pa.table(
            {
                "lang": self.langs.take(pa.array(lang)),
                "word": self.words.take(pa.array(word)),
                "n": pa.array(n, pa.int64()),
            }
        )

    def suffixes(self, longest: int) -> np.ndarray:
        """A column each for the language and ``longest`` words of suffixes of two words or more; -1 beyond a piece's end."""
        at = np.flatnonzero(self.left > 1)
        out = np.full((longest + 1, len(at)), -1, dtype=np.int32)
        out[0] = self.lang[at]
        for k in range(longest):
            there = self.left[at] > k
            out[k + 1, there] = self.ids[at[there] + k]
        return out

    def leading(self, columns: np.ndarray) -> Iterator[np.ndarray]:
        """Hashes of the language and the first k words, from k = 0 on, one held at a time; alike on every machine."""
        of_lang, of_word = (
            pd.util.hash_array(np.append(listed.to_numpy(zero_copy_only=False), [""]), categorize=False) for listed in (self.langs, self.words)
        )
        hashed = of_lang[columns[0]]
        yield hashed
        for column in columns[1:]:
            hashed = (hashed ^ (hashed >> np.uint64(29))) * _MIX + of_word[column]
            yield hashed


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        langs, texts, size = [], [], 0
        for lang, text in zip(batch.column(0), batch.column(1)):
            langs.append("und" if not lang.is_valid else lang.as_py())
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield Words(langs, texts)
                pa.default_memory_pool().release_unused()
                langs, texts, size = [], [], 0
        if texts:
            yield Words(langs, texts)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(31))) * _MIX) >> np.uint64(40)).astype(np.int64) % buckets


def survey(df: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(lang, word, n) of the words, and (null, null, n) with depth and bucket of the suffixes' leading words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros((longest, buckets), dtype=np.int64)
        for words in _chunks(batches):
            for k, hashed in enumerate(words.leading(words.suffixes(longest))):
                if 2 <= k < longest:
                    filled[k] += np.bincount(_bucket(hashed, buckets), minlength=buckets)
            del hashed
            table = words.counts()
            nothing = pa.nulls(len(table), pa.int32())
            yield from table.append_column("depth", nothing).append_column("bucket", nothing).to_batches()
        depth, bucket = np.nonzero(filled)
        nothing = pa.nulls(len(depth), pa.string())
        yield pa.RecordBatch.from_arrays(
            [nothing, nothing, pa.array(filled[depth, bucket]), pa.array(depth, pa.int32()), pa.array(bucket, pa.int32())],
            names=["lang", "word", "n", "depth", "bucket"],
        )

    counted = df.mapInArrow(run, "lang string, word string, n long, depth int, bucket int")
    return counted.groupBy("lang", "word", "depth", "bucket").agg(F.sum("n").alias("n"))


def plan_routes(filled: np.ndarray, group: int) -> tuple[np.ndarray, int, int]:
    """Route of each (depth, bucket), -1 where it is too full; the first route by whole suffixes, and how many of these."""
    longest, _ = filled.shape
    routes, first = np.full(filled.shape, -1, dtype=np.int64), 0
    rest = 0
    for k in range(2, longest):
        fits = filled[k] <= group
        before = np.cumsum(np.where(fits, filled[k], 0)) - np.where(fits, filled[k], 0)
        routes[k] = np.where(fits, first + before // group, -1)
        first = int(routes[k].max(initial=first - 1)) + 1
        rest = int(filled[k][~fits].sum())
        if not rest:
            break
    return routes, first, -(-rest // group)


def _packed(words: Words, columns: np.ndarray, weight: np.ndarray) -> bytes:
    """Some suffixes with the words they use, as Arrow IPC bytes."""
    arrays, places = [], []
    for listed, part in ((words.langs, columns[:1]), (words.words, columns[1:])):
        used = np.zeros(len(listed) + 1, dtype=bool)
        used[part] = True
        used[-1] = False  # where a piece has ended
        place = np.append(np.cumsum(used[:-1], dtype=np.int32) - 1, -1).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays([0, used.sum()], listed.take(pa.array(np.flatnonzero(used)))))
        places.append(place[part])
    arrays += [pa.array([numbers.astype("<i4").tobytes()], pa.binary()) for numbers in (np.concatenate(places), weight)]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(arrays, names=["langs", "words", "at", "weight"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def route(df: DataFrame, longest: int, routes: np.ndarray, whole_from: int, wholes: int) -> DataFrame:
    """(route, depth, suffixes): suffixes of one route, packed; depth is the number of leading words it goes by."""
    buckets = routes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches):
            columns = words.suffixes(longest)
            to = np.full(columns.shape[1], -1, dtype=np.int64)
            depth = np.full(columns.shape[1], longest, dtype=np.int32)
            for k, hashed in enumerate(words.leading(columns)):
                if 2 <= k < longest:
                    todo = np.flatnonzero(to < 0)
                    to[todo] = routes[k][_bucket(hashed[todo], buckets)]
                    depth[todo[to[todo] >= 0]] = k
            todo = np.flatnonzero(to < 0)
            to[todo] = whole_from + _bucket(hashed[todo], max(1, wholes))
            # equal suffixes become one; equal hashes alone don't make them equal
            order = np.lexsort((hashed, to))
            del hashed, todo
            columns, to, depth = columns[:, order], to[order], depth[order]
            new = np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0))[: len(to)]
            first = np.flatnonzero(new)
            weight = np.diff(np.append(first, len(to)))
            columns, to, depth = columns[:, first], to[first], depth[first]
            cut = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)]), len(to))
            rows = [(int(to[a]), int(depth[a]), _packed(words, columns[:, a:b], weight[a:b])) for a, b in zip(cut, cut[1:])]
            if rows:
                r, d, s = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, pa.int64()), pa.array(d, pa.int32()), pa.array(s, pa.binary())], names=["route", "depth", "suffixes"]
                )

    return df.mapInArrow(run, "route long, depth int, suffixes binary")


def sort_suffixes(columns: np.ndarray, weight: np.ndarray, least: int, depth: int) -> Iterator[tuple[np.ndarray, int]]:
    """Multikey three-way quicksort of pointers to suffixes; yields (language and words, count) of the phrases found.

    Phrases of ``depth`` words or more are complete here and are yielded from
    ``least`` on. Shorter ones have further occurrences elsewhere: all of two
    words or more are yielded.
    """
    deepest = len(columns) - 1
    partial = depth if depth > 2 else 0  # below this depth nothing is abandoned
    stack = [(np.arange(columns.shape[1]), 0)]
    while stack:
        at, d = stack.pop()
        key = columns[d][at]
        middle = key[:: max(1, len(key) // 15)]
        pivot = np.partition(middle, len(middle) // 2)[len(middle) // 2]
        for side in (at[key < pivot], at[key > pivot]):
            if len(side) and (d < partial or weight[side].sum() >= least):
                stack.append((side, d))
        if pivot < 0:  # pieces that end here
            continue
        equal = at[key == pivot]
        count = int(weight[equal].sum())
        if d >= 2 and (count >= least or d < depth):
            yield columns[: d + 1, equal[0]], count
        if d < deepest and (count >= least or d + 1 < partial):
            stack.append((equal, d + 1))


def _unpacked(packed: list[pa.Buffer]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Languages, words and suffixes of several packs, under one numbering; one pack's numbers are held at a time."""
    listed, numbers = [], []
    for name in ("langs", "words"):
        parts = [_pack(data)[name].flatten() for data in packed]
        coded = pa.concat_arrays(parts).dictionary_encode()
        listed.append(coded.dictionary)
        of_all = coded.indices.to_numpy()
        ends = np.cumsum([len(p) for p in parts])
        numbers.append([np.append(of_all[end - len(p) : end], np.int32(-1)) for p, end in zip(parts, ends)])
        del parts
    weights = [np.frombuffer(_pack(data)["weight"][0].as_buffer(), "<i4") for data in packed]
    suffixes, done = None, 0
    for data, weight, of_lang, of_word in zip(packed, weights, *numbers):
        at = np.frombuffer(_pack(data)["at"][0].as_buffer(), "<i4").reshape(-1, len(weight))
        if suffixes is None:
            suffixes = np.empty((len(at), sum(map(len, weights))), dtype=np.int32)
        here = suffixes[:, done : done + len(weight)]
        np.take(of_lang, at[0], out=here[0], mode="wrap")
        for column, to in zip(at[1:], here[1:]):
            np.take(of_word, column, out=to, mode="wrap")
        done += len(weight)
    return *listed, suffixes, np.concatenate(weights).astype(np.int64)


def _pack(data: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def count_phrases(df: DataFrame, longest: int = LONGEST, least: int = LEAST, buckets: int = BUCKETS, group: int = GROUP_SUFFIXES):
    """(counts, totals): (lang, phrase, words, n) of frequent words and phrases, and (lang, n) of all words."""
    given = df.select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    surveyed = written(survey(given, longest, buckets), "survey")
    filled = np.zeros((longest, buckets), dtype=np.int64)
    for row in surveyed.where("depth is not null").select("depth", "bucket", "n").toLocalIterator():
        filled[row.depth, row.bucket] = row.n
    routes, whole_from, wholes = plan_routes(filled, group)

    def sort(table: pa.Table) -> pa.Table:
        langs, words, columns, weight = _unpacked([pack.as_buffer() for pack in table["suffixes"]])
        found = list(sort_suffixes(columns, weight, least, table["depth"][0].as_py()))
        del columns, weight
        pa.default_memory_pool().release_unused()
        return pa.table(
            {
                "lang": pa.array([langs[int(key[0])].as_py() for key, _ in found], pa.string()),
                "phrase": pa.array([" ".join([words[i].as_py() for i in key[1:].tolist()]) for key, _ in found], pa.string()),
                "words": pa.array([len(key) - 1 for key, _ in found], pa.int32()),
                "n": pa.array([n for _, n in found], pa.int64()),
            }
        )

    routed = route(given, longest, routes, whole_from, wholes)
    found = routed.groupBy("route").applyInArrow(sort, "lang string, phrase string, words int, n long")
    phrases = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = surveyed.where("depth is null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    counts = written(phrases.unionByName(words.where(F.col("n") >= least)), "phrases")
    return counts, words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(
    df: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, covered_pct: int = COVERED_PCT, scale: int = SCALE, **sizes
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``least`` is the count that makes a candidate; a candidate is dropped if a
    longer one that contains it has ``covered_pct`` per cent of its count.
    """
    counts, totals = count_phrases(df, longest, least, **sizes)
    candidates = counts.where("words > 1").withColumn("_w", F.split("phrase", " ", -1))
    joined = lambda begin, n: F.array_join(F.slice("_w", begin, n), " ")

    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "words", "_w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    sides = cuts.select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("_l"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("_r")
    )
    part = counts.select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    left = part.withColumnRenamed("_part", "_l").withColumnRenamed("_n", "l")
    right = part.withColumnRenamed("_part", "_r").withColumnRenamed("_n", "r")
    cut = sides.join(left, ["lang", "_l"]).join(right, ["lang", "_r"]).join(totals, "lang")
    whole = "cast({} as decimal(19,0))".format
    score = F.expr(f"({scale}BD * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c"))

    spans = candidates.where("words > 2").select(
        "lang", F.col("n").alias("_longer"), "_w", F.explode(F.expr("sequence(2, words - 1)")).alias("_size"), "words"
    )
    inner = spans.select("lang", "_longer", "_w", "_size", F.explode(F.expr("sequence(1, words - _size + 1)")).alias("_at"))
    covers = inner.select("lang", joined(F.col("_at"), F.col("_size")).alias("phrase"), "_longer")
    most = covers.groupBy("lang", "phrase").agg(F.max("_longer").alias("_most"))
    alone = scored.join(most, ["lang", "phrase"], "left").where(f"_most is null or 100 * _most < {covered_pct} * a")

    # the best of each slice first, so that no task sees all phrases of a language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = alone.select("lang", "phrase", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), "n", F.col("_c.score").alias("score"))
    salted = flat.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    best = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(f"_place <= {top}")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(f"rank <= {top}").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
