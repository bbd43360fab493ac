"""Alignment of two tokenizers' tokens, and how widely each token pair is linked.

A text is tokenised whole by both tokenizers. Where tokens of both that carry a
leading space begin at one byte, the ends before them are shared; these anchors
cut the text into windows of (A ids, B ids). Bytes of a token follow from its
id, so a window's alignment follows from its ids and is worked out once a block
of documents for each pair of id tuples, and remembered there. Inside a window the byte offsets where both
end cut it into groups; every A token of a group is linked to every B token.

How many documents link a pair of ids is a corpus-wide sum. Documents are taken
in blocks of bounded text. A block lists the different pairs that it links; only
these lists are summed and answered, so a pair that all documents link is one
row a block. The answers then meet their block's documents again.

Defined results
    * null or empty text, and texts whose joined token bytes are not a space plus
      the text: no tokens (zeros, an empty digest);
    * special strings inside texts are plain text, none are added;
    * repeated rows and ids, null ids: each row is a document of its own;
    * ties between B ids of one A id: all are best; an empty table gives no rows;
    * only the id and the text are read, whatever other columns are called;
    * a text is never cut: its ids are held by one task, about 100 bytes a token.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.llm.common import written

#: Text of one block of documents, and most of its documents.
BLOCK_CHARS, BLOCK_ROWS = 5_000_000, 4096
#: Unbroken runs beyond this go to the library's encoder, which does not slow down on them.
LONG_RUN = 2000
# characters on which both encoders of the byte-level file cut words alike (tested one by one)
_UNUSUAL = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")
# fixed values: the byte-level format's word pattern and its letters for bytes
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _VISIBLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class ByteLevel:
    """A byte-level BPE file: ids as its own library gives them, and the bytes of each id.

    Where the file's ids are in the order of its merges, usual texts take the
    quicker encoder that works by such ranks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        vocab = given["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max(self.library.get_vocab(True).values()) + 1)
        for token, i in self.library.get_vocab(True).items():
            self.bytes_of[i] = bytes(_BYTE_OF[c] for c in token) if token in vocab and all(c in _BYTE_OF for c in token) else token.encode()
        self.quick = self._ranked(given)

    def _ranked(self, given: dict):
        cut = given.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not given.get("normalizer")
        merges = [m.split(" ") if isinstance(m, str) else m for m in given["model"]["merges"]]
        vocab = given["model"]["vocab"]
        bytewise = [t for t, i in vocab.items() if i < 256 and len(t) == 1]
        if not plain or len(bytewise) != 256 or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {self.bytes_of[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _usual(self, text: str) -> bool:
        return not _UNUSUAL.search(text) and " " * LONG_RUN not in text and max(map(len, text.split(" "))) < LONG_RUN

    def encode(self, texts: list[str]) -> list[list[int]]:
        quick = [self.quick is not None and self._usual(t) for t in texts]
        slow = self.library.encode_batch([t for t, q in zip(texts, quick) if not q], add_special_tokens=False)
        rest = iter(slow)
        return [self.quick.encode_ordinary(t) if q else next(rest).ids for t, q in zip(texts, quick)]


class Pieces:
    """A sentence-piece model: ids of texts (it puts the space before them) and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(i) for i in range(self.library.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class _Numbered(dict):
    """Numbers keys in the order of their first coming."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _spread(sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + sizes[0] - 1, begin[1] .., one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begin - before, sizes) + np.arange(sizes.sum())


class Aligner:
    """Aligns blocks of texts. A window's key is its A ids, then its B ids raised by ``raised``, as uint32 bytes."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.raised = len(self.a.bytes_of)
        both = [*self.a.bytes_of, *self.b.bytes_of]
        self.size = np.array([len(t) for t in both], dtype=np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in both])
        self.letters = np.frombuffer(b"".join(both), dtype=np.uint8)
        self.first = np.cumsum(self.size) - self.size
        self.written = [f"{i - self.raised if i >= self.raised else i}{mark}" for i in range(len(both)) for mark in ",|;"]

    def _spells(self, ids: np.ndarray, whole: np.ndarray) -> bool:
        sizes = self.size[ids]
        return sizes.sum() == len(whole) and bool((self.letters[_spread(sizes, self.first[ids])] == whole).all())

    def windows(self, text: str, a_ids: list[int], b_ids: list[int]) -> list[bytes] | None:
        """Keys of the text's windows; None if either side does not spell the text."""
        whole = np.frombuffer(b" " + text.encode(), dtype=np.uint8)
        a, b = np.array(a_ids, dtype=np.uint32), np.array(b_ids, dtype=np.uint32) + np.uint32(self.raised)
        if not (self._spells(a, whole) and self._spells(b, whole)):
            return None
        a_size, b_size = self.size[a], self.size[b]
        a_from, b_from = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        a_at, b_at = np.flatnonzero(self.spaced[a]), np.flatnonzero(self.spaced[b])
        marked = np.zeros(len(whole), dtype=np.uint8)
        marked[a_from[a_at]] = 1
        marked[b_from[b_at]] += 1
        # both sides have a space-marked token here, so what is before it ends on both
        a_at, b_at = a_at[marked[a_from[a_at]] == 2], b_at[marked[b_from[b_at]] == 2]
        a_cut = np.concatenate([[0], a_at[a_at > 0], [len(a)]])
        b_cut = np.concatenate([[0], b_at[b_at > 0], [len(b)]])
        order = np.empty(len(a) + len(b), dtype=np.uint32)
        order[np.arange(len(a)) + np.repeat(b_cut[:-1], np.diff(a_cut))] = a
        order[np.arange(len(b)) + np.repeat(a_cut[1:], np.diff(b_cut))] = b
        spelt, cut = order.tobytes(), (4 * (a_cut + b_cut)).tolist()
        return [spelt[i:j] for i, j in pairwise(cut)]

    def work_out(self, keys: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of different windows: numbers of groups, digest texts, numbers of links; and all links as a << 32 | b.

        Both sides of a window span the same bytes, so all windows laid end to
        end are cut by one comparison of byte offsets.
        """
        ids = np.frombuffer(b"".join(keys), dtype=np.uint32)
        of_b = ids >= self.raised
        a, b = ids[~of_b], ids[of_b]
        a_end, b_end = np.cumsum(self.size[a]), np.cumsum(self.size[b])
        marked = np.zeros(int(a_end[-1]) + 1 if len(a) else 1, dtype=np.uint8)
        marked[a_end] = 1
        marked[b_end] += 1
        a_last, b_last = marked[a_end] == 2, marked[b_end] == 2
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n_groups = int(a_last.sum())
        n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        b_first = np.cumsum(n_b) - n_b
        links = n_b[a_group]
        pairs = np.repeat(a.astype(np.int64) << 32, links) | (b[_spread(links, b_first[a_group])] - np.uint32(self.raised))
        # text: the ids of a group's A tokens, then those of its B tokens, each with the mark that follows it
        order = np.empty(len(ids), dtype=np.int64)
        order[np.arange(len(a)) + b_first[a_group]] = 3 * a.astype(np.int64) + a_last
        order[np.arange(len(b)) + np.cumsum(n_a)[b_group]] = 3 * b.astype(np.int64) + 2 * b_last
        table = self.written
        text = [table[i] for i in order.tolist()]
        to = np.cumsum([len(k) // 4 for k in keys], dtype=np.int64)
        texts = ["".join(text[i:j]) for i, j in pairwise([0, *to.tolist()])]
        a_to = np.cumsum(~of_b)[to - 1]
        n_links = np.diff(np.append(0, np.cumsum(links))[a_to], prepend=0)
        return np.diff(a_group[a_to - 1] + 1, prepend=0), texts, n_links, pairs

    def block(self, texts: list[str]):
        """Per text: n_a, n_b, n_groups, n_links, digest, places of its pairs, how often; then the block's pairs and their documents.

        Equal windows of the block are numbered alike and worked out once.
        """
        a_ids, b_ids = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        number = _Numbered()
        n_a, n_b, used = [], [], []
        for text, a, b in zip(texts, a_ids, b_ids):
            keys = self.windows(text, a, b) if text else None
            n_a.append(len(a) if keys else 0)
            n_b.append(len(b) if keys else 0)
            used.append([number[key] for key in keys or ()])
        none = np.empty(0, dtype=np.int64)
        n_groups, texts_of, sizes, links = self.work_out(list(number)) if number else (none, [], none, none)
        pairs, place = np.unique(links, return_inverse=True)
        spelt = ["".join([texts_of[i] for i in mine])[:-1].encode() for mine in used]
        digests = [hashlib.sha256(t).hexdigest() if t else "" for t in spelt]
        window = np.array([i for mine in used for i in mine], dtype=np.int64)
        of_text = np.repeat(np.arange(len(texts)), [len(mine) for mine in used])
        begin = np.cumsum(sizes) - sizes
        # every link of every text by (text, place of its pair), equal ones once and counted
        each = np.repeat(of_text, sizes[window]) * max(1, len(pairs)) + place[_spread(sizes[window], begin[window])]
        each.sort()
        first = np.flatnonzero(np.append(True, each[1:] != each[:-1])[: len(each)])
        often = np.diff(np.append(first, len(each))).astype("<u4")
        text_of, which = np.divmod(each[first], max(1, len(pairs)))
        documents = np.bincount(which, minlength=len(pairs))
        cut = np.searchsorted(text_of, np.arange(len(texts) + 1)).tolist()
        which = which.astype("<u4")
        at = [which[i:j].tobytes() for i, j in pairwise(cut)]
        times = [often[i:j].tobytes() for i, j in pairwise(cut)]
        sums = [np.bincount(of_text, weights=n[window], minlength=len(texts)).astype(np.int64).tolist() for n in (n_groups, sizes)]
        return n_a, n_b, *sums, digests, at, times, pairs, documents


_ALIGNERS: dict = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        begin, chars, texts = 0, 0, []
        for i, value in enumerate(batch.column(1)):
            texts.append(value.as_py() or "")
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS or len(texts) >= BLOCK_ROWS or i + 1 == batch.num_rows:
                yield batch.column(0).slice(begin, len(texts)), texts
                begin, chars, texts = i + 1, 0, []


def align(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): documents with their blocks, and the pairs each block links (block, at, code, n)."""
    paths = tokenizers or default_tokenizers()
    kind = df.schema[id_col].dataType.simpleString()
    figures = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema = f"`{id_col}` {kind}, {figures}, block long, at binary, times binary, pairs binary, documents binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        first = TaskContext.get().partitionId() << 32
        for number, (ids, texts) in enumerate(_blocks(batches)):
            n_a, n_b, n_groups, n_links, digests, at, times, pairs, documents = aligner.block(texts)
            n = len(texts)
            # the block's own row comes last: no id, no figures, the pairs and in how many documents they are
            columns = [
                pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                *[pa.array([*c, None], pa.int64()) for c in (n_a, n_b, n_groups, n_links)],
                pa.array([*digests, None], pa.string()),
                pa.array([first + number] * (n + 1), pa.int64()),
                *[pa.array([*c, None], pa.binary()) for c in (at, times)],
                pa.array([None] * n + [pairs.astype("<i8").tobytes()], pa.binary()),
                pa.array([None] * n + [documents.astype("<i8").tobytes()], pa.binary()),
            ]
            names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "at", "times", "pairs", "documents"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, documents in zip(*(batch.column(i).to_pylist() for i in range(3))):
                code = np.frombuffer(pairs, "<i8")
                rows = [np.full(len(code), block), np.arange(len(code), dtype=np.int32), code, np.frombuffer(documents, "<i8")]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["block", "at", "code", "n"])

    rows = written(df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema), "aligned")
    own = rows.where("pairs is not null").select("block", "pairs", "documents")
    return rows.where("pairs is null").drop("pairs", "documents"), own.mapInArrow(listed, "block long, at int, code long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(code, a, b, n, best): documents that link a pair, and whether no other B id of its A id has more."""
    summed = pairs.groupBy("code").agg(F.sum("n").alias("n"))
    counts = written(summed.withColumn("a", F.shiftright("code", 32)).withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("_most"))  # one row an A id at most
    return counts.join(most, "a").select("code", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def alignments(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    documents, pairs = align(df, id_col, text_col, tokenizers)
    answers = pairs.join(pair_counts(pairs).select("code", F.col("n").alias("_n"), "best"), "code").select("block", "at", "_n", "best")
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", groups_sha256 string"

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        size = docs.num_rows and told.num_rows
        count, best = np.zeros(size + 1, dtype=np.int64), np.zeros(size + 1, dtype=np.int64)
        if size:
            place = told["at"].to_numpy()
            count, best = np.zeros(place.max() + 1, dtype=np.int64), np.zeros(place.max() + 1, dtype=np.int64)
            count[place], best[place] = told["_n"].to_numpy(), told["best"].to_numpy().astype(np.int64)
        n_best, sums = [], []
        for at, times in zip(docs["at"], docs["times"]):
            which = np.frombuffer(at.as_py(), "<u4")
            often = np.frombuffer(times.as_py(), "<u4").astype(np.int64)
            n_best.append(int((best[which] * often).sum()))
            sums.append(int((count[which] * often).sum()))
        kept = [docs[n] for n in names[:5]]
        return pa.table([*kept, pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), docs["groups_sha256"]], names=names)

    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
