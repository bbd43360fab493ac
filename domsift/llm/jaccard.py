"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

    1. one pass over the texts makes each document's n-gram set (hashed to 64
       bits), a 128-bit digest of it, and its MinHash signature in bands;
    2. documents of equal sets are one set from here on, with a number of its own
       and a count; doc_ids may be on several sets and only name classes;
    3. sets that share a band bucket are chained to the bucket's smallest number
       (one edge a row, never all pairs), connected components of these chains
       are the candidate clusters;
    4. inside a cluster the full n-gram sets are compared, blocks of members
       against blocks of members; only counts and one edge a member come out.

Comparing whole clusters, step 4 also finds pairs that share no band themselves.
Its work grows with the square of the *different* sets in one cluster (not with
copies), in tasks of two bounded blocks; blocks whose set sizes differ by more
than the threshold allows are never paired.

Defined results
    * words are white-space separated and lower-cased; a text of fewer than
      ``n`` words is one n-gram; a text without words is its own n-gram, so
      empty and null texts are copies of each other;
    * class_id: smallest doc_id of a set of documents linked directly or through
      others; n_links: the other documents of Jaccard ``threshold`` or more,
      copies counted one by one;
    * rows of one doc_id: each is a document; a null doc_id has class_id null
      and 0 links, and links nobody;
    * only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.llm.common import written
from domsift.llm.components import connected_components

NGRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
MAX_HASHES = 192
#: Members of one block of a large cluster, and n-grams of them, at most.
BLOCK_MEMBERS = 256
BLOCK_GRAMS = 1_000_000

_SEED = 0x9E3779B97F4A7C15
_P = np.uint64(0x2127599BF4325C37 | 1)


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows a band, so fewest false candidates, that keep the recall at the threshold."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Grams:
    """Sorted 64-bit hashes of a text's word n-grams.

    A running polynomial over the bytes of the normalised text gives every
    n-gram's hash by one subtraction, so no n-gram is ever built as a string.
    """

    def __init__(self, n: int = NGRAM):
        self.n = n
        self.bytes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))
        self.inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.up) < size:
            size = 1 << (size - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _P))), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, self.inverse))), dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.array([1], dtype=np.uint64)
        raw = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        self._powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            run = np.concatenate(([np.uint64(0)], np.cumsum(self.bytes[raw] * self.up[: len(raw)], dtype=np.uint64)))
            gaps = np.flatnonzero(raw == 32)
            start = np.concatenate(([0], gaps + 1))
            end = np.concatenate((gaps, [len(raw)]))
            k = min(self.n, len(words))
            start, end = start[: len(start) - k + 1], end[k - 1 :]
            grams = _mix((run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(_SEED))
        return np.unique(grams)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


class Signature:
    """MinHash band hashes: ``bands * rows`` independent minima over the set."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(20231)
        self.a = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.band = _mix(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint32).max, dtype=np.uint32)
        folded = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
        for at in range(0, len(folded), 512):  # stays in the processor's cache
            part = folded[at : at + 512, None] * self.a
            part += self.b
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            part ^= part >> np.uint32(13)
            np.minimum(low, part.min(axis=0), out=low)
        rows = low.reshape(self.bands, self.rows).astype(np.uint64)
        return _mix((_mix(rows + self.mix) * self.mix).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """(doc_id, digest, n_grams, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, signature = Grams(n), Signature(bands, rows)
        for batch in batches:
            digest, size, hashes = [], [], []
            for value in batch.column(1):
                grams = grams_of(value.as_py())
                digest.append(_digest(grams))
                size.append(len(grams))
                hashes.append(signature(grams))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digest, pa.binary()),
                    pa.array(size, pa.int32()),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "n_grams", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest binary, n_grams int, bands array<long>")


def _verify(threshold: float, n: int):
    """Links inside one group of members: (set_id, links, label) of each member."""
    up = math.floor(threshold * 1000 + 0.5)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(b, dtype=np.uint64) for b in group["grams"]]
        ids, copies, side = (group[c].to_numpy() for c in ("set_id", "copies", "side"))
        m = len(sets)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(m), sizes)
        grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((m, m), dtype=np.float64)
        width = max(1, 4_000_000 // max(1, m))
        n_columns = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, n_columns, width):
            a, b = np.searchsorted(column, (at, at + width))
            part = np.zeros((m, min(width, n_columns - at)), dtype=np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            common += part @ part.T
        common = common.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        linked = common * 1000 >= union * up
        np.fill_diagonal(linked, False)
        if not group["own"].iloc[0]:  # two blocks, one perhaps empty: each block's own pairs are another group's
            linked &= side[:, None] != side[None, :]
        label = np.arange(m)
        while True:  # smallest label of the neighbours, until nothing changes
            near = np.where(linked, label[None, :], m).min(axis=1, initial=m)
            new = np.minimum(label, near)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"set_id": ids, "links": linked @ copies, "label": ids[label]})

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs`` (doc_id, text)."""
    signed, whole = _classes(docs, threshold, n, recall)
    known = signed.where("doc_id is not null").select("doc_id", "digest")
    out = known.join(whole, "digest").select("doc_id", "class_id", "n_links")
    nameless = signed.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless)


def _classes(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (digest, rep, class_id, n_links, first) of each set of n-grams.

    ``rep`` is the set's smallest doc_id. ``first`` marks one set of each class:
    of those with its smallest doc_id that of the smallest digest.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = written(signatures(docs, bands, rows, n), "signatures")
    known = signed.where("doc_id is not null")
    # the number is of use because the table is written: it stays what it is
    sets = written(
        known.groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .withColumn("set_id", F.monotonically_increasing_id()),
        "sets",
    )
    # a set may share a bucket with itself only: such buckets end here
    buckets = sets.select("set_id", F.explode("bands").alias("bucket"))
    first = buckets.groupBy("bucket").agg(F.min("set_id").alias("a"), F.max("set_id").alias("_last")).where("a <> _last").select("bucket", "a")
    chains = buckets.join(written(first, "buckets"), "bucket").where("set_id <> a").select("a", F.col("set_id").alias("b")).distinct()
    clusters = connected_components(chains)
    members = written(
        clusters.select(F.col("node").alias("set_id"), F.col("label").alias("cluster")).join(
            sets.select("set_id", "digest", "rep", "copies", "n_grams"), "set_id"
        ),
        "members",
    )
    if members.isEmpty():
        alone = sets.select("digest", "rep", F.col("rep").alias("class_id"), (F.col("copies") - 1).alias("n_links"), F.lit(True).alias("first"))
        return signed, written(alone, "classes")
    found = _compare(docs, members, threshold, n)
    linked = written(members.select("set_id", "digest", "rep").join(found, "set_id"), "linked")
    firsts = written(linked.groupBy("label").agg(F.min(F.struct("rep", "digest")).alias("_first")), "firsts")
    named = linked.join(firsts, "label").select(
        "digest", F.col("_first.rep").alias("class_id"), "links", (F.col("digest") == F.col("_first.digest")).alias("first")
    )
    whole = (
        sets.select("digest", "rep", "copies")
        .join(named, "digest", "left")
        .select(
            "digest",
            "rep",
            F.coalesce("class_id", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("first", F.lit(True)).alias("first"),
        )
    )
    return signed, written(whole, "classes")


def _compare(docs: DataFrame, members: DataFrame, threshold: float, n: int) -> DataFrame:
    """(set_id, label, links) of the members of all clusters (set_id, digest, rep, cluster, copies, n_grams).

    ``label``: smallest set_id of the sets linked directly or through others.
    """
    # size classes as wide as the threshold: members of classes further apart than one can't be linked
    sized = members.withColumn("size_class", F.floor(F.log(F.col("n_grams")) / -math.log(threshold) + 1e-9).cast("int"))
    counted = sized.groupBy("cluster", "size_class").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("g"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.least(F.col("g") / BLOCK_GRAMS, F.col("m")))).cast("int")
    per_cluster = (
        counted.groupBy("cluster")
        .agg(
            F.sum("m").alias("m"),
            F.sum("g").alias("g"),
            F.map_from_entries(F.collect_list(F.struct("size_class", blocks.alias("k")))).alias("blocks"),
        )
        .select("cluster", ((F.col("m") <= BLOCK_MEMBERS) & (F.col("g") <= BLOCK_GRAMS)).alias("one"), "blocks")
    )
    plan = sized.join(written(per_cluster, "clusters"), "cluster")
    own = F.pmod(F.xxhash64("set_id"), F.element_at("blocks", F.col("size_class"))).cast("int")
    here = plan.withColumn("block", own)

    def pairs(step: int):
        """Groups of this member's block with the blocks of a size class further up or down."""
        other = F.col("size_class") + step
        k = F.coalesce(F.try_element_at("blocks", other), F.lit(0))
        every = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        mine, theirs = F.struct(F.col("size_class").alias("s"), F.col("block").alias("b")), lambda b: F.struct(other.alias("s"), b.alias("b"))
        return F.transform(
            every,
            lambda b: F.struct(
                F.least(mine, theirs(b)).alias("x"), F.greatest(mine, theirs(b)).alias("y"), (mine > theirs(b)).cast("int").alias("side")
            ),
        )

    nothing = F.struct(F.lit(0).alias("s"), F.lit(0).alias("b"))
    alone = F.array(F.struct(nothing.alias("x"), nothing.alias("y"), F.lit(0).alias("side")))
    groups = F.when(F.col("one"), alone).otherwise(F.concat(pairs(-1), pairs(0), pairs(1)))
    placed = written(here.select("set_id", "digest", "copies", "cluster", F.explode(groups).alias("group")), "groups")

    # a set's smallest doc_id may be on other sets too: rows are told apart by the digest
    wanted = members.select("rep").distinct()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = Grams(n)
        for batch in batches:
            sets = [grams_of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "grams"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep", "left_semi").select("text")
    sets = texts.mapInArrow(grams, "digest binary, grams binary").dropDuplicates(["digest"])
    compared = written(
        placed.join(sets, "digest")
        .select("cluster", "group.x", "group.y", "group.side", (F.col("group.x") == F.col("group.y")).alias("own"), "set_id", "copies", "grams")
        .groupBy("cluster", "x", "y")
        .applyInPandas(_verify(threshold, n), "set_id long, links long, label long"),
        "links",
    )
    links = compared.groupBy("set_id").agg(F.sum("links").alias("links"))
    labels = connected_components(compared.select(F.col("set_id").alias("a"), F.col("label").alias("b")))
    return links.join(labels, links["set_id"] == labels["node"], "left").select("set_id", F.coalesce("label", "set_id").alias("label"), "links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest doc_id, with all its columns.

    Rows without a doc_id stay. Where the smallest doc_id is on several rows of
    its class, one of the smallest digest of n-grams stays; its rows of other
    classes are judged there.
    """
    signed, whole = _classes(docs.select("doc_id", "text"), threshold, n, TARGET_RECALL)
    judged = signed.where("doc_id is not null").select("doc_id", "digest").join(whole, "digest")
    by_id = written(
        judged.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max(F.col("first") & (F.col("rep") == F.col("doc_id"))).alias("_first"))
        .where("_rows > 1 or not _first"),
        "not-single",
    )
    single = docs.join(by_id.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = by_id.where("_first").select("doc_id")
    if again.isEmpty():
        return single

    @F.pandas_udf("binary")
    def digests(texts: pd.Series) -> pd.Series:
        grams_of = Grams(n)
        return texts.map(lambda t: _digest(grams_of(t)))

    digest = "_" + max(docs.columns, key=len)  # no column of the table
    kept = whole.where("first").select(F.col("rep").alias("doc_id"), F.col("digest").alias(digest)).join(again, "doc_id", "left_semi")
    rows = docs.join(again, "doc_id", "left_semi").withColumn(digest, digests("text"))
    return single.unionByName(rows.join(kept, ["doc_id", digest], "left_semi").dropDuplicates(["doc_id", digest]).select(docs.columns))
