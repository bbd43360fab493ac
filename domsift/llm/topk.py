"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). The index is a table of blocks; a
block keeps its vectors and, for each dimension, postings grouped into segments
of equal quantised value. For a query each segment has an impact: the most its
members can gain in that dimension over the block's least. Segments are taken by
descending impact and added into accumulators. A block is left as soon as it is
proven that at most a few members can still be among the k best, counting what
earlier blocks have given, or when no segment is left; those members are scored
again exactly.

Queries are a stated set of rows; they meet every block, so the work is their
product with the table. Blocks are dealt into strips and queries into lanes; a
task takes one strip and one lane, holds the lane's queries with their k best so
far, and takes the strip's blocks one at a time. There is no join: a block is
copied once a lane, a query once a strip, nothing is broadcast or collected, and
a task gives k rows a query, whatever the number of its blocks.

Defined results
    * null vectors, vectors with null or non-finite components, and rows of null
      id take no part;
    * rows with one id, repeats too, are rows of their own: each is a candidate
      for all others and asks for itself; a row is never its own neighbour;
    * shorter vectors are padded with zeros; where a block's and a query's sums
      could pass 64 bits they are taken in Python's integers, all members of the
      block at once; a component or a score that a long can't hold is an error;
    * ties go to the smaller id; fewer than k others: all of them;
    * only the two named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domsift.llm.common import written

SCALE = 256
#: Rows of a block, and bytes of its vectors as longs, at most.
BLOCK_ROWS, BLOCK_BYTES = 16384, 1 << 23
#: Bytes of queries and their best that a task holds at most; queries that are worth a lane of their own.
LANE_BYTES, LANE_ROWS = 1 << 25, 64
#: Each lane is a copy of the table, each strip one of the queries: strips at most, lanes at most where memory does not ask for more, tasks from which on more lanes are not worth a copy.
STRIPS, LANES, TASKS = 64, 4, 128
LEVEL_BITS = 4
#: Members that are left for exact scoring, at most, when a block is given up early.
RESCORE = 64
#: Scaled components from here on are refused; blocks with components from ``_WIDE`` on are scored without an index.
_REFUSED, _WIDE, _SUM = 1 << 62, 1 << 31, 1 << 61


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """array<long>, or null where the vector takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    def whole(x: Column) -> Column:
        held = F.abs(x.cast("double") * scale) < float(_REFUSED)
        return F.when(held, F.floor(x.cast("double") * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    value = F.transform(vector, whole)
    return F.when(vector.isNotNull() & F.coalesce(usable, F.lit(False)), value)


class Block:
    """Postings of one block, grouped by dimension and quantised value."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, d = vectors.shape
        self.largest = int(np.abs(vectors).max(initial=0))
        if self.largest >= _WIDE:
            return
        self.low = vectors.min(axis=0)
        span = (vectors.max(axis=0) - self.low).astype(np.int64)
        self.shift = np.array([max(0, int(s).bit_length() - LEVEL_BITS) for s in span])
        level = (vectors - self.low) >> self.shift
        self.levels = 1 << LEVEL_BITS
        order = np.argsort(level, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(order.T)
        ordered = np.take_along_axis(level, order, axis=0)
        self.starts = np.stack([np.searchsorted(ordered[:, j], np.arange(self.levels + 1)) for j in range(d)])
        steps = np.arange(self.levels)
        self.least = self.low[:, None] + (steps << self.shift[:, None])
        self.most = np.minimum(self.least + (1 << self.shift[:, None]) - 1, vectors.max(axis=0)[:, None])

    def search(self, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, exact scores) of all members that can be among the k best.

        ``floor``: a score that k others are known to reach; what stays below is left out.
        """
        n, d = self.vectors.shape
        if self.largest >= _WIDE or self.largest * int(np.abs(query).max(initial=0)) * max(1, d) >= _SUM:
            scores = [sum(map(int.__mul__, row, query.tolist())) for row in self.vectors.tolist()]
            return np.arange(n), np.array(scores, dtype=np.int64)
        up = np.maximum(query[:, None] * self.least, query[:, None] * self.most)
        down = np.minimum(query[:, None] * self.least, query[:, None] * self.most)
        filled = self.starts[:, 1:] > self.starts[:, :-1]
        base = np.where(filled, down, np.iinfo(np.int64).max).min(axis=1)
        impact = up - base[:, None]
        slack = int(np.where(filled, up - down, 0).max(axis=1).sum())
        dims, levels = np.nonzero(filled & (query != 0)[:, None])
        order = np.argsort(-impact[dims, levels], kind="stable")
        dims, levels, impacts = dims[order], levels[order], impact[dims, levels][order]
        first, last = self.starts[dims, levels], self.starts[dims, levels + 1]
        active = int((query != 0).sum())
        # a member's impacts so far, times 2^16, plus the number of its dimensions seen
        seen_bits = 16
        total = np.zeros(n, dtype=object if int(impact.max(initial=0)) * max(1, active) >= 1 << 46 else np.int64)
        shift = int(base[query != 0].sum())
        known = None if floor is None else floor - shift
        check = max(16, len(order) // 12)
        alive = np.arange(n)
        for i in range(len(order)):
            if i % check == 0 and i:
                gained, seen = total >> seen_bits, total & ((1 << seen_bits) - 1)
                ceiling = gained + (active - seen) * int(impacts[i])
                bar = known
                if n >= k:
                    kth = int(np.partition(gained, n - k)[n - k]) - slack
                    bar = kth if bar is None else max(bar, kth)
                if bar is not None:
                    alive = np.flatnonzero(ceiling >= bar)
                    if len(alive) <= RESCORE:
                        break
            total[self.postings[dims[i], first[i] : last[i]]] += (int(impacts[i]) << seen_bits) + 1
        else:
            gained = total >> seen_bits
            bar = known
            if n >= k:
                kth = int(np.partition(gained, n - k)[n - k]) - slack
                bar = kth if bar is None else max(bar, kth)
            alive = np.arange(n) if bar is None else np.flatnonzero(gained >= bar)
        return alive, self.vectors[alive] @ query


def _packed(vectors: pa.ListArray, width: int, kind: np.dtype) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=kind)
    out[np.arange(width) < pc.list_value_length(vectors).to_numpy(zero_copy_only=False)[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


class Asked:
    """Some queries of a task, with the k best of the blocks seen so far."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int):
        self.names, self.vectors, self.k = names, vectors, k
        self.count = np.zeros(len(names), dtype=np.int64)
        self.ids = np.zeros((len(names), k), dtype=np.int64)
        self.scores = np.zeros((len(names), k), dtype=np.int64)

    def meet(self, block: Block, ids: np.ndarray) -> None:
        k = self.k
        for i, name in enumerate(self.names[:, 1].tolist()):
            n = int(self.count[i])
            # own vector may be a member: one more than k
            at, score = block.search(self.vectors[i].astype(np.int64), k + 1, int(self.scores[i, -1]) if n == k else None)
            other = ids[at, 1] != name
            found = np.concatenate([self.ids[i, :n], ids[at[other], 0]])
            score = np.concatenate([self.scores[i, :n], score[other]])
            order = np.lexsort((found, -score))[:k]
            self.count[i] = n = len(order)
            self.ids[i, :n], self.scores[i, :n] = found[order], score[order]

    def best(self) -> pa.RecordBatch:
        filled = np.arange(self.k) < self.count[:, None]
        columns = [np.repeat(self.names[:, 1], self.count), np.repeat(self.names[:, 0], self.count), self.ids[filled], self.scores[filled]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best others of each row where ``is_query``."""
    usable = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
    # numbered once the rows lie in files, so that a task run again finds the same numbers
    read = written(usable.where("id is not null and v is not null"), "usable")
    vectors = written(read.withColumn("row", F.monotonically_increasing_id()), "vectors")
    largest = F.greatest(F.array_max("v"), -F.array_min("v"))
    rows, width, most = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(largest), F.lit(0))).first()
    chosen = vectors.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    n_queries = chosen.count()
    kind = np.dtype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))
    blocks = max(1, -(-rows // block_rows))
    strips = min(blocks, STRIPS)
    lane_rows = max(1, LANE_BYTES // (width * kind.itemsize + 16 * (k + 1)))
    lanes = max(1, -(-n_queries // lane_rows), min(LANES, -(-TASKS // strips), -(-n_queries // LANE_ROWS)))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        names = np.stack([group["id"].to_numpy(), group["row"].to_numpy()], axis=1)
        data = _packed(group["v"].chunk(0), width, kind)
        return pa.table({"part": group["part"][:1], "ids": pa.array([names.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    def parted(frame: DataFrame, parts: int) -> DataFrame:
        part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")
        return frame.select("id", "row", "v", part).groupBy("part").applyInArrow(pack, "part int, ids binary, data binary")

    def dealt(packs: DataFrame, asks: bool) -> DataFrame:
        """Blocks to each lane's task of their strip, queries to each strip's task of their lane."""
        own, others = F.col("part") % (lanes if asks else strips), F.explode(F.sequence(F.lit(0), F.lit((strips if asks else lanes) - 1)))
        spread = packs.select("part", "ids", "data", others.alias("other"))
        task = F.col("other") * lanes + own if asks else own * lanes + F.col("other")
        return spread.select(task.cast("int").alias("task"), F.lit(not asks).alias("block"), "part", "ids", "data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if row["task"] != now:
                    yield from (queries.best() for queries in asked)
                    now, asked = row["task"], []
                ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(-1, 2)
                data = np.frombuffer(row["data"], dtype=kind).reshape(len(ids), -1)
                if not row["block"]:
                    asked.append(Asked(ids, data, k))
                    continue
                block = Block(data.astype(np.int64))
                for queries in asked:
                    queries.meet(block, ids)
        yield from (queries.best() for queries in asked)

    index = parted(vectors, blocks)
    # packs of queries that are no larger than blocks
    queries = parted(chosen, lanes * max(1, -(-n_queries // (lanes * block_rows))))
    both = dealt(queries, True).unionByName(dealt(index, False))
    met = both.repartitionById(strips * lanes, "task").sortWithinPartitions("task", "block", "part")
    partial = met.mapInArrow(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
