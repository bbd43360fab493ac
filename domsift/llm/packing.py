"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents longer than a sequence are cut into whole sequences and one rest. The
pieces are dealt at random over shards of a bounded number of tokens. In each
shard a piece goes where the sum over gaps of (open sequences with that gap)
squared becomes smallest, a new sequence being one of the choices. Longest first,
the rule leaves two or three part-filled sequences of the 2,000 in a shard, so
nothing is packed across shards.

Defined results
    * null text: as an empty one; every document ends with ``end_id``, so an
      empty one is a piece of one token;
    * null and repeated ids, repeated rows: each row is packed on its own;
    * ties between gaps: the smaller gap wins; equal lengths go in the order of
      id, piece and checksum; an empty table gives no rows;
    * only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.llm.common import written
from domsift.llm.token_counts import default_tokenizer
from domsift.llm.wordbpe import WordIds

CAPACITY = 4096
#: What one task packs at a time, in tokens and in pieces (whichever is reached first).
SHARD_TOKENS = 8_000_000
SHARD_PIECES = 200_000

_IDS: dict = {}


def _ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def tokenise(
    df: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids_crc32 [, ids]."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ids(path)
        for batch in batches:
            rows, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = encoder.ids(value.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the given order.

    ``open_at[g]`` counts the open bins of gap g. Moving a bin from gap g to
    g - s changes the sum of squares by 2 (open_at[g-s] - open_at[g]) + 2, or by
    1 - 2 open_at[g] when it fills the bin; a new bin by 2 open_at[capacity-s] + 1.
    """
    open_at = np.zeros(capacity + 1, dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(open_at[s:]) + s  # open bins that the item fits into
        gap, best = capacity, (2 * open_at[capacity - s] + 1 if s < capacity else 0)
        if len(gaps):
            change = 2 * (open_at[gaps - s] - open_at[gaps]) + 2
            if gaps[0] == s:
                change[0] = 1 - 2 * open_at[s]
            k = int(change.argmin())
            if change[k] <= best:
                gap = int(gaps[k])
                open_at[gap] -= 1
        if gap == capacity and not (len(gaps) and gaps[-1] == capacity):
            target, made = made, made + 1
        else:
            target = waiting[gap].pop()
        bins[i], offsets[i] = target, capacity - gap
        if gap > s:
            open_at[gap - s] += 1
            waiting[gap - s].append(target)
    return bins, offsets


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", **tokenise_options) -> DataFrame:
    """One row per piece: its columns from ``tokenise`` plus sequence_id and offset."""
    pieces = written(tokenise(df, capacity=capacity, id_col=id_col, **tokenise_options), "pieces")
    tokens, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-tokens // SHARD_TOKENS), -(-rows // SHARD_PIECES))
    # by place in the written table: also a row that repeats without end is dealt over all shards
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.drop_columns("_shard")
        order = [("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        group = group.sort_by(order)
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        sequence = pa.array((key[0].as_py() << 32) + bins, pa.int64())
        return group.append_column("sequence_id", sequence).append_column("offset", pa.array(offsets, pa.int64()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("_shard").applyInArrow(run, f"{columns}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (``with_ids=True``): sequence_id, ids, doc starts.

    A group is one sequence, so it never holds more than the capacity.
    """
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return whole.select(
        "sequence_id",
        F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"),
        F.transform("_parts", lambda p: p["offset"]).alias("starts"),
    )
