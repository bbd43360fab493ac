"""Digests flushed by size or by tick, in batch: what ``digest_flush_stream`` sends, without one task per channel.

A channel's digest is sent when ``batch_size`` different domains are pending, and
at ticks ``width`` apart; a digest sent by size starts the ticks anew. So a digest
depends on all before it, through the row that sent the last one by size: its
*anchor*. Between two anchors the rows simply fall into windows of ``width`` from
the first one. The work is to find the anchors:

1. for each row, the row at which ``batch_size`` domains are reached counting from
   it, if that is within ``width`` (two pointers inside a time bucket);
2. from each row that could be an anchor, the next one: windows are walked until a
   window's first row reaches the size before the window ends. A walk that leaves
   its bucket goes on in the channel's next bucket where the size can be reached at
   all, and walks that go on alike are one walk;
3. the rows on the chain that begins at the channel's first row, by pointer doubling.

Tasks hold one (channel, bucket) each, as rows without texts: what a digest shows of
an alert is written beside them and meets the few columns again at the end, in tasks
of at most about ``TEXTS_PER_TASK`` rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domsift.operators.dedup import epoch_micros
from domsift.operators.digest import DEFAULT_BATCH_SIZE, DEFAULT_FLUSH_SECONDS, digest_entry, format_digest
from domsift.operators.scan import BUCKET_SECONDS, bucket_of, look
from domsift.operators.store import stored


#: Rows with their texts that a task handles.
TEXTS_PER_TASK = 25_000


def _reaches(width: int, size: int):
    """Per bucket: each own row with the row at which ``size`` groups are reached within ``width`` (else null)."""

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_bucket", "_pos"], kind="stable", ignore_index=True)
        us, groups, own = pdf["_us"].to_numpy(), pd.factorize(pdf["_g"])[0], int((pdf["_task"] == pdf["_bucket"]).sum())
        ends = np.full(own, -1)
        seen = np.zeros(len(groups) and groups.max() + 1, dtype=np.int64)
        last, different = 0, 0
        for first in range(own):
            while different < size and last < len(us) and us[last] - us[first] < width:
                different += seen[groups[last]] == 0
                seen[groups[last]] += 1
                last += 1
            if different >= size:
                ends[first] = last - 1
            seen[groups[first]] -= 1
            different -= seen[groups[first]] == 0
        out = pdf.loc[: own - 1, ["_c", "_bucket", "_pos", "_us"]].copy()
        for name, col in (("_end_bucket", "_bucket"), ("_end_pos", "_pos"), ("_end_us", "_us")):
            out[name] = pd.Series(np.where(ends >= 0, pdf[col].to_numpy()[ends], 0), dtype="Int64").mask(ends < 0)
        return out

    return reach


def _walks(width: int):
    """Per bucket: each walk (from after row ``_after``, or from time ``_from``) with the next anchor, or where it leaves."""

    def walk(walks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos", kind="stable", ignore_index=True)
        us, never = rows["_us"].to_numpy(), rows["_end_us"].isna().to_numpy()
        end_us = np.where(never, np.iinfo(np.int64).max, rows["_end_us"].fillna(0).to_numpy(dtype=np.int64))
        at = walks["_from"].to_numpy(dtype=np.int64).copy()
        here = np.where(walks["_after"] >= 0, walks["_after"], np.searchsorted(us, at, side="left"))
        found = np.full(len(walks), -1)
        going = np.flatnonzero(here < len(us))
        while len(going):
            row = here[going]
            close = at[going] + ((us[row] - at[going]) // width + 1) * width
            hit = end_us[row] < close
            found[going[hit]] = row[hit]
            going, close = going[~hit], close[~hit]
            at[going] = close
            here[going] = np.searchsorted(us, close, side="left")
            going = going[here[going] < len(us)]
        out = walks[["_c", "_bucket", "_from", "_after"]].copy()
        for name in ("_end_bucket", "_end_pos", "_end_us"):
            out[name] = rows[name].reindex(found).reset_index(drop=True).set_axis(out.index).astype("Int64")
        out["_leaves"] = at
        return out

    return walk


def _anchors(rows: DataFrame, width: int, size: int, bucket: int) -> DataFrame:
    """The rows (``_c``, ``_bucket``, ``_pos``) that send a digest by size.

    ``rows`` is a stored table of ``_c``, ``_us``, ``_g``, ``_bucket`` and ``_pos``.
    """
    task = F.when(F.col("_us") - F.col("_bucket") * bucket < width, F.array(F.col("_bucket"), F.col("_bucket") - 1))
    dealt = rows.select("_c", "_bucket", "_pos", "_us", "_g", F.explode(F.coalesce(task, F.array("_bucket"))).alias("_task"))
    reached = "_c string, _bucket bigint, _pos bigint, _us bigint, _end_bucket bigint, _end_pos bigint, _end_us bigint"
    ends = stored(dealt.groupBy("_c", "_task").applyInPandas(_reaches(width, size), reached), "reached")
    ahead = Window.partitionBy("_c").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    buckets = ends.groupBy("_c", "_bucket").agg(F.max(F.col("_end_us").isNotNull()).alias("_active"), F.min("_us").alias("_first"))
    buckets = stored(
        buckets.withColumn("_next", F.min(F.when(F.col("_active"), F.col("_bucket"))).over(ahead))
        .withColumn("_opens", F.row_number().over(Window.partitionBy("_c").orderBy("_bucket")) == 1),
        "buckets",
    )
    active = ends.join(buckets.where("_active").select("_c", "_bucket"), ["_c", "_bucket"], "left_semi")
    node = lambda b, p: F.struct(F.col(b).alias("b"), F.col(p).alias("p"))
    # walks start after each possible anchor, and before the channel's first row
    possible = ends.where("_end_us is not null").select(
        "_c", F.col("_end_bucket").alias("_bucket"), F.col("_end_us").alias("_from"), F.col("_end_pos").alias("_after")
    )
    opening = buckets.where("_opens").select("_c", "_bucket", F.col("_first").alias("_from"), F.lit(0).cast("bigint").alias("_after"))
    walks = possible.distinct().unionByName(opening).withColumn("a", node("_bucket", "_after"))
    settled = None
    while True:
        # in a bucket where the size can't be reached a walk goes on at once
        place = walks.join(buckets.select("_c", "_bucket", "_active", "_next"), ["_c", "_bucket"])
        goes = ~F.col("_active")
        start = F.col("_next") * bucket
        phase = F.when(F.col("_from") > start, F.col("_from")).otherwise(start - F.pmod(start - F.col("_from"), F.lit(width)))
        walks = place.where("_active or _next is not null").select(
            "_c", "a", F.when(goes, F.col("_next")).otherwise(F.col("_bucket")).alias("_bucket"),
            F.when(goes, phase).otherwise(F.col("_from")).alias("_from"),
            F.when(goes, F.lit(-1)).otherwise(F.col("_after")).cast("bigint").alias("_after"),
        )
        walks = stored(walks, "walks")
        if walks.isEmpty():
            break
        different = walks.select("_c", "_bucket", "_from", "_after").distinct()
        went = "_c string, _bucket bigint, _from bigint, _after bigint, _end_bucket bigint, _end_pos bigint, _end_us bigint, _leaves bigint"
        done = different.groupBy("_c", "_bucket").cogroup(active.groupBy("_c", "_bucket")).applyInPandas(_walks(width), went)
        met = stored(walks.join(done, ["_c", "_bucket", "_from", "_after"]), "met")
        links = met.where("_end_us is not null").select("_c", "a", node("_end_bucket", "_end_pos").alias("b"))
        settled = links if settled is None else settled.unionByName(links)
        # those that left their bucket go on in the next one where the size can be reached
        left = met.where("_end_us is null").join(buckets.select("_c", "_bucket", "_next"), ["_c", "_bucket"]).where("_next is not null")
        start = F.col("_next") * bucket
        phase = F.when(F.col("_leaves") > start, F.col("_leaves")).otherwise(start - F.pmod(start - F.col("_leaves"), F.lit(width)))
        walks = left.select("_c", "a", F.col("_next").alias("_bucket"), phase.alias("_from"), F.lit(-1).cast("bigint").alias("_after"))
    on_chain = opening.select("_c", node("_bucket", "_after").alias("a"))
    if settled is None:
        return on_chain.where("false").select("_c", F.col("a.b").alias("_bucket"), F.col("a.p").alias("_pos"))
    jumps = stored(settled, "jumps")
    while not jumps.isEmpty():
        more = on_chain.join(jumps, ["_c", "a"]).select("_c", F.col("b").alias("a"))
        on_chain = stored(on_chain.unionByName(more).distinct(), "chain")
        then = jumps.select("_c", F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = stored(jumps.join(then, ["_c", "b"]).select("_c", "a", F.col("c").alias("b")), "jumps")
    return on_chain.where("a.p > 0").select("_c", F.col("a.b").alias("_bucket"), F.col("a.p").alias("_pos"))


def digest_flush(
    alerts: DataFrame, channel: str, ts: str = "timestamp", width_seconds: float = DEFAULT_FLUSH_SECONDS,
    batch_size: int = DEFAULT_BATCH_SIZE, order: str | None = None, bucket_seconds: float = BUCKET_SECONDS,
) -> DataFrame:
    """Batch twin of ``digest_flush_stream``: one row per digest, with the stream's columns and ``reason``.

    ``reason`` is ``size``, or ``tick`` for what was pending at a tick (also the
    last of a channel: it is flushed at its tick, as the stream does once the
    watermark gets there).

    Rows are in the order of (``ts``, ``order``, domain). Rows without a time are
    in no digest; rows without a channel are a channel of their own; an empty
    table gives no digest. A channel's rows of one bucket are one task, so
    ``bucket_seconds`` (never below the width) bounds the memory of a busy one.
    """
    if batch_size < 1 or width_seconds <= 0:
        raise ValueError("batch_size and width_seconds must be positive")
    width = max(1, int(round(width_seconds * 1_000_000)))
    bucket = max(width, int(round(bucket_seconds * 1_000_000)))
    entry = digest_entry(ts)
    rows = alerts.select(
        F.col(channel).cast("string").alias("_channel"), epoch_micros(alerts, ts).alias("_us"),
        (F.col(order) if order else F.lit(0)).alias("_order"), F.col("domain").alias("_name"), entry.alias("_entry"),
    ).where("_us is not null")
    rows = rows.withColumn("_c", F.coalesce(F.concat(F.lit("="), "_channel"), F.lit(""))).withColumn("_bucket", bucket_of(F.col("_us"), bucket))
    texts = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "alerts")
    in_bucket = Window.partitionBy("_c", "_bucket").orderBy("_us", "_order", "_name")
    rows = texts.select("_c", "_channel", "_us", "_order", "_name", "_bucket", "_id", F.col("_entry.group").alias("_group"))
    rows = stored(rows.withColumn("_pos", F.row_number().over(in_bucket).cast("bigint")).drop("_order", "_name"), "rows")
    points = rows.select("_c", "_bucket", "_pos", "_us", F.coalesce(F.concat(F.lit("="), "_group"), F.lit("")).alias("_g"))
    sent = stored(_anchors(points, width, batch_size, bucket).withColumn("_cut", F.lit(True)), "anchors")
    first = rows.groupBy("_c").agg(F.min(F.struct("_bucket", "_pos")).alias("_f"))
    opens = first.select("_c", "_f._bucket", "_f._pos", F.lit(True).alias("_opens"))
    marked = rows.join(sent, ["_c", "_bucket", "_pos"], "left").join(opens, ["_c", "_bucket", "_pos"], "left")
    mark = F.struct("_us", "_bucket", F.when(F.col("_cut"), F.col("_pos")).otherwise(F.lit(0).cast("bigint")).alias("_pos"))
    seen = look(
        marked.withColumn("_t", F.col("_us")).withColumn("_b", F.col("_bucket")), ["_c"], F.col("_us"), F.when(F.col("_cut") | F.col("_opens"), mark), "_anchor", ["_pos"],
        bucket_seconds=bucket / 1_000_000,
    )
    seen = seen.withColumnsRenamed({"_t": "_us", "_b": "_bucket"})
    seen = seen.withColumn("_anchor", F.coalesce("_anchor", F.struct("_us", "_bucket", F.lit(0).cast("bigint").alias("_pos"))))
    tick: Column = F.floor((F.col("_us") - F.col("_anchor._us")) / F.lit(width)).cast("bigint")
    key = ["_c", "_channel", "_anchor", "_k"]
    rank = F.struct("_us", "_bucket", "_pos", "_id")
    per_group = seen.withColumn("_k", tick).groupBy(*key, F.col("_group").alias("group")).agg(
        F.min(rank).alias("_first"), (F.count(F.lit(1)) - 1).alias("more"), F.max(F.when(F.col("_cut"), F.col("_us"))).alias("_sent"),
    )
    tasks = max(1, -(-texts.count() // TEXTS_PER_TASK))
    shown = texts.select("_id", "_entry").repartition(tasks, "_id")
    per_group = per_group.withColumn("_id", F.col("_first._id")).repartition(tasks, "_id").join(shown, "_id").repartition(tasks, *key)
    e = F.col("_entry")
    more = F.when(F.col("more") > 0, F.concat(F.lit(" (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    line = F.concat(e["head"], more, e["tail"])
    one = F.struct(F.col("_first"), F.col("group"), F.col("more"), e["alert"].alias("alert"), e["sort_key"].alias("k"), line.alias("line"))
    digests = per_group.groupBy(*key).agg(
        F.array_sort(F.collect_list(one)).alias("_all"), F.max("_sent").alias("_sent"), F.min("_first").alias("_first")
    )
    due = F.col("_anchor._us") + (F.col("_k") + 1) * width
    texts = F.array_sort(F.transform("_all", lambda x: F.struct(x["k"], x["line"])))
    digests = digests.select(
        "_c", "_channel", "_first", "_all",
        F.timestamp_micros(F.coalesce("_sent", due)).alias("flushed_at"),
        F.when(F.col("_sent").isNotNull(), "size").otherwise("tick").alias("reason"),
        format_digest(F.transform(texts, lambda x: x["line"])).alias("text"),
    )
    return _numbered(stored(digests, "digests")).select(
        F.col("_channel").alias("channel"), "batch", "flushed_at", "reason", F.size("_all").cast("bigint").alias("entries"),
        F.col("_all.group").alias("groups"), F.col("_all.more").alias("deduplicated"), F.col("_all.alert").alias("alerts"), "text",
    )


def _numbered(digests: DataFrame) -> DataFrame:
    """Add ``batch``, the digest's number in its channel: counted per bucket, then inside each."""
    digests = digests.withColumn("_bucket", F.col("_first._bucket"))
    before = Window.partitionBy("_c").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = digests.groupBy("_c", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_c", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_c", "_bucket").orderBy("_first")
    return digests.join(counts, ["_c", "_bucket"]).withColumn("batch", (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint"))
