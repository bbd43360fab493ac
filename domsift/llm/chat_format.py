r"""Chat transcripts as marked text, proven reversible by parsing it again.

A turn is rendered as ``<s>`` role ``[INST]`` text ``[/INST]</s>``. The parser
is the grammar read backwards: split at ``</s>``, then one fixed pattern per
turn. A transcript is first rendered as it is; where the parser does not give
back the very turns that went in, its roles and texts are escaped and it is
rendered again.

Escaping puts one backslash after the opening character of a control string,
also when backslashes already stand there (``</s>`` -> ``<\/s>`` ->
``<\\/s>``); the parser takes one away. Opening characters occur nowhere else
in a control string, so no text can form one together with a marker.

Everything is built from Spark SQL functions; no Python runs on the executors.

Defined results
    * null text or role: empty string; null turn number: sorts first;
    * rows of equal turn are ordered by role, then text; repeated rows are
      turns of their own; a null ``conv_id`` is a transcript of its own;
    * an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE, TEXT_OPEN, TEXT_CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"/?s>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*(?:{_CONTROL}))"
_UNESCAPE = rf"([<\[])\\(\\*(?:{_CONTROL}))"
_TURN = r"(?s)^<s>(.*?)\[INST\](.*)\[/INST\]$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def render(turns: Column, escaped: bool) -> Column:
    """array<struct<role, text>> -> marked text."""
    safe = escape if escaped else (lambda c: c)
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(F.lit(TURN_OPEN), safe(t["role"]), F.lit(TEXT_OPEN), safe(t["text"]), F.lit(TEXT_CLOSE + TURN_CLOSE)),
        ),
        "",
    )


def segments(formatted: Column) -> Column:
    """Marked text -> the turns' marked strings, each without its closing marker."""
    pieces = F.split(formatted, TURN_CLOSE, -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def parse(formatted: Column) -> Column:
    """Marked text -> array<struct<role, text>>, unescaped."""
    return F.transform(
        segments(formatted),
        lambda s: F.struct(
            unescape(F.regexp_extract(s, _TURN, 1)).alias("role"),
            unescape(F.regexp_extract(s, _TURN, 2)).alias("text"),
        ),
    )


def loss_mask(formatted: Column, learned_role: str = "assistant") -> Column:
    """Runs over the marked text in order: array<struct<n_chars, learn>>.

    Only the (still escaped) text of ``learned_role`` turns is learned. Runs
    instead of offsets, so that the mask grows in line with the turns.
    """

    def runs(s: Column) -> Column:
        text = F.regexp_extract(s, _TURN, 2)
        role = unescape(F.regexp_extract(s, _TURN, 1))
        after = F.lit(len(TEXT_CLOSE + TURN_CLOSE))
        before = F.length(s) + len(TURN_CLOSE) - F.length(text) - after
        return F.array(
            F.struct(before.alias("n_chars"), F.lit(False).alias("learn")),
            F.struct(F.length(text).alias("n_chars"), (role == learned_role).alias("learn")),
            F.struct(after.alias("n_chars"), F.lit(False).alias("learn")),
        )

    return F.flatten(F.transform(segments(formatted), runs))


def format_chats(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> one row per conversation.

    Columns: conv_id, formatted, escaped (whether texts had to be escaped),
    identical (whether the parser gives back the source), turns (as parsed from
    ``formatted``) and loss_mask.
    """
    row = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    source = F.transform("_rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = whole.select("conv_id", source.alias("_source")).withColumn("_plain", render(F.col("_source"), escaped=False))
    tried = plain.withColumn("escaped", ~(parse(F.col("_plain")) == F.col("_source")))
    formatted = tried.withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("_source"), escaped=True)).otherwise(F.col("_plain"))
    )
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    return parsed.select(
        "conv_id",
        "formatted",
        "escaped",
        (F.col("turns") == F.col("_source")).alias("identical"),
        "turns",
        loss_mask(F.col("formatted")).alias("loss_mask"),
    )


def learned_text(formatted: Column, mask: Column) -> Column:
    """The text under the mask's learned runs, unescaped: each run once, in order.

    A turn has three runs of the mask (before, text, after), so a text is cut
    out of its own turn's string and long transcripts are read once.
    """

    def under(s: Column, i: Column) -> Column:
        before, text = F.get(mask, i * 3), F.get(mask, i * 3 + 1)
        cut = F.substring(s, before["n_chars"] + 1, text["n_chars"])
        return F.when(text["learn"], unescape(cut)).otherwise(F.lit(""))

    return F.array_join(F.transform(segments(formatted), under), "")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the marked text; the learned text through the loss mask."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = learned_text(F.col("formatted"), F.col("loss_mask"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )
