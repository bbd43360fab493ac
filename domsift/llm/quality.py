r"""Line-first cleaning: rules on every line, then a verdict on what they left.

A text is cut into lines at ``\n``. Each line with a word is tried by the
punctuation, navigation and boilerplate rules below; lines that fail go. A
document is rejected if the figures of its whole text fail (``base_failed``), or
if the lines removed hold more than ``max_loss`` of its word characters.

Line rules (shares of the line's own words)
    * punctuation: no closing mark at its end, or runs of two or more marks
      (``!!``, ``%%%``) on more than three words in ten;
    * navigation: two or more menu separators (``|``, ``»``, ..), one for every
      four words or more;
    * boilerplate: a standing phrase in a line of at most 30 words, a line equal
      to an earlier one, or more than three words in ten that only repeat the
      word before them.

Everything is built from Spark SQL functions on the row itself: no shuffle, and
no Python on the executors. Windows are compared by two independent 64-bit
hashes; a text without equal first hashes is settled by these alone.

Defined results
    * null text: no words, no lines; as an empty one it fails the base rules and
      its cleaned text is empty;
    * null and repeated ids, repeated rows, ties: each row is judged alone;
    * an empty table gives no rows; only the id and the text are read, other
      columns, whatever their names, do not get in the way;
    * texts of any length are taken whole; a row needs about 60 bytes a word
      besides its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MAX_LOSS_PCT = 50
#: A run of marks, or a word that repeats the one before, may stand on so many of ten words.
TENTHS = 3
BOILERPLATE_WORDS = 30

_WORD = r"[^\x20\x09-\x0D]"
_OTHER_SPACE = "\x09\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
#: A closing mark, then at most quotes and brackets; looked for in a line's last characters.
CLOSED, CLOSED_CHARS = r"[.!?:;…。！？]['\"”’»)\]]*\z", 12
MARKS = r"[!?#*$%&|<>=~^_+]{2,}"
SEPARATORS = "|»›•·→"
#: Phrases that stand on pages whatever these are about.
PHRASES = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "copyright ©",
    "©",
    "(c) 19",
    "(c) 20",
    "powered by",
    "sign up for",
    "subscribe to",
    "click here",
    "skip to content",
    "back to top",
    "lorem ipsum",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` puts it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _holds(text: Column, chars: str) -> Column:
    """Whether a text holds one of ``chars``; a byte search, so that most texts are spared a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in chars])


def count_chars(text: Column, chars: str) -> Column:
    return F.when(_holds(text, chars), F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(0)


def words(line: Column) -> Column:
    """The words of a text without line feeds."""
    spaced = F.when(_holds(line, _OTHER_SPACE), F.translate(line, _OTHER_SPACE, "    ")).otherwise(line)
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(_WORD))


def _paired(hashes: Column, step: int) -> Column:
    """Hashes of what begins at i and at i + ``step``, for every i."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def _repeats(hashes: Column) -> Column:
    return F.size(hashes) - F.size(F.array_distinct(hashes))


def repeated_words(tokens: Column) -> Column:
    """How many words stand in windows of eight words that occur twice or more.

    A window that comes again brings five windows of four words that came before,
    so texts with fewer repeats of those are settled first.
    """

    def fours(of_words: Column) -> Column:
        return _bound(_paired(of_words, 1), lambda twos: _paired(twos, 2))

    def covered(eights: Column) -> Column:
        second = _bound(_bound(F.transform(tokens, lambda w: F.xxhash64(F.lit(1), w)), fours), lambda h: _paired(h, 4))
        places = F.sequence(F.lit(0), F.size(eights) - 1)
        keyed = F.zip_with(
            F.arrays_zip(eights.alias("h"), second.alias("g")), places, lambda p, i: F.struct(p["h"].alias("h"), p["g"].alias("g"), i.alias("i"))
        )

        def starts(rows: Column) -> Column:
            def same(row: Column, at: Column) -> Column:
                other = F.get(rows, at)
                return F.coalesce((other["h"] == row["h"]) & (other["g"] == row["g"]), F.lit(False))

            met = F.filter(rows, lambda row, j: F.when(j > 0, same(row, j - 1)).otherwise(False) | same(row, j + 1))
            return F.sort_array(F.transform(met, lambda row: row["i"]))

        return F.aggregate(
            _bound(F.sort_array(keyed), starts),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")),
            lambda acc: acc["n"],
        )

    def settled(of_fours: Column) -> Column:
        whole = _bound(_paired(of_fours, 4), lambda eights: F.when(_repeats(eights) == 0, 0).otherwise(covered(eights)))
        return F.when(_repeats(of_fours) < 5, 0).otherwise(whole)

    return F.when(F.size(tokens) <= WINDOW, 0).otherwise(_bound(_bound(F.transform(tokens, lambda w: F.xxhash64(w)), fours), settled))


def line_fails(line: Column, tokens: Column, menu: Column | None = None) -> Column:
    """Name of the first rule that a line of words ``tokens`` fails, else null.

    ``menu``: whether its document holds a menu separator at all.
    """
    n = F.size(tokens)
    end = F.right(F.rtrim(F.translate(F.right(line, F.lit(CLOSED_CHARS)), _OTHER_SPACE, "    ")), F.lit(CLOSED_CHARS))
    separators = count_chars(line, SEPARATORS)
    echoes = F.size(F.filter(tokens, lambda w, i: F.when(i > 0, F.get(tokens, i - 1) == w).otherwise(False)))
    standing = _bound(
        F.translate(line, _UPPER, _LOWER), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in PHRASES])
    )
    return (
        F.when(~end.rlike(CLOSED) | (10 * F.regexp_count(line, F.lit(MARKS)) > TENTHS * n), "punctuation")
        .when((F.lit(True) if menu is None else menu) & (separators >= 2) & (4 * separators >= n), "navigation")
        .when((n <= BOILERPLATE_WORDS) & standing, "boilerplate")
        .when(10 * (n - F.size(F.array_distinct(tokens))) <= TENTHS * n, None)
        .when(10 * echoes > TENTHS * n, "boilerplate")
    )


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: int = MAX_LOSS_PCT) -> DataFrame:
    """Per row: id, figures of the whole text, base_failed, the lines' fate, cleaned text and ``kept``.

    ``max_loss``: the most of its word characters, in per cent, that a document may lose.
    """
    text = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cut = text.withColumn("_lines", worded_lines(F.col("_text"))).withColumn("_menu", _holds(F.col("_text"), SEPARATORS))
    different = cut.withColumn(
        "_different",
        F.transform(F.array_distinct("_lines"), lambda line: F.struct(line.alias("line"), words(line).alias("words"))),
    )
    tried = different.withColumn(
        "_words",
        F.when(F.size("_different") == F.size("_lines"), F.flatten(F.transform("_different", lambda row: row["words"]))).otherwise(
            F.flatten(F.transform("_lines", words))
        ),
    ).withColumn(
        "_tried",
        F.transform(
            "_different",
            lambda row: F.struct(row["line"].alias("line"), line_fails(row["line"], row["words"], F.col("_menu")).alias("rule")),
        ),
    )

    def failed(rule: str) -> Column:
        return F.size(F.filter("_tried", lambda t: t["rule"] == rule)).cast("long")

    figures = tried.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count_chars(F.col("_text"), _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size("_different")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        failed("punctuation").alias("n_punctuation"),
        failed("navigation").alias("n_navigation"),
        failed("boilerplate").alias("n_boilerplate"),
        F.array_join(F.transform(F.filter("_tried", lambda t: t["rule"].isNull()), lambda t: t["line"]), "\n").alias("cleaned"),
    )
    based = figures.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    )
    left = based.withColumn("left_chars", F.length(F.translate("cleaned", "\x20\x0a" + _OTHER_SPACE, "")).cast("long"))
    lost = 100 * (F.col("word_chars") - F.col("left_chars"))
    return left.withColumn("kept", ~F.col("base_failed") & (lost <= max_loss * F.col("word_chars")))
