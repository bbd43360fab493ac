"""Rules as data: a table of whole rule trees matched through an index of required pieces of a few letters.

``match_rules`` compiles a rule set into the plan. Here rules stay rows: the plan
is the same for any rules and none is collected.

1. A rule's *branches*: whatever name the rule matches holds a piece of at least one
   branch (a regex gives one branch for each of its alternatives, ``any`` those of
   all its children, ``all`` those of its most selective child). Pieces have three
   letters; a literal of one or two letters is a piece too. The rarest piece of each
   branch, by a count over the names, is the branch's key.
2. Names and rules meet in an equi-join on these pieces. Rules without a piece that
   is surely there have the empty piece, which every name holds. A piece that many
   names hold or many rules ask for is cut into cells of bounded numbers of both;
   others are one cell, so a rule is not repeated for names that don't hold it.
3. The whole tree is checked on the names so found.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domsift.functions.regex import to_java_regex
from domsift.operators.rules import NODES, NONE, Expr
from domsift.operators.scan import join_null_safe
from domsift.operators.store import stored

PIECE = 3
#: Names and rules of one cell of a piece.
CELL_NAMES, CELL_RULES = 1_000, 10_000
_COMPILED = (
    "file string, ord int, rule_name string, branches array<array<string>>, patterns array<string>, program array<struct<op: string, n: int>>"
)


def _closing(java: str, i: int) -> int:
    """The place after the class or group that opens at ``i``."""
    depth, n = 0, len(java)
    while i < n:
        ch = java[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            i += 2 if java.startswith("[^", i) else 1
            first = i
            while i < n and (java[i] != "]" or i == first):
                i += 2 if java[i] == "\\" else 1
            if not depth:
                return i + 1
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return n


def required_pieces(java: str, least: int = PIECE) -> list[list[str]] | None:
    """For each top-level alternative of a regex, the pieces that all its matches hold; None if one has none.

    Literals shorter than ``PIECE``, but not than ``least``, are pieces as a whole.

    Only what is surely literal counts: groups, classes, escapes that stand for
    more than a character, and characters with a quantifier are left out. A
    regex with flags or other special groups has no sure piece.
    """
    special = java.replace("\\\\", "")
    if "\\Q" in special or any(not part.startswith(":") for part in special.split("(?")[1:]):
        return None
    branches, runs, run, i = [], [], "", 0
    while i <= len(java):
        ch = java[i] if i < len(java) else "|"
        literal, after = None, i + 1
        if ch in "([":
            after = _closing(java, i)
        elif ch == "\\" and i + 1 < len(java):
            after = i + 2
            if not java[i + 1].isalnum():
                literal = java[i + 1]
            elif java[after : after + 1] == "{":
                after = java.find("}", after) + 1 or len(java)
            elif java[i + 1] in "xu0c":  # a character by its number
                return None
        elif ch not in ".^$|)]?*+{}":
            literal = ch
        quantifier = java[after : after + 1]
        if literal is not None and (not quantifier or quantifier not in "?*+{"):
            run += literal
        else:
            runs.append(run + literal if literal is not None and quantifier == "+" else run)
            run = literal if literal is not None and quantifier == "+" else ""
        while after < len(java) and java[after] in "?*+{":
            after = java.find("}", after) + 1 or len(java) if java[after] == "{" else after + 1
        if ch == "|":
            runs.append(run)
            pieces = sorted({r[k : k + PIECE] for r in runs if len(r) >= least for k in range(max(1, len(r) - PIECE + 1))})
            if not pieces:
                return None
            branches.append(pieces)
            runs, run = [], ""
        i = after
    return branches


def _branches(expr: Expr) -> list[list[str]] | None:
    if expr.kind == "domain_regex":
        return required_pieces(to_java_regex(expr.args), 1)
    of = [_branches(e) for e in expr.args]
    if expr.kind == "any":
        return None if None in of else [b for branches in of for b in branches]
    sure = [b for b in of if b is not None]
    # fewest branches whose longest pieces are longest, then the most pieces to choose from
    shortest = lambda b: min((max(map(len, pieces)) for pieces in b), default=0)
    return min(sure, key=lambda b: (-min(shortest(b), PIECE) if b else -PIECE, len(b), -min(map(len, b), default=0))) if sure else None


def _program(expr: Expr, patterns: list[str]) -> list[dict]:
    """The tree in postfix order; its patterns are appended to ``patterns``."""
    if expr.kind in NODES:
        return [step for e in expr.args for step in _program(e, patterns)] + [{"op": expr.kind, "n": len(expr.args)}]
    patterns.append(to_java_regex(expr.args))
    return [{"op": "leaf", "n": len(patterns) - 1}]


def _compile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file, ord_, name, text in batch.itertuples(index=False):
            expr = Expr.parse(json.loads(text))
            if expr.level() > NONE:
                raise ValueError(f"rule {name!r} needs more than the name; use match_rules")
            patterns: list[str] = []
            program = _program(expr, patterns)
            rows.append((file, ord_, name, _branches(expr), patterns, program))
        yield pd.DataFrame(rows, columns=["file", "ord", "rule_name", "branches", "patterns", "program"])


def _holds(program: Column, name: Column, patterns: Column) -> Column:
    """A postfix tree on a name; each leaf's pattern is tried where its step is."""

    def leaf(s: Column) -> Column:
        return F.coalesce(F.rlike(name, F.get(patterns, s["n"])), F.lit(False))

    def step(stack: Column, s: Column) -> Column:
        rest, top = F.size(stack) - s["n"], F.slice(stack, F.size(stack) - s["n"] + 1, s["n"])
        joined = F.when(s["op"] == "all", F.forall(top, lambda x: x)).otherwise(F.exists(top, lambda x: x))
        below = F.slice(stack, F.lit(1), rest)
        return F.when(s["op"] == "leaf", F.concat(stack, F.array(leaf(s)))).otherwise(F.concat(below, F.array(joined)))

    return F.aggregate(program, F.array().cast("array<boolean>"), step, lambda stack: F.get(stack, F.lit(0)))


def _pieces(name: Column) -> Column:
    """The different pieces of a name of up to ``PIECE`` letters, the empty one among them."""
    letters = F.split(name, "")
    of = lambda n: lambda i: F.concat(*[F.get(letters, i + k) for k in range(n)])
    pieces = [F.array(F.lit(""))]
    for n in range(1, PIECE + 1):
        places = F.sequence(F.lit(0), F.size(letters) - n)
        pieces.append(F.when((F.size(letters) >= n) & (name != ""), F.transform(places, of(n))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*pieces))


def match_rules_indexed(df: DataFrame, rules_df: DataFrame, domain: str = "domain", salts: int | None = None) -> DataFrame:
    """Names matched with a rules table (``file``, ``ord``, ``name``, ``expr_json``) of any size; rows as ``match_rules_table``.

    One row per input row and matching rule: the input columns, ``rule_name`` and
    ``rule_ord``. Repeated rules match once each; no rules or no names give no
    rows; a null name matches only a rule that asks for nothing (``all: []``).
    A rule that needs DNS or ASN data, or a pattern that doesn't compile, fails
    the job. ``salts``: over how many parts each piece's names are spread (default: by
    their number).
    """
    spark = df.sparkSession
    given = rules_df.select("file", F.col("ord").cast("int").alias("ord"), F.col("name").alias("rule_name"), "expr_json")
    # a small file, but dear rows: spread first
    given = given.repartition(spark.sparkContext.defaultParallelism)
    rules = stored(given.mapInPandas(_compile, _COMPILED).withColumn("_rule", F.monotonically_increasing_id()), "rules")
    names = stored(df.select(F.col(domain).alias("_name")).distinct(), "names")
    asked = rules.select("_rule", F.posexplode(F.coalesce("branches", F.array(F.array(F.lit(""))))).alias("_branch", "_any"))
    asked = asked.select("_rule", "_branch", F.explode("_any").alias("_piece"))
    wanted = stored(asked.select("_piece").distinct(), "pieces")
    held = names.select("_name", F.explode(_pieces(F.col("_name"))).alias("_piece"))
    held = stored(held.join(wanted, "_piece", "left_semi"), "held")
    common = stored(held.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")), "common")
    # a key that no name holds matches nothing, so rarest first and those at once away
    rare = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_piece").alias("piece"))
    keys = asked.join(common, "_piece", "left").groupBy("_rule", "_branch").agg(F.min(rare).alias("_r")).where("_r.n > 0")
    keys = stored(keys.select("_rule", F.col("_r.piece").alias("_piece")).distinct(), "keys")
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("bigint")
    cells = keys.groupBy("_piece").agg(F.count(F.lit(1)).alias("_m")).join(common, "_piece")
    name_parts = F.lit(salts).cast("bigint") if salts else parts("_n", CELL_NAMES)
    cells = stored(cells.select("_piece", name_parts.alias("_names"), parts("_m", CELL_RULES).alias("_rules")), "cells")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    by_name = held.join(cells, "_piece").select("_piece", "_name", dealt("_name", "_names").alias("_u"), each("_rules").alias("_v"))
    by_rule = keys.join(cells, "_piece").select("_piece", "_rule", each("_names").alias("_u"), dealt("_rule", "_rules").alias("_v"))
    met = by_name.join(by_rule, ["_piece", "_u", "_v"]).select("_name", "_rule").distinct()
    tried = met.join(rules.select("_rule", "rule_name", F.col("ord").alias("rule_ord"), "patterns", "program"), "_rule")
    right = tried.where(_holds(F.col("program"), F.col("_name"), F.col("patterns")))
    matches = right.select(F.col("_name").alias(domain), "rule_name", "rule_ord")
    return join_null_safe(df, matches, [domain], "inner").select(*df.columns, "rule_name", "rule_ord")
