"""Detection rules: a boolean tree over the name, its ASNs and its addresses,
compiled once on the driver into one Catalyst expression per rule.

Leaves: ``domain_regex``, ``asns``, ``not_asns``, ``ip_networks``,
``not_ip_networks``; inner nodes ``all`` / ``any`` to any depth.  The tree
has no negation node, so replacing every ASN/IP leaf by ``true`` gives a
necessary condition that can run before the DNS join (predicate pushdown
the optimizer cannot derive from an array of tags).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domsift.functions.dns import all_ips
from domsift.functions.ip import Network, cidr_bounds, ip_in_networks
from domsift.functions.regex import PatternError, check_pattern_local, to_java_regex

NONE, STANDARD = 0, 1  # enrichment levels a rule needs

LEAVES = ("domain_regex", "asns", "not_asns", "ip_networks", "not_ip_networks")
NODES = ("all", "any")

# Custom leaves: name -> (builder(args, ctx) -> Column, level)
_CUSTOM_LEAVES: dict[str, tuple[Callable[[Any, "RuleContext"], Column], int]] = {}


def register_leaf(name: str, builder: Callable[[Any, "RuleContext"], Column], level: int = STANDARD) -> None:
    """Add a rule leaf kind: ``builder(args, ctx)`` returns a boolean Column."""
    _CUSTOM_LEAVES[name] = (builder, level)


@dataclass(frozen=True)
class Expr:
    kind: str
    args: Any  # list[Expr] for nodes; str / list for leaves

    @staticmethod
    def parse(obj: dict) -> "Expr":
        keys = [k for k in obj if k != "name"]
        if len(keys) != 1:
            raise ValueError(f"a rule expression needs exactly one kind, got {keys}")
        kind = keys[0]
        val = obj[kind]
        if kind in NODES:
            return Expr(kind, tuple(Expr.parse(x) for x in (val or [])))
        if kind == "domain_regex":
            return Expr(kind, str(val))
        if kind in ("asns", "not_asns"):
            return Expr(kind, tuple(int(x) for x in (val or [])))
        if kind in ("ip_networks", "not_ip_networks"):
            return Expr(kind, tuple(cidr_bounds(x) for x in (val or [])))
        if kind in _CUSTOM_LEAVES:
            return Expr(kind, val)
        raise ValueError(f"unknown rule expression kind {kind!r}")

    def level(self) -> int:
        if self.kind in NODES:
            return max((e.level() for e in self.args), default=NONE)
        if self.kind == "domain_regex":
            return NONE
        if self.kind in _CUSTOM_LEAVES:
            return _CUSTOM_LEAVES[self.kind][1]
        return STANDARD

    def to_obj(self) -> dict:
        if self.kind in NODES:
            return {self.kind: [e.to_obj() for e in self.args]}
        if self.kind in ("ip_networks", "not_ip_networks"):
            return {self.kind: [n.text for n in self.args]}
        return {self.kind: list(self.args) if isinstance(self.args, tuple) else self.args}


@dataclass(frozen=True)
class Rule:
    name: str
    expr: Expr
    file: str = ""
    ord: int = 0

    @property
    def level(self) -> int:
        return self.expr.level()


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    file_stats: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def from_objects(objs: list[dict], ignore: list[str] | None = None, file: str = "") -> "RuleSet":
        rules = [Rule(str(o["name"]), Expr.parse(o), file, i) for i, o in enumerate(objs)]
        return RuleSet(rules, list(ignore or []), {file: len(rules)} if file else {})

    def by_level(self, level: int) -> list[Rule]:
        return [r for r in self.rules if r.level == level]


@dataclass
class RuleContext:
    domain: Column
    enrichment: Column
    ips: Column
    strict: bool = True


def context(
    domain: str = "domain", enrichment: str = "enrichment", dns: str = "dns", strict: bool = True
) -> RuleContext:
    return RuleContext(F.col(domain), F.col(enrichment), all_ips(dns), strict)


def _regex(pattern: str, ctx: RuleContext) -> Column:
    try:
        java = check_pattern_local(pattern)
    except PatternError:
        if ctx.strict:
            raise
        return F.lit(False)  # an invalid pattern never matches
    return F.coalesce(ctx.domain.rlike(java), F.lit(False))


def _asns(asns: tuple[int, ...], ctx: RuleContext) -> Column:
    if not asns:
        return F.lit(False)
    wanted = [F.lit(a).cast("bigint") for a in asns]
    return F.coalesce(F.exists(ctx.enrichment, lambda e: F.coalesce(e.getField("as_number").isin(*wanted), F.lit(False))), F.lit(False))


def _has_asn(ctx: RuleContext) -> Column:
    return F.coalesce(F.exists(ctx.enrichment, lambda e: e.getField("as_number").isNotNull()), F.lit(False))


def _networks(nets: tuple[Network, ...], ctx: RuleContext) -> Column:
    if not nets:
        return F.lit(False)
    return F.coalesce(F.exists(ctx.ips, lambda ip: ip_in_networks(ip, list(nets))), F.lit(False))


def compile_expr(expr: Expr, ctx: RuleContext, pushdown: bool = False) -> Column:
    """Rule tree -> boolean Column (never null).

    ``pushdown=True`` replaces every leaf that needs enrichment by ``true``:
    the result is a necessary condition evaluable on the bare name.
    """
    k = expr.kind
    if k == "all":
        out = F.lit(True)
        for e in expr.args:
            out = out & compile_expr(e, ctx, pushdown)
        return out
    if k == "any":
        out = F.lit(False)
        for e in expr.args:
            out = out | compile_expr(e, ctx, pushdown)
        return out
    if k == "domain_regex":
        return _regex(expr.args, ctx)
    if pushdown and expr.level() > NONE:
        return F.lit(True)
    if k == "asns":
        return _asns(expr.args, ctx)
    if k == "not_asns":
        return _has_asn(ctx) & ~_asns(expr.args, ctx)
    if k == "ip_networks":
        return _networks(expr.args, ctx)
    if k == "not_ip_networks":
        return (F.size(ctx.ips) > 0) & ~_networks(expr.args, ctx)
    builder, _ = _CUSTOM_LEAVES[k]
    return F.coalesce(builder(expr.args, ctx), F.lit(False))


def rule_column(rule: Rule, ctx: RuleContext | None = None, pushdown: bool = False) -> Column:
    return compile_expr(rule.expr, ctx or context(), pushdown)


def tags_column(rules: list[Rule], ctx: RuleContext | None = None) -> Column:
    """Names of the matching rules, in the given order (duplicates kept)."""
    ctx = ctx or context()
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(rule_column(r, ctx), F.lit(r.name)) for r in rules]))


def prefilter_column(rules: list[Rule], ctx: RuleContext | None = None) -> Column:
    """OR over rules of their necessary conditions on the bare name."""
    ctx = ctx or context()
    out = F.lit(False)
    for r in rules:
        out = out | rule_column(r, ctx, pushdown=True)
    return out


def match_rules(
    df: DataFrame,
    rules: RuleSet | list[Rule],
    ctx: RuleContext | None = None,
    out: str = "source_tag",
    drop_unmatched: bool = True,
) -> DataFrame:
    """Attach ``source_tag``: name-only rules in load order, then enrichment rules.

    Rows that match nothing are dropped unless ``drop_unmatched=False``.
    """
    rule_list = rules.rules if isinstance(rules, RuleSet) else rules
    ordered = [r for r in rule_list if r.level == NONE] + [r for r in rule_list if r.level != NONE]
    res = df.withColumn(out, tags_column(ordered, ctx))
    return res.where(F.size(out) > 0) if drop_unmatched else res


def ignore_filter(df: DataFrame, patterns: list[str], domain: str = "domain", spark: SparkSession | None = None) -> DataFrame:
    """Drop names that match any ignore pattern; an empty list drops nothing.

    Patterns are checked when the filter is built; one bad pattern is an error.
    """
    if not patterns:
        return df
    cond = F.lit(False)
    for p in patterns:
        java = check_pattern_local(p)
        if spark is not None:
            from domsift.functions.regex import check_pattern

            java = check_pattern(spark, p)
        cond = cond | F.coalesce(F.col(domain).rlike(java), F.lit(False))
    return df.where(~cond)


def rules_frame(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The rule set as a table ``(file, ord, name, level, expr_json, pattern)``.

    ``pattern`` is the Java form of a rule that is one ``domain_regex`` (or an
    ``all``/``any`` of exactly one), for the table-driven matcher; else null.
    """
    import json

    rows = []
    for r in rules.rules:
        e = r.expr
        while e.kind in NODES and len(e.args) == 1:
            e = e.args[0]
        pat = to_java_regex(e.args) if e.kind == "domain_regex" else None
        rows.append((r.file, r.ord, r.name, r.level, json.dumps(r.expr.to_obj()), pat))
    return spark.createDataFrame(
        rows, "file STRING, ord INT, name STRING, level INT, expr_json STRING, pattern STRING"
    )


def match_rules_table(
    df: DataFrame,
    rules_df: DataFrame,
    domain: str = "domain",
    rules_per_column: int = 200,
) -> DataFrame:
    """Names matched with a rules *table* of whole rule trees (name-only rules).

    Returns one row per (input row, matching rule): the input columns plus
    ``rule_name`` and ``rule_ord``.  The table is configuration: its trees are
    read once and compiled to expressions, ``rules_per_column`` to an array
    column, so the names are scanned once and no pattern is compiled per row.
    A rule that needs DNS or ASN data raises ``ValueError``; none is left out.
    """
    import json

    ctx = RuleContext(F.col(domain), F.array(), F.array())
    found = []
    for r in rules_df.select("file", "ord", "name", "expr_json").orderBy("file", "ord").collect():
        expr = Expr.parse(json.loads(r.expr_json))
        if expr.level() > NONE:
            raise ValueError(f"rule {r.name!r} needs more than the name; use match_rules")
        hit = F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.ord).alias("rule_ord"))
        found.append(F.when(compile_expr(expr, ctx), hit))
    if not found:
        return df.where(F.lit(False)).withColumns({"rule_name": F.lit(""), "rule_ord": F.lit(0)})
    parts = [F.array_compact(F.array(*found[i : i + rules_per_column])) for i in range(0, len(found), rules_per_column)]
    hits = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.select("*", F.explode(hits).alias("_hit")).select(*df.columns, "_hit.rule_name", "_hit.rule_ord")


def rule_match_counts(df: DataFrame, tags: str = "source_tag") -> DataFrame:
    """Matches per rule name: ``(rule, matches)``."""
    return (
        df.select(F.explode(tags).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).cast("bigint").alias("matches"))
    )


def rule_file_stats(rules_df: DataFrame) -> DataFrame:
    """Rules per file, plus the totals as a ``(file, rules, total_rules, total_files)`` table."""
    per_file = rules_df.groupBy("file").agg(F.count(F.lit(1)).cast("bigint").alias("rules"))
    # one row, by two partial aggregates
    totals = per_file.agg(F.sum("rules").cast("bigint").alias("total_rules"), F.count(F.lit(1)).cast("bigint").alias("total_files"))
    return per_file.crossJoin(F.broadcast(totals)).select("file", "rules", "total_rules", "total_files")
