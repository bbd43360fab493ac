"""Rule sources: YAML rule files and one-regex-per-line pattern files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domsift.operators.rules import Expr, Rule, RuleSet


def load_rules(paths: list[str] | None) -> RuleSet:
    """Concatenate YAML rule files in the given order.

    Each file is ``{ignore: [regex], rules: [{name, <expression>}]}``.  No
    files gives an empty set; a missing file or bad YAML is an error.  This
    is driver-side configuration (a few thousand rules at most), not data.
    """
    import yaml

    out = RuleSet()
    for path in paths or []:
        with open(path, encoding="utf-8") as fh:
            doc = yaml.safe_load(fh.read()) or {}
        if not isinstance(doc, dict):
            raise ValueError(f"rule file {path} must be a mapping")
        rules = doc.get("rules") or []
        for i, obj in enumerate(rules):
            out.rules.append(Rule(str(obj["name"]), Expr.parse(obj), path, i))
        out.file_stats[path] = len(rules)
        out.ignore.extend(str(p) for p in (doc.get("ignore") or []))
    return out


def rules_from_yaml_text(text: str, file: str = "<inline>") -> RuleSet:
    import yaml

    doc = yaml.safe_load(text) or {}
    rules = doc.get("rules") or []
    return RuleSet(
        [Rule(str(o["name"]), Expr.parse(o), file, i) for i, o in enumerate(rules)],
        [str(p) for p in (doc.get("ignore") or [])],
        {file: len(rules)},
    )


def pattern_lines(df: DataFrame, source: str, text: str) -> DataFrame:
    """Text blobs -> one rule per non-blank, non-comment line.

    Output ``(name, line_no, pattern)``: ``name`` is the source's name,
    ``line_no`` the 1-based line, ``pattern`` the trimmed line.  Every line
    of every text is kept; nothing is cut.
    """
    lines = df.select(
        F.col(source).cast("string").alias("name"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"),
    )
    trimmed = lines.select("name", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("pattern"))
    return trimmed.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))


def rules_from_patterns(spark: SparkSession, path_glob: str) -> DataFrame:
    """One-regex-per-line ``*.txt`` files -> rules named after each file's base name."""
    files = spark.read.text(path_glob, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("base"),
        F.col("value"),
    )
    return pattern_lines(files, "base", "value")


def rules_from_pattern_files_local(paths: list[str]) -> RuleSet:
    """Driver-side variant for small pattern files (config, not data)."""
    out = RuleSet()
    for path in paths:
        base = os.path.splitext(os.path.basename(path))[0]
        n = 0
        with open(path, encoding="utf-8") as fh:
            for line in fh:
                t = line.strip()
                if not t or t.startswith("#"):
                    continue
                out.rules.append(Rule(base, Expr("all", (Expr("domain_regex", t),)), path, n))
                n += 1
        out.file_stats[path] = n
    return out
