import pytest
from pyspark.sql import functions as F

from domsift.functions.regex import PatternError, to_java_regex
from domsift.operators.rules import (
    NONE,
    STANDARD,
    Expr,
    RuleContext,
    compile_expr,
    ignore_filter,
    match_rules,
    match_rules_table,
    rules_frame,
)
from domsift.sources.rules import rules_from_yaml_text

ENR = "array<struct<ip:string,as_number:bigint,as_name:string,country_code:string>>"
DNS = "struct<a_records:array<string>,aaaa_records:array<string>,ns_records:array<string>>"


def _alerts(spark, rows):
    return spark.createDataFrame(rows, f"domain STRING, dns {DNS}, enrichment {ENR}")


def test_levels_follow_the_deepest_leaf():
    rs = rules_from_yaml_text("""
rules:
  - {name: by-name, any: [{domain_regex: shop}, {domain_regex: bank}]}
  - {name: deep, all: [{domain_regex: shop}, {any: [{domain_regex: pay}, {all: [{asns: [64500]}]}]}]}
  - {name: by-net, ip_networks: ["198.51.100.0/24"]}
""")
    assert [r.name for r in rs.by_level(NONE)] == ["by-name"]
    assert {r.name for r in rs.by_level(STANDARD)} == {"deep", "by-net"}


def test_tree_truth_table(spark):
    rs = rules_from_yaml_text(r"""
rules:
  - {name: three-deep, all: [{domain_regex: "^pay"}, {any: [{domain_regex: nope}, {all: [{domain_regex: shop}, {asns: [64500]}]}]}]}
  - {name: one-leaf-fails, all: [{domain_regex: "^pay"}, {domain_regex: bank}, {asns: [64500]}]}
  - {name: none-of-any, any: [{domain_regex: bank}, {asns: [64501, 64502]}]}
  - {name: name-only, any: [{domain_regex: bank}, {domain_regex: "\\.example$"}]}
  - {name: empty-any, any: []}
""")
    df = _alerts(spark, [("pay-shop.example", (["198.51.100.7"], [], []), [("198.51.100.7", 64500, "NETWORK", "NO")])])
    assert match_rules(df, rs).select("source_tag").first()[0] == ["name-only", "three-deep"]


def test_rules_table_takes_whole_trees(spark):
    names = rules_from_yaml_text(r"""
rules:
  - {name: either, any: [{domain_regex: "^a"}, {domain_regex: "z$"}]}
  - {name: both, all: [{domain_regex: "^a"}, {domain_regex: "z$"}]}
""")
    df = spark.createDataFrame([("az",), ("ab",), ("bz",), ("bb",), (None,)], "domain STRING")
    for chunk in (1, 200):
        got = match_rules_table(df, rules_frame(spark, names), rules_per_column=chunk).select("domain", "rule_name").collect()
        assert sorted(map(tuple, got)) == [("ab", "either"), ("az", "both"), ("az", "either"), ("bz", "either")]
    needs_asn = rules_from_yaml_text("rules: [{name: n, asns: [1]}]")
    with pytest.raises(ValueError, match="needs more"):
        match_rules_table(df, rules_frame(spark, needs_asn))


def test_posix_classes_and_lenient_patterns(spark):
    df = spark.createDataFrame([("123",), ("abc",), ("a-1",)], "domain STRING")
    hits = lambda p, strict=True: [r[0] for r in df.where(compile_expr(Expr("domain_regex", p), context_of(strict))).collect()]
    assert hits("^[[:digit:]]+$") == ["123"]
    assert hits("^[[:alpha:]_]+$") == ["abc"]
    assert hits("^[^[:digit:]]+$") == ["abc"]
    assert hits(r"^\p{L}+$") == ["abc"]
    with pytest.raises(PatternError):
        hits("(")
    assert hits("(", strict=False) == []
    with pytest.raises(PatternError):
        to_java_regex("[[:nothing:]]")


def context_of(strict):
    return RuleContext(F.col("domain"), F.array(), F.array(), strict)


def test_not_rules_need_enrichment(spark):
    rs = rules_from_yaml_text("""
rules:
  - name: not-asn
    not_asns: [1]
  - name: not-net
    not_ip_networks: ["10.0.0.0/8"]
""")
    no_asn = _alerts(spark, [("a.com", ([], [], []), [])])
    assert match_rules(no_asn, rs).count() == 0
    failed = _alerts(spark, [("a.com", (["1.2.3.4"], [], []), [("1.2.3.4", None, None, None)])])
    assert match_rules(failed, rs).select("source_tag").first()[0] == ["not-net"]
    inside = _alerts(spark, [("a.com", (["10.1.2.3"], [], []), [("10.1.2.3", 1, "A", "US")])])
    assert match_rules(inside, rs).count() == 0


def test_ip_networks_and_empty_lists(spark):
    rs = rules_from_yaml_text("""
rules:
  - name: v6
    ip_networks: ["2001:db8::/32"]
  - name: v4host
    ip_networks: ["192.168.1.77/24"]
  - name: none
    asns: []
  - name: all-empty
    all: []
""")
    df = _alerts(spark, [("a.com", (["192.168.1.5"], ["2001:db8::1"], []), [])])
    assert match_rules(df, rs).select("source_tag").first()[0] == ["all-empty", "v6", "v4host"]


def test_ignore_filter(spark):
    df = spark.createDataFrame([("sub.ignored.com",), ("exact-ignore.net",), ("safe-domain.com",)], "domain STRING")
    kept = ignore_filter(df, [r"\.ignored\.com$", "exact-ignore.net"], spark=spark)
    assert [r.domain for r in kept.collect()] == ["safe-domain.com"]
    assert ignore_filter(df, []).count() == 3
    with pytest.raises(PatternError):
        ignore_filter(df, ["("])


def test_regex_dialect(spark):
    df = spark.createDataFrame([("a.com\n",), ("a.com",), ("a\rb",)], "d STRING")
    end = to_java_regex("com$")
    assert [r.d for r in df.where(F.col("d").rlike(end)).collect()] == ["a.com"]
    assert df.where(F.col("d").rlike(to_java_regex("^a.b$"))).count() == 1  # '.' matches '\r'
    assert to_java_regex("(?P<x>a)").startswith("(?d)(?<x>")
    for bad in [r"(a)\1", "(?=a)", "(?<!a)b"]:
        with pytest.raises(PatternError):
            to_java_regex(bad)
