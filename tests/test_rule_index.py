"""Rules as data: the index against the compiled rules, and the pieces a regex surely needs."""

import json
import random
import re

import pytest

from domsift.operators import rule_index
from domsift.operators.rule_index import match_rules_indexed, required_pieces
from domsift.operators.rules import match_rules_table
from domsift.plans import queries

RULES = "file STRING, ord INT, name STRING, expr_json STRING"
PATTERNS = ["pay", "^pay", "login$", "pay|bank", "pay|b", "ba+nk", "ba?nk", "ban{0,2}k", r"shop\.test$", r"^\d+-", "(secure|safe)-bank", "[lm]ogin",
            "(?i)PAY", r"x\.y|pay.*bank", "", "é-pay", r"se(cu)?re", r"pay\+", "[]a]bank", r"\x70ay", "(a|(b[)]c))login"]


@pytest.mark.parametrize(
    "pattern, pieces",
    [
        ("paypal", [["ayp", "pal", "pay", "ypa"]]), ("pay|bank", [["pay"], ["ank", "ban"]]), ("ba+nk", [["ank"]]), ("abba+nkk", [["abb", "ank", "bba", "nkk"]]),
        ("ba?nk", None), ("pay(x|y)?bank", [["ank", "ban", "pay"]]), (r"a\.b\d", [["a.b"]]), ("[abc]de", None), ("(?i)paypal", None),
        ("pay|b", None), (r"\p{Lower}shop", [["hop", "sho"]]), ("login{0,3}", [["log", "ogi"]]), ("x[(|]login", [["gin", "log", "ogi"]]),
    ],
)
def test_required_pieces(pattern, pieces):
    assert required_pieces(pattern) == pieces


def tree(draw, depth=0):
    if depth < 3 and draw.random() < 0.5:
        return {draw.choice(["all", "any"]): [tree(draw, depth + 1) for _ in range(draw.randrange(4))]}
    return {"domain_regex": draw.choice(PATTERNS)}


def test_index_equals_compiled_rules(spark):
    draw = random.Random(11)
    parts = ["pay", "bank", "login", "shop.test", "secure-", "safe-bank", "42-", "bnk", "baank", "é-pay", "x.y", "PAY", "-", "m", "pay+", "]bank", "b)clogin"]
    names = ["".join(draw.choices(parts, k=draw.randrange(4))) for _ in range(150)] + [None, "", "ab", "🙂pay🙂", "pay" * 5000] + ["pay-bank"] * 40
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id INT, domain STRING").repartition(5)
    rows = [("f", i, f"r{i}", json.dumps(tree(draw))) for i in range(120)]
    rules = spark.createDataFrame(rows, RULES)
    key = lambda out: sorted((r.id, r.rule_ord) for r in out.collect())
    assert key(match_rules_indexed(df, rules, salts=3)) == key(match_rules_table(df, rules))


def test_each_piece_is_in_each_match():
    draw = random.Random(3)
    for _ in range(3000):
        pattern = "".join(draw.choices(["a", "b", "c", "ab", "a?", "b+", "(a|b)", "(?:ab)*", "[ab]", "c{1,2}", "|", r"\.", "."], k=draw.randrange(1, 9)))
        branches = required_pieces(pattern)
        for _ in range(20 if branches else 0):
            text = "".join(draw.choices("abc.", k=9))
            if re.search(pattern, text):
                assert any(any(p in text for p in branch) for branch in branches)
                assert any(all(p in text for p in branch) for branch in branches)


@pytest.mark.parametrize("cell", [1, 3, 1000])
def test_short_pieces_and_cells(spark, monkeypatch, cell):
    """A rule of one or two sure letters meets the names that hold them only; cells of any size lose no pair."""
    assert required_pieces(r"^a|b.*cd\.[a-z]+$", 1) == [["a"], ["b", "cd."]] and required_pieces("ba?n", 1) == [["b", "n"]]
    draw = random.Random(5)
    for _ in range(2000):
        pattern = "".join(draw.choices(["a", "b", "c", "a?", "b+", "(a|b)", "[ab]", "c{1,2}", "|", r"\.", "."], k=draw.randrange(1, 9)))
        for text in ["".join(draw.choices("abc.", k=5)) for _ in range(9)]:
            if re.search(pattern, text):
                assert any(all(p in text for p in branch) for branch in required_pieces(pattern, 1) or [[]])
    monkeypatch.setattr(rule_index, "CELL_NAMES", cell)
    monkeypatch.setattr(rule_index, "CELL_RULES", cell)
    names = [None, "", *("".join(draw.choices("abcd.", k=draw.randrange(1, 6))) for _ in range(60)), "ab.cd", "ab.cd"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id INT, domain STRING")
    leaf = lambda: {"domain_regex": draw.choice(["^a", "b", r"c\.", "a.*d", "abc", "", "ab|d", "z"])}
    rows = [("f", i, f"r{i // 2}", json.dumps({draw.choice(["all", "any"]): [leaf() for _ in range(draw.randrange(4))]})) for i in range(40)]
    rules = spark.createDataFrame(rows, RULES)
    key = lambda out: sorted((r.id, r.rule_ord) for r in out.collect())
    assert key(match_rules_indexed(df, rules)) == key(match_rules_table(df, rules))


def test_query_matches_names_not_rows(spark, monkeypatch):
    feed = spark.createDataFrame([(i, n) for i, n in enumerate(["x.abc.com"] * 30 + ["q.net"] * 5 + [None])], "event_id BIGINT, domain STRING")
    rules = spark.createDataFrame([("f", 0, "r", '{"domain_regex": "abc"}'), ("f", 1, "r", '{"all": []}')], RULES)
    met = []
    monkeypatch.setattr(queries.tables, "feed", lambda spark, d: feed)
    monkeypatch.setattr(queries, "_customer_rules", lambda spark, d: rules)
    monkeypatch.setattr(queries, "match_rules_indexed", lambda df, rules: met.append(df.count()) or match_rules_indexed(df, rules))
    got = {(r.domain, r.rule_name, r.n, r.last_id) for r in queries.q_match_rules_indexed(spark, "x").collect()}
    assert got == {("x.abc.com", "r", 60, 29), ("q.net", "r", 5, 34), (None, "r", 1, 35)} and met == [3]


def test_index_of_nothing_and_refusals(spark):
    df = spark.createDataFrame([("a.test", "1")], "domain STRING, rule STRING")
    one = spark.createDataFrame([(None, 0, "n", '{"domain_regex": "a.t"}')] * 2, RULES)
    assert [tuple(r) for r in match_rules_indexed(df, one).collect()] == [("a.test", "1", "n", 0)] * 2
    assert match_rules_indexed(df, one.limit(0)).count() == match_rules_indexed(df.limit(0), one).count() == 0
    with pytest.raises(Exception, match="needs more than the name"):
        match_rules_indexed(df, spark.createDataFrame([("f", 0, "n", '{"asns": [1]}')], RULES)).count()
