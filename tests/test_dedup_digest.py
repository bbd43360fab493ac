import datetime as dt
import random

from pyspark.sql import functions as F

from domsift.functions.text import format_digest_line, format_plain
from domsift.operators.dedup import dedup_key, suppress_repeats
from domsift.operators.digest import digest_batches, digest_sort_key
from domsift.operators.suffix import registrable_domains

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
ENR = "array<struct<ip:string,as_number:bigint,as_name:string,country_code:string>>"
DNS = "struct<a_records:array<string>,aaaa_records:array<string>,ns_records:array<string>>"


def test_registrable_domain(spark):
    sfx = spark.createDataFrame([(r,) for r in ["com", "us", "net", "*.ck", "!www.ck", "co.uk"]], "rule STRING")
    names = ["example.com", "sub.example.com", "a.b.example.co.uk", "x.y.ck", "www.ck", "no-dots",
             "a.b.c.com-d.us", "z.another.net", "foo.unlisted"]
    got = {r.domain: r.base_domain for r in registrable_domains(
        spark.createDataFrame([(n,) for n in names], "domain STRING"), sfx).collect()}
    assert got == {"example.com": "example.com", "sub.example.com": "example.com", "a.b.example.co.uk": "example.co.uk",
                   "x.y.ck": "x.y.ck", "www.ck": "www.ck", "no-dots": None,
                   "a.b.c.com-d.us": "com-d.us",
                   "z.another.net": "another.net", "foo.unlisted": "foo.unlisted"}


def test_repeat_pairs(spark):
    """A later alert repeats an earlier one exactly if their keys agree by the rule."""
    kinds = [(d, t, f) for d in ("shop.test", "www.shop.test", "shop.invalid") for t in (["b", "a"], ["a", "b"], ["c"]) for f in (False, True)]

    def rule(kind):  # standard: registrable domain and tag set; first resolution: full name and tag set
        domain, tags, first = kind
        return (domain if first else ".".join(domain.split(".")[-2:]), tuple(sorted(tags)), first)

    pairs = [(a, b) for a in kinds for b in kinds]
    rows = []
    for i, pair in enumerate(pairs):
        for j, (d, tags, fr) in enumerate(pair):
            rows.append((i, j, d, ".".join(d.split(".")[-2:]), tags, fr, T0 + dt.timedelta(seconds=j)))
    df = spark.createDataFrame(rows, "pair INT, j INT, domain STRING, base_domain STRING, source_tag ARRAY<STRING>, "
                                     "resolved_after_nxdomain BOOLEAN, ts TIMESTAMP")
    keyed = df.withColumn("k", F.concat_ws("#", F.col("pair").cast("string"), dedup_key()))
    out = {(r.pair, r.j): r.passed for r in suppress_repeats(keyed, "k", "ts", 3600, order="j").collect()}
    for i, (a, b) in enumerate(pairs):
        assert out[(i, 0)] is True
        assert out[(i, 1)] is (rule(a) != rule(b)), (a, b)


def test_rows_without_a_time_hold_nothing_back(spark):
    rows = [(0, "k", None), (1, "k", T0), (2, "k", T0 + dt.timedelta(seconds=1)), (3, "k", None)]
    got = {r.id: r.passed for r in suppress_repeats(spark.createDataFrame(rows, "id INT, k STRING, ts TIMESTAMP"), "k", "ts", 50, order="id").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


def test_suppress_matches_greedy_loop(spark):
    rnd = random.Random(11)
    rows = [(i, f"k{rnd.randrange(4)}", T0 + dt.timedelta(seconds=rnd.randrange(0, 2000))) for i in range(400)]
    df = spark.createDataFrame(rows, "id INT, k STRING, ts TIMESTAMP")
    got = {r.id: r.passed for r in suppress_repeats(df, "k", "ts", 50, order="id").collect()}
    last = {}
    for i, k, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        ok = k not in last or ts >= last[k] + dt.timedelta(seconds=50)
        if ok:
            last[k] = ts
        assert got[i] is ok


def _agg_rows(spark, rows):
    return spark.createDataFrame(rows, f"base_domain STRING, deduplicated_count BIGINT, domain STRING, "
                                       f"source_tag ARRAY<STRING>, dns {DNS}, enrichment {ENR}")


# fixed values: the links a digest line is made of
SITE = "<https://urlscan.io/search/#page.{kind}%3A{query}|{text}>"
LOOKUPS = "(<https://www.shodan.io/search?query={kind}%3A{value}|shodan>|<https://www.virustotal.com/gui/{section}/{value}|vt>)"


def test_digest_line(spark):
    ips = ["203.0.113.9", "203.0.113.10", "198.51.100.1", "198.51.100.2"]
    full = ("shop.test", 2, "a.shop.test", ["one", "two"], (ips, [], []), [(ips[0], 64500, "NETWORK", "NO")])
    unnamed = ("bank.test", 0, "bank.test", ["one"], (ips[:1], [], []), [(ips[0], 64500, None, None)])
    bare = ("none.test", 0, "none.test", ["one"], ([], [], ["ns.none.test"]), [])
    line = {r.domain: r.line for r in _agg_rows(spark, [full, unnamed, bare]).select("domain", format_digest_line().alias("line")).collect()}
    host = lambda base, name: SITE.format(kind="domain", query=base, text=name)
    names = lambda base: LOOKUPS.format(kind="hostname", value=base, section="domain")
    assert line["none.test"] == "[one] " + host("none.test", "none.test") + names("none.test")
    query = "(" + "%20OR%20".join(f"%22{ip}%22" for ip in ips[:3]) + ")"
    at = SITE.format(kind="ip", query=query, text=ips[0] + " (+3 more)") + " " + LOOKUPS.format(kind="ip", value=ips[0], section="ip-address")
    assert line["a.shop.test"] == (
        "[one, two] " + host("shop.test", "a.shop.test") + " (+2 more)" + names("shop.test") + " | " + at + " @ 64500/NETWORK, NO")
    assert line["bank.test"] is not None and " @ 64500/, " in line["bank.test"]


def test_digest_lines_in_order_and_batches_of_size(spark):
    """Each part of the sort key decides once: the registrable domain, the folded name, the AS name, missing ones last."""
    def row(i, name, base, as_name="", number=7):
        enrichment = [] if as_name == "" else [("198.51.100.4", number, as_name, None)]
        return (i, T0 + dt.timedelta(seconds=90 - i), name, base, ["feed"], (["198.51.100.4"], [], []), enrichment)
    given = [
        row(0, "solo", None, "zeta"), row(1, "Solo", None, "Alpha"),          # equal but for case: the AS name decides
        row(2, "shop.kiwi.test", "kiwi.test", "m"), row(3, "shop.apple.test", "apple.test", "z"),
        row(4, "mango", None), row(5, "mango", None, "nu", None),               # no AS name, or one without a number
        row(6, "berry", None, "omega"),
    ]
    schema = f"id INT, timestamp TIMESTAMP, domain STRING, base_domain STRING, source_tag ARRAY<STRING>, dns {DNS}, enrichment {ENR}"
    df = spark.createDataFrame(given, schema)
    keyed = df.withColumn("place", digest_sort_key(F.struct("base_domain", "domain", "enrichment")))
    assert [r.id for r in keyed.orderBy("place", "id").collect()] == [3, 2, 6, 4, 5, 1, 0]
    one = digest_batches(df, "timestamp", 300, order="id").collect()
    lines = [line for r in one for line in r.text.removeprefix("```\n").removesuffix("\n```").split("\n")]
    assert [sum(name in line for line in lines) for name in ("apple.test", "kiwi.test", "berry", "mango")] == [1, 1, 1, 1]
    assert sum(r.entries for r in one) == len(lines) == 6
    # in order of arrival (the latest id first), two registrable domains a digest
    cut = sorted(digest_batches(df, "timestamp", 300, batch_size=2, order="id").collect(), key=lambda r: (r.window_start, r.batch))
    assert [r.entries for r in cut] == [2, 2, 2]
    assert "berry" in cut[0].text and "mango" in cut[0].text and "(+1 more)" in cut[0].text


def test_plain_line(spark):
    rows = [("example.com", ["watch"], (["192.0.2.1", "192.0.2.2"], ["2001:db8::1"], []),
             [("192.0.2.1", 64500, "NETWORK", "US")], T0),
            ("example.com", ["watch"], (["192.0.2.1", "192.0.2.2"], ["2001:db8::1"], []), [], T0),
            ("example.com", ["watch"], ([], [], []), [], T0)]
    df = spark.createDataFrame(rows, f"domain STRING, source_tag ARRAY<STRING>, dns {DNS}, enrichment {ENR}, timestamp TIMESTAMP")
    out = [r.l for r in df.select(format_plain().alias("l")).collect()]
    assert out[0].startswith("[watch] example.com -> 192.0.2.1 [US, 64500, NETWORK] (+2 other IPs) [2024-01-01T12:00:00")
    assert out[1].startswith("[watch] example.com -> 192.0.2.1 [No enrichment data] (+2 other IPs)")
    assert out[2].startswith("[watch] example.com ->") and out[2].endswith("]")
