import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from domsift.functions.ip import ip_key, ip_version
from domsift.operators.ranges import enrich_dns_table, enrich_ips, normalise_ranges
from domsift.sources.asn import asn_ranges_from_rows, read_asn_ranges

TSV = [
    ("1.0.0.0", "1.0.0.255", 13335, "US", "CLOUDFLARENET"),
    ("1.0.4.0", "1.0.5.255", 38803, "CN", "CHINANET-BJ"),
    ("8.8.8.0", "8.8.8.255", 15169, "US", "GOOGLE"),
    ("2001:4860:4860::8888", "2001:4860:4860::8888", 15169, "US", "GOOGLE-IPV6"),
    ("2a03:2880:f10d:83:face:b00c::25de", "2a03:2880:f10d:83:face:b00c::25de", 32934, "IE", "FACEBOOK"),
    ("0.0.0.0", "0.0.0.0", 0, "ZZ", "Not routed"),
]


def test_ip_key_matches_python(spark):
    texts = ["1.2.3.4", "0.0.0.0", "255.255.255.255", "01.2.3.4", "1.2.3", "::", "::1", "2001:db8::1",
             "::ffff:1.2.3.4", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8",
             "abcd::12345", "::2:3:4:5:6:7:8", ":1::", "256.1.1.1", "2a03:2880:f10d:83:face:b00c::25de"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select(
        "t", ip_version("t").alias("v"), F.hex(ip_key("t")).alias("k")).collect()
    for r in rows:
        try:
            a = ipaddress.ip_address(r.t)
            exp = (a.version, format(int(a), "032X"))
        except ValueError:
            exp = (None, None)
        assert (r.v, r.k) == exp, r.t


def test_asn_fixture(spark, tmp_path):
    path = tmp_path / "asn.tsv"
    path.write_text("".join("\t".join(map(str, row)) + "\n" for row in TSV))
    ranges = read_asn_ranges(spark, str(path))
    assert ranges.count() == 5  # the not-routed row is skipped
    pts = spark.createDataFrame([(x,) for x in ["1.0.0.128", "1.0.0.0", "1.0.0.255", "2001:4860:4860::8888",
                                                "192.168.1.1", "0.0.0.0"]], "ip STRING")
    for bc in (True, False):
        got = {r.ip: r.as_number for r in enrich_ips(pts, ranges, broadcast=bc).collect()}
        assert got == {"1.0.0.128": 13335, "1.0.0.0": 13335, "1.0.0.255": 13335,
                       "2001:4860:4860::8888": 15169, "192.168.1.1": None, "0.0.0.0": None}


def test_asn_bad_rows_fail(spark, tmp_path):
    bad = tmp_path / "bad.tsv"
    bad.write_text("1.0.0.0\tnot-an-ip\t5\tUS\tX\n")
    with pytest.raises(Exception):
        read_asn_ranges(spark, str(bad)).collect()
    short = tmp_path / "short.tsv"
    short.write_text("1.0.0.0\t1.0.0.5\t5\tUS\n")
    with pytest.raises(Exception):
        read_asn_ranges(spark, str(short)).collect()


def test_normalise_and_join_match_overwrite_order(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        lo = rnd.randrange(0, 2**32 - 2**26)
        w = rnd.choice([5, 300, 70_000, 2**20, 2**25])
        rows.append((str(ipaddress.ip_address(lo)), str(ipaddress.ip_address(lo + w)), i % 5 + 1, "C", f"N{i % 3}", i))
    raw = spark.createDataFrame(rows, "start_ip STRING, end_ip STRING, asn BIGINT, country STRING, description STRING, row_ord BIGINT")
    ranges = asn_ranges_from_rows(raw)
    norm = sorted((bytes(r.lo), bytes(r.hi)) for r in normalise_ranges(ranges).collect())
    assert all(a[1] < b[0] for a, b in zip(norm, norm[1:]))  # disjoint
    probes = [rnd.randrange(0, 2**32) for _ in range(500)] + [int(ipaddress.ip_address(r[0])) for r in rows]

    def brute(x):
        best = None
        for s, e, asn, _, name, _ in rows:
            if int(ipaddress.ip_address(s)) <= x <= int(ipaddress.ip_address(e)):
                best = (asn, name)
        return best

    pts = spark.createDataFrame([(str(ipaddress.ip_address(x)),) for x in probes], "ip STRING")
    got = {r.ip: (r.as_number, r.as_name) if r.as_number is not None else None for r in enrich_ips(pts, ranges).collect()}
    for x in probes:
        assert got[str(ipaddress.ip_address(x))] == brute(x)


def test_range_up_to_the_last_address(spark):
    rows = [("f000::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", 64500, "TOP", "NO", 0), ("ff00::", "ff0f::", 64501, "MID", "SE", 1)]
    raw = spark.createDataFrame(rows, "lo STRING, hi STRING, as_number BIGINT, as_name STRING, country_code STRING, row_ord BIGINT")
    table = raw.select(F.lit(6).alias("ver"), ip_key(F.col("lo")).alias("lo"), ip_key(F.col("hi")).alias("hi"), "as_number", "as_name", "country_code", "row_ord")
    points = spark.createDataFrame([("ff02::1",), ("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff",), ("f000::",), ("efff::",)], "ip STRING")
    got = {r.ip: r.as_number for r in enrich_ips(points, table, "ip").collect()}
    assert got == {"ff02::1": 64501, "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff": 64500, "f000::": 64500, "efff::": None}


def test_equal_dns_rows_stay_apart(spark):
    rows = [("a.test", 1, ["192.0.2.1"], []), ("a.test", 1, ["192.0.2.2", "192.0.2.3"], [])]
    dns = spark.createDataFrame(rows, "domain STRING, observed_at INT, a ARRAY<STRING>, aaaa ARRAY<STRING>")
    none = spark.createDataFrame([], "ver INT, lo BINARY, hi BINARY, as_number BIGINT, as_name STRING, country_code STRING, row_ord BIGINT")
    got = sorted([e.ip for e in r.enrichment] for r in enrich_dns_table(dns, none).collect())
    assert got == [["192.0.2.1"], ["192.0.2.2", "192.0.2.3"]]


def test_sweep_equals_broadcast(spark):
    rnd = random.Random(9)
    ranges, at4, at6 = [], 0, int(ipaddress.ip_address("2001:db8::"))
    for i in range(300):  # touching ranges, gaps, one that spans several partitions, both versions
        lo = at4 + rnd.choice([0, 0, 1, 5000])
        at4 = lo + rnd.choice([1, 256, 70_000, 2**28 if i == 150 else 9])
        ranges.append((str(ipaddress.IPv4Address(lo)), str(ipaddress.IPv4Address(at4 - 1)), i, "C", f"N{i}", i))
        lo = at6 + rnd.choice([0, 2**70])
        at6 = lo + rnd.choice([1, 2**64, 2**90])
        ranges.append((str(ipaddress.IPv6Address(lo)), str(ipaddress.IPv6Address(at6 - 1)), 1000 + i, "C", f"M{i}", 1000 + i))
    raw = spark.createDataFrame(ranges, "start_ip STRING, end_ip STRING, asn BIGINT, country STRING, description STRING, row_ord BIGINT")
    table = asn_ranges_from_rows(raw)
    ends = [(int(ipaddress.ip_address(r[k])), ipaddress.ip_address(r[k]).version) for r in ranges for k in (0, 1)]
    near = [(n + d, v) for n, v in ends for d in (-1, 0, 1) if n + d >= 0]
    ips = [str((ipaddress.IPv4Address if v == 4 else ipaddress.IPv6Address)(n)) for n, v in near] + [None] * 50 + ["no address"] + ["0.0.0.9"] * 200
    pts = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id INT, ip STRING").repartition(5)
    rows = lambda **kw: sorted(map(tuple, enrich_ips(pts, table, **kw).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        swept = rows(broadcast=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert swept == rows(broadcast=True) == rows() and len(swept) == len(ips)
    assert sum(r[2] is not None for r in swept) > len(near) // 2
    empty = table.limit(0)
    assert all(r.as_number is None for r in enrich_ips(pts, empty, broadcast=False).collect())
    assert enrich_ips(pts.limit(0), table, broadcast=False).count() == 0
