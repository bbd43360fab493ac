import datetime as dt

import pytest
from pyspark.sql import functions as F

from domsift.functions.text import format_digest_line, format_plain
from domsift.operators import rules
from domsift.operators.digest import digest_batches
from domsift.operators.dns import first_resolution
from domsift.operators.ranges import enrich_dns_table, enrich_ips
from domsift.operators.suffix import registrable_domain
from domsift.sinks.writers import write_alerts_json, write_alerts_text, write_digests
from domsift.sources.asn import read_asn_ranges
from domsift.sources.dns import read_dns_observations
from domsift.sources.feed import parse_messages, read_feed
from domsift.sources.rules import load_rules
from domsift.streaming.ops import enrich_stream, with_rules_reload

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _alerts(spark):
    rows = [(T0, "b.test", "b.test", ["x"], False, (["192.0.2.1"], [], []), [("192.0.2.1", 64500, None, None)]),
            (T0, "a.test", None, ["x", "y"], False, ([], [], []), [])]
    return spark.createDataFrame(
        rows, "timestamp TIMESTAMP, domain STRING, base_domain STRING, source_tag ARRAY<STRING>, resolved_after_nxdomain BOOLEAN, "
              "dns STRUCT<a_records: ARRAY<STRING>, aaaa_records: ARRAY<STRING>, ns_records: ARRAY<STRING>>, "
              "enrichment ARRAY<STRUCT<ip: STRING, as_number: BIGINT, as_name: STRING, country_code: STRING>>")


def test_read_feed_text(spark, tmp_path):
    (tmp_path / "feed.txt").write_text('{"data": ["a.test", "b.test"]}\nbroken\n{"data": []}\n')
    got = parse_messages(read_feed(spark, str(tmp_path / "feed.txt"))).collect()
    assert [r.domain for r in got] == ["a.test", "b.test"]


def test_dns_observations_have_a_fixed_schema(spark, tmp_path):
    (tmp_path / "obs.json").write_text(
        '{"domain": "a.test", "observed_at": "2024-01-01T00:00:00Z", "a": ["192.0.2.1"], "extra": 1}\n'
        '{"domain": "b.test"}\n{"observed_at": "2024-01-01T00:00:00Z"}\nnot json\n')
    batch = read_dns_observations(spark, str(tmp_path / "obs.json"), fmt="json")
    assert [(r.domain, r.a, r.ns_error) for r in batch.collect()] == [("a.test", ["192.0.2.1"], None)]
    stream = read_dns_observations(spark, str(tmp_path), streaming=True, fmt="json")
    assert stream.isStreaming and stream.columns == batch.columns


def test_rule_files_join_in_order(spark, tmp_path):
    (tmp_path / "one.yml").write_text("ignore: ['^x']\nrules:\n  - name: second\n    domain_regex: b\n")
    (tmp_path / "two.yml").write_text("rules:\n  - name: first\n    domain_regex: a\nignore: ['^y']\n")
    rs = load_rules([str(tmp_path / "one.yml"), str(tmp_path / "two.yml")])
    assert [r.name for r in rs.rules] == ["second", "first"] and rs.ignore == ["^x", "^y"]
    assert load_rules(None).rules == []
    with pytest.raises(FileNotFoundError):
        load_rules([str(tmp_path / "none.yml")])


def test_register_leaf_and_reload(spark, tmp_path):
    rules.register_leaf("longer_than", lambda n, ctx: F.length("domain") > n, rules.NONE)
    path = tmp_path / "rules.yml"
    names = spark.createDataFrame([("abc.test",), ("a.test",)], "domain STRING")
    got = []
    run = with_rules_reload(lambda: load_rules([str(path)]), lambda df, e: got.append(sorted((r.domain, *r.source_tag) for r in df.collect())))
    for n in (6, 7, 20):
        path.write_text(f"rules:\n  - name: long\n    longer_than: {n}\n")
        run(names, n)
    assert got == [[("abc.test", "long")], [("abc.test", "long")], []]


def test_asn_files_keep_the_order_given(spark, tmp_path):
    (tmp_path / "small.tsv").write_text("192.0.2.0\t192.0.2.255\t1\tNO\tSMALL\n")
    wide = "192.0.2.0\t192.0.2.127\t2\tSE\tWIDE\n" + "".join(f"10.0.{i}.0\t10.0.{i}.255\t3\tDK\tREST\n" for i in range(200))
    (tmp_path / "large.tsv").write_text(wide)
    points = spark.createDataFrame([("192.0.2.1",), ("192.0.2.200",), ("10.0.7.7",), ("2001:db8::1",), ("x",)], "ip STRING")
    files = [str(tmp_path / "small.tsv"), str(tmp_path / "large.tsv")]
    look = lambda paths: [r.as_name for r in enrich_ips(points, read_asn_ranges(spark, paths)).collect()]
    assert look(files) == ["WIDE", "SMALL", "REST", None, None]
    assert look(files[::-1]) == ["SMALL", "SMALL", "REST", None, None]
    (tmp_path / "reversed.tsv").write_text("192.0.2.9\t192.0.2.1\t1\tNO\tX\n")
    with pytest.raises(Exception, match="bad range"):
        read_asn_ranges(spark, str(tmp_path / "reversed.tsv")).collect()


def test_levels_in_use_and_no_provider(spark):
    key = lambda x: bytearray(x.to_bytes(16, "big"))
    schema = "ver TINYINT, lo BINARY, hi BINARY, as_number BIGINT, as_name STRING, country_code STRING, row_ord BIGINT"
    six = spark.createDataFrame([(6, key(0xFF << 120), key((1 << 128) - 1), 9, "TOP", "NO", 0)], schema)
    points = spark.createDataFrame([("ff02::1",), ("10.0.0.1",), (None,)], "ip STRING")
    assert [r.as_number for r in enrich_ips(points, six).collect()] == [9, None, None]
    none = spark.createDataFrame([], schema)
    assert [r.as_number for r in enrich_ips(points, none).collect()] == [None, None, None]
    dns = spark.createDataFrame([("a.test", ["10.0.0.1"], None)], "domain STRING, a ARRAY<STRING>, aaaa ARRAY<STRING>")
    assert enrich_dns_table(dns, None).first().enrichment == []
    names = spark.createDataFrame([("a.test",), ("b.test",)], "domain STRING")
    assert [r.domain for r in enrich_stream(names, enrich_dns_table(dns, None)).collect()] == ["a.test"]


def test_registrable_domain_spelling(spark):
    sfx = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",)], "rule STRING")
    want = {"A.EXAMPLE.CO.UK": "example.co.uk", "a.example.com.": "example.com", "co.uk": None, "b.a.x.ck": "a.x.ck",
            "x.ck": None, "a.www.ck": "www.ck", "com": None, "": None, None: None, "a..com": ".com"}
    rows = spark.createDataFrame([(d, "kept") for d in want], "domain STRING, base_domain STRING")
    assert {r.domain: r.base_domain for r in registrable_domain(rows, sfx).collect()} == want
    assert {r.domain: r.base_domain for r in registrable_domain(rows, sfx, max_broadcast_bytes=0).collect()} == want
    assert registrable_domain(rows, sfx.limit(0)).where("domain = 'co.uk'").first().base_domain == "co.uk"


def test_first_resolution_has_a_horizon(spark):
    obs = [(0, "nxdomain"), (5, "failure"), (9, "success"), (20, "success"), (100, "nxdomain"), (200, "nxdomain"), (800, "success"),
           (900, "nxdomain"), (1531, "success")]
    rows = [(i, "a.test", T0 + dt.timedelta(seconds=t), st) for i, (t, st) in enumerate(obs)]
    df = spark.createDataFrame(rows, "id INT, domain STRING, observed_at TIMESTAMP, status STRING")
    flagged = lambda **kw: [r.id for r in first_resolution(df, order="id", **kw).where("resolved_after_nxdomain").orderBy("id").collect()]
    assert flagged() == [2, 6]
    assert flagged(horizon_seconds=631) == [2, 6, 8]
    assert flagged(horizon_seconds=9) == [2]


def test_file_sinks_and_own_formatter(spark, tmp_path):
    alerts = _alerts(spark)
    write_alerts_json(alerts, f"{tmp_path}/json")
    write_alerts_text(alerts, f"{tmp_path}/text")
    write_alerts_text(alerts, f"{tmp_path}/own", formatter=lambda: F.upper("domain"))
    lines = {k: sorted(r.value for r in spark.read.text(f"{tmp_path}/{k}").collect()) for k in ("json", "text", "own")}
    assert len(lines["json"]) == len(lines["text"]) == 2 and '"domain":"a.test"' in "".join(lines["json"])
    assert lines["own"] == ["A.TEST", "B.TEST"]
    own = digest_batches(alerts, formatter=lambda domain, count, **kw: F.concat(domain, F.lit("/"), count.cast("string"))).first()
    assert own.text == "```\nb.test/0\na.test/0\n```"
    write_digests(digest_batches(alerts, formatter=format_digest_line), f"{tmp_path}/digest")
    assert spark.read.json(f"{tmp_path}/digest").first().text.startswith("```\n[x] ")
