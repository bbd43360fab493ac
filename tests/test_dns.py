import datetime as dt

from domsift.operators.dns import health_transitions, retry_outcome, with_status, first_resolution, nxdomain_offsets_s, RetryConfig

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)
OBS = ("event_id INT, domain STRING, observed_at TIMESTAMP, ns_error STRING, a_error STRING, aaaa_error STRING, "
       "ns ARRAY<STRING>, a ARRAY<STRING>, aaaa ARRAY<STRING>")


def test_status_rules(spark):
    rows = [
        (1, "a", T0, "NXDOMAIN", None, None, [], [], []),
        (2, "b", T0, "io error", None, None, [], [], []),
        (3, "c", T0, None, "timeout", None, ["ns"], [], ["::1"]),
        (4, "d", T0, None, "request timeout", "x", ["ns"], [], []),
        (5, "e", T0, None, None, "no records found", ["ns"], [], []),
        (6, "f", T0, None, None, None, ["ns"], [], []),
        (7, "g", T0, None, "SERVFAIL", None, ["ns"], [], []),
    ]
    got = {r.event_id: r.status for r in with_status(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {1: "nxdomain", 2: "failure", 3: "success", 4: "timeout", 5: "nxdomain", 6: "nxdomain", 7: "failure"}


def test_first_resolution_and_retry(spark):
    assert nxdomain_offsets_s(RetryConfig()) == [10, 30, 70, 150, 310, 630]
    rows = [
        (1, "newly-active.com", T0, "NXDOMAIN", None, None, [], [], []),
        (2, "newly-active.com", T0 + dt.timedelta(seconds=12), None, None, None, ["ns"], ["5.5.5.5"], []),
    ]
    obs = with_status(spark.createDataFrame(rows, OBS))
    fr = {r.event_id: r.resolved_after_nxdomain for r in first_resolution(obs, order="event_id").collect()}
    assert fr == {1: False, 2: True}
    out = retry_outcome(obs, order="event_id").first()
    assert (out.outcome, out.attempt) == ("resolved", 1)


def test_health(spark):
    rows = [(1, "google.com", T0, True), (2, "google.com", T0 + dt.timedelta(seconds=1), False),
            (3, "google.com", T0 + dt.timedelta(seconds=2), False), (4, "google.com", T0 + dt.timedelta(seconds=3), True)]
    df = spark.createDataFrame(rows, "id INT, resolver STRING, ts TIMESTAMP, ok BOOLEAN")
    ev = [r.event for r in health_transitions(df, "resolver", "ts", "ok").orderBy("id").collect()]
    assert ev == [None, "UNHEALTHY", "REMAINS_UNHEALTHY", "RECOVERED"]
