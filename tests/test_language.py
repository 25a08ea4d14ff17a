import pytest

from tidewatch.plans import language as L


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    for t in range(0, 301, 30):
        s = t * 1000
        for mode, rate in (("idle", 0.7), ("user", 0.2), ("iowait", 0.1)):
            rows.append(("node_cpu_seconds_total", {"mode": mode, "instance": "h:9100", "job": "n"}, s, rate * t))
        for dev in ("eth0", "lo", "bond1"):
            rows.append(("node_network_receive_bytes_total", {"device": dev, "instance": "h:9100"}, s, t * 1048576.0 * 2))
        rows.append(("db_errors_total", {"from_instance": "d", "job": "g"}, s, float(t if t < 200 else t - 200)))
        for k in range(12):
            rows.append(("pg_database_size_bytes", {"datname": f"d{k}", "from_instance": "d", "job": "g"}, s, float(k * t)))
        rows.append(("pg_connections_used_conn", {"from_instance": "d", "job": "g"}, s, 30.0))
        rows.append(("pg_connections_max_conn", {"from_instance": "d", "job": "g"}, s, 120.0))
    return spark.createDataFrame(rows, "name string, labels map<string,string>, ts_ms long, value double")


def run(samples, text, at=180_000):
    return {tuple(sorted(r["labels"].items())): round(r["value"], 6) for r in L.evaluate(samples, text, at).collect()}


def test_every_derived_metric_parses_and_runs(samples):
    assert len(L.DERIVED) == 63  # and one family by time units
    for text in L.DERIVED.values():
        L.evaluate(samples, text, 180_000)


def test_values(samples):
    host = (("instance", "h"), ("job", "n"))
    assert run(samples, L.DERIVED["os_cpu_idle_usage"]) == {host: 0.7}
    assert run(samples, L.DERIVED["os_cpu_processor_number"]) == {host: 1.0}
    assert run(samples, L.DERIVED["os_network_receive_bytes"]) == {(("device", "eth0"), ("instance", "h")): 2.0}
    assert run(samples, L.DERIVED["db_connections_used_ratio"]) == {(("from_instance", "d"), ("job", "g")): 0.25}
    top = run(samples, L.DERIVED["db_database_increase_rate"])
    assert len(top) == 10 and max(top.values()) == 11.0 and min(top.values()) == 2.0


def test_resets_and_ranges(samples):
    one = (("from_instance", "d"), ("job", "g"))
    # (120 s, 300 s]: 150, 180, 10, 40, 70, 100 after a reset at 210 s
    assert run(samples, L.DERIVED["db_errors_rate"], 300_000) == {one: 130.0}
    assert run(samples, "irate(db_errors_total[3m])", 210_000) == {one: round(10 / 30, 6)}
    assert run(samples, "rate(db_errors_total[1m])", 180_000) == {one: 0.5}


def test_grid_and_lookback(samples):
    got = L.evaluate(samples, "pg_connections_used_conn", 0, 720_000, 60_000).collect()
    assert sorted(r["ts_ms"] for r in got) == list(range(0, 600_001, 60_000))


def test_names_and_arithmetic(samples):
    assert run(samples, "sum by (__name__) ({from_instance='d', datname=''})")[(("__name__", "pg_connections_max_conn"),)] == 120.0
    assert run(samples, "(pg_connections_used_conn + 10) * 2 - 5 > 70") == {(("from_instance", "d"), ("job", "g")): 75.0}
    assert run(samples, "pg_connections_used_conn > 70") == {}
    for bad in ("sum(", "1 + 1", "irate(x)", "a b"):
        with pytest.raises(ValueError):
            L.evaluate(samples, bad, 0)


def test_leak_metrics(samples):
    assert set(L.leak_metrics(samples, "db_errors")) == {f"db_errors_total_{u}" for u in ("1m", "10m", "60m", "24h")}


def test_leak_metrics_have_all_names(spark):
    assert len(L.leak_metrics(spark.range(1200).selectExpr("concat('m_', id) AS name"), "m_")) == 4 * 1200


def test_families_are_of_all_metrics(spark, sf):
    from tidewatch.plans.registry import QUERIES

    names = {r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().collect()}
    got = [r["metric"] for r in QUERIES["s17_families"](spark, sf).collect()]
    assert len({n[0] for n in names}) > 1 and sorted(got) == sorted(f"{n}_{u}" for n in names for u in ("1m", "10m", "60m", "24h"))


def test_families_of_odd_names(spark):
    rows = spark.createDataFrame([("pa",), ("b",), ("",), (None,), ("b",)], "name string")
    got = {(r["name"], r["metric"]) for r in L.families(rows).where("unit = '1m'").collect()}
    assert got == {("pa", "pa_1m"), ("b", "b_1m"), ("", "_1m"), (None, None)}
    assert {r["metric"] for r in L.families(rows, "p").collect()} == {f"pa_{u}" for u in L.LEAK_UNITS}
    assert len(L.leak_metrics(rows, "")) == 3 * 4
