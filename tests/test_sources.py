from pyspark.sql import functions as F

from tidewatch.sources import series as S
from tidewatch.sources import store
from tidewatch.sources import texts as X


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "noise before\n"
        "2024-01-01 00:00:01.000 UTC t1 db 11 LOG:  statement: select a\n"
        "from t where b = 1\n"
        "2024-01-01 00:00:02.000 UTC t2 db 12 LOG:  execute p1: update t set a = $1 where b = $2\n"
        "2024-01-01 00:00:02.000 UTC t2 db 12 DETAIL:  parameters: $1 = '5', $2 = 'x'\n"
        "2024-01-01 00:00:03.000 UTC t1 db 11 LOG:  statement: begin;\n"
        "2024-01-01 00:00:04.000 UTC t1 db 11 LOG:  statement: insert into t values (1);\n"
        "2024-01-01 00:00:05.000 UTC t2 db 12 LOG:  statement: select 2\n"
        "2024-01-01 00:00:06.000 UTC t1 db 11 LOG:  statement: delete from t;\n"
        "2024-01-01 00:00:07.000 UTC t1 db 11 LOG:  statement: commit;\n"
    )
    records = X.read_log(spark, str(tmp_path), "%m %c %d %p")
    assert records.count() == 8
    got = {(r["c"], r["statement"]) for r in X.log_statements(records, "c").collect()}
    assert got == {("t1", "select a from t where b = 1;"), ("t2", "update t set a = '5' where b = 'x';"), ("t1", "insert into t values (1);delete from t;"), ("t2", "select 2;")}


def test_answers_and_tables(spark):
    df = spark.createDataFrame([('[{"metric":{"__name__":"m","a":"1"},"values":[[1.5,"2"],[2.5,"NaN"]]}]',)], "a string")
    assert [(r["name"], r["labels"], r["ts_ms"], r["value"]) for r in X.from_answer(df, "a").orderBy("ts_ms").collect()] == [("m", {"a": "1"}, 1500, 2.0), ("m", {"a": "1"}, 2500, None)]
    text = spark.createDataFrame([(1, " a | b\n---+---\n 1 | x y\n 2 | \n(2 rows)\n")], "k int, t string")
    assert [r["cells"] for r in X.table_output(text, "k", "t").orderBy("row").collect()] == [["1", "x y"], ["2", ""]]


def test_connection_strings(spark):
    one = spark.range(1)
    assert one.select(X.dsn_parts(F.lit(" host=h  port=5432 user=u "))).first()[0] == {"host": "h", "port": "5432", "user": "u"}
    parts = X.address_parts(F.lit("postgresql://u:p@h:5432/d"))
    assert one.select(*(c.alias(n) for n, c in parts.items())).first().asDict() == {"user": "u", "password": "p", "host": "h", "port": "5432", "dbname": "d"}


def test_stored_samples_are_selected_by_the_scan(spark, tmp_path):
    rows = [(n, {"from_instance": str(k % 7), "device": "a" if k % 2 else "b"}, k, float(k % 50)) for n in ("cpu", "mem", "odd name/%") for k in range(500)] + [("cpu", {}, 1, 3.0)]
    samples = spark.createDataFrame(rows, "name string, labels map<string,string>, ts_ms long, value double")
    folder = str(tmp_path / "samples")
    store.write_samples(samples, folder)
    assert store.metric_names(spark, folder) == ["cpu", "mem", "odd name/%"]
    pick = lambda s: s.metric("odd name/%").from_server("3").filter(device="a").between(100, 300).values(10.0, 40.0)
    got = pick(S.Selector.stored(spark, folder)).fetchall()
    want = pick(S.Selector(samples)).fetchall()
    assert sorted((r["ts_ms"], r["value"]) for r in got.collect()) == sorted((r["ts_ms"], r["value"]) for r in want.collect()) != []
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    got = pick(S.Selector.stored(spark, folder)).fetchall()
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    by_folder, by_file = plan.split("PartitionFilters: ")[1].split("PushedFilters: ")[:2]
    assert "odd name/%" in by_folder
    assert all(x in by_file for x in ("EqualTo(label_from_instance,3)", "GreaterThanOrEqual(ts_ms,100)", "LessThanOrEqual(ts_ms,300)", "GreaterThanOrEqual(value,10.0)", "LessThan(value,40.0)"))
    assert S.Selector.stored(spark, folder).metric("cpu").filter(from_instance="").fetchall().count() == 1
