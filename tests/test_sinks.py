import datetime as dt

from tidemark.sources import sinks

EVENT = "rule_id string, symbol string, session date, horizon int, net_return double"


def test_events_come_back_by_rule(spark, tmp_path):
    rows = [(rule, symbol, dt.date(2020, 1, day), 5, 0.5 * day) for rule in ("1", "b") for symbol in ("x", "y") for day in (1, 2)]
    df = spark.createDataFrame(rows, EVENT)
    sinks.write_events(df, f"{tmp_path}/e")
    back = sinks.read_events(spark, f"{tmp_path}/e", "1", df.schema)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(r for r in rows if r[0] == "1")


def test_a_write_without_events_reads_as_none(spark, tmp_path):
    none = spark.createDataFrame([], EVENT)
    sinks.write_events(none, f"{tmp_path}/e")
    back = sinks.read_events(spark, f"{tmp_path}/e", "b", none.schema)
    assert back.count() == 0 and set(back.columns) == set(none.columns)
