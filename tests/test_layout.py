import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import outcomes as oc
from tidemark.operators import rules as ru
from tidemark.operators.series import equal_weight_benchmark, number_bars
from tidemark.plans import event_study as es
from tidemark.sources import layout


@pytest.fixture
def name(spark):
    table = f"bars_{uuid.uuid4().hex[:8]}"
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def _rows(df):
    return sorted(map(repr, df.select("symbol", "session", "horizon", F.round("net_return", 10), F.round("excess_return", 10)).collect()))


def test_study_of_a_laid_out_table_moves_no_bars(spark, make_bars, walk, tmp_path, name):
    bars = make_bars({"600000": walk(160, 21), "300001": walk(150, 22), "688001": walk(160, 23), "600005": walk(90, 24)})
    base, study, rule = bars.drop("bar_ix", "n_bars", "prev_close"), oc.Study(horizons=(1, 5)), ru.breakdown_rule()
    bench = equal_weight_benchmark(bars)
    laid = layout.save_bars(base, name, buckets=4, path=str(tmp_path / "t"))
    plain, stored = (es.run(number_bars(x), rule, bench, None, study) for x in (base, laid))
    assert layout.exchanges_of_bars(plain) > 0 and layout.exchanges_of_bars(stored) == 0
    assert _rows(plain) == _rows(stored) != []


def test_a_range_of_days_still_reaches_the_scan(spark, make_bars, walk, tmp_path, name):
    bars = make_bars({"600000": walk(60, 1), "300001": walk(60, 2)}).drop("bar_ix", "n_bars", "prev_close")
    laid = layout.save_bars(bars, name, buckets=2, path=str(tmp_path / "t")).where(F.col("session") >= F.lit(dt.date(2020, 2, 1)))
    numbered = number_bars(laid)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert layout.exchanges_of_bars(numbered) == 0 and "GreaterThanOrEqual(session" in plan
    assert numbered.count() == 2 * 29


def test_defined_cases(spark, make_bars, walk, tmp_path, name):
    bars = make_bars({"600000": walk(5, 1)}).withColumn("symbol", F.when(F.col("bar_ix") > 1, F.col("symbol")))
    assert layout.save_bars(bars.where("false"), name, path=str(tmp_path / "t")).count() == 0
    with pytest.raises(ValueError, match="exists"):
        layout.save_bars(bars, name, buckets=2)
    assert layout.save_bars(bars, name, buckets=2, path=str(tmp_path / "t"), replace=True).where("symbol is null").count() == 2
    other = f"{name}_plain"
    bars.write.option("path", str(tmp_path / "p")).saveAsTable(other)
    with pytest.raises(ValueError, match="not laid out"):
        layout.open_bars(spark, other)
    spark.sql(f"DROP TABLE {other}")
    assert [layout.bucket_count(n) for n in (0, 1, 4_000_001, 9_000_000)] == [1, 1, 2, 4]
