"""What must not grow with the tables: folders, files a task reads, repeated rules."""
import datetime as dt

from pyspark.sql import functions as F

from helpers import raw, values
from offerloom.checks import history, streams
from offerloom.functions import text as tx
from offerloom.operators import aggregates as ag
from offerloom.operators import ranking as rk
from offerloom.streaming import keyed as ky

c = F.col


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gates_of_detail_candidates_build_the_name_once(spark):
    rows = raw(spark, dict(brand="Mammut"), dict(brand="Mammut", availability="Ausverkauft"), dict(brand="Mammut", name=None), dict(brand="Mammut", url=None))
    out = rk.detail_candidates(rows.withColumn("name", F.concat(F.lit("MARKED "), c("name"))), ["Mammut"])
    assert _plan(out).count("MARKED") == 1 and values(out, "seq") == [(0,)]


def test_month_reports_screen_once(spark, monkeypatch):
    rows = spark.createDataFrame([(dt.date(2024, 1, 2), "s1", 1, None, 50.0, "confirmed"), (dt.date(2024, 2, 2), "s1", 1, "x", None, None)],
                                 "run_date date, source_id string, l_suppkey long, reason string, effective_discount_pct double, size_fit string")
    monkeypatch.setattr(history, "screened", lambda spark, d: rows.withColumn("reason", F.when(c("reason") != "MARKED", c("reason"))))
    cov, report = history.month_reports(spark, "")
    out = ag.run_metrics(report, cov)
    assert "MARKED" not in _plan(out)
    assert sorted(values(out.where("metric = 'normalized_offers'"), "run_date", "value")) == [("2024-01", 1), ("2024-02", 0)]


def test_computed_leaves_the_generator_nothing_to_evaluate(spark):
    df = tx.computed(spark.range(3), {"x": F.aggregate(F.transform(F.array("id"), lambda v: v + 1), F.lit(0).cast("long"), lambda a, v: a + v)}).where("x > 1")
    made = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line]
    assert made and not any("lambdafunction" in line for line in made) and sorted(values(df, "id", "x")) == [(1, 2), (2, 3)]


def test_folding_of_ascii_and_other_text(spark):
    texts = ["Haglöfs L.I.M ’Fuse’", "HAGLOFS", "Fjällräven", "ØRN Ærø", "áb", "Kelvin", "", None]
    got = values(spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fold(c("t")).alias("f"), tx.strip_marks(c("t")).alias("s")), "t", "f", "s")
    assert [f for _, f, _ in got] == [tx.fold_py(t or "") for t in texts]
    assert [s for _, _, s in got] == ["Haglofs L.I.M ’Fuse’", "HAGLOFS", "Fjallraven", "ØRN Ærø", "ab", "Kelvin", "", None]


def test_arrivals_of_many_files_are_one_micro_batch_each(spark, tmp_path, monkeypatch):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(k, k % 7, "view", float(k % 11), start + dt.timedelta(hours=k % 600, minutes=k % 13)) for k in range(3000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = {}
    for size in (100_000, 100):
        folder = tmp_path / f"arrivals-{size}"
        with monkeypatch.context() as m:
            m.setattr(streams.sk, "work_folder", lambda spark, name: str(folder))
            stream = streams._arrivals(spark, str(tmp_path), rows_per_file=size)
        files = len(list(folder.glob("in/*.parquet")))
        table = streams._started(spark, ky.offer_lifetimes(stream, streams.KEYS, ["value"]))
        found[size] = files, sorted(values(ky.newest_lifetimes(table, streams.KEYS), "user_id", "first_seen", "last_seen", "observations", "value", "state"))
    assert found[100_000][0] == 3 and found[100][0] > 3 and found[100][0] % 3 == 0
    assert found[100][1] == found[100_000][1] and found[100][1]
