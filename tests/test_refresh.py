"""Refreshed counts equal counts from scratch, and only touched periods are read and written."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from segpanel.operators.aggregate import monthly_counts, weekly_counts
from segpanel.plans import refresh as rf
from segpanel.plans.refresh import PeriodTable, read_counts, refresh

SCHEMA = "id long, day date, cat string, ok boolean"


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def rows(first, days, start=0):
    return [(start + i, first + timedelta(days=i % days), "xyz"[i % 3] if i % 7 else None, i % 5 != 0) for i in range(3 * days)]


def table(tmp_path, period="week"):
    return PeriodTable(str(tmp_path / "out"), str(tmp_path / "in"), "day", ("cat",), "ok", period)


def check(spark, t):
    events = spark.read.parquet(t.source)
    counts = (weekly_counts if t.period == "week" else monthly_counts)(events.filter("day is not null"), "day", list(t.keys), F.col("ok"))
    assert sorted(map(tuple, read_counts(spark, t).collect()), key=str) == sorted((tuple(r) for r in counts.select(t.period, *t.keys, "n").collect()), key=str)


def folders(t):
    return {d: os.stat(f"{t.counts}/{d}").st_mtime_ns for d in os.listdir(t.counts) if "=" in d}


@pytest.mark.parametrize("period", ["week", "month"])
def test_late_changed_and_removed_files(spark, tmp_path, period):
    t = table(tmp_path, period)
    write(spark, t.source, rows(date(2024, 1, 1), 60))
    write(spark, t.source, rows(date(2024, 3, 4), 40, 1000))
    first = refresh(spark, t)
    check(spark, t)
    assert len(first.scanned) == 2 and first.emptied == ()
    before = folders(t)
    assert refresh(spark, t) == rf.Refreshed((), (), (), ()) and folders(t) == before
    # Late rows of two days, rows without a day and rows that don't count.
    late = [(1, date(2024, 1, 17), "x", True), (2, date(2024, 3, 6), None, True), (3, None, "x", True), (4, date(2024, 5, 1), "x", False)]
    write(spark, t.source, late)
    second = refresh(spark, t)
    check(spark, t)
    assert set(second.periods) == ({date(2024, 1, 15), date(2024, 3, 4)} if period == "week" else {date(2024, 1, 1), date(2024, 3, 1)})
    assert len(second.scanned) == 1
    after = folders(t)
    assert {d for d in after if after[d] != before.get(d)} == {f"{period}={p}" for p in second.periods}
    # The second file goes, and with it the periods that it alone held.
    gone = next(p for p in (tmp_path / "in").glob("part-*.parquet") if date(2024, 4, 10) in {r.day for r in spark.read.parquet(str(p)).collect()})
    gone.unlink()
    third = refresh(spark, t)
    check(spark, t)
    assert third.scanned == () and third.emptied and not any(f"{period}={p}" in folders(t) for p in third.emptied)
    write(spark, t.source, [(1, date(2025, 1, 1), "x", False)])
    assert refresh(spark, t).periods == ()
    assert refresh(spark, t).scanned == ()  # a file without rows that count is known too


def test_failed_refresh_is_repeated(spark, tmp_path, monkeypatch):
    t = table(tmp_path)
    write(spark, t.source, rows(date(2024, 1, 1), 20))
    refresh(spark, t)
    write(spark, t.source, [(1, date(2024, 1, 9), "x", True)])
    with monkeypatch.context() as broken:
        broken.setattr(rf.versions, "replace_table", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            refresh(spark, t)
    assert refresh(spark, t).periods == (date(2024, 1, 8),)
    check(spark, t)


def test_only_touched_periods_are_read(spark, tmp_path, plan):
    t = table(tmp_path)
    write(spark, t.source, rows(date(2024, 1, 1), 60))
    text = plan(rf.touched_rows(spark, t, [t.source], [date(2024, 1, 15), date(2024, 1, 8), date(2024, 2, 5)]))
    pushed = text.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "Or(And(GreaterThanOrEqual(day,2024-01-08),LessThanOrEqual(day,2024-01-21)),And(GreaterThanOrEqua" in pushed  # the plan cuts long texts
    assert rf._stretches([date(2024, 2, 1), date(2024, 1, 1), date(2024, 4, 1)], "month") == [
        (date(2024, 1, 1), date(2024, 2, 29)), (date(2024, 4, 1), date(2024, 4, 30))]
    with pytest.raises(ValueError):
        PeriodTable("a", "b", "day", ("cat",), period="year")
