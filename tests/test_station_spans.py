"""Station facts from spans against facts of the day-by-day panel; no empty day becomes a row."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridegauge.catalog import stations as cs
from ridegauge.operators import panel as pn
from ridegauge.plans.bindings import DENSE_DAILY, SPARSE_DAILY

START = dt.date(2023, 1, 1)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def daily(spark):
    rng = random.Random(11)
    rows = []
    for i in range(80):
        share, begin, end = rng.choice([0.02, 0.2, 0.7, 0.97]), rng.randint(0, 200), rng.randint(201, 430)
        for day in range(begin, end):
            if rng.random() < share:
                rows.append((f"s{i}", START + dt.timedelta(day), rng.choice([None, 0.0, 0.0, 1.0, 5.0, 8.0, -2.0])))
    rows += [("nulls", START + dt.timedelta(d), None) for d in (3, 9, 50)] + [("one", START + dt.timedelta(7), 4.0)]
    return spark.createDataFrame(rows, "station_id string, date date, target double").cache()


def by_day(daily):
    """Per station the counts that the panel's rows give, in plain Python."""
    out = {}
    for r in sorted(pn.analysis_panel(daily).collect(), key=lambda r: (r.station_id, r.date)):
        out.setdefault(r.station_id, []).append(r)
    return out


def longest(flags):
    best = now = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    return best


def test_inventory_from_spans(daily):
    panel = by_day(daily)
    for found in (pn.station_inventory(daily), pn.inventory(pn.analysis_panel(daily))):
        rows = {r.station_id: r for r in found.collect()}
        assert set(rows) == set(panel)
        for key, days in panel.items():
            r, end = rows[key], days[0].global_end
            recent = [d for d in days if d.date > end - dt.timedelta(90)]
            want = {
                "observed_days": sum(d.is_observed_in_service for d in days), "missing_in_service_days": sum(d.is_missing_in_service for d in days),
                "out_of_service_days": sum(d.is_out_of_service for d in days), "pre_service_days": sum(d.is_pre_service for d in days),
                "post_service_days": sum(d.is_post_service for d in days), "unknown_days": sum(d.is_unknown_ambiguous for d in days),
                "in_service_days": sum(d.is_in_service for d in days), "recent_in_service_days": sum(d.is_in_service for d in recent),
                "recent_active_days": sum(d.is_observed_positive for d in recent), "longest_missing_streak": longest(d.is_missing_in_service for d in days),
                "longest_active_streak": longest(d.is_observed_positive for d in days), "observed_zero_days": sum(d.is_observed_zero for d in days),
            }
            assert {k: r[k] for k in want} == want, key


def test_state_totals_from_spans(daily):
    got = {(r.station_id, r.day_state): (r.days, r.first_day, r.last_day, r.day_sum) for r in pn.day_state_totals(daily).collect()}
    want = {}
    for key, days in by_day(daily).items():
        for d in days:
            want.setdefault((key, d.day_state), []).append(d.date)
    zero = dt.date(1990, 1, 1)
    assert got == {k: (len(v), min(v), max(v), sum((d - zero).days for d in v)) for k, v in want.items()}


@pytest.mark.parametrize("name", ["i04_day_state", "i07_inventory", "i10_inventory_sparse", "i09_median_gap", "j17_station_profiles_month", "j17_station_profiles_weekday"])
def test_no_row_a_day(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


@pytest.mark.parametrize("make", [lambda d: pn.panel_grid(d), lambda d: pn.station_days(d), lambda d: pn.station_facts(pn.analysis_panel(d), d)])
def test_tasks_grow_with_the_days(daily, monkeypatch, make):
    """Twice the rows make more tasks, not larger ones: the number follows the days, not the session's setting."""
    from ridegauge.operators import keyed

    monkeypatch.setattr(keyed.spread, "__defaults__", (1_000,))
    plan = make(daily)._jdf.queryExecution().executedPlan().toString()
    wanted = {int(n) for n in __import__("re").findall(r"hashpartitioning\(station_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert wanted and min(wanted) >= daily.count() // 1_000 and max(wanted) > 8
