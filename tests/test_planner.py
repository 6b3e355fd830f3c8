"""Views, intervals and the slice model."""

import math
from datetime import datetime, timedelta

import pytest

from vistaframe.ir import Aggregate, By, Filter, Group, Query
from vistaframe.plans import planner
from vistaframe.plans.slicing import SliceModel, paced, slices

TEXT = {"text"}
VIEW = Query("d", filter=(Filter("text", "contains", ("river",)),))


def asked(*words, extra=()):
    return Query("d", filter=(Filter("text", "contains", words), *extra))


def test_solves():
    assert planner.solves(VIEW, asked("river", "amber"), TEXT)
    assert planner.solves(VIEW, asked("Amber RIVER"), TEXT)
    assert not planner.solves(VIEW, asked("amber"), TEXT)
    assert not planner.solves(VIEW, Query("e", filter=asked("river").filter), TEXT)
    grouped = Query("d", filter=VIEW.filter, group=Group((By("x", name="x"),), (Aggregate("*", "count", "n"),)))
    assert not planner.solves(grouped, asked("river"), TEXT)


def test_suggest():
    found = planner.suggest(asked("river", "amber"), TEXT, [])
    assert [v.filter[0].values for v in found] == [("amber",), ("river",)]
    assert planner.suggest(asked("river", "amber"), TEXT, [VIEW]) == []
    assert planner.view_name(VIEW).startswith("d_") and len(planner.view_name(VIEW)) == 34


def test_names_of_views_tell_fields_and_relations_apart():
    names = {planner.view_name(Query("d", filter=(Filter(f, r, v),))) for f in ("text", "title") for r in ("contains", "matches") for v in (("river",), ("river", "amber"))}
    assert len(names) == 8


def test_time_range():
    t, us = datetime(2016, 1, 1), timedelta(microseconds=1)
    bounds = lambda *f: planner.time_range(Query("d", filter=tuple(Filter("t", r, v) for r, v in f)), "t")
    assert bounds(("=", ("2016-01-01",))) == (t, t + us) and bounds(("<=", ("2016-01-01",))) == (None, t + us) and bounds((">", ("2016-01-01",))) == (t + us, None)
    assert bounds(("<", ("2016-01-01",))) == (None, t) and bounds((">=", ("2015-01-01",)), ("inRange", ("2014-01-01", "2016-01-01"))) == (datetime(2015, 1, 1), t) and bounds(("isNotNull", ())) == (None, None)


def test_split():
    until = datetime(2016, 6, 1)
    between = lambda a, b: Filter("t", "inRange", (a, b))
    both = planner.split(asked("river", extra=(between("2016-01-01", "2016-12-01"),)), VIEW, "v", until, "t", TEXT)
    assert [(p.query.dataset, p.start, p.end, p.nulls) for p in both] == [("v", None, until, False), ("d", until, None, False)]
    # the view's own filter isn't asked again
    assert both[0].query.filter == (between("2016-01-01", "2016-12-01"),)
    old = planner.split(asked("river", extra=(between("2015-01-01", "2016-01-01"),)), VIEW, "v", until, "t", TEXT)
    assert [p.query.dataset for p in old] == ["v"]
    new = planner.split(asked("river", extra=(between("2016-07-01", "2016-08-01"),)), VIEW, "v", until, "t", TEXT)
    assert [p.query.dataset for p in new] == ["d"]
    free = planner.split(asked("river"), VIEW, "v", until, "t", TEXT)
    assert free[1].nulls


def test_slice_model():
    m = SliceModel(100, 0.6, 1)
    assert m.estimate(2000) == (1, math.inf)
    for seen, limit, expected in (((1, math.inf, 500), 3500, 2), ((2, math.inf, 1500), 4000, 4)):
        m.learn(*seen)
        assert m.estimate(limit)[0] == expected
    m.learn(4, math.inf, 1800)
    assert m.estimate(4200) == (8, 3492)
    m.learn(8, 3492, 3000)
    assert m.estimate(3200) == (6, 2420)


def test_slices_cover_the_range():
    now = [0.0]
    start, end, seen = datetime(2024, 1, 1), datetime(2024, 2, 1), []

    def work(lo, hi):
        seen.append((lo, hi))
        now[0] += (hi - lo) / timedelta(hours=1) * 0.01
        return False

    shares = [s for *_, s in slices(start, end, 1000, work, clock=lambda: now[0])]
    assert seen[0] == (end - timedelta(days=2), end) and seen[-1][0] == start and shares[-1] == 1
    assert all(a[0] == b[1] for a, b in zip(seen, seen[1:]))
    assert list(slices(start, end, 1000, lambda a, b: True, clock=lambda: now[0]))[0][0] == end - timedelta(days=2)


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    out = list(paced(iter([{"value": 1}, {"value": 2}]), 500, lambda: now[0], sleep))
    assert out[-1] == {"key": "done"} and slept == [pytest.approx(0.5)]
