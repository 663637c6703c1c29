"""Sparse weights against their dense form."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from panelkite.operators import holdings as hd
from panelkite.operators import metrics as mt
from panelkite.operators import signals as sg

DDL = "ts DATE, symbol_id BIGINT, weight DOUBLE"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=7 * i)


def random_weights(seed, dates=12, symbols=6):
    """Dense rows in which some dates repeat the one before and some are all cash."""
    rng = random.Random(seed)
    rows, last = [], {}
    for d in range(dates):
        kind = rng.random()
        if kind < 0.3:
            now = last
        elif kind < 0.5:
            now = {}
        else:
            chosen = rng.sample(range(symbols), rng.randint(1, 3))
            now = {s: rng.choice([0.25, 0.5]) for s in chosen}
        rows += [(day(d), s, now.get(s, 0.0)) for s in range(symbols)]
        last = now
    return rows


def as_set(df):
    return {tuple(r) for r in df.select("ts", "symbol_id", "weight").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_dense_sparse_and_back(frame, seed):
    rows = random_weights(seed)
    dense = frame(rows, DDL)
    found = hd.sparse(dense)
    assert found.held.where("weight = 0").isEmpty()
    assert as_set(hd.export(found, dense)) == set(rows)
    coded = hd.intervals(found)
    assert as_set(hd.export(hd.at_dates(coded, found.dates), dense)) == set(rows)
    assert coded.count() <= found.held.count()


@pytest.mark.parametrize("seed", range(4))
def test_event_dates(frame, seed):
    rows = random_weights(seed)
    by_date = {}
    for ts, symbol, weight in rows:
        by_date.setdefault(ts, {})[symbol] = weight
    order = sorted(by_date)
    expected = {b for a, b in zip([None, *order], order) if a is None or by_date[a] != by_date[b]}
    dense = frame(rows, DDL)
    assert {r.ts for r in hd.event_dates(hd.sparse(dense)).collect()} == expected
    assert {r.ts for r in sg.event_panel(dense).select("ts").distinct().collect()} == expected


def test_digests_do_not_depend_on_order_and_see_swaps(frame):
    rows = [(day(0), 1, 0.5), (day(0), 2, 0.25), (day(1), 2, 0.25), (day(1), 1, 0.5), (day(2), 1, 0.25), (day(2), 2, 0.5)]
    found = {r.ts: (r.n, r.digest, r.digest2) for r in hd.date_digests(hd.sparse(frame(rows, DDL))).collect()}
    assert found[day(0)] == found[day(1)] != found[day(2)]


def test_episode_ends_on_a_date_in_cash(frame):
    dates = frame([(day(i),) for i in range(5)], "ts DATE")
    held = frame([(day(1), 1, 0.5), (day(2), 2, 0.5), (day(4), 1, 0.4)], DDL)
    episode = hd.first_episode(hd.Holdings(dates, held))
    assert [r.ts for r in episode.dates.orderBy("ts").collect()] == [day(1), day(2), day(3)]
    assert episode.held.count() == 2
    never = hd.first_episode(hd.Holdings(dates.where("ts < '2024-01-16'"), held.where("ts < '2024-01-16'")))
    assert never.dates.isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_turnover_needs_no_zeros(frame, seed):
    dense = frame([("r", *row) for row in random_weights(seed)], "run_id STRING, " + DDL)
    dates = dense.select("run_id", "ts").distinct()
    a = mt.turnover(dense).first()
    b = mt.turnover(dense.where("weight <> 0"), dates=dates).first()
    assert (a.n_rebalances, a.turnover) == (b.n_rebalances, pytest.approx(b.turnover))


def test_nothing_held(frame):
    dates = frame([(day(i),) for i in range(3)], "ts DATE")
    empty = hd.Holdings(dates, frame([], DDL))
    assert [r.ts for r in hd.event_dates(empty).collect()] == [day(0)]
    assert hd.intervals(empty).isEmpty()
    assert as_set(hd.export(empty, frame([(1,)], "symbol_id BIGINT"))) == {(day(i), 1, 0.0) for i in range(3)}
