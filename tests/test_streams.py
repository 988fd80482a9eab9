"""Stateful streams: order, repeats, idle keys, the size of the state, late rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barline import streaming as st
from barline.operators import signals as sg
from barline.streaming.ordered import Positions, Signals

START = datetime(2024, 1, 1)


def bars(symbols=3, n=60, seed=1):
    """Hourly bars; the first symbol falls silent after a third of them."""
    r = random.Random(seed)
    out = []
    for s in range(symbols):
        price = 100.0
        for i in range(n // 3 if s == 0 else n):
            price *= 1 + r.uniform(-0.03, 0.03)
            out.append((f"S{s}", START + timedelta(hours=i), round(price * 1.01, 4), round(price * 0.99, 4), round(price, 4)))
    return out


SCHEMA = "symbol string, time_close timestamp, high double, low double, close double"


def batch_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("time_close", F.col("time_close").cast("timestamp_ntz"))
    ao = sg.awesome_oscillator(df, 3, 8).withColumn("ao", F.round(F.col("ao") + 1e-12, 9))
    colored = ao.withColumn("ao_color", F.when(F.col("ao").isNotNull(), F.when(F.col("ao") >= F.lag("ao").over(sg._w()), 1).otherwise(-1)))
    signalled = sg.color_signals(colored)
    return signalled, sg.trades(signalled)


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-7)


def test_signals_of_disordered_batches_and_the_state_left(spark):
    rows = bars()
    df = spark.createDataFrame(rows + rows[::7], SCHEMA)  # some bars twice
    arrives = F.timestamp_micros((F.unix_micros("time_close") + F.pmod(F.hash("symbol", "time_close"), F.lit(4)) * 3_600_000_000).cast("long"))
    end = F.struct(F.lit("~end").alias("symbol"), (F.lit(START) + F.expr("INTERVAL 100 DAYS")).cast("timestamp").alias("time_close"), *[F.lit(1.0).alias(c) for c in ("high", "low", "close")])
    seen = []
    got = st.run_available(st.signal_stream(st.replay(df, arrives, 8, end), 3, 8, "5 hours", "1 day"), watch=seen).persist()
    signalled, traded = batch_rows(spark, rows)
    mine = {(r.symbol, r.time_close): r for r in got.withColumn("time_close", F.col("time_close").cast("timestamp_ntz")).collect()}
    want = signalled.collect()
    assert len(mine) == len(want) == got.count()
    for w in want:
        m = mine[w.symbol, w.time_close]
        assert close(m.ao, w.ao) and (m.ao_color, m.long_signal, m.short_signal) == (w.ao_color, w.long_signal, w.short_signal)
    trades = sorted((r.symbol, r.side, str(r.time_close.replace(tzinfo=None)), r.trade_return, r.total_return_index) for r in st.closed_trades(got).collect())
    theirs = sorted((r.symbol, r.side, str(r.time_close), r.trade_return, r.total_return_index) for r in traded.collect())
    assert [t[:3] for t in trades] == [t[:3] for t in theirs] and all(close(a, b) for x, y in zip(trades, theirs, strict=True) for a, b in zip(x[3:], y[3:], strict=True))
    state = [p.stateOperators[0].numRowsTotal for p in seen if p.stateOperators]
    assert len(seen) >= 9 and state[-1] < max(state) and state[-1] <= 3  # but the last row of all, and its timers


def test_late_rows_are_dropped_and_counted(spark):
    ticks = [(i, "a", START + timedelta(hours=i), 50.0, 1.0) for i in range(48)] + [(99, "a", START, 70.0, 1.0)]
    df = spark.createDataFrame(ticks, "event_id long, id string, timestamp timestamp, prices double, volume double")
    arrives = F.when(F.col("event_id") == 99, F.lit(START) + F.expr("INTERVAL 47 HOURS")).otherwise(F.col("timestamp")).cast("timestamp")
    seen = []
    out = st.run_available(st.hour_bar_stream(st.replay(df, arrives, 6), "2 hours"), watch=seen)
    assert out.where("num > 1").count() == 0
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in seen) == 1


def test_positions_carry_over_batches(spark):
    prices = [50, 61, 50, 59, 39, 45, 70, 70, 20]
    df = spark.createDataFrame([("a", START + timedelta(hours=i), float(p)) for i, p in enumerate(prices)], "id string, timestamp timestamp, prices double")
    end = F.struct(F.lit("~end").alias("id"), (F.lit(START) + F.expr("INTERVAL 100 DAYS")).cast("timestamp").alias("timestamp"), F.lit(50.0).alias("prices"))
    got = st.run_available(st.position_stream(st.replay(df, F.col("timestamp"), 5, end), 60.0, 40.0, "1 hour", "1 day")).orderBy("timestamp").collect()
    assert [(r.prices, r.position) for r in got] == [(61.0, 1), (39.0, 0), (70.0, 1), (20.0, 0)]


def test_positions_of_ticks_at_one_time(spark):
    """As SQL has peers: the last of them that crosses a level decides, the first is shown."""
    prices = [[50], [70, 30], [30, 50, 70], [45, 65], [35, 55], [65, 20, 50]]  # by place
    rows = [(10 * i - k, "a", START + timedelta(hours=i), float(p)) for i, same in enumerate(prices) for k, p in zip(range(len(same), 0, -1), same, strict=True)]
    df = spark.createDataFrame(rows[::-1] + rows[::3], "event_id long, id string, timestamp timestamp, prices double")  # some twice
    end = F.struct(F.lit(-1).cast("long").alias("event_id"), F.lit("~end").alias("id"), (F.lit(START) + F.expr("INTERVAL 100 DAYS")).cast("timestamp").alias("timestamp"), F.lit(50.0).alias("prices"))
    got = st.run_available(st.position_stream(st.replay(df, F.col("timestamp"), 3, end), 60.0, 40.0, "1 hour", "1 day", "event_id")).orderBy("timestamp").collect()
    assert [(r.timestamp.hour, r.prices, r.position) for r in got] == [(2, 30.0, 1), (4, 35.0, 0)]


@pytest.mark.parametrize(("kind", "row", "n"), [(Signals(3, 8, 1), (1.0, 1.0, 1.0), 13), (Positions(60, 40, 1), (50.0,), 2)])
def test_state_fits_its_schema(kind, row, n):
    tail: list[float] = []
    state, out = kind.start, None
    for i in range(20):
        state, out = kind.step(tuple(state), tail, (i, *row), True)
        assert len(state) == len(kind.kept.split(", ")) and len(tail) <= 8
        assert out is None or len(out) + 2 == len(kind.out)
