"""Row-frame features and bars against plain-Python models of the reference's
per-event semantics."""

import pytest

from driftwise.functions.timefmt import parse_duration
from driftwise.operators.bars import aggregate, flatten_bars
from driftwise.operators.features import extract_features
from driftwise.operators.normalize import normalize
from tests.conftest import events


def model_features(closes, features, window_size=20):
    """Sequential model: history of payloads (None = row without close)."""
    hist, out = [], []
    for c in closes:
        hist.append(c)
        hist = hist[-2 * window_size:]
        row = {}
        for f in features:
            kind, p = f.split("_")[0], int(f.split("_")[1])
            if c is None:
                continue
            vals = [0.0 if x is None else x for x in hist]
            if kind == "sma" and len(hist) >= p:
                row[f] = sum(vals[-p:]) / p
            elif kind == "ema" and len(hist) >= p:
                a = 2 / (p + 1)
                e = vals[-p]
                for x in vals[-p + 1:]:
                    e = a * x + (1 - a) * e
                row[f] = e
            elif kind == "rsi" and len(hist) >= p + 1:
                cs = vals[-(p + 1):]
                g = sum(max(cs[i] - cs[i - 1], 0) for i in range(1, len(cs))) / p
                lo = sum(max(cs[i - 1] - cs[i], 0) for i in range(1, len(cs))) / p
                row[f] = 100 if lo == 0 else 100 - 100 / (1 + g / lo)
        out.append(row)
    return out


@pytest.mark.parametrize("closes", [
    [10, 11, 12, 11, 10, 9, 10, 11, 13, 12, 12, 14, 15, 13, 12, 11, 10, 9, 9, 10],
    [5.0] * 20,                                   # constant series: RSI 100
    [1, None, 3, 4, None, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20],  # rows without close
    [3, 1],                                       # fewer rows than any period
])
def test_features_match_model(spark, closes):
    feats = ["sma_3", "ema_4", "rsi_5", "sma_50", "bogus", "rsi_x"]
    rows = [(f"e{i:03d}", "s", "t", i, (None, None, None if c is None else float(c))) for i, c in enumerate(closes)]
    df = events(spark, rows)
    got = {r.event_id: r for r in extract_features(df, feats, window_size=20).collect()}
    want = model_features(closes, ["sma_3", "ema_4", "rsi_5", "sma_50"])
    for i, w in enumerate(want):
        r = got[f"e{i:03d}"]
        for f in ("sma_3", "ema_4", "rsi_5"):
            if f in w:
                assert r[f] == pytest.approx(w[f], abs=1e-9), (i, f)
            else:
                assert r[f] is None, (i, f)
        assert "sma_50" in r.asDict()  # the lookback follows the period asked for


def test_normalize_edges(spark):
    rows = [(f"e{i}", "s", "t", i, (v, None, None)) for i, v in enumerate([5.0, 5.0, 7.0, None, 6.0])]
    got = {r.event_id: r.price_normalized for r in normalize(events(spark, rows), ["price"], window_size=3).collect()}
    assert got["e0"] is None and got["e1"] is None  # min == max
    assert got["e2"] == pytest.approx(1.0)
    assert got["e3"] is None  # no value: no output, not in the state
    assert got["e4"] == pytest.approx(0.5)  # window = [5, 7, 6]
    z = {r.event_id: r.price_normalized for r in
         normalize(events(spark, rows), ["price"], method="z_score", window_size=3).collect()}
    assert z["e0"] is None and z["e1"] == pytest.approx(0.0)


def test_parse_duration():
    assert parse_duration("30s") == 30 and parse_duration("5m") == 300 and parse_duration("2h") == 7200
    assert parse_duration("1d") == 60  # unknown unit -> one minute, as the reference


def test_bars(spark):
    rows = [
        ("a", "s", "t", 0, (10.0, 1.0, None)), ("b", "s", "t", 30, (12.0, 2.0, None)),
        ("c", "s", "t", 30, (9.0, 1.0, None)),  # same second: event_id breaks the tie
        ("d", "s", "t", 59, (11.0, None, None)), ("e", "s", "t", 61, (None, 5.0, None)),
        ("f", "s", "u", 70, (3.0, 1.0, None)),
    ]
    got = {(r.type, r.window_start.second + 60 * r.window_start.minute): r
           for r in flatten_bars(aggregate(events(spark, rows), window="1m")).collect()}
    assert set(got) == {("t_aggregated", 0), ("u_aggregated", 60)}  # window of e has no price -> no bar
    b = got[("t_aggregated", 0)]
    assert (b.open, b.high, b.low, b.close, b.volume, b["count"], b.event_id) == (10.0, 12.0, 9.0, 11.0, 4.0, 4, "d")
