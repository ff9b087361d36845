"""Keyed rolling state for streams (``applyInPandasWithState``).

State per key is JSON text: the last ``keep`` values (bounded ring buffer) and
the count of rows seen; a micro-batch's rows of the key are sorted by the order
columns, appended to the buffer, and the operator's formulas are evaluated with
NumPy over buffer + new rows. Memory per key is O(keep).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..detectors.adwin import Adwin, _change_pct
from ..functions.payload import numeric_field
from ..operators.features import ema_weights, parse_features

ORDER = ("timestamp", "event_id")


def _prep(df: DataFrame, key: Sequence[str], order: Sequence[str], value_cols: dict) -> DataFrame:
    return df.select(*[F.col(k) for k in key], "event_id", "timestamp",
                     *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order) if c not in ("event_id", "timestamp")],
                     *[v.alias(n) for n, v in value_cols.items()])


def _sort(pdf: pd.DataFrame, order: Sequence[str]) -> pd.DataFrame:
    cols = [c if c in ("event_id", "timestamp") else f"_o{i}" for i, c in enumerate(order)]
    return pdf.sort_values(cols, kind="mergesort")


def feature_values(xs: np.ndarray, last: int, kind: str, p: int) -> np.ndarray:
    """The feature for the ``last`` rows of a value sequence, NaN where it needs more rows
    than there are; all rows at once over a strided window."""
    out = np.full(last, np.nan)
    need = p + 1 if kind == "rsi" else p
    if len(xs) < need:
        return out
    frames = np.lib.stride_tricks.sliding_window_view(xs, need)[-last:]
    if kind == "sma":
        vals = frames.mean(axis=1)
    elif kind == "ema":
        vals = frames[:, ::-1] @ np.array(ema_weights(p))
    else:
        d = np.diff(frames, axis=1)
        gain, loss = d.clip(min=0).sum(axis=1) / p, (-d).clip(min=0).sum(axis=1) / p
        with np.errstate(divide="ignore", invalid="ignore"):
            vals = np.where(loss == 0, 100.0, 100.0 - 100.0 / (1.0 + gain / loss))
    out[last - len(vals):] = vals
    return out


def stream_features(df: DataFrame, features: Sequence[str], window_size: int = 20, value: str = "close",
                    key: Sequence[str] = ("source", "type"), order: Sequence[str] = ORDER) -> DataFrame:
    """Streaming SMA / EMA / RSI (same definitions as ``extract_features``)."""
    specs = parse_features(features)
    keep = max([p + 1 if k == "rsi" else p for _, k, p in specs] + [1])
    key = list(key)
    src = _prep(df, key, order, {"_x": F.coalesce(numeric_field(df, value), F.lit(0.0)), "_has": numeric_field(df, value).isNotNull()})
    out_schema = ", ".join([f"`{k}` string" for k in key] + ["event_id string", "timestamp timestamp"] +
                           [f"`{n}` double" for n, _, _ in specs])

    def fn(k, batches: Iterator[pd.DataFrame], state):
        buf, seen = (json.loads(state.get[0]) if state.exists else ([], 0))
        pdf = _sort(pd.concat(list(batches), ignore_index=True), order)
        xs = np.array(buf + pdf["_x"].astype(float).tolist())
        has = pdf["_has"].to_numpy(dtype=bool)
        res = {n: feature_values(xs, len(pdf), kind, p) for n, kind, p in specs}
        res = {n: [v if ok and v == v else None for v, ok in zip(vals.tolist(), has, strict=True)]
               for n, vals in res.items()}
        state.update((json.dumps([xs[-keep:].tolist(), seen + len(pdf)]),))
        out = pd.DataFrame({**{kc: [str(v) for v in [k[i]] * len(pdf)] for i, kc in enumerate(key)},
                            "event_id": pdf["event_id"].astype(str).values, "timestamp": pdf["timestamp"].values,
                            **{n: res[n] for n in res}})
        yield out

    return src.groupBy(*key).applyInPandasWithState(fn, out_schema, "buf string", "append",
                                                    GroupStateTimeout.NoTimeout)


def stream_normalize(df: DataFrame, field: str, method: str = "min_max", window_size: int = 100,
                     key: Sequence[str] = ("source",), order: Sequence[str] = ORDER) -> DataFrame:
    """Streaming rolling normalisation of one field (same as ``normalize``)."""
    key = list(key)
    src = _prep(df, key, order, {"_v": numeric_field(df, field)})
    name = f"{field}_normalized"
    out_schema = ", ".join([f"`{k}` string" for k in key] + ["event_id string", "timestamp timestamp",
                                                             f"`{name}` double"])

    def fn(k, batches, state):
        buf = json.loads(state.get[0]) if state.exists else []
        pdf = _sort(pd.concat(list(batches), ignore_index=True), order)
        vals = []
        for v in pdf["_v"].tolist():
            if v is None or (isinstance(v, float) and np.isnan(v)):
                vals.append(None)
                continue
            buf.append(float(v))
            buf = buf[-window_size:]
            a = np.array(buf)
            if method == "min_max":
                lo, hi = a.min(), a.max()
                vals.append(float((v - lo) / (hi - lo)) if hi != lo else None)
            else:
                vals.append(float((v - a.mean()) / max(a.std(), 1e-8)) if len(a) > 1 else None)
        state.update((json.dumps(buf),))
        yield pd.DataFrame({**{kc: [str(k[i])] * len(pdf) for i, kc in enumerate(key)},
                            "event_id": pdf["event_id"].astype(str).values, "timestamp": pdf["timestamp"].values,
                            name: vals})

    return src.groupBy(*key).applyInPandasWithState(fn, out_schema, "buf string", "append",
                                                    GroupStateTimeout.NoTimeout)


def stream_adwin(df: DataFrame, field: str, delta: float = 0.002, grace_period: int = 100,
                 key: Sequence[str] = ("source",), order: Sequence[str] = ORDER) -> DataFrame:
    """Streaming exact ADWIN on one field: drift rows as they happen."""
    key = list(key)
    src = _prep(df, key, order, {"_x": numeric_field(df, field)}).filter(F.col("_x").isNotNull())
    out_schema = ", ".join([f"`{k}` string" for k in key] + [
        "event_id string", "timestamp timestamp", "prev_mean double", "new_mean double", "change_pct double",
        "width long"])

    def fn(k, batches, state):
        if state.exists:
            text, seen = state.get
            det = Adwin.from_json(text, delta=delta)
        else:
            det, seen = Adwin(delta), 0
        pdf = _sort(pd.concat(list(batches), ignore_index=True), order)
        rows = []
        for eid, ts, x in zip(pdf["event_id"], pdf["timestamp"], pdf["_x"]):
            seen += 1
            if seen < grace_period:
                continue
            r = det.update(float(x))
            if r is not None:
                rows.append([*[str(v) for v in k], str(eid), ts, r[0], r[1], _change_pct(r[0], r[1]), det.width])
        state.update((det.to_json(), seen))
        cols = list(key) + ["event_id", "timestamp", "prev_mean", "new_mean", "change_pct", "width"]
        yield pd.DataFrame(rows, columns=cols)

    return src.groupBy(*key).applyInPandasWithState(fn, out_schema, "adwin string, seen long", "append",
                                                    GroupStateTimeout.NoTimeout)
