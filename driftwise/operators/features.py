"""Moving-average / momentum features over the last p rows per key: sma_p, ema_p, rsi_p."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import numeric_field, set_field
from ..plans.rolling import Frame, over_rows

KEY = ("source", "type")
ORDER = ("timestamp", "event_id")
_NAME = re.compile(r"^(sma|ema|rsi)_(\d+)$")


def parse_features(features: Sequence[str]) -> list[tuple[str, str, int]]:
    """``["sma_5", "ema_20", "rsi_14", "junk"]`` -> [(name, kind, period)];
    unknown or unparsable names are ignored, periods must be >= 1."""
    out = []
    for f in features:
        m = _NAME.match(str(f))
        if m and int(m.group(2)) >= 1:
            out.append((f, m.group(1), int(m.group(2))))
    return out


def ema_weights(period: int) -> list[float]:
    """Weights of lag 0..p-1 for an EMA (alpha = 2/(p+1)) seeded at the oldest of
    the last p values and run forward to the current one."""
    alpha = 2.0 / (period + 1)
    ws = [alpha * (1 - alpha) ** j for j in range(period - 1)]
    ws.append((1 - alpha) ** (period - 1))
    return ws


def extract_features(
    df: DataFrame,
    features: Sequence[str],
    window_size: int = 20,
    value: str = "close",
    key: Sequence[str] = KEY,
    order: Sequence[str] = ORDER,
    split: bool = True,
) -> DataFrame:
    """Add each feature as a column (and payload key) on rows with a numeric ``value``.

    The history is every row of the key (rows without the value count as 0). Each
    feature looks back as far as its own period asks; ``window_size`` is accepted for
    configs that carry it and bounds nothing (the reference caps its list there).
    * ``sma_p``: mean of the last p values (needs p rows).
    * ``ema_p``: alpha = 2/(p+1), seeded with the oldest of the last p values.
    * ``rsi_p``: simple means of gains and losses over the last p differences
      (needs p+1 rows); no losses -> 100.
    """
    specs = parse_features(features)
    if not specs:
        return df
    need = max((p + 1 if k == "rsi" else p) for _, k, p in specs)
    # outputs go to rows carrying a numeric ``value`` (a null or text value would
    # make the reference's arithmetic fail on that event)
    x = df.withColumn("_x", F.coalesce(numeric_field(df, value), F.lit(0.0))).withColumn(
        "_has", numeric_field(df, value).isNotNull()
    )

    def build(fr: Frame):
        first: list[Column] = [F.lag("_x", 1).over(fr.w).alias("_prev")]
        second: list[Column] = []
        for name, kind, p in specs:
            if kind == "sma":
                val = F.when(fr.rn >= p, F.avg("_x").over(fr.rows(p)))
            elif kind == "ema":
                terms = [F.lit(wt) * (F.col("_x") if j == 0 else F.lag("_x", j).over(fr.w))
                         for j, wt in enumerate(ema_weights(p))]
                val = F.when(fr.rn >= p, sum(terms[1:], terms[0]))
            else:
                d = F.col("_x") - F.col("_prev")
                gain = F.sum(F.greatest(d, F.lit(0.0))).over(fr.rows(p)) / p
                loss = F.sum(F.greatest(-d, F.lit(0.0))).over(fr.rows(p)) / p
                val = F.when(fr.rn >= p + 1, F.when(loss == 0, F.lit(100.0)).otherwise(
                    F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss)))
            second.append(F.when(F.col("_has"), val).alias(name))
        return [first, second]

    out = over_rows(x, key, order, need - 1, build, split=split)
    for name, _, _ in specs:
        out = out.withColumn("payload", set_field(out, name, F.col(name)))
    return out.drop("_x", "_has", "_prev")
