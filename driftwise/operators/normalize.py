"""Rolling min-max / z-score normalisation over the last N numeric values per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import numeric_field, parsed, payload_kind, set_field
from ..plans.rolling import Frame, materialize, over_rows

ORDER = ("timestamp", "event_id")
METHODS = ("min_max", "z_score")
STD_FLOOR = 1e-8


def normalize(
    df: DataFrame,
    fields: Sequence[str],
    method: str = "min_max",
    window_size: int = 100,
    key: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    split: bool = True,
    suffix: str = "_normalized",
) -> DataFrame:
    """Add ``<field>_normalized`` (column and payload key) per field.

    The state is the last ``window_size`` numeric values of the field for the key
    (rows without a numeric value neither enter it nor get an output).
    * ``min_max``: (v - min) / (max - min); nothing when min == max.
    * ``z_score``: (v - mean) / max(std_pop, 1e-8); needs at least 2 values.
    The default key is ``source`` because the reference keeps one state per
    source pipeline; the planner splits such hot keys into blocks.
    """
    if method not in METHODS:
        raise ValueError(f"unknown normalize method {method!r}")
    names = {f: f"{f}{suffix}" for f in fields}
    vs = {f: f"_v{i}" for i, f in enumerate(fields)}
    text = payload_kind(df) == "json" and not df.isStreaming
    if text:  # dealt out first: few input splits would leave the decoding few tasks
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism, *dict.fromkeys([*key, *order]))
    decoded, held = parsed(df)
    tagged = decoded.select(*df.columns, *[numeric_field(decoded, f, held).alias(v) for f, v in vs.items()])
    if text:  # the passes below would each decode it again
        tagged = materialize(tagged)
    if len(vs) == 1 or df.isStreaming:
        return _one_by_one(tagged, names, vs, method, window_size, key, order, split)
    # rows lacking a field must not count for its frame: a table in which every row has
    # all fields is normalised in one pass, else the fields that are sometimes missing
    # are done for themselves
    missing = tagged.agg(*[F.max(F.col(v).isNull()).alias(v) for v in vs.values()]).first()
    full = {f: v for f, v in vs.items() if not missing[v]}
    if full:
        def build(fr: Frame):
            return [_scaled(fr, v, method, window_size).alias(names[f]) for f, v in full.items()]

        tagged = over_rows(tagged, key, order, window_size - 1, build, split=split)
        for f in full:
            tagged = tagged.withColumn("payload", set_field(tagged, names[f], F.col(names[f])))
    return _one_by_one(tagged, names, {f: v for f, v in vs.items() if f not in full}, method, window_size, key, order,
                       split).drop(*vs.values())


def _scaled(fr: Frame, v: str, method: str, window_size: int):
    w = fr.rows(window_size)
    if method == "min_max":
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        return F.when(hi != lo, (F.col(v) - lo) / (hi - lo))
    std = F.greatest(F.sqrt(F.var_pop(v).over(w)), F.lit(STD_FLOOR))
    return F.when(F.count(v).over(w) > 1, (F.col(v) - F.avg(v).over(w)) / std)


def _one_by_one(tagged, names, vs, method, window_size, key, order, split):
    """Fields with missing values: the frame runs over the rows that have the field."""
    out = tagged
    for field, v in vs.items():
        name = names[field]
        has = out.filter(F.col(v).isNotNull())
        rest = out.filter(F.col(v).isNull()).withColumn(name, F.lit(None).cast("double"))
        done = over_rows(has, key, order, window_size - 1,
                         lambda fr, v=v, name=name: [_scaled(fr, v, method, window_size).alias(name)], split=split)
        merged = done.unionByName(rest)
        out = merged.withColumn("payload", set_field(merged, name, F.col(name)))
    return out.drop(*vs.values())
