"""Detector registry and the pattern engine: each configured detector sees the
events of its source and emits pattern rows; outputs are unioned."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detectors.adwin import adwin_step
from ..detectors.adwin_merged import CHUNK, adwin_merged_step
from ..detectors.cluster import cluster_step
from ..detectors.common import ORDER
from ..detectors.drift import drift_step
from ..detectors.hst import anomaly_step, detect_anomaly
from ..detectors.series import State
from ..functions.payload import numeric_field
from .rolling import materialize

log = logging.getLogger(__name__)

# One step of a detector: its rows and the state of the last step to patterns and new state.
Step = Callable[[DataFrame, State | None], tuple[DataFrame, dict[str, DataFrame]]]


def _fields(cfg: Mapping) -> list[str]:
    # the reference's configs use both "fields" and "features" for the same thing
    return list(cfg.get("fields") or cfg.get("features") or [])


def _rows(cfg: Mapping) -> dict:
    """``key`` and ``order`` of a detector's row sequence; by default one per source."""
    return {k: tuple(cfg[k]) for k in ("key", "order") if cfg.get(k)}


@dataclass(frozen=True)
class Detector:
    """A configured detector. Called with rows it returns their patterns; ``step`` goes on
    from an earlier step's state."""

    name: str
    fields: tuple[str, ...]
    columns: tuple[str, ...]  # key and order columns it needs
    step: Step
    whole: Callable[[DataFrame], DataFrame] | None = None  # form that needs all rows at once

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.whole(df) if self.whole else self.step(df, None)[0]


def _detector(name: str, cfg: Mapping, step, whole=None, **params) -> Detector:
    rows = _rows(cfg)
    columns = tuple(dict.fromkeys([*rows.get("key", ("source",)), *rows.get("order", ORDER), "event_id", "source", "timestamp"]))
    fields = tuple(_fields(cfg))
    return Detector(name, fields, columns, lambda df, state: step(df, state, list(fields), detector=name, **params, **rows), whole)


def _adwin(name: str, cfg: Mapping) -> Detector:
    """``method``: ``adwin`` (exact, a key is one task; the default), ``merged`` (mergeable
    buckets, chunks of a key run in parallel) or ``adjacent`` (two adjacent frames)."""
    params = dict(delta=cfg.get("delta", 0.002), grace_period=cfg.get("grace_period", 100))
    if cfg.get("method", "adwin") == "adjacent":
        return _detector(name, cfg, drift_step, frame=cfg.get("frame", 50), **params)
    if cfg.get("method") == "merged":
        return _detector(name, cfg, adwin_merged_step, chunk=cfg.get("chunk", CHUNK), **params)
    return _detector(name, cfg, adwin_step, **params)


def _hst(name: str, cfg: Mapping) -> Detector:
    """``scale``: ``first`` (range of a key's first window, the default), ``none``, or ``all``
    (range of all rows, for a run over a whole table only)."""
    params = dict(n_trees=cfg.get("n_trees", 10), height=cfg.get("height", 8), window_size=cfg.get("window_size", 100),
                  threshold=cfg.get("threshold", 0.95), seed=cfg.get("seed", 0))
    scale, whole = cfg.get("scale", "first"), None
    if scale == "all":
        whole = lambda df: detect_anomaly(df, _fields(cfg), detector=name, **params, **_rows(cfg))
    return _detector(name, cfg, anomaly_step, whole, scale=scale, **params)


def _cluster(name: str, cfg: Mapping) -> Detector:
    return _detector(name, cfg, cluster_step, n_clusters=cfg.get("n_clusters", 4), window_size=cfg.get("window_size", 50),
                     threshold=cfg.get("threshold", 0.3), centroids=cfg.get("centroids"))


DETECTORS: dict[str, Callable[[str, Mapping], Detector]] = {
    "adwin": _adwin,
    "half_space_trees": _hst,
    "cluster_detector": _cluster,
}


def get_detector(name: str, detector_type: str, config: Mapping | None = None) -> Detector | None:
    factory = DETECTORS.get(detector_type)
    return factory(name, dict(config or {})) if factory else None


class PatternEngine:
    """``PatternEngine(config).detect(clean_df)`` -> pattern rows of all detectors;
    ``step`` does the same batch by batch."""

    def __init__(self, config: Mapping):
        self.detectors: list[tuple[str, Detector]] = []
        for d in config.get("detectors", []) or []:
            det = get_detector(d.get("name"), d.get("type"), d.get("config", {}))
            if det is None:
                log.warning("Unknown detector type: %s", d.get("type"))
                continue
            self.detectors.append((d.get("source"), det))

    def shared(self, df: DataFrame) -> DataFrame:
        """The rows and values that the detectors use, read and decoded once for all of them:
        events of their sources, their key and order columns, and the numeric fields."""
        fields = list(dict.fromkeys(f for _, d in self.detectors for f in d.fields))
        columns = list(dict.fromkeys(c for _, d in self.detectors for c in d.columns if c in df.columns))
        sources = list(dict.fromkeys(s for s, _ in self.detectors))
        rows = df.filter(F.col("source").isin(sources)).select(
            *columns, F.struct(*[numeric_field(df, f).alias(f) for f in fields]).alias("payload"))
        # few input splits would leave the detectors few tasks
        return materialize(rows.repartition(df.sparkSession.sparkContext.defaultParallelism))

    def detect(self, df: DataFrame) -> DataFrame | None:
        if not self.detectors:
            return None
        rows = self.shared(df)
        return reduce(lambda a, b: a.unionByName(b), [det(rows.filter(F.col("source") == src)) for src, det in self.detectors])

    def step(self, df: DataFrame, states: Mapping[str, State]) -> tuple[DataFrame | None, dict[str, dict[str, DataFrame]]]:
        """Patterns of a batch and the detectors' new states, by the detector's place."""
        if not self.detectors:
            return None, {}
        rows, found, out = self.shared(df), [], {}
        for i, (src, det) in enumerate(self.detectors):
            patterns, out[f"detector{i}"] = det.step(rows.filter(F.col("source") == src), states.get(f"detector{i}"))
            found.append(patterns)
        return reduce(lambda a, b: a.unionByName(b), found), out
