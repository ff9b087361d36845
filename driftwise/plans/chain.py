"""Config-driven preprocessing: a ``default`` chain for every event, then a
chain per source. Each chain is DataFrame transforms; per-source chains run on
``filter(source == s)`` slices and are fanned back in with ``unionByName``
(missing columns null), so Catalyst still sees one plan."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import Operator, get_operator

log = logging.getLogger(__name__)


def _build(ops: Sequence[Mapping]) -> list[Operator]:
    out = []
    for spec in ops or []:
        op = get_operator(spec.get("name"), spec.get("config", {}))
        if op is None:
            log.warning("Unknown operator: %s", spec.get("name"))
            continue
        out.append(op)
    return out


class Pipeline:
    """``Pipeline(config).transform(df)``; config as in the reference
    (``{"default": [...], "pipelines": [{"source": s, "operators": [...]}]}``,
    optionally nested under ``"preprocessing"``)."""

    def __init__(self, config: Mapping):
        cfg = config.get("preprocessing", config)
        self.default = _build(cfg.get("default", []))
        self.by_source: dict[str, list[Operator]] = {}
        for p in cfg.get("pipelines", []) or []:
            if p.get("source"):
                self.by_source[p["source"]] = _build(p.get("operators", []))

    @staticmethod
    def _chain(df: DataFrame, ops: Sequence[Operator]) -> DataFrame:
        return reduce(lambda d, op: op(d), ops, df)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._chain(df, self.default)
        if not self.by_source:
            return out
        parts = [self._chain(out.filter(F.col("source") == s), ops) for s, ops in self.by_source.items()]
        rest = out.filter(~F.col("source").isin(list(self.by_source)) | F.col("source").isNull())
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, rest)
