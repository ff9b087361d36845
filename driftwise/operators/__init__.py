"""Operator registry: name -> factory(config) -> (DataFrame -> DataFrame)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from .bars import aggregate
from .features import extract_features
from .normalize import normalize
from .validate import add_timestamp, drop_malformed, validate_schema

log = logging.getLogger(__name__)

Operator = Callable[[DataFrame], DataFrame]


def _validate(cfg: Mapping) -> Operator:
    return lambda df: validate_schema(df, strict=cfg.get("strict", True))


def _add_timestamp(cfg: Mapping) -> Operator:
    return lambda df: add_timestamp(df, field=cfg.get("field", "processing_time"))


def _drop_malformed(cfg: Mapping) -> Operator:
    return lambda df: drop_malformed(df, cfg.get("required_payload_fields", []))


def _normalize(cfg: Mapping) -> Operator:
    return lambda df: normalize(df, cfg.get("fields", []), method=cfg.get("method", "min_max"),
                                window_size=cfg.get("window_size", 100), key=tuple(cfg.get("key", ("source",))))


def _aggregate(cfg: Mapping) -> Operator:
    return lambda df: aggregate(df, window=cfg.get("window", "1m"), method=cfg.get("method", "ohlcv"),
                                watermark=cfg.get("watermark"))


def _features(cfg: Mapping) -> Operator:
    return lambda df: extract_features(df, cfg.get("features", []), window_size=cfg.get("window_size", 20),
                                       key=tuple(cfg.get("key", ("source", "type"))))


OPERATORS: dict[str, Callable[[Mapping], Operator]] = {
    "validate_schema": _validate,
    "add_timestamp": _add_timestamp,
    "drop_malformed": _drop_malformed,
    "normalize_price": _normalize,
    "aggregate": _aggregate,
    "extract_features": _features,
}


def register_operator(name: str, factory: Callable[[Mapping], Operator]) -> None:
    OPERATORS[name] = factory


def get_operator(name: str, config: Mapping | None = None) -> Operator | None:
    """The configured operator, or None for an unknown name."""
    factory = OPERATORS.get(name)
    return factory(dict(config or {})) if factory else None


__all__ = ["OPERATORS", "aggregate", "add_timestamp", "drop_malformed", "extract_features", "get_operator",
           "normalize", "register_operator", "validate_schema"]
