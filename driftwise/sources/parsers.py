"""Parsers by the name a source config gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.validate import parse_json_events
from .files import read_csv_events, read_json_events
from .messages import parse_chart, parse_trades

# File parsers take (spark, path, source, ...), message parsers a DataFrame of texts.
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "csv_parser": read_csv_events,
    "json_parser": read_json_events,
    "binance_trade_parser": parse_trades,
    "yahoo_finance_parser": parse_chart,
    "event_parser": parse_json_events,
}


def get_parser(name: str) -> Callable[..., DataFrame]:
    if name not in PARSERS:
        raise ValueError(f"Unknown parser: {name}")
    return PARSERS[name]
