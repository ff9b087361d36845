"""Column-expression helpers (JVM-side; no Python UDFs)."""

from .ids import fresh_id, stable_id
from .payload import has_field, numeric_field, payload_json
from .timefmt import display_text, iso_text, parse_duration, parse_iso

__all__ = [
    "display_text", "fresh_id", "has_field",
    "iso_text", "numeric_field", "parse_duration", "parse_iso", "payload_json",
    "stable_id",
]
