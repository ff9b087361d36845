"""Field access on the event payload, whatever its physical form.

A payload is one of
* STRUCT  - typed fast path (driver tables, parsed feeds); a key is present when
  the struct declares it, a value may still be null;
* VARIANT - schemaless JSON in Spark's binary form;
* STRING  - JSON text at rest; it is read through ``try_parse_json`` (bad JSON -> null).

All helpers return Column expressions chosen at plan time from the schema, so the
work stays in Catalyst/codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A JSON value counts as numeric when it is an integer, a decimal, a float or a
# boolean (booleans are numbers in the reference's type test).
_NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType,
)
# Over a value with its type, so that neither is worked out again for each test.
_VARIANT_NUMBER_SQL = (
    "transform(transform(array({v}), x -> struct(x AS v, schema_of_variant(x) AS t)), x -> CASE"
    " WHEN x.t = 'BOOLEAN' THEN CAST(try_variant_get(x.v, '$', 'boolean') AS double)"
    " WHEN x.t IN ('TINYINT','SMALLINT','INT','BIGINT','FLOAT','DOUBLE') OR x.t LIKE 'DECIMAL%'"
    " THEN try_variant_get(x.v, '$', 'double') END)[0]"
)


def _path(field: str) -> str:
    return "$." + field if field.isidentifier() else "$['" + field.replace("'", "\\'") + "']"


def payload_kind(df: DataFrame, col: str = "payload") -> str:
    dt = df.schema[col].dataType
    if isinstance(dt, T.StructType):
        return "struct"
    if isinstance(dt, T.VariantType):
        return "variant"
    if isinstance(dt, T.StringType):
        return "json"
    if isinstance(dt, T.MapType):
        return "map"
    raise TypeError(f"unsupported payload type {dt.simpleString()}")


def _variant_item(df: DataFrame, field: str, col: str) -> Column:
    src = f"try_parse_json(`{col}`)" if payload_kind(df, col) == "json" else f"`{col}`"
    return F.expr(f"variant_get({src}, '{_path(field)}')")


def has_field(df: DataFrame, field: str, col: str = "payload") -> Column:
    """True when the key is present (a JSON null value still counts as present)."""
    kind = payload_kind(df, col)
    if kind == "struct":
        return F.col(col).isNotNull() & F.lit(field in df.schema[col].dataType.fieldNames())
    if kind == "map":
        return F.map_contains_key(F.col(col), F.lit(field))
    return _variant_item(df, field, col).isNotNull()


def numeric_field(df: DataFrame, field: str, col: str = "payload") -> Column:
    """The field as DOUBLE when it is present and numeric (bool -> 1.0/0.0), else null.

    Numeric *text* such as ``"5"`` is not numeric, as in the reference.
    """
    kind = payload_kind(df, col)
    if kind == "struct":
        st = df.schema[col].dataType
        if field not in st.fieldNames():
            return F.lit(None).cast("double")
        ftype = st[field].dataType
        if isinstance(ftype, _NUMERIC_TYPES):
            return F.col(f"{col}.`{field}`").cast("double")
        return F.lit(None).cast("double")
    if kind == "map":
        return F.col(col).getItem(field).cast("double")
    src = f"try_parse_json(`{col}`)" if kind == "json" else f"`{col}`"
    return F.expr(_VARIANT_NUMBER_SQL.format(v=f"variant_get({src}, '{_path(field)}')"))


def parsed(df: DataFrame, col: str = "payload") -> tuple[DataFrame, str]:
    """The rows and the column to take several fields from: JSON text is parsed once, into
    a VARIANT column; other forms stay as they are."""
    if payload_kind(df, col) != "json":
        return df, col
    return df.withColumn(f"_{col}", F.try_parse_json(F.col(col))), f"_{col}"


def payload_json(df: DataFrame, col: str = "payload") -> Column:
    """Payload rendered as JSON text (the at-rest form)."""
    kind = payload_kind(df, col)
    if kind == "json":
        return F.col(col)
    return F.to_json(F.col(col))


def set_field(df: DataFrame, field: str, value: Column, col: str = "payload") -> Column:
    """Payload with ``field`` set to ``value`` (null value -> payload unchanged).

    STRUCT payloads get a new struct field; JSON text payloads get the key
    appended (or replaced when present)."""
    kind = payload_kind(df, col)
    if kind == "struct":
        return F.col(col).withField(field, value)
    text = F.col(col) if kind == "json" else F.to_json(F.col(col))
    entry = F.concat(F.lit(f'"{field}":'), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))
    empty = F.regexp_like(text, F.lit(r"^\s*\{\s*\}\s*$"))
    appended = F.when(empty, F.concat(F.lit("{"), entry, F.lit("}"))).otherwise(
        F.concat(F.regexp_replace(text, r"\s*\}\s*$", ""), F.lit(","), entry, F.lit("}"))
    )
    present = _variant_item(df, field, col).isNotNull() if kind == "json" else F.lit(False)
    return F.when(value.isNull(), text).when(present, replace_key(text, field, entry)).otherwise(appended)


def replace_key(text: Column, field: str, entry: Column) -> Column:
    """JSON object text with the top-level ``field`` replaced by the rendered ``entry``
    (``"field":value``). The object is parsed once, as a map of VARIANTs, so every other
    value is written back with its own type."""
    kept = F.map_filter(F.try_parse_json(text).cast("map<string,variant>"), lambda k, v: k != F.lit(field))
    rest = F.to_json(kept)
    return F.when(F.size(kept) == 0, F.concat(F.lit("{"), entry, F.lit("}"))).otherwise(
        F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(","), entry, F.lit("}")))
