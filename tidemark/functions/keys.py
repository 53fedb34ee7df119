"""Row keys: canonical JSON, content hash, business keys, derived names."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXTS = (T.StringType, T.BinaryType)

# Characters replaced in the canonical text, in this order.
HTML_ESCAPES = (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"))
# chr() takes its argument modulo 256, so chr(8232) and chr(8233) are the parentheses.
SEPARATOR_ESCAPES = {
    "literal": (("(", "\\u2028"), (")", "\\u2029")),
    "unicode": (("\u2028", "\\u2028"), ("\u2029", "\\u2029")),
}


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _quoted(name: str) -> Column:
    return F.col(_sql_name(name))


def _number_text(name: str, dtype: T.DataType) -> Column | None:
    """A number as canonical JSON text; None for types that need the detour.

    `23.0` is `23`, `1.50` is `1.5`. Doubles keep their exponents, floats print theirs as doubles
    do, NaN and infinities are strings. Decimals of more than six places can print with an
    exponent, so they are left to the detour. Written as SQL: a wide table has hundreds of
    columns, and each function call costs the driver a round trip.
    """
    c = _sql_name(name)
    text = f"string({c})"
    if isinstance(dtype, T.DecimalType) and dtype.scale <= 6:
        if dtype.scale > 0:
            text = f"rtrim('.', rtrim('0', {text}))"
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        exponent = f"WHEN contains({text}, 'E') THEN string(double({text}))"
        text = f"""CASE
            WHEN isnan({c}) OR abs({c}) = double('Infinity') THEN concat('"', {text}, '"')
            WHEN {c} = 0 THEN '0'
            WHEN endswith({text}, '.0') THEN substr({text}, 1, length({text}) - 2)
            {exponent if isinstance(dtype, T.FloatType) else ""}
            ELSE {text} END"""
    elif not isinstance(dtype, INTEGERS):
        return None
    return F.expr(f"coalesce({text}, 'null')")


def _printed(*members: str) -> Column:
    return F.expr(f"to_json(struct({', '.join(members)}), map('ignoreNullFields', 'false', 'timeZone', 'UTC'))")


def _inside(json_object: Column, skip: int = 1) -> Column:
    """A JSON object without its first `skip` characters and its last."""
    return json_object.substr(F.lit(skip + 1), F.length(json_object) - skip - 1)


def _special(name: str) -> bool:
    return any(char in name for escapes in (HTML_ESCAPES, *SEPARATOR_ESCAPES.values()) for char, _ in escapes)


def _members(
    df: DataFrame, columns: Sequence[str] | None, escape: Callable[[Column], Column]
) -> list[Column]:
    """Escaped JSON members, one or several columns each, in byte order of the names.

    Numbers are printed by a cast, which is far cheaper than a JSON writer. Adjacent texts share
    one `to_json`, and so do adjacent times. Nested values and long decimals take the detour over
    VARIANT, which drops trailing zeros and sorts nested members. Numbers and times hold
    none of the escaped characters, so only free text and odd names are searched for them.
    """
    names = list(columns) if columns is not None else df.columns
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate column names cannot be keyed: {names}")
    types = {f.name: f.dataType for f in df.schema.fields}
    members: list[Column] = []
    run: list[str] = []

    def labelled(name: str, value: Column) -> Column:
        label = F.lit(json.dumps(name, ensure_ascii=False) + ":")
        return F.concat(escape(label) if _special(name) else label, value)

    def close_run() -> None:
        if len(run) == 1:  # the name need not be searched
            value = _inside(_printed(f"{_sql_name(run[0])} AS v"), skip=5)
            members.append(labelled(run[0], escape(value) if isinstance(types[run[0]], TEXTS) else value))
        elif run:
            members.append(escape(_inside(_printed(*map(_sql_name, run)))))
        run.clear()

    for name in sorted(names, key=lambda n: n.encode("utf-8")):
        dtype = types[name]
        if isinstance(dtype, TEXTS + TIMES):
            if run and isinstance(dtype, TEXTS) != isinstance(types[run[0]], TEXTS):
                close_run()
            run.append(name)
            continue
        close_run()
        number = _number_text(name, dtype)
        if number is not None:
            members.append(labelled(name, number))
        else:
            members.append(escape(_inside(F.to_json(F.parse_json(_printed(_sql_name(name)))))))
    close_run()
    return members


def _object(members: Sequence[Column]) -> Column:
    parts = [F.lit("{")]
    for member in members:
        parts += [F.lit(","), member] if len(parts) > 1 else [member]
    return F.concat(*parts, F.lit("}"))


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as JSON text: every column, nulls kept, members in byte order of their names.

    Numbers are in normal form (no trailing zeros), so rows that differ only in decimal scale
    share a text. The member order is known from the schema, so no map is built or sorted per row.
    """
    return _object(_members(df, columns, lambda text: text))


def json_escape(text: Column, separators: str = "literal") -> Column:
    """Replace `& < >` and the two separators by their `\\uXXXX` texts.

    `separators="literal"` replaces parentheses, `"unicode"` replaces U+2028 and U+2029.
    """
    for char, escape in HTML_ESCAPES + SEPARATOR_ESCAPES[separators]:
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def row_key(df: DataFrame, columns: Sequence[str] | None = None, separators: str = "literal") -> Column:
    """SHA-256 of the whole escaped row, lowercase hex: any change of any column gives another key.

    Instants are printed in UTC, so the key does not depend on the session's time zone.

    The text is never null; `coalesce` tells the optimizer so, which otherwise adds a null test
    before joins and thereby computes the key twice.
    """
    text = _object(_members(df, columns, lambda t: json_escape(t, separators)))
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def business_key(*columns: str | Column) -> Column:
    """Parts joined by `_`; null as soon as one part is null."""
    parts: list[Column] = []
    for c in columns:
        if parts:
            parts.append(F.lit("_"))
        parts.append((_quoted(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts)


def single_column_key(column: str) -> Column:
    return _quoted(column).cast("string")


def with_key(df: DataFrame, key: Column | None = None, name: str = "key") -> DataFrame:
    """The key column first, then every source column. Default key: `row_key`."""
    if name in df.columns:
        raise ValueError(f"source already has a column named {name!r}")
    return df.select((row_key(df) if key is None else key).alias(name), "*")


def derived_names(
    table: Column,
    domain: str,
    view_prefix: str,
    table_suffix: str,
    pascal: bool = True,
    view_suffix: str | None = None,
) -> dict[str, Column]:
    """View, sink table and query name of a table id; the view ends in the domain by default."""
    stem = F.concat(F.upper(table.substr(1, 1)), F.lower(F.substr(table, F.lit(2))))
    return {
        "view_name": F.concat(F.lit(view_prefix), F.lower(table), F.lit(f"_{view_suffix or domain}")),
        "table_name": F.concat(F.lit("tb_"), stem if pascal else table, F.lit(table_suffix)),
        "query_name": F.concat(F.lit(f"extract-{domain}-"), table),
    }
