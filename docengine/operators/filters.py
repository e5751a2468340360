"""The filter language: {"field": value}, {"field": {"$gt": a, "$lte": b}}, AND over fields.

Values are compared within a class only (number, string, boolean, list); a class mismatch is false, never a cast. Null
and missing fields equal None and satisfy no inequality. A field name is taken literally first and as a dotted path
second. Conditions on typed columns are plain comparisons with literals of the column's own class, so they reach the
Parquet scan; documents in VARIANT get the same rules with a guard on the stored type.
"""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("$eq", "$gt", "$gte", "$lt", "$lte")
NUMBER, STRING, BOOLEAN, LIST, TIME, OTHER = "number", "string", "boolean", "list", "time", "other"


class FilterError(ValueError):
    """A filter that is not of the language."""


def literal_class(value) -> str:
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float, decimal.Decimal)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, (list, tuple)):
        return LIST
    if isinstance(value, (datetime.date, datetime.datetime)):
        return TIME
    return OTHER


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.ArrayType):
        return LIST
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIME
    return OTHER


def conditions(spec: Mapping) -> list[tuple[str, str, object]]:
    """(field, operator, value) of a filter, all of which must hold."""
    if not isinstance(spec, Mapping):
        raise FilterError("a filter is an object")
    out = []
    for field, wanted in spec.items():
        if not isinstance(field, str):
            raise FilterError(f"not a field name: {field!r}")
        if not isinstance(wanted, Mapping):
            out.append((field, "$eq", wanted))
            continue
        if not wanted:
            raise FilterError(f"no operator for {field!r}")
        for op, value in wanted.items():
            if op not in OPERATORS:
                raise FilterError(f"unknown operator {op!r} for {field!r}")
            if isinstance(value, Mapping):
                raise FilterError(f"{op} of {field!r} compares with an object")
            out.append((field, op, value))
    return out


def resolve(schema: T.StructType, field: str) -> tuple[Column, T.DataType] | None:
    """The column of a field: the literal name first, then a path through structs and maps; names are case-sensitive."""

    def inside(kind: T.DataType, at: Column | None, rest: str) -> tuple[Column, T.DataType] | None:
        if isinstance(kind, T.StructType):
            by_name = {f.name: f.dataType for f in kind.fields}
            cuts = [len(rest), *(i for i in range(len(rest) - 1, 0, -1) if rest[i] == ".")]
            for cut in cuts:
                name, left = rest[:cut], rest[cut + 1 :]
                if name in by_name:
                    quoted = name.replace("`", "``")
                    found = F.col(f"`{quoted}`") if at is None else at.getField(name)
                    if not left:
                        return found, by_name[name]
                    if deeper := inside(by_name[name], found, left):
                        return deeper
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and at is not None:
            return F.try_element_at(at, F.lit(rest)), kind.valueType
        return None

    return inside(schema, None, field)


def _compare(op: str, left: Column, right: Column) -> Column:
    return {"$gt": left > right, "$gte": left >= right, "$lt": left < right, "$lte": left <= right}[op]


def _whole(op: str, column: Column, value: float) -> Column:
    """A whole-number column against a fraction, in whole numbers, so that nothing is lost beyond 2**53."""
    if math.isnan(value):
        return F.lit(False)
    if math.isinf(value):
        return column.isNotNull() & F.lit((value > 0) == (op in ("$lt", "$lte"))) if op != "$eq" else F.lit(False)
    if op == "$eq":
        return _number(op, column, int(value)) if value == int(value) else F.lit(False)
    if value == int(value):
        return _number(op, column, int(value))
    return column > math.floor(value) if op in ("$gt", "$gte") else column < math.ceil(value)


def _number(op: str, column: Column, value) -> Column:
    right = F.lit(value) if abs(value) < 1 << 63 else F.lit(decimal.Decimal(value))
    return column.eqNullSafe(right) if op == "$eq" else _compare(op, column, right)


def typed_condition(column: Column, kind: T.DataType, op: str, value, contains: bool = False, python_bool_eq: bool = False) -> Column:
    if value is None:
        if op != "$eq":
            return F.lit(False)
        return column.isNull()
    own, given = type_class(kind), literal_class(value)
    if given == OTHER:
        raise FilterError(f"cannot compare with {value!r}")
    if contains and own == LIST and given != LIST and op == "$eq":
        return F.exists(column, lambda x: F.coalesce(typed_condition(x, kind.elementType, "$eq", value), F.lit(False)))
    if python_bool_eq and {own, given} == {BOOLEAN, NUMBER} and op == "$eq":
        return column.cast("int").eqNullSafe(F.lit(int(value))) if own == BOOLEAN else typed_condition(column, kind, op, int(value))
    if own != given:
        return F.lit(False)
    if own == LIST:
        if op != "$eq":
            return F.lit(False)
        same = F.size(column).eqNullSafe(len(value))
        for i, item in enumerate(value):
            same = same & F.coalesce(typed_condition(F.get(column, F.lit(i)), kind.elementType, "$eq", list(item) if isinstance(item, tuple) else item), F.lit(False))
        return column.isNotNull() & same
    if own == NUMBER:
        if isinstance(value, float) and isinstance(kind, T.IntegralType):
            return _whole(op, column, value)
        if isinstance(value, float) and math.isnan(value):
            return F.lit(False)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            found = column.eqNullSafe(F.lit(float(value))) if op == "$eq" else _compare(op, column, F.lit(float(value)))
            return found & ~F.isnan(column) if op in ("$gt", "$gte") else found
        return _number(op, column, value)
    return column.eqNullSafe(F.lit(value)) if op == "$eq" else _compare(op, column, F.lit(value))


def compile_filter(spec: Mapping, schema: T.StructType, contains: bool = False, python_bool_eq: bool = False) -> Column:
    """The condition that a filter puts on rows with this schema; an empty filter is true."""
    whole = F.lit(True)
    for field, op, value in conditions(spec):
        found = resolve(schema, field)
        one = typed_condition(*found, op, value, contains, python_bool_eq) if found else F.lit(value is None and op == "$eq")
        whole = one if whole is None else whole & one
    return whole


# --- documents in VARIANT ---


def variant_path(name: str) -> str:
    if "'" not in name:
        return f"['{name}']"
    if '"' not in name:
        return f'["{name}"]'
    raise FilterError(f"cannot address {name!r}")


def variant_value(data: Column, field: str) -> Column:
    """A field's value as VARIANT: the literal name first, then the path; null if missing."""
    literal = F.try_variant_get(data, "$" + variant_path(field), "variant")
    if "." not in field:
        return literal
    return F.coalesce(literal, F.try_variant_get(data, "$" + "".join(variant_path(p) for p in field.split(".")), "variant"))


def variant_class(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), NUMBER)
        .when(kind == "STRING", STRING)
        .when(kind == "BOOLEAN", BOOLEAN)
        .when(kind.startswith("ARRAY"), LIST)
        .when(kind == "VOID", F.lit(None))
        .otherwise(F.when(kind.isNotNull(), OTHER))
    )


def variant_condition(value: Column, op: str, wanted, contains: bool = False) -> Column:
    if wanted is None:
        return (value.isNull() | F.is_variant_null(value)) if op == "$eq" else F.lit(False)
    given = literal_class(wanted)
    if given in (OTHER, TIME):
        raise FilterError(f"cannot compare with {wanted!r}")
    own = variant_class(value).eqNullSafe(given)
    if given == LIST:
        if op != "$eq":
            return F.lit(False)
        items = F.try_variant_get(value, "$", "array<variant>")
        same = F.size(items).eqNullSafe(len(wanted))
        for i, item in enumerate(wanted):
            same = same & F.coalesce(variant_condition(F.get(items, F.lit(i)), "$eq", item), F.lit(False))
        return own & same
    if given == NUMBER:
        if isinstance(wanted, float) and not math.isfinite(wanted):
            real = F.try_variant_get(value, "$", "double")
            return own & F.lit(not math.isnan(wanted)) & (real == F.lit(wanted) if op == "$eq" else _compare(op, real, F.lit(wanted)))
        exact, real = F.try_variant_get(value, "$", "decimal(38,9)"), F.try_variant_get(value, "$", "double")
        text = format(decimal.Decimal(repr(wanted)) if isinstance(wanted, float) else decimal.Decimal(wanted), "f")
        right = F.lit(text).try_cast("decimal(38,9)") if len(text.split(".")[0].lstrip("-")) <= 29 and len(text.partition(".")[2]) <= 9 else F.lit(None).cast("decimal(38,9)")
        floating = F.schema_of_variant(value).isin("FLOAT", "DOUBLE") | exact.isNull() | right.isNull()
        a = exact == right if op == "$eq" else _compare(op, exact, right)
        b = real == F.lit(float(wanted)) if op == "$eq" else _compare(op, real, F.lit(float(wanted)))
        found = own & F.coalesce(F.when(floating, b).otherwise(a), F.lit(False))
    else:
        held = F.try_variant_get(value, "$", "string" if given == STRING else "boolean")
        found = own & F.coalesce(held == F.lit(wanted) if op == "$eq" else _compare(op, held, F.lit(wanted)), F.lit(False))
    if contains and op == "$eq":
        items = F.try_variant_get(value, "$", "array<variant>")
        found = found | (variant_class(value).eqNullSafe(LIST) & F.coalesce(F.exists(items, lambda x: variant_condition(x, "$eq", wanted)), F.lit(False)))
    return found


def compile_variant_filter(spec: Mapping, data: Column, contains: bool = False) -> Column:
    whole = F.lit(True)
    for field, op, value in conditions(spec):
        whole = whole & variant_condition(variant_value(data, field), op, value, contains)
    return whole


def scoped(df: DataFrame, owner: str, principal) -> DataFrame:
    """A collection that shows only the principal's documents; later filters are added to this one."""
    return df.filter(compile_filter({owner: principal}, df.schema))
