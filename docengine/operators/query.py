"""Queries on a collection: filter, sort, offset, limit, projection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.operators import filters

LIMIT, OFFSET = 100, 0


def _count(name: str, value) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} is a whole number from 0, not {value!r}")
    return value


@dataclass(frozen=True)
class QuerySpec:
    """A query's body; other members are ignored."""

    filter: Mapping = field(default_factory=dict)
    sort: tuple[tuple[str, int], ...] = ()
    limit: int = LIMIT
    offset: int = OFFSET
    fields: tuple[str, ...] | None = None

    @classmethod
    def of(cls, body: Mapping) -> QuerySpec:
        if not isinstance(body, Mapping):
            raise ValueError("a query is an object")
        sort = body.get("sort") or {}
        pairs = tuple(sort.items()) if isinstance(sort, Mapping) else tuple(map(tuple, sort))
        for name, way in pairs:
            if way not in (1, -1) or isinstance(way, bool):
                raise ValueError(f"sort {name!r} by 1 or -1, not {way!r}")
        spec = body.get("filter") or {}
        filters.conditions(spec)
        fields = body.get("fields")
        return cls(spec, pairs, _count("limit", body.get("limit", LIMIT)), _count("offset", body.get("offset", OFFSET)), None if fields is None else tuple(fields))


def _ways(columns: list[Column], way: int) -> list[Column]:
    """Nulls first going up, last going down."""
    return [c.asc_nulls_first() if way == 1 else c.desc_nulls_last() for c in columns]


def _variant_keys(value: Column) -> list[Column]:
    """Null, boolean, number, string, anything else; within a class by value."""
    kind = filters.variant_class(value)
    rank = F.when(kind == filters.BOOLEAN, 1).when(kind == filters.NUMBER, 2).when(kind == filters.STRING, 3).when(kind.isNotNull(), 4)
    return [rank, F.when(kind == filters.BOOLEAN, F.try_variant_get(value, "$", "boolean")), F.when(kind == filters.NUMBER, F.try_variant_get(value, "$", "double")), F.when(kind.isNotNull() & ~kind.isin(filters.BOOLEAN, filters.NUMBER), F.try_variant_get(value, "$", "string"))]


def ordered(df: DataFrame, sort, id_col: str, data: str | None = None) -> list[Column]:
    """Sort keys of a total order: the sort's fields, then the id."""
    out: list[Column] = []
    for name, way in sort:
        if data is not None:
            out += _ways(_variant_keys(filters.variant_value(F.col(data), name)), way)
        elif found := filters.resolve(df.schema, name):
            out += _ways([found[0]], way)
    return [*out, F.col(id_col).asc_nulls_first()]


def run(df: DataFrame, body: Mapping | QuerySpec, id_col: str, data: str | None = None, contains: bool = False) -> DataFrame:
    """The page of df's rows that a query asks for. data names the VARIANT column of a schema-free collection.

    Filter and projection reach the scan; sort, offset and limit become one bounded sort, so no task holds more than
    offset + limit rows.
    """
    spec = body if isinstance(body, QuerySpec) else QuerySpec.of(body)
    if data is None:
        found = df.filter(filters.compile_filter(spec.filter, df.schema, contains)) if spec.filter else df
    else:
        found = df.filter(filters.compile_variant_filter(spec.filter, F.col(data), contains)) if spec.filter else df
    page = found.orderBy(*ordered(df, spec.sort, id_col, data)).offset(spec.offset).limit(spec.limit)
    return page if spec.fields is None else project(page, spec.fields)


def project(df: DataFrame, fields) -> DataFrame:
    """The named fields, under their own names; a field that no document has is null."""
    out = []
    for name in fields:
        found = filters.resolve(df.schema, name)
        out.append((found[0] if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def without(df: DataFrame, fields) -> DataFrame:
    """The documents without the named fields, which may lie in structs."""
    out = df
    for name in fields:
        if name in out.columns:
            out = out.drop(name)
        elif "." in name and isinstance(out.schema[name.split(".")[0]].dataType if name.split(".")[0] in out.columns else None, T.StructType):
            top, rest = name.split(".", 1)
            out = out.withColumn(top, F.col(f"`{top}`").dropFields(rest))
    return out


def envelope(df: DataFrame, collection: str, id_col: str, timestamp: Column, node: str = "local") -> DataFrame:
    """Documents of a typed table: id, collection, data, version_vector, timestamp."""
    body = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.lit(collection).alias("collection"), body.alias("data"), F.create_map(F.lit(node), F.lit(1).cast("bigint")).alias("version_vector"), timestamp.cast("double").alias("timestamp"))
