"""Metadata filters: JSON-like specifications compiled to column predicates.

``{"field": value}`` and ``{"field": {"$op": operand, ...}}`` with $eq $ne $gt $gte $lt $lte $in $nin; several fields, and
several operators of a field, must all hold; ``{"$and": [...]}`` and ``{"$or": [...]}`` nest and take precedence over
sibling keys, which they hide ($and over $or). A field that a row lacks is null: $ne and $nin accept it, ranges don't. An
operator that isn't known rejects all rows; ``strict`` raises for that and for hidden sibling keys instead. Operands of
another type than the field equal nothing and compare as false.

The predicates leave null where a plain comparison does, so that Parquet scans can use them; wrap them in
``coalesce(..., false)`` to project them as a column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From a field's name and an operand to the field's column, or None if it can't be compared with the operand.
Resolver = Callable[[str, Any], "Column | None"]

RANGES = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}
OPERATORS = ("$eq", "$ne", *RANGES, "$in", "$nin")


def typed_fields(schema: T.StructType) -> Resolver:
    """Fields are columns of ``schema``; a name that isn't one is null in every row."""
    types = {f.name: f.dataType for f in schema}

    def resolve(field: str, operand: Any) -> Column | None:
        kind = types.get(field)
        column = F.lit(None) if kind is None else F.col(f"`{field.replace('`', '``')}`")
        if kind is None or operand is None:
            return column
        if isinstance(operand, (bool, int, float, Decimal)):
            if isinstance(kind, T.BooleanType):
                return column.cast("int") if not isinstance(operand, bool) else column
            if isinstance(kind, T.NumericType):
                return column
            return None
        if isinstance(operand, str):
            return column if isinstance(kind, T.StringType) else None
        if isinstance(operand, (dt.date, dt.datetime)):
            return column if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None
        return None

    return resolve


def variant_fields(metadata: str | Column = "metadata") -> Resolver:
    """Fields are keys of a VARIANT column; values of another type than the operand count as not comparable."""
    column = F.col(metadata) if isinstance(metadata, str) else metadata

    def resolve(field: str, operand: Any) -> Column | None:
        path = '$["' + field.replace('"', '\\"') + '"]'
        kind = "boolean" if isinstance(operand, bool) else "double" if isinstance(operand, (int, float)) else "string"
        value = F.try_variant_get(column, path, kind)
        if operand is None:
            return F.try_variant_get(column, path, "string")
        wanted = {"boolean": ["BOOLEAN"], "string": ["STRING"]}.get(kind)
        found = F.schema_of_variant(F.try_variant_get(column, path, "variant"))
        ok = found.isin(wanted) if wanted else ~found.isin("STRING", "BOOLEAN", "VOID")
        return F.when(ok, value)

    return resolve


def _literal(value: Any) -> Column:
    return F.lit(int(value)) if isinstance(value, bool) else F.lit(value)


def _equal(resolve: Resolver, field: str, value: Any) -> Column:
    column = resolve(field, value)
    if column is None:
        return F.lit(False)
    if isinstance(value, bool):
        as_number = resolve(field, int(value))
        return as_number.eqNullSafe(F.lit(int(value))) if as_number is not None else column.eqNullSafe(F.lit(value))
    return column.isNull() if value is None else column.eqNullSafe(F.lit(value))


def _listed(resolve: Resolver, field: str, values: Any) -> Column:
    if isinstance(values, str):  # membership in a text is containment
        column = resolve(field, "")
        return F.lit(False) if column is None else F.coalesce(F.contains(F.lit(values), column), F.lit(False))
    if not isinstance(values, (Sequence, set, frozenset)):
        raise ValueError(f"$in and $nin take a list, not {values!r}")
    plain: dict[str, tuple[Column, list]] = {}
    for v in values:
        column = resolve(field, int(v) if isinstance(v, bool) else v) if v is not None else None
        if column is not None:
            plain.setdefault(type(v).__name__ if isinstance(v, str) else "number", (column, []))[1].append(int(v) if isinstance(v, bool) else v)
    tests = [column.isin(own) for column, own in plain.values()]
    if any(v is None for v in values):
        tests.append(resolve(field, None).isNull())
    return reduce(or_, tests) if tests else F.lit(False)


def _operator(resolve: Resolver, field: str, op: str, value: Any, strict: bool) -> Column:
    if op == "$eq":
        return _equal(resolve, field, value)
    if op == "$ne":
        return ~_equal(resolve, field, value)
    if op in RANGES:
        column = resolve(field, int(value) if isinstance(value, bool) else value)
        return F.lit(False) if column is None or value is None else RANGES[op](column, _literal(value))
    if op == "$in":
        return _listed(resolve, field, value)
    if op == "$nin":
        return ~F.coalesce(_listed(resolve, field, value), F.lit(False))
    if strict:
        raise ValueError(f"unknown operator {op!r}")
    return F.lit(False)


def _all(tests: list[Column]) -> Column:
    return reduce(and_, tests) if tests else F.lit(True)


def compile_filter(spec: Mapping[str, Any] | None, fields: DataFrame | T.StructType | Resolver, strict: bool = False) -> Column:
    """The predicate of a specification over a DataFrame's columns (or a schema's, or a resolver's fields)."""
    resolve = fields if callable(fields) and not isinstance(fields, (DataFrame, T.StructType)) else typed_fields(fields.schema if isinstance(fields, DataFrame) else fields)
    if not spec:
        return F.lit(True)
    for key, join, empty in (("$and", and_, True), ("$or", or_, False)):
        if key in spec:
            if strict and len(spec) > 1:
                raise ValueError(f"{key} hides its sibling keys")
            parts = [compile_filter(s, resolve, strict) for s in spec[key]]
            return reduce(join, parts) if parts else F.lit(empty)
    tests = []
    for field, condition in spec.items():
        if isinstance(condition, Mapping):
            tests += [_operator(resolve, field, op, value, strict) for op, value in condition.items()]
        else:
            tests.append(_equal(resolve, field, condition))
    return _all(tests)


def predicate(fn: Callable[[dict], bool], columns: Sequence[str]) -> Column:
    """A boolean column from a Python function of a row's metadata: the slow path, in Arrow batches."""
    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(fn(r)) for r in rows.to_dict("records")], dtype=bool)

    return run(F.struct(*columns))
