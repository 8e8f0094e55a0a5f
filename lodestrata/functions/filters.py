"""Metadata rules as Column predicates, so that they reach the scan.

A rule is a dict with ``field`` or ``fields``, ``operator``, ``value`` or ``values``. Rules are joined by
and, the fields of a rule by or; ``neq`` holds if no field equals, so also where a field is missing. Any
element of an array may match. A field is a column, or a path into a JSON column (column.key.key).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, date, datetime, time
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains", "mime_match", "date_after", "date_on_or_after", "date_before", "date_on_or_before")


def boundary(value: Any, end_of_day: bool) -> datetime | None:
    """A date or time of a rule in UTC; of a date alone its first or last microsecond."""
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=UTC)
    try:
        text = str(value).strip()
        if len(text) == 10:
            return datetime.combine(date.fromisoformat(text), time.max if end_of_day else time.min, UTC)
        at = datetime.fromisoformat(text)
        return at if at.tzinfo else at.replace(tzinfo=UTC)
    except ValueError:
        return None


def number(value: Any) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(str(value).strip())
    except ValueError:
        return None


class Field:
    """A field's column and type in a table."""

    def __init__(self, df: DataFrame, name: str):
        self.known, self.kind, self.column = True, None, None
        head, _, rest = name.partition(".")
        if head not in df.columns:
            self.known = False
            return
        kind = df.schema[head].dataType
        self.column = F.col(f"`{head}`")
        while rest and isinstance(kind, T.StructType):
            head, _, rest = rest.partition(".")
            if head not in kind.names:
                self.known = False
                return
            self.column, kind = self.column[head], kind[head].dataType
        if rest and isinstance(kind, T.StringType):
            self.column, kind = F.get_json_object(self.column, f"$.{rest}"), T.StringType()
            self.json = True
        elif rest:
            self.known = False
        self.kind = kind

    def any(self, test: Callable[[Column, T.DataType], Column]) -> Column:
        """True if the value, or an element of it, passes; false or null where there is none."""
        if not self.known:
            return F.lit(False)
        if isinstance(self.kind, T.ArrayType):
            return F.exists(self.column, lambda x: F.coalesce(test(x, self.kind.elementType), F.lit(False)))
        return test(self.column, self.kind)


def equal(c: Column, kind: T.DataType, value: Any) -> Column:
    if isinstance(kind, T.StringType):
        if not isinstance(value, str) or not value.strip():
            return F.lit(False)
        return F.contains(c, F.lit(value.strip())) & (strip(c) == value.strip())  # the first is one that scans can use
    if isinstance(kind, T.BooleanType):
        return c.cast("int") == value if isinstance(value, (bool, int)) else F.lit(False)
    if isinstance(kind, T.NumericType):
        return c == F.lit(int(value) if isinstance(value, bool) else value) if isinstance(value, (bool, int, float)) else F.lit(False)
    at = boundary(value, False)
    return c.cast("timestamp") == F.lit(at) if at else F.lit(False)


def test_of(op: str, value: Any, values: Sequence[Any]) -> Callable[[Column, T.DataType], Column] | None:
    if op in ("eq", "neq"):
        return None if value is None or str(value).strip() == "" else lambda c, k: equal(c, k, value)
    if op == "in":
        among = [v for v in (values or [value]) if v is not None and str(v).strip() != ""]
        return (lambda c, k: reduce(or_, [equal(c, k, v) for v in among])) if among else None
    if op in ("gt", "gte", "lt", "lte"):
        bound = number(value)
        if bound is None:
            return None
        compare = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}[op]

        def ordered(c: Column, k: T.DataType) -> Column:
            if isinstance(k, T.NumericType):
                return compare(c, F.lit(int(bound) if isinstance(k, T.IntegralType) and bound.is_integer() else bound))
            return compare(c.try_cast("double"), F.lit(bound)) if isinstance(k, T.StringType) else F.lit(False)

        return ordered
    if op == "contains":
        return (lambda c, k: F.contains(F.lower(c.cast("string")), F.lit(value.lower()))) if isinstance(value, str) and value else None
    if op == "mime_match":
        mime = str(value or "").strip().lower()
        if not mime:
            return None
        return lambda c, k: F.startswith(F.lower(c.cast("string")), F.lit(mime[:-1])) if mime.endswith("/*") else F.lower(c.cast("string")) == mime
    late = op in ("date_before", "date_on_or_before")
    at = boundary(value, late)
    if at is None:
        return None
    compare = {"date_after": Column.__gt__, "date_on_or_after": Column.__ge__, "date_before": Column.__lt__, "date_on_or_before": Column.__le__}[op]

    def dated(c: Column, k: T.DataType) -> Column:
        if isinstance(k, T.TimestampNTZType):  # compared as it is stored, so that the scan can skip by it
            return compare(c, F.lit(at.astimezone(UTC).replace(tzinfo=None)).cast("timestamp_ntz"))
        return compare(F.try_to_timestamp(c) if isinstance(k, T.StringType) else c.cast("timestamp"), F.lit(at))

    return dated


def predicate(df: DataFrame, rules: Sequence[dict[str, Any]], strict: bool = False) -> Column:
    """All rules as one predicate. Rules that can't be read are skipped, or raise ValueError if strict."""
    out = []
    for rule in rules:
        fields, op = list(rule.get("fields") or ([rule["field"]] if rule.get("field") else [])), rule.get("operator")
        if not fields or op not in OPERATORS:
            if strict:
                raise ValueError(f"a rule needs a field and a known operator: {rule}")
            continue
        test = test_of(op, rule.get("value"), rule.get("values") or [])
        if test is None and strict:
            raise ValueError(f"{op} can't use this value: {rule}")
        hit = reduce(or_, [Field(df, f).any(test) for f in fields]) if test else F.lit(False)
        out.append(~F.coalesce(hit, F.lit(False)) if op == "neq" else hit)
    return reduce(and_, out, F.lit(True))


def matching(df: DataFrame, rules: Sequence[dict[str, Any]], strict: bool = False) -> DataFrame:
    return df.where(predicate(df, rules, strict))
