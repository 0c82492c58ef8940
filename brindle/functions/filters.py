"""JSON filters compiled to column expressions over the payload, so that they run before any top-k."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from brindle.errors import InvalidQuery

_NUMBER = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity|nan)", re.IGNORECASE)
_NUMERIC_TYPES = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"


def as_number(value) -> float | None:
    """A filter value as a number: numbers, and strings that spell one; no booleans."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    if isinstance(value, str):
        return float(value) if _NUMBER.fullmatch(value) else None
    return float(value)


class Field:
    """A payload value, with its kind taken apart. ``id`` is the record's id, dots lead through objects."""

    def __init__(self, name: str, payload: str, id_col: str):
        if name == "id":
            self.exists, self.text = F.col(id_col).isNotNull(), F.col(id_col).cast("string")
            self.is_text, self.flag, self.json, own = F.lit(True), F.lit(None).cast("boolean"), F.to_json(F.struct(id_col)), F.lit(None).cast("double")
        else:
            path = "$" + "".join(f"[{_quoted(part)}]" for part in name.split("."))
            v = F.try_variant_get(F.try_parse_json(F.col(payload)), path, "variant")
            kind = F.schema_of_variant(v)
            self.exists, self.is_text = v.isNotNull(), kind == "STRING"
            self.text = F.when(self.is_text, F.try_variant_get(v, "$", "string"))
            self.flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            self.json = F.to_json(v)
            own = F.when(kind.rlike(_NUMERIC_TYPES), F.try_variant_get(v, "$", "double"))
        spelled = F.when(self.text.rlike(f"(?i)^(?:{_NUMBER.pattern})$"), F.regexp_replace(self.text, r"(?i)^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double"))
        self.number = F.coalesce(own, spelled)


def _quoted(key: str) -> str:
    return f"'{key}'" if "'" not in key else f'"{key}"'


def equals(f: Field, value) -> Column:
    """Strings with strings and booleans with booleans exactly; else as numbers, if both are; else as JSON."""
    number = as_number(value)
    as_json = f.json == F.to_json(F.parse_json(F.lit(json.dumps(value, sort_keys=True))))
    by_number = F.lit(False) if number is None or math.isnan(number) else (f.number == number) & ~F.isnan(f.number)
    if isinstance(value, str):
        other = F.when(f.number.isNotNull(), by_number) if number is not None else F.when(F.lit(False), F.lit(False))
        return F.when(f.is_text, f.text == value).otherwise(F.coalesce(other, F.lit(False)))
    if isinstance(value, bool):
        return F.coalesce(f.flag == value, F.lit(False))
    if number is not None:
        return F.when(f.number.isNotNull(), by_number).otherwise(F.lit(False))
    return F.coalesce(as_json, F.lit(False))


def condition(name: str, op: str, value, payload: str = "payload", id_col: str = "id") -> Column:
    """One comparison. A missing field satisfies none, not even ``!=``; order is numeric only; in ``LIKE`` only ``%`` is
    special; an unknown operator is satisfied by nothing."""
    f = Field(name, payload, id_col)
    if op in ("=", "!="):
        e = equals(f, value)
        test = e if op == "=" else ~F.coalesce(e, F.lit(False))
    elif op in ("<", "<=", ">", ">="):
        number = as_number(value)
        if number is None or math.isnan(number):
            return F.lit(False)
        x = F.when(~F.isnan(f.number), f.number)
        test = {"<": x < number, "<=": x <= number, ">": x > number, ">=": x >= number}[op]
    elif op == "LIKE" and isinstance(value, str):
        test = f.text.like(value.replace("\\", "\\\\").replace("_", "\\_"))
    else:
        return F.lit(False)
    return f.exists & F.coalesce(test, F.lit(False))


def compile_filter(filter, payload: str = "payload", id_col: str = "id", similar=None) -> Column:
    """``{"field", "op", "value"}``; a list of filters, all of which must hold; or a map of fields to values that they must
    equal. Never NULL. Anything else is satisfied by nothing. Also ``Bool`` and ``Similar``, as the SQL front end writes
    them; ``similar`` gives the column of the latter."""
    if isinstance(filter, Similar):
        if similar is None:
            raise InvalidQuery("a similarity can't be a condition here")
        return F.coalesce(similar(filter), F.lit(False))
    if isinstance(filter, Bool):
        parts = [compile_filter(p, payload, id_col, similar) for p in filter.parts]
        if filter.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if filter.op == "and" else (out | p)
        return out
    if isinstance(filter, (list, tuple)):
        out = F.lit(True)
        for p in filter:
            out = out & compile_filter(p, payload, id_col, similar)
        return out
    if isinstance(filter, dict):
        if {"field", "op", "value"} <= filter.keys():
            if not isinstance(filter["field"], str) or not isinstance(filter["op"], str):
                return F.lit(False)
            return condition(filter["field"], filter["op"], filter["value"], payload, id_col)
        return compile_filter([{"field": k, "op": "=", "value": v} for k, v in filter.items()], payload, id_col)
    return F.lit(False)


class Bool:
    """A connective of conditions that plain JSON filters can't express."""

    def __init__(self, op: str, parts: list):
        self.op, self.parts = op, parts

    def __repr__(self) -> str:
        return f"not {self.parts[0]}" if self.op == "not" else "(" + f" {self.op} ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Similar:
    """A condition on the similarity to a vector."""

    vector: tuple[float, ...]
    op: str
    threshold: float

    def __repr__(self) -> str:
        return f"VECTOR_SIM {self.op} {self.threshold}"


def fields_of(filter) -> set[str]:
    """Fields that a filter refers to."""
    if isinstance(filter, Bool):
        return set().union(*map(fields_of, filter.parts))
    if isinstance(filter, (list, tuple)):
        return set().union(*map(fields_of, filter))
    if isinstance(filter, dict):
        return {filter["field"]} if {"field", "op", "value"} <= filter.keys() and isinstance(filter["field"], str) else set(filter)
    return set()


def hoist(records, fields: list[str], payload: str = "payload"):
    """Records with the declared payload fields as columns of their own (``f_<name>``), which Parquet can skip by; numbers
    and numeric strings also as ``n_<name>``."""
    for name in fields:
        f = Field(name, payload, "id")
        column = name.replace(".", "_")
        records = records.withColumn(f"f_{column}", F.coalesce(f.text, f.json)).withColumn(f"n_{column}", f.number)
    return records


def hoisted(filter, fields) -> Column | None:
    """What a filter says about hoisted fields, as conditions on their columns that Parquet can skip by. Every row that
    satisfies the filter satisfies them; the reverse isn't so. None if there is nothing of the kind."""
    if isinstance(filter, Bool):
        return _every([hoisted(p, fields) for p in filter.parts]) if filter.op == "and" else None
    if isinstance(filter, (list, tuple)):
        return _every([hoisted(p, fields) for p in filter])
    if not isinstance(filter, dict):
        return None
    if not {"field", "op", "value"} <= filter.keys():
        return _every([hoisted({"field": k, "op": "=", "value": v}, fields) for k, v in filter.items()])
    name, op, value = filter["field"], filter["op"], filter["value"]
    if name not in fields or not isinstance(name, str):
        return None
    text, number, n = F.col(f"f_{name.replace('.', '_')}"), F.col(f"n_{name.replace('.', '_')}"), as_number(value)
    if n is not None and not math.isnan(n) and op in ("=", "<", "<=", ">", ">="):
        test = {"=": number == n, "<": number < n, "<=": number <= n, ">": number > n, ">=": number >= n}[op]
        return test | (text == value) if op == "=" and isinstance(value, str) else test
    if op == "=" and isinstance(value, str):
        return text == value
    return None


def _every(parts: list) -> Column | None:
    parts = [p for p in parts if p is not None]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out & p
    return out
