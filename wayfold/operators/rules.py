"""Declarative rules: JSON conditions compiled to Columns, ordered evaluation, logs and statistics."""

from __future__ import annotations

import functools
import json
import math
import operator
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERMINAL = ("accept", "reject")


def _text(field: Column) -> Column:
    return F.coalesce(field.cast("string"), F.lit("undefined"))


def _plain(v: object) -> str:
    """A JSON value as text."""
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    return v if isinstance(v, str) else json.dumps(v)


def _number(v: object) -> float:
    """A JSON value as a number; what is none is not a number."""
    try:
        return float(v) if v is not None and (not isinstance(v, str) or v.strip()) else 0.0
    except (TypeError, ValueError):
        return math.nan


def _equal(f: Column, v: object, kind: T.DataType) -> Column:
    """Equality of values of one kind; values of different kinds are unequal."""
    if v is None:
        return f.isNull()  # a null column is a missing field
    fits = (
        isinstance(kind, T.BooleanType) if isinstance(v, bool)
        else isinstance(kind, T.NumericType) if isinstance(v, int | float)
        else isinstance(kind, T.StringType) and isinstance(v, str)
    )
    return f.eqNullSafe(F.lit(v)) if fits else F.lit(False)


def _compared(f: Column, v: object, compare: Callable[[Column, Column], Column]) -> Column:
    """A blank text is 0 on either side; what is no number, and a missing field, compares with nothing."""
    n = _number(v)
    blank = F.regexp_replace(f.cast("string"), r"\s+", "") == ""
    return F.lit(False) if math.isnan(n) else F.coalesce(compare(F.when(blank, F.lit(0.0)).otherwise(f.try_cast("double")), F.lit(n)), F.lit(False))


# The comparators of a condition's leaf.
COMPARATORS: dict[str, Callable[[Column, object, T.DataType], Column]] = {
    "equals": _equal,
    "contains": lambda f, v, _: F.contains(F.lower(_text(f)), F.lit(_plain(v).lower())),
    "starts_with": lambda f, v, _: F.startswith(F.lower(_text(f)), F.lit(_plain(v).lower())),
    "ends_with": lambda f, v, _: F.endswith(F.lower(_text(f)), F.lit(_plain(v).lower())),
    "matches": lambda f, v, _: _text(f).rlike(f"(?i){_plain(v)}"),
    "greater_than": lambda f, v, _: _compared(f, v, operator.gt),
    "less_than": lambda f, v, _: _compared(f, v, operator.lt),
}


def _field(path: str, columns: Sequence[str] | T.StructType) -> tuple[Column, T.DataType]:
    """The column of a dotted path and its type; a path that leads nowhere is a missing text."""
    parts, kind = path.split("."), columns
    if not isinstance(columns, T.StructType):
        return (F.col(path), T.StringType()) if parts[0] in columns else (F.lit(None).cast("string"), T.StringType())
    for part in parts:
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(None).cast("string"), T.StringType()
        kind = kind[part].dataType
    return F.col(".".join(f"`{x}`" for x in parts)), kind


def compile_condition(condition: Mapping | str, columns: Sequence[str] | T.StructType, compat_leaf_and: bool = False) -> Column:
    """A boolean Column for a condition tree.

    A node is `and` (true without children), `or` (false without children) or `not` (the
    first child negated; true without one). A node with a field and no children is a leaf
    whatever its operator says; with `compat_leaf_and` an operator wins, so an `and`
    leaf is always true. `columns` are names, all of texts, or a schema: then values of other
    types than the field's are unequal to it, and a path may lead into structs. A field that is no
    column compares as missing; what is no number is neither greater nor less.
    """
    c = json.loads(condition) if isinstance(condition, str) else condition
    children = [compile_condition(x, columns, compat_leaf_and) for x in c.get("conditions") or []]
    kind = c.get("operator")
    if kind in ("and", "or", "not") and (children or compat_leaf_and or not c.get("field")):
        if kind == "and":
            return functools.reduce(operator.and_, children, F.lit(True))
        if kind == "or":
            return functools.reduce(operator.or_, children, F.lit(False))
        return ~children[0] if children else F.lit(True)
    compare = COMPARATORS.get(c.get("comparator", ""))
    if not c.get("field") or compare is None:
        return F.lit(False)
    field, kind = _field(c["field"], columns)
    return compare(field, c.get("value"), kind)


def ordered(rules: Sequence[Mapping]) -> list[Mapping]:
    """Enabled rules, highest priority first, earlier ones first among equals."""
    return sorted((r for r in rules if r.get("enabled", True)), key=lambda r: -r.get("priority", 0))


def matches(rules: Sequence[Mapping], pages: DataFrame, compat_leaf_and: bool = False) -> Column:
    """The array of matching rules, {id, nth, action, value}, in order. One pass, no join."""
    cases = [
        F.when(
            compile_condition(r["condition"], pages.schema, compat_leaf_and),
            F.struct(F.lit(r["id"]).alias("id"), F.lit(i).alias("nth"), F.lit(r["action"]["type"]).alias("action"), F.lit(r["action"].get("value")).cast("string").alias("value")),
        )
        for i, r in enumerate(ordered(rules))
    ]
    if not cases:
        return F.array().cast("array<struct<id:string,nth:int,action:string,value:string>>")
    return F.filter(F.array(*cases), lambda x: x.isNotNull())


def applied(found: Column) -> Column:
    """The matching rules up to and with the first that accepts or rejects."""
    stop = F.array_min(F.transform(F.filter(found, lambda x: x["action"].isin(*TERMINAL)), lambda x: x["nth"]))
    return F.filter(found, lambda x: stop.isNull() | (x["nth"] <= stop))


def outcome(used: Column) -> Column:
    """{action, tags, boosts} of the applied rules; action is accept, reject or null."""
    end = F.filter(used, lambda x: x["action"].isin(*TERMINAL))
    tags = F.transform(F.filter(used, lambda x: x["action"] == "tag"), lambda x: x["value"])
    return F.struct(
        F.get(end, 0)["action"].alias("action"), tags.alias("tags"), F.size(F.filter(used, lambda x: x["action"] == "priority_boost")).alias("boosts")
    )


def execution_log(pages: DataFrame, used: Column, key: str = "page_id") -> DataFrame:
    """A row for each applied rule of each page."""
    return pages.select(key, F.explode(used).alias("x")).select(key, F.col("x.id").alias("rule_id"), "x.action")


def statistics(rules: DataFrame, log: DataFrame) -> DataFrame:
    """Uses of every rule, 0 for unused ones; the average time of none is 0."""
    joined = rules.join(log.select("rule_id", "matched", "execution_time_ms"), F.col("id") == F.col("rule_id"), "left")
    return joined.groupBy("id", "name", "priority").agg(
        F.count("rule_id").alias("executions"), F.sum(F.when(F.col("matched"), 1).otherwise(0)).alias("matches"),
        F.coalesce(F.avg("execution_time_ms"), F.lit(0.0)).alias("average_ms"),
    )


def export_rules(rules: Sequence[Mapping]) -> str:
    """All rules as JSON."""
    return json.dumps(list(rules), sort_keys=True)


def import_rules(text: str) -> list[dict]:
    """Rules from JSON with new ids and no uses."""
    return [{**r, "id": f"rule_{uuid.uuid4().hex}", "usage_count": 0} for r in json.loads(text)]
