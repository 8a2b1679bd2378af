"""Values of the dialect: a column with its static type, and the dialect's operations on it.

The dialect is two-valued and forgiving: null equals null, an empty string
counts as null, whatever is divided by zero is 0. Everything here is a
built-in Spark expression, so that filters are pushed down and code is
generated.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import QueryError

NUMERIC = ("bool", "int", "float")


@dataclass(frozen=True, eq=False)
class Value:
    """``kind``: null, bool, int, float, string, mixed (see ``unified``) or list.

    ``test`` is what WHERE may use in place of a truth: null for false, and
    plain enough to reach the scan.
    """

    column: Column
    kind: str
    literal: object = None
    constant: bool = False
    test: Column | None = None


def lit(value: object) -> Value:
    kind = "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "string"
    column = F.lit(value).cast("long") if kind == "int" else F.lit(value)
    return Value(column, kind, value, True)


def of_column(column: Column, kind: T.DataType) -> Value:
    """A table's column; times become seconds since 1970 (UTC)."""
    if isinstance(kind, T.TimestampType):
        return Value(F.unix_micros(column) / F.lit(1e6), "float")
    if isinstance(kind, T.TimestampNTZType):
        return Value(F.unix_micros(F.to_utc_timestamp(column.cast("timestamp"), F.current_timezone())) / F.lit(1e6), "float")
    if isinstance(kind, T.BooleanType):
        return Value(column, "bool")
    if isinstance(kind, T.IntegralType):
        return Value(column.cast("long"), "int")
    if isinstance(kind, T.NumericType):
        return Value(column.cast("double"), "float")
    return Value(column.cast("string"), "string")


def truthy(v: Value) -> Column:
    """Whether a value counts as true: not null, 0, NaN or an empty string."""
    c = v.column
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return F.coalesce(c, F.lit(False))
    if v.kind == "int":
        return F.coalesce(c != 0, F.lit(False))
    if v.kind == "float":
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if v.kind == "mixed":
        return F.coalesce(F.when(c["rank"] == 3, c["text"] != "").otherwise(c["number"] != 0), F.lit(False))
    return F.coalesce(c != "", F.lit(False)) if v.kind == "string" else c.isNotNull()


def condition(v: Value) -> Column:
    """A value as a condition of WHERE."""
    return truthy(v) if v.test is None else v.test


def number(v: Value) -> Value:
    """A value in arithmetic: null is 0, true is 1."""
    if v.kind == "null":
        return Value(F.lit(0).cast("long"), "int", 0, True)
    if v.kind == "bool":
        return Value(F.coalesce(v.column.cast("long"), F.lit(0)), "int")
    if v.kind in ("int", "float"):
        return v if v.constant else Value(F.coalesce(v.column, F.lit(0)), v.kind)
    raise QueryError("Arithmetic needs numbers here.", hint="Text has no numeric value.")


def _digits(c: Column) -> Column:
    """A fraction in text: written out from a millionth up to 21 digits, else as ``1.5e-7``."""
    plain, size = c.cast("string"), F.abs(c)

    def written(places: int) -> Column:
        return F.regexp_replace(plain.cast(f"decimal(38,{places})").cast("string"), r"\.?0+$", "")

    short = F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E(\d)", "E+$1")
    out = F.when(~F.contains(plain, F.lit("E")), plain).when(F.isnan(c), F.lit("NaN")).when(size.between(1e-6, 1), written(24)).when((size > 1) & (size < 1e21), written(15))
    return out.otherwise(F.replace(short, F.lit("E"), F.lit("e")))


def text(v: Value) -> Column:
    """A value in text: whole numbers without a fraction, null as ``null``."""
    c = v.column
    if v.kind == "null":
        return F.lit("null")
    if v.kind == "float":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        c = F.when(F.isnan(c), F.lit("NaN")).when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(_digits(c))
    elif v.kind == "mixed":
        c = c["text"]
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit("null"))


def equal(a: Value, b: Value) -> Column:
    """Strict equality: of different types false, null equals null, NaN nothing."""
    if a.kind == "null" or b.kind == "null":
        other = b if a.kind == "null" else a
        return F.lit(True) if other.kind == "null" else (other.column["rank"] == 0) if other.kind == "mixed" else other.column.isNull()
    if "mixed" in (a.kind, b.kind):
        x, y = (v.column if v.kind == "mixed" else unified([v])[0].column for v in (a, b))
        return x.eqNullSafe(y)
    sides = {"int": "number", "float": "number"}
    if sides.get(a.kind, a.kind) != sides.get(b.kind, b.kind):
        return a.column.isNull() & b.column.isNull()
    same = a.column.eqNullSafe(b.column)
    return same & ~F.isnan(F.coalesce(a.column, F.lit(0.0))) if "float" in (a.kind, b.kind) and not (a.constant or b.constant) else same


_ORDER = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def compare(op: str, a: Value, b: Value) -> Value:
    """Order: text with text, or anything else as numbers."""
    if (a.kind == "string") != (b.kind == "string"):
        raise QueryError(f"Text can't be compared with {_called(b if a.kind == 'string' else a)}.", hint="Compare text with text, or numbers with numbers.")
    if a.kind != "string":
        if "mixed" in (a.kind, b.kind) or "list" in (a.kind, b.kind):
            raise QueryError("Values of several types have no order here.")
    test = None
    if a.kind == "string":
        x, y = a.column, b.column
    else:
        for v, w, flip in ((a, b, False), (b, a, True)):
            if v.kind in ("int", "float") and not v.constant and w.kind in ("int", "float") and w.constant:
                test = _ORDER[op](w.column, v.column) if flip else _ORDER[op](v.column, w.column)
                if _ORDER[op](*((w.literal, 0) if flip else (0, w.literal))):  # null counts as 0
                    test = test | v.column.isNull()
        x, y = number(a).column, number(b).column
    plain = _ORDER[op](x, y)
    return Value(F.coalesce(plain, F.lit(False)), "bool", test=plain if test is None else test)


def _called(v: Value) -> str:
    return {"null": "NULL", "bool": "true or false", "int": "a number", "float": "a number"}.get(v.kind, "this")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    a, b = number(a), number(b)
    x, y = a.column, b.column
    kind = "int" if a.kind == b.kind == "int" else "float"
    if op == "/":
        return Value(F.when(y == 0, F.lit(0.0)).otherwise(x.cast("double") / y.cast("double")), "float")
    if op == "%":
        return Value(F.when(y == 0, F.lit(0).cast("long" if kind == "int" else "double")).otherwise(x % y), kind)
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], kind)


def like(v: Value, pattern: str, negated: bool) -> Column:
    """Case-blind LIKE without an escape character."""
    found = F.ilike(v.column if v.kind == "string" else text(v), F.lit(pattern.replace("\\", "\\\\")))
    found = F.coalesce(found, F.ilike(F.lit("null"), F.lit(pattern.replace("\\", "\\\\")))) if v.kind == "string" else found
    return ~found if negated else found


def is_empty(v: Value) -> Column:
    if v.kind == "null":
        return F.lit(True)
    if v.kind == "mixed":
        return (v.column["rank"] == 0) | ((v.column["rank"] == 3) & (v.column["text"] == ""))
    return v.column.isNull() | (v.column == "") if v.kind == "string" else v.column.isNull()


def among(v: Value, options: list[Value], negated: bool) -> Value:
    """IN, by strict equality; literals of one type become a set that Spark can push down."""
    same = [o for o in options if o.constant and o.literal is not None and (o.kind == v.kind or {o.kind, v.kind} == {"int", "float"})]
    rest = [o for o in options if o not in same and not (o.constant and o.literal is not None and v.kind not in ("mixed", "null"))]
    plain = v.column.isin([o.literal for o in same]) if same and v.kind != "mixed" else None
    found = F.lit(False) if plain is None else F.coalesce(plain, F.lit(False))
    rest = rest if v.kind != "mixed" else options
    for o in rest:
        found = found | equal(v, o)
    return Value(~found, "bool") if negated else Value(found, "bool", test=None if rest else plain)


def unified(values: list[Value]) -> list[Value]:
    """The values in one Spark type. Of several types each becomes (rank, number, text), which sorts null, bool, number, text."""
    kinds = {v.kind for v in values} - {"null"}
    if len(kinds) <= 1 or kinds == {"int", "float"}:
        kind = "float" if kinds == {"int", "float"} else next(iter(kinds), "null")
        name = {"bool": "boolean", "int": "long", "float": "double", "string": "string"}.get(kind)
        return [Value(v.column.cast(name) if name else v.column, kind, v.literal, v.constant) for v in values]

    def tagged(v: Value) -> Value:
        if v.kind == "mixed":
            return v
        rank = {"null": 0, "bool": 1, "int": 2, "float": 2}.get(v.kind, 3)
        known = F.lit(0) if rank == 0 else F.when(v.column.isNull(), 0).otherwise(rank)
        digits = v.column.cast("double") if rank in (1, 2) else F.lit(None).cast("double")
        return Value(F.struct(known.cast("int").alias("rank"), digits.alias("number"), (F.lit(None).cast("string") if rank == 0 else F.when(v.column.isNull(), None).otherwise(text(v))).alias("text")), "mixed")

    return [tagged(v) for v in values]


def shown(v: Value) -> Column:
    """The column as results show it: values of several types as text."""
    return v.column["text"] if v.kind == "mixed" else v.column.cast("string") if v.kind == "null" else v.column


def case(branches: list[tuple[Column, Value]], otherwise: Value) -> Value:
    *values, last = unified([v for _, v in branches] + [otherwise])
    out = None
    for (condition, _), v in zip(branches, values, strict=True):
        out = F.when(condition, v.column) if out is None else out.when(condition, v.column)
    return Value(out.otherwise(last.column), last.kind)


# ---- functions


def _string(v: Value) -> Column:
    return v.column if v.kind == "string" else text(v)


def round_(x: Value, digits: Value) -> Value:
    """To so many digits, halves upwards."""
    n = number(x)
    scale = F.lit(float(10.0**digits.literal)) if digits.constant and isinstance(digits.literal, int) else F.pow(F.lit(10.0), number(digits).column)
    return Value(F.floor(n.column * scale + F.lit(0.5)) / scale, "float")


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def substr(s: Value, start: Value, length: Value | None) -> Value:
    """From place ``start`` (0 is the first, negative from the end) to ``start + length``, each taken within the text; places are UTF-16 units.

    Half of a character of two units is shown as U+FFFD.
    """
    c = F.coalesce(_string(s), F.lit("null"))
    size = units(c)

    def within(place: Column) -> Column:
        return F.when(place < 0, F.greatest(size + place, F.lit(0))).otherwise(F.least(place, size))

    first = number(start).column.cast("int")
    begin = within(first)
    end = size if length is None else within(first + number(length).column.cast("int"))
    n = F.greatest(end - begin, F.lit(0))
    part = F.substring(F.encode(c, "UTF-16BE"), 2 * begin + 1, 2 * n)
    unknown = F.unhex(F.lit("FFFD"))
    low, high = F.hex(F.substring(part, 1, 1)).between("DC", "DF"), F.hex(F.substring(part, -2, 1)).between("D8", "DB")
    part = F.when(low, F.concat(unknown, F.substring(part, F.lit(3), F.length(part)))).otherwise(part)
    part = F.when(high, F.concat(F.substring(part, F.lit(1), F.length(part) - 2), unknown)).otherwise(part)
    return Value(F.when(F.length(c) == size, F.substring(c, begin + 1, n)).otherwise(F.decode(part, "UTF-16BE")), "string")


def coalesce(values: list[Value]) -> Value:
    """The first that is neither null nor an empty string."""
    branches = [(~is_empty(v), v) for v in values]
    return case(branches, lit(None))


def scalar(name: str, args: list[Value], now: float) -> Value:
    if name == "now":
        return lit(float(now))
    if name in ("lower", "upper"):
        return Value((F.lower if name == "lower" else F.upper)(F.coalesce(_string(args[0]), F.lit("null"))), "string")
    if name == "length":  # in UTF-16 units
        return Value(units(F.coalesce(_string(args[0]), F.lit("null"))).cast("long"), "int")
    if name == "abs":
        n = number(args[0])
        return Value(F.abs(n.column), n.kind)
    if name == "round":
        return round_(args[0], args[1] if len(args) > 1 else lit(0))
    if name == "substr":
        return substr(args[0], args[1], args[2] if len(args) > 2 else None)
    return coalesce(args)


# ---- aggregates


def summed(v: Value) -> Value:
    """Sum of numbers and truths, nothing is 0; fractions to six digits."""
    c = v.column.cast("long") if v.kind == "bool" else v.column
    if v.kind == "null":
        return lit(0)
    if v.kind in ("bool", "int"):
        return Value(F.coalesce(F.sum(c), F.lit(0)), "int")
    return Value(F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6), "float")


def averaged(v: Value) -> Value:
    c = F.lit(None).cast("double") if v.kind == "null" else v.column.cast("double")
    return Value(F.coalesce(F.round(F.avg(c), 3), F.lit(0.0)), "float")


def extreme(name: str, v: Value) -> Value:
    return Value((F.min if name == "min" else F.max)(v.column if v.kind != "null" else v.column.cast("string")), v.kind if v.kind != "null" else "string")


def distinct(v: Value, approximate: bool) -> Value:
    """Distinct values that are not null; approximately with a standard error of 1.6 %."""
    c = F.when(v.column["rank"] > 0, v.column) if v.kind == "mixed" else v.column.cast("string") if v.kind == "null" else v.column
    return Value(F.approx_count_distinct(c, 0.01625) if approximate else F.count_distinct(c), "int")


def percentile(v: Value, percent: float, approximate: bool) -> Value:
    """The value at a share; approximately from a sketch that merges, of rank within a ten-thousandth, else with a group's values in one task."""
    c = F.lit(None).cast("double") if v.kind == "null" else v.column.cast("double")
    found = F.percentile_approx(c, percent / 100, 10000) if approximate else F.percentile(c, percent / 100)
    return Value(F.round(F.coalesce(found, F.lit(0.0)), 2), "float")
