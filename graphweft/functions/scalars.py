"""The scalar function registry: name -> Column builder. All built-ins, nothing leaves the JVM.

A builder takes a :class:`Call` with the argument columns and their Spark types. Names are case-insensitive.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Call:
    args: list[Column]
    types: list[T.DataType]
    #: The values of the arguments that are literals, else None.
    literals: list

    def a(self, k: int) -> Column:
        return self.args[k]

    def is_list(self, k: int = 0) -> bool:
        return isinstance(self.types[k], T.ArrayType)

    def is_string(self, k: int = 0) -> bool:
        return isinstance(self.types[k], (T.StringType, T.NullType))

    def __len__(self) -> int:
        return len(self.args)


REGISTRY: dict[str, Callable[[Call], Column]] = {}


def register(*names: str):
    """Add a scalar function; a name that is taken is refused."""

    def add(f):
        for n in names:
            if n.lower() in REGISTRY:
                raise ValueError(f"function {n} is already registered")
            REGISTRY[n.lower()] = f
        return f

    return add


def _simple(names: str, f: Callable) -> None:
    register(*names.split())(f)


ISO_DATE, ISO_TIME, ISO = "yyyy-MM-dd", "HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"


def truthy(c: Column, t: T.DataType) -> Column:
    """The value in boolean position: null, 0, the empty text and the empty list are false, maps are true. Never null."""
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(t, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() if not isinstance(t, T.NullType) else F.lit(False)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


# -- text ------------------------------------------------------------------------------------------------------------
_simple("toUpper upper", lambda c: F.upper(c.a(0).cast("string")))
_simple("toLower lower", lambda c: F.lower(c.a(0).cast("string")))
_simple("trim", lambda c: F.regexp_replace(c.a(0), r"\A\s+|\s+\z", ""))
_simple("ltrim", lambda c: F.regexp_replace(c.a(0), r"\A\s+", ""))
_simple("rtrim", lambda c: F.regexp_replace(c.a(0), r"\s+\z", ""))
_simple("split", lambda c: F.split(c.a(0), F.concat(F.lit("\\Q"), c.a(1), F.lit("\\E")), -1))
_simple("replace", lambda c: F.replace(c.a(0), c.a(1), c.a(2)))
_simple("substring", lambda c: F.substring(c.a(0), c.a(1).cast("int") + 1, c.a(2).cast("int")) if len(c) > 2 else F.substring(c.a(0), c.a(1).cast("int") + 1, F.lit(2**31 - 1)))
_simple("left", lambda c: F.left(c.a(0), c.a(1).cast("int")))
_simple("right", lambda c: F.right(c.a(0), c.a(1).cast("int")))
_simple("startsWith starts_with", lambda c: F.coalesce(F.startswith(c.a(0), c.a(1)), F.lit(False)))
_simple("endsWith ends_with", lambda c: F.coalesce(F.endswith(c.a(0), c.a(1)), F.lit(False)))
_simple("contains", lambda c: F.coalesce(F.contains(c.a(0), c.a(1)), F.lit(False)))
_simple("char_length character_length", lambda c: F.char_length(c.a(0)).cast("long"))
_simple("reverse", lambda c: F.reverse(c.a(0)))
_simple("size", lambda c: F.when(c.a(0).isNotNull(), F.size(c.a(0)).cast("long")) if c.is_list() or isinstance(c.types[0], T.MapType) else F.char_length(c.a(0)).cast("long"))

# -- conversion ------------------------------------------------------------------------------------------------------
def _to_text(c: Call) -> Column:
    return F.coalesce(F.to_json(c.a(0)) if isinstance(c.types[0], (T.ArrayType, T.StructType, T.MapType)) else c.a(0).cast("string"), F.lit("null"))


def _to_int(c: Call) -> Column:
    x = c.a(0)
    if c.is_string():
        whole = F.trim(x).try_cast("bigint")
        return F.coalesce(whole, F.trim(x).try_cast("double").try_cast("bigint"))
    return x.try_cast("bigint")


def _to_bool(c: Call) -> Column:
    """Null stays null; every text but the empty one and ``false`` is true, as are all numbers but 0, lists and maps."""
    x, t = c.a(0), c.types[0]
    if isinstance(t, T.NullType):
        return F.lit(None).cast("boolean")
    if c.is_string():
        return ~x.isin("", "false")
    if isinstance(t, (T.BooleanType, T.NumericType)):
        return truthy(x, t) | F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return F.when(x.isNotNull(), F.lit(True))


_simple("toString str", _to_text)
_simple("toInteger int integer", lambda c: F.coalesce(_to_int(c), F.lit(0).cast("long")))
_simple("toFloat float", lambda c: F.coalesce(c.a(0).try_cast("double"), F.lit(0.0)))
_simple("toBoolean bool", _to_bool)
_simple("toIntegerOrNull", _to_int)
_simple("toFloatOrNull", lambda c: c.a(0).try_cast("double"))
_simple("toBooleanOrNull", lambda c: F.when(F.lower(c.a(0)).isin("true", "false"), F.lower(c.a(0)) == "true") if c.is_string() else c.a(0).try_cast("boolean"))


def _to_list(c: Call) -> Column:
    if isinstance(c.types[0], T.NullType):
        return F.array().cast("array<string>")
    own = c.a(0) if c.is_list() else F.array(c.a(0))
    return F.when(c.a(0).isNull(), F.slice(own, 1, 0)).otherwise(own)


_simple("toList", _to_list)
TYPE_NAMES = ((T.NullType, "NULL"), (T.BooleanType, "BOOLEAN"), (T.IntegralType, "INTEGER"), (T.NumericType, "FLOAT"), (T.ArrayType, "LIST"), (T.StructType, "MAP"), (T.MapType, "MAP"))


def type_name(t: T.DataType) -> str:
    return next((n for k, n in TYPE_NAMES if isinstance(t, k)), "STRING")


_simple("valueType valueTypeOf apoc.meta.type", lambda c: F.when(c.a(0).isNull(), "NULL").otherwise(F.lit(type_name(c.types[0]))))
_simple("coalesce", lambda c: F.coalesce(*c.args))
_simple("nullIf", lambda c: F.when(c.a(0).eqNullSafe(c.a(1)), None).otherwise(c.a(0)))
_simple("exists", lambda c: c.a(0).isNotNull())
_simple("isEmpty", lambda c: F.coalesce(F.size(c.a(0)) == 0 if c.is_list() or isinstance(c.types[0], T.MapType) else c.a(0) == "", F.lit(True)))


# -- time ------------------------------------------------------------------------------------------------------------
def _stamp(c: Column, t: T.DataType, seconds: bool = True) -> Column:
    """A text, a number (days or seconds since 1970) or a time as a timestamp."""
    if is_number(t):
        return F.timestamp_seconds(c) if seconds else F.date_from_unix_date(c.cast("int")).cast("timestamp_ntz")
    if isinstance(t, T.StringType):
        return F.regexp_replace(c, r"Z\z", "").try_cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def _at(c: Call, seconds: bool = True) -> Column:
    return _stamp(c.a(0), c.types[0], seconds) if len(c) else F.current_timestamp()


_simple("now timestamp", lambda c: F.unix_millis(F.current_timestamp()))
_simple("date", lambda c: F.date_format(_at(c, False), ISO_DATE))
_simple("datetime", lambda c: F.date_format(_at(c), ISO + "'Z'"))
_simple("localdatetime", lambda c: F.date_format(_at(c), ISO))


def _clock(c: Call, zone: str) -> Column:
    if len(c) and c.is_string():
        return F.concat(F.rpad(F.regexp_extract(c.a(0), r"(\d\d:\d\d(?::\d\d)?)", 1), 8, ":00"), F.lit(zone))
    return F.concat(F.date_format(_at(c), ISO_TIME), F.lit(zone))


_simple("time", lambda c: _clock(c, "Z"))
_simple("localtime", lambda c: _clock(c, ""))
_simple("duration", lambda c: F.coalesce(c.a(0).cast("string"), F.lit("PT0S")) if len(c) else F.lit("PT0S"))
for _n, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("quarter", F.quarter), ("dayOfYear", F.dayofyear)):
    _simple(f"date.{_n}", lambda c, f=_f: f(_at(c, False)).cast("long"))
_simple("date.week", lambda c: F.ceil(F.dayofyear(_at(c, False)) / 7).cast("long"))
_simple("date.dayOfWeek", lambda c: (F.weekday(_at(c, False)) + 1).cast("long"))
for _n, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute)):
    _simple(f"datetime.{_n}", lambda c, f=_f: f(_at(c)).cast("long"))
_simple("datetime.second", lambda c: F.second(_at(c)).cast("long"))


def _date_truncate(c: Call) -> Column:
    at = _stamp(c.a(1), c.types[1], False)
    cut = F.when(F.lower(c.a(0)) == "year", F.trunc(at, "year")).when(F.lower(c.a(0)) == "month", F.trunc(at, "month")).otherwise(F.to_date(at))
    return F.date_format(cut, ISO_DATE)


_simple("date.truncate", _date_truncate)


def _datetime_truncate(c: Call) -> Column:
    at, out = _stamp(c.a(1), c.types[1]), None
    for u in ("year", "month", "day", "hour", "minute"):
        v = F.date_format(F.date_trunc(u, at), ISO + "'Z'")
        out = F.when(F.lower(c.a(0)) == u, v) if out is None else out.when(F.lower(c.a(0)) == u, v)
    return out.otherwise(F.date_format(at, ISO + "'Z'"))


_simple("datetime.truncate", _datetime_truncate)
for _k, _n in enumerate(("hour", "minute", "second")):
    _simple(f"time.{_n}", lambda c, k=_k: F.try_element_at(F.split(F.regexp_extract(c.a(0), r"(\d\d:\d\d(?::\d\d)?)", 1), ":"), F.lit(k + 1)).try_cast("bigint"))
_simple("time.truncate", lambda c: F.when(F.lower(c.a(0)) == "hour", F.concat(F.substring(c.a(1), 1, 2), F.lit(":00:00Z"))).when(F.lower(c.a(0)) == "minute", F.concat(F.substring(c.a(1), 1, 5), F.lit(":00Z"))).otherwise(c.a(1)))

# -- numbers ---------------------------------------------------------------------------------------------------------
_simple("abs", lambda c: F.abs(c.a(0)))
_simple("ceil ceiling", lambda c: F.ceil(c.a(0).cast("double")).cast("double"))
_simple("floor", lambda c: F.floor(c.a(0).cast("double")).cast("double"))
_simple("round", lambda c: F.round(c.a(0).cast("double"), 0) if len(c) == 1 else F.round(c.a(0).cast("double"), c.a(1).cast("int")))
_simple("sign", lambda c: F.signum(c.a(0)).cast("long"))
_simple("sqrt", lambda c: F.when(c.a(0) >= 0, F.sqrt(c.a(0))))
_simple("rand random", lambda c: F.round(F.rand() * (c.a(0) if len(c) else F.lit(1.0)), 6))
_simple("pi", lambda c: F.pi())
_simple("e", lambda c: F.e())
for _n in ("sin", "cos", "tan", "asin", "acos", "atan", "degrees", "radians", "sinh", "cosh", "tanh", "exp", "log10"):
    _simple(_n, lambda c, f=getattr(F, _n): f(c.a(0).cast("double")))
_simple("atan2", lambda c: F.atan2(c.a(0).cast("double"), c.a(1).cast("double")))
_simple("pow power", lambda c: F.pow(c.a(0).cast("double"), c.a(1).cast("double")))
_simple("log ln", lambda c: F.ln(c.a(0).cast("double")))
_simple("randomUUID apoc.create.uuid", lambda c: F.uuid())


# -- lists -----------------------------------------------------------------------------------------------------------
def _range(c: Call) -> Column:
    a, b = c.a(0).cast("long"), c.a(1).cast("long")
    s = c.a(2).cast("long") if len(c) > 2 else F.lit(1).cast("long")
    ok = (s > 0) & (a <= b)
    return F.when(ok, F.sequence(a, F.when(ok, b).otherwise(a), F.when(ok, s).otherwise(F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))


def _slice(c: Call) -> Column:
    n = F.size(c.a(0))
    start = F.least(F.greatest(c.a(1).cast("int"), F.lit(0)), n)
    end = F.least(c.a(2).cast("int"), n) if len(c) > 2 else n
    return F.slice(c.a(0), start + 1, F.greatest(end - start, F.lit(0)))


_simple("range", _range)
_simple("head", lambda c: F.try_element_at(c.a(0), F.lit(1)))
_simple("last", lambda c: F.try_element_at(c.a(0), F.lit(-1)))
_simple("tail", lambda c: F.slice(c.a(0), 2, 2**31 - 1))
_simple("slice", _slice)
_simple("indexOf", lambda c: F.coalesce(F.array_position(c.a(0), c.a(1)), F.lit(0)).cast("long") - 1)
# One list argument each: the short forms without a condition.
_simple("all", lambda c: F.coalesce(F.forall(c.a(0), lambda x: x.isNotNull()), F.lit(False)))
_simple("any", lambda c: F.coalesce(F.size(c.a(0)) > 0, F.lit(False)))
_simple("none", lambda c: F.coalesce(F.size(c.a(0)) == 0, F.lit(True)))
_simple("single", lambda c: F.coalesce(F.size(c.a(0)) == 1, F.lit(False)))


# -- vectors ---------------------------------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when the lengths differ or a vector is all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; null when the lengths differ."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.sqrt(dot(d, d)))


_simple("vector.similarity.cosine", lambda c: F.round(cosine(c.a(0), c.a(1)), 6))
_simple("vector.similarity.euclidean", lambda c: F.round(1 / (1 + euclidean(c.a(0), c.a(1))), 6))
_simple("db.create.setNodeVectorProperty", lambda c: F.lit(None))

# -- extension package -----------------------------------------------------------------------------------------------
def _join(c: Call) -> Column:
    # array_join takes a literal delimiter only.
    parts = F.filter(F.transform(c.a(0), lambda x: x.cast("string")), lambda x: x.isNotNull())
    joined = F.aggregate(parts, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, c.a(1), x)))
    return F.coalesce(joined, F.lit(""))


_simple("apoc.text.join", _join)


def _flatten(c: Call) -> Column:
    x, t = c.a(0), c.types[0]
    while isinstance(t, T.ArrayType) and isinstance(t.elementType, T.ArrayType):
        x, t = F.flatten(x), t.elementType
    return x


def _to_json(c: Call) -> Column:
    t = c.types[0]
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c.a(0), {"ignoreNullFields": "false"})
    else:
        text = F.regexp_replace(F.to_json(F.array(c.a(0))), r"\A\[|\]\z", "")
    for sign, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


_simple("apoc.coll.flatten", _flatten)
_simple("apoc.coll.toSet", lambda c: F.array_distinct(c.a(0)))
_simple("apoc.convert.toJson", _to_json)


def _floats(t: T.DataType) -> T.DataType:
    if isinstance(t, T.NumericType):
        return T.DoubleType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_floats(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _floats(f.dataType)) for f in t.fields])
    return t


def _from_json_map(c: Call) -> Column:
    """A literal object has the types of its values, numbers as floats; of other texts the values are text, nested ones as JSON. What is no object is null."""
    if c.literals[0] is not None:
        text = str(c.literals[0])
        try:
            whole = json.loads(text)
        except ValueError:
            whole = None
        if not isinstance(whole, dict):
            return F.lit(None).cast("map<string,string>")
        if whole:
            kind = _floats(T.DataType.fromDDL(SparkSession.active().range(1).select(F.schema_of_json(F.lit(text))).first()[0]))
            return F.from_json(c.a(0), kind)
    return F.from_json(c.a(0), "map<string,string>")


_simple("apoc.convert.fromJsonMap", _from_json_map)


def _map_merge(c: Call) -> Column:
    a, b = c.types
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.fieldNames(), *b.fieldNames()]))
        return F.struct(*[(c.a(1) if n in b.fieldNames() else c.a(0))[n].alias(n) for n in names])
    return F.map_concat(F.map_filter(c.a(0), lambda k, v: ~F.array_contains(F.map_keys(c.a(1)), k)), c.a(1))


_simple("apoc.map.merge", _map_merge)
