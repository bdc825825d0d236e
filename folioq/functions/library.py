"""Scalar and array functions by name and number of arguments.

Each takes typed values and gives one. Arguments of a kind that a function has no use for give null. Instants are in UTC.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindFault, FolioError
from .text import formatted, to_text
from .values import LENIENT, NUMBERS, Highest, JsonText, Lowest, Val, array, common, doc, equal, field, fitted, json_fields, json_items, lit, null

FUNCTIONS: dict[tuple[str, int], Callable[..., Val]] = {}
INT, LONG, DOUBLE, STRING, BOOL, DATE = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()
#: Functions whose results differ from call to call.
VOLATILE = {"RANDOM", "GUID", "OBJECTID", "NOW", "NOW_UTC", "TODAY"}


def fn(*names: str, n: int | tuple[int, ...]) -> Callable:
    def add(f: Callable[..., Val]) -> Callable[..., Val]:
        for name in names:
            for k in (n,) if isinstance(n, int) else n:
                FUNCTIONS[name, k] = f
        return f

    return add


def call(name: str, args: list[Val]) -> Val:
    f = FUNCTIONS.get((name, len(args)))
    if not f:
        raise BindFault(f"no function {name} with {len(args)} arguments")
    return f(*args)


def constant(v: Val, what: str) -> object:
    if not v.literal:
        raise BindFault(f"{what} must be a constant")
    return v.literal[0]


def text(col: Column) -> Val:
    return Val(col, STRING)


def whole(col: Column) -> Val:
    return Val(col.cast(INT), INT)


# Strings. Positions count from 0.


def _string(name: str, make: Callable[[Column], Column]) -> None:
    fn(name, n=1)(lambda s: text(make(s.col)) if s.kind == "string" else null(STRING))


_string("LOWER", F.lower)
_string("UPPER", F.upper)
#: Unicode's white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_string("LTRIM", lambda c: F.ltrim(c, F.lit(BLANKS)))
_string("RTRIM", lambda c: F.rtrim(c, F.lit(BLANKS)))
_string("TRIM", lambda c: F.trim(c, F.lit(BLANKS)))


@fn("INDEXOF", n=(2, 3))
def index_of(s: Val, sub: Val, start: Val | None = None) -> Val:
    """Null if the start is outside the string."""
    if s.kind != "string" or sub.kind != "string":
        return null(INT)
    at = start.col.cast(INT) if start else F.lit(0)
    found = F.when(sub.col == "", at).otherwise(F.call_function("locate", sub.col, s.col, at + 1) - 1)
    return whole(F.when((at >= 0) & (at <= F.length(s.col)), found))


@fn("SUBSTRING", n=(2, 3))
def substring(s: Val, start: Val, length: Val | None = None) -> Val:
    """Null if the start, or the end that the length asks for, is outside the string."""
    if s.kind != "string" or start.kind not in NUMBERS or length and length.kind not in NUMBERS:
        return null(STRING)
    at, size = start.col.cast(INT), F.length(s.col)
    n = length.col.cast(INT) if length else size - at
    inside = (at >= 0) & (at <= size) & (n >= 0) & (n <= size - at)
    return text(F.when(inside, F.substring(s.col, at + 1, n)))


@fn("REPLACE", n=3)
def replace(s: Val, old: Val, new: Val) -> Val:
    """Null if there is nothing to look for."""
    if {s.kind, old.kind, new.kind} != {"string"}:
        return null(STRING)
    return text(F.when(old.col != "", F.replace(s.col, old.col, new.col)))


def _pad(left: bool) -> Callable[..., Val]:
    def pad(s: Val, n: Val, fill: Val) -> Val:
        """With the first character of the filling; null for a negative width, and without a filling."""
        if s.kind != "string" or fill.kind != "string" or n.kind not in NUMBERS:
            return null(STRING)
        width = n.col.cast(INT)
        more = F.repeat(F.substring(fill.col, 1, 1), F.greatest(F.lit(0), width - F.length(s.col)))
        return text(F.when((width >= 0) & (fill.col != ""), F.concat(more, s.col) if left else F.concat(s.col, more)))

    return pad


fn("LPAD", n=3)(_pad(True))
fn("RPAD", n=3)(_pad(False))


#: Code points that no text has: Unicode keeps them for use inside programs.
MARK, GONE = "\ufdd0", "\ufdd1"
#: A group that captures, by its opening bracket.
GROUP = re.compile(r"(?<!\\)\((?!\?)|\(\?<(?![=!])")


@fn("SPLIT", n=(2, 3))
def split(s: Val, sep: Val, by_regex: Val | None = None) -> Val:
    """By a literal, without empty parts; or by a regular expression, with them, and with what its groups have caught in between."""
    t = T.ArrayType(STRING)
    if s.kind != "string" or sep.kind != "string":
        return Val(F.array().cast(t), t, True)
    if by_regex and constant(by_regex, "useRegex"):
        java = _java(sep)
        groups = len(GROUP.findall(java))
        if not groups:
            return Val(F.split(s.col, java), t, True)
        marked = F.regexp_replace(s.col, F.lit(f"(?:{java})"), F.lit("".join(f"{MARK}{GONE}${i}" for i in range(1, groups + 1)) + MARK))
        caught = F.filter(F.split(marked, MARK), lambda x: x != GONE)  # a group that took no part, or nothing
        return Val(F.transform(caught, lambda x: F.replace(x, F.lit(GONE), F.lit(""))), t, True)
    if sep.literal:
        parts = F.split(s.col, re.escape(str(sep.literal[0])))
    else:
        parts = F.split(s.col, F.concat(F.lit("\\Q"), sep.col, F.lit("\\E")))
    return Val(F.filter(parts, lambda x: x != ""), t, True)


@fn("FORMAT", n=2)
def format_(v: Val, how: Val) -> Val:
    return text(formatted(v, str(constant(how, "a format"))))


@fn("JOIN", n=(1, 2))
def join(items: Val, sep: Val | None = None) -> Val:
    if items.kind != "array":
        return text(to_text(items))
    parts = F.transform(items.col, lambda x: to_text(Val(x, items.element)))
    return text(F.array_join(parts, str(constant(sep, "a separator")) if sep else ""))


def _java(pattern: Val) -> str:
    return re.sub(r"\(\?P<", "(?<", str(constant(pattern, "a pattern")))


@fn("IS_MATCH", n=2)
def is_match(s: Val, pattern: Val) -> Val:
    if s.kind != "string":
        return Val(F.lit(False), BOOL)
    return Val(F.coalesce(s.col.rlike(_java(pattern)), F.lit(False)), BOOL)


@fn("MATCH", n=3)
def match(s: Val, pattern: Val, group: Val) -> Val:
    """A group of the first match, by number or name; null without a match, empty without such a group."""
    if s.kind != "string":
        return null(STRING)
    java, which = _java(pattern), constant(group, "a group")
    names = re.findall(r"\(\?<([A-Za-z]\w*)>|(?<!\\)(\()(?!\?)", java)
    number = which if isinstance(which, int) else next((i + 1 for i, (name, _) in enumerate(names) if name == which), None)
    found = F.lit("") if number is None or number > len(names) else F.regexp_extract(s.col, java, number)
    return text(F.when(s.col.rlike(java), found))


# Numbers


@fn("ABS", n=1)
def abs_(x: Val) -> Val:
    return Val(F.abs(x.col), x.type) if x.kind in NUMBERS else null()


@fn("ROUND", n=2)
def round_(x: Val, digits: Val) -> Val:
    """Half to even, as scaling by a power of ten gives it."""
    if x.kind in ("int", "long") or x.kind not in NUMBERS:
        return x if x.kind in NUMBERS else null()
    if x.kind == "decimal":
        return Val(F.bround(x.col, int(constant(digits, "digits"))).cast(x.type), x.type)
    scale = F.pow(F.lit(10.0), digits.col.cast(DOUBLE))
    return Val(F.rint(x.col * scale) / scale, DOUBLE)


@fn("POW", n=2)
def pow_(x: Val, y: Val) -> Val:
    if x.kind not in NUMBERS or y.kind not in NUMBERS:
        return null(DOUBLE)
    return Val(F.pow(x.col.cast(DOUBLE), y.col.cast(DOUBLE)), DOUBLE)


# Dates


def _part(name: str, make: Callable[[Column], Column]) -> None:
    fn(name, n=1)(lambda d: whole(make(d.col.cast(DATE))) if d.kind == "date" else null(INT))


_part("YEAR", F.year)
_part("MONTH", F.month)
_part("DAY", F.dayofmonth)
_part("HOUR", F.hour)
_part("MINUTE", F.minute)
_part("SECOND", F.second)
UNITS = {"y": "YEAR", "year": "YEAR", "M": "MONTH", "month": "MONTH", "d": "DAY", "day": "DAY", "h": "HOUR", "hour": "HOUR", "m": "MINUTE", "minute": "MINUTE", "s": "SECOND", "second": "SECOND"}
SECONDS = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}


def _unit(v: Val) -> str | None:
    name = str(constant(v, "a unit"))
    return UNITS.get(name) or UNITS.get(name.lower() if len(name) > 1 else name)


@fn("DATEADD", n=3)
def date_add(unit: Val, n: Val, d: Val) -> Val:
    u = _unit(unit)
    if not u or d.kind != "date" or n.kind not in NUMBERS:
        return null(DATE)
    return Val(F.timestamp_add(u, n.col.cast(INT), d.col.cast(DATE)), DATE)


@fn("DATEDIFF", n=3)
def date_diff(unit: Val, start: Val, end: Val) -> Val:
    """Years and months by the calendar, the others by whole seconds; towards zero."""
    u = _unit(unit)
    if not u or start.kind != "date" or end.kind != "date":
        return null(INT)
    a, b = start.col.cast(DATE), end.col.cast(DATE)
    years = F.year(b) - F.year(a)
    if u == "YEAR":
        early = (F.month(b) < F.month(a)) | ((F.month(b) == F.month(a)) & (F.dayofmonth(b) < F.dayofmonth(a)))
        return whole(years - F.when(early, 1).otherwise(0))
    if u == "MONTH":
        days = F.datediff(F.add_months(b, 1), F.to_date(b))
        return whole(years * 12 + F.month(b) - F.month(a) + (F.dayofmonth(b) - F.dayofmonth(a)) / days)
    seconds = ((F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)).cast("long")
    return whole((seconds / F.lit(SECONDS[u])).cast("long"))


fn("TO_LOCAL", "TO_UTC", n=1)(lambda d: d if d.kind == "date" else null(DATE))


# Arrays and documents


def listed(v: Val) -> Val:
    """The value as a sequence: an array's items, or itself alone."""
    if v.kind == "array":
        return Val(F.coalesce(v.col, F.array().cast(v.type)), v.type, True, literal=v.literal)
    if isinstance(v.type, JsonText):
        return Val(F.coalesce(json_items(v.col), F.array(v.col)), T.ArrayType(JsonText()), True)
    return Val(F.array(v.col), T.ArrayType(v.type), True)


fn("ITEMS", n=1)(listed)
fn("ARRAY", n=1)(lambda v: Val(v.col, v.type) if v.kind == "array" else Val(F.array(v.col), T.ArrayType(v.type)))


def _pair(a: Val, b: Val) -> tuple[Column, Column, T.DataType]:
    a, b = listed(a), listed(b)
    t = T.ArrayType(common([a.element, b.element]))
    return fitted(a, t), fitted(b, t), t


def _sets(name: str, make: Callable[[Column, Column], Column]) -> None:
    def pair(a: Val, b: Val) -> Val:
        x, y, t = _pair(a, b)
        return Val(make(x, y), t, True)

    fn(name, n=2)(pair)


_sets("CONCAT", lambda x, y: F.concat(x, y))
_sets("UNION", F.array_union)
_sets("EXCEPT", F.array_except)
fn("DISTINCT", n=1)(lambda v: Val(F.array_distinct(listed(v).col), listed(v).type, True))


@fn("TOP", n=2)
def top(v: Val, n: Val) -> Val:
    s = listed(v)
    if n.kind not in ("int", "long"):
        return Val(F.array().cast(s.type), s.type, True)
    return Val(F.slice(s.col, F.lit(1), F.greatest(n.col.cast(INT), F.lit(0))), s.type, True)


@fn("KEYS", n=1)
def keys(v: Val) -> Val:
    t = T.ArrayType(STRING)
    if isinstance(v.type, JsonText):
        return Val(F.coalesce(F.map_keys(json_fields(v.col)), F.array().cast(t)), t, True)
    if isinstance(v.type, T.StructType):
        return Val(F.array(*[F.lit(f.name) for f in v.type.fields]).cast(t), t, True)
    return Val(F.map_keys(v.col) if isinstance(v.type, T.MapType) else F.array().cast(t), t, True)


@fn("VALUES", n=1)
def values(v: Val) -> Val:
    if isinstance(v.type, JsonText):
        return Val(F.coalesce(F.map_values(json_fields(v.col)), F.array().cast(T.ArrayType(STRING))), T.ArrayType(JsonText()), True)
    if isinstance(v.type, T.StructType):
        return array([field(v, f.name) for f in v.type.fields], seq=True)
    if isinstance(v.type, T.MapType):
        return Val(F.map_values(v.col), T.ArrayType(v.type.valueType), True)
    t = T.ArrayType(T.NullType())
    return Val(F.array().cast(t), t, True)


@fn("EXTEND", n=2)
def extend(a: Val, b: Val) -> Val:
    if not isinstance(a.type, T.StructType):
        return b
    if not isinstance(b.type, T.StructType):
        return a
    return doc({f.name: field(v, f.name) for v in (a, b) for f in v.type.fields})


@fn("COUNT", n=1)
def count(v: Val) -> Val:
    return whole(F.size(listed(v).col))


@fn("SUM", n=1)
def sum_(v: Val) -> Val:
    s = listed(v)
    if Val(s.col, s.element).kind not in NUMBERS:
        return lit(0)
    t = LONG if Val(s.col, s.element).kind in ("int", "long") else s.element
    zero = F.lit(0).cast(t)
    return Val(F.aggregate(s.col, zero, lambda a, x: (a + F.coalesce(x, zero)).cast(t)), t)


@fn("AVG", n=1)
def avg(v: Val) -> Val:
    s = listed(v)
    if Val(s.col, s.element).kind not in NUMBERS:
        return lit(0)
    some = F.filter(s.col, lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x.cast(DOUBLE))
    return Val(F.when(F.size(some) > 0, total / F.size(some)).otherwise(F.lit(0.0)), DOUBLE)


def _extreme(least: bool) -> Callable[..., Val]:
    def extreme(v: Val) -> Val:
        s = listed(v)
        best = F.array_min(s.col) if least else F.array_max(s.col)
        if least:  # null is a value, the least
            best = F.when(~F.exists(s.col, lambda x: x.isNull()), best)
        return Val(best, s.element)

    return extreme


fn("MIN", n=1)(_extreme(True))
fn("MAX", n=1)(_extreme(False))
fn("FIRST", n=1)(lambda v: Val(F.get(listed(v).col, F.lit(0)), listed(v).element))
fn("LAST", n=1)(lambda v: Val(F.get(listed(v).col, F.size(listed(v).col) - 1), listed(v).element))
fn("ANY", n=1)(lambda v: Val(F.size(listed(v).col) > 0, BOOL))


@fn("LENGTH", n=1)
def length(v: Val) -> Val:
    if v.kind == "string":
        return whole(F.coalesce(F.length(v.col), F.lit(0)))
    if v.kind == "binary":
        return whole(F.coalesce(F.octet_length(v.col), F.lit(0)))
    if v.kind == "array" or isinstance(v.type, T.MapType):
        return whole(F.when(v.col.isNull(), 0).otherwise(F.size(v.col)))
    if isinstance(v.type, T.StructType):
        return whole(F.when(v.col.isNull(), 0).otherwise(len(v.type.fields)))
    return lit(0) if v.kind == "null" else whole(F.when(v.col.isNull(), 0))


# Conditions


@fn("IIF", n=3)
def iif(test: Val, yes: Val, no: Val) -> Val:
    if test.kind != "bool":
        raise BindFault("the condition of IIF must be a boolean")
    t = common([yes.type, no.type])
    return Val(F.when(test.col, fitted(yes, t)).otherwise(fitted(no, t)), t)


@fn("COALESCE", n=2)
def coalesce(a: Val, b: Val) -> Val:
    t = common([a.type, b.type])
    return Val(F.coalesce(fitted(a, t), fitted(b, t)), t)


@fn("RANDOM", n=(0, 2))
def random(low: Val | None = None, high: Val | None = None) -> Val:
    if low is None:
        return whole(F.floor(F.rand() * (2**31 - 1)))
    return whole(low.col + F.floor(F.rand() * (high.col - low.col)))


# JSON


@fn("JSON", n=1)
def json(v: Val) -> Val:
    """The value of a JSON text; null if it is none. Keys need no quotes. A constant is a typed value, extended notation included; of a column the fields
    and items can be asked for, however deep, and are texts: use INT, DOUBLE and the like."""
    if v.kind != "string":
        return null()
    if v.literal and v.literal[0] is not None:
        from ..sources.extjson import decode

        try:
            return lit(decode(v.literal[0]))
        except (FolioError, ValueError):
            return null()
    alone = F.get(F.from_json(F.concat(F.lit("["), v.col, F.lit("]")), T.ArrayType(STRING), {**LENIENT, "mode": "PERMISSIVE"}), F.lit(0))
    start = F.ltrim(v.col)
    made = F.when(start.startswith("{"), F.when(json_fields(v.col).isNotNull(), v.col)).when(start.startswith("["), F.when(json_items(v.col).isNotNull(), v.col)).otherwise(alone)
    return Val(made, JsonText())


# Casts


def _to_int(t: T.DataType) -> Callable[..., Val]:
    def cast(v: Val) -> Val:
        if v.kind in ("int", "long"):
            return Val(v.col.try_cast(t), t)
        if v.kind in ("double", "decimal"):
            return Val(F.rint(v.col.cast(DOUBLE)).try_cast(t), t)
        if v.kind == "string":
            return Val(F.when(v.col.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v.col).try_cast(t)), t)
        return Val(v.col.cast(t), t) if v.kind == "bool" else null(t)

    return cast


fn("INT32", "INT", n=1)(_to_int(INT))
fn("INT64", "LONG", n=1)(_to_int(LONG))


#: Separators of groups of digits, the decimal point, and the short date, by culture; first the invariant one.
CULTURES = {
    "": (",", ".", "M/d/yyyy"),
    "en-US": (",", ".", "M/d/yyyy"),
    "en-GB": (",", ".", "d/M/yyyy"),
    "de-DE": (".", ",", "d.M.yyyy"),
    "es-ES": (".", ",", "d/M/yyyy"),
    "fr-FR": ("\u202f\u00a0", ",", "d/M/yyyy"),
    "it-IT": (".", ",", "d/M/yyyy"),
    "ja-JP": (",", ".", "yyyy/M/d"),
    "zh-CN": (",", ".", "yyyy/M/d"),
}


def _culture(v: Val | None) -> tuple[str, str, str]:
    """By name, or by the language of the first that has it."""
    name = str(constant(v, "a culture")).lower() if v else ""
    for known, values in CULTURES.items():
        if name in (known.lower(), known.lower().split("-")[0]) or name == "invariant":
            return values
    raise BindFault(f"culture {name!r} is not supported: only {', '.join(filter(None, CULTURES))} and the invariant one")


def _to_real(t: T.DataType) -> Callable[..., Val]:
    def cast(v: Val, culture: Val | None = None) -> Val:
        """Groups may be set apart after the first digit; brackets around a number stand for a minus sign."""
        groups, point, _ = _culture(culture)
        if v.kind in NUMBERS:
            return Val(v.col.try_cast(t), t)
        if v.kind != "string":
            return null(t)
        digits = rf"(?:[0-9][0-9{groups}]*(?:[{point}][0-9]*)?|[{point}][0-9]+)(?:[eE][+-]?[0-9]+)?"
        bare = F.trim(v.col, F.lit(BLANKS))
        plain = F.translate(F.translate(bare, f"{groups}()", ""), point, ".")
        number = F.when(bare.rlike(rf"^[+-]?{digits}$"), plain).when(bare.rlike(rf"^\({digits}\)$"), F.concat(F.lit("-"), plain))
        if t == DOUBLE:
            endless = "\u221e" if culture and constant(culture, "a culture") else "Infinity"
            number = F.when(bare.rlike("^[+-]?NaN$"), "NaN").when(bare.rlike(f"^[+-]?{endless}$"), F.replace(bare, F.lit(endless), F.lit("Infinity"))).otherwise(number)
        return Val(number.try_cast(t), t)

    return cast


fn("DOUBLE", n=(1, 2))(_to_real(DOUBLE))
fn("DECIMAL", n=(1, 2))(_to_real(T.DecimalType(38, 18)))
fn("STRING", n=1)(lambda v: text(to_text(v)))


@fn("BINARY", n=1)
def binary(v: Val) -> Val:
    if v.kind == "string":
        return Val(F.try_to_binary(F.regexp_replace(v.col, r"\s", ""), F.lit("base64")), T.BinaryType())
    return v if v.kind == "binary" else null(T.BinaryType())


fn("OBJECTID", n=1)(lambda v: text(F.when(v.col.rlike("^[0-9a-fA-F]{24}$"), F.lower(v.col))) if v.kind == "string" else null(STRING))
fn("GUID", n=1)(lambda v: text(F.when(v.col.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(v.col))) if v.kind == "string" else null(STRING))
fn("GUID", n=0)(lambda: text(F.uuid()))
fn("OBJECTID", n=0)(lambda: text(F.concat(F.lower(F.lpad(F.hex(F.unix_timestamp()), 8, "0")), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))))
fn("OID_CREATIONTIME", n=1)(lambda v: Val(F.timestamp_seconds(F.conv(F.substring(v.col, 1, 8), 16, 10).cast("long")), DATE) if v.kind == "string" else null(DATE))


@fn("BOOLEAN", "BOOL", n=1)
def boolean(v: Val) -> Val:
    if v.kind == "bool":
        return Val(F.coalesce(v.col, F.lit(False)), BOOL)
    if v.kind == "string":
        low = F.lower(F.trim(v.col))
        return Val(F.when(v.col.isNull(), False).when(low == "true", True).when(low == "false", False), BOOL)
    return lit(False) if v.kind == "null" else Val(F.when(v.col.isNull(), False), BOOL)


def milliseconds(c: Column) -> Column:
    return F.date_trunc("MILLISECOND", c.cast(DATE))


@fn("DATETIME", "DATE", "DATETIME_UTC", "DATE_UTC", n=(1, 2, 3))
def datetime(a: Val, b: Val | None = None, c: Val | None = None) -> Val:
    if c:
        return Val(F.try_make_timestamp(a.col, b.col, c.col, F.lit(0), F.lit(0), F.lit(0)), DATE)
    short = _culture(b)[2]
    if a.kind == "date":
        return Val(milliseconds(a.col), DATE)
    if a.kind != "string":
        return null(DATE)
    return Val(milliseconds(F.coalesce(F.try_to_timestamp(a.col), F.try_to_timestamp(F.trim(a.col), F.lit(f"{short}[ H:m[:s]]")))), DATE)


fn("NOW", "NOW_UTC", n=0)(lambda: Val(milliseconds(F.current_timestamp()), DATE))
fn("TODAY", n=0)(lambda: Val(F.current_date().cast(DATE), DATE))


# The ends of the order. As results they are the texts of their extended notation.


fn("MINVALUE", n=0)(lambda: Val(F.lit('{"$minValue":"1"}'), Lowest(), literal=("$minValue",)))
fn("MAXVALUE", n=0)(lambda: Val(F.lit('{"$maxValue":"1"}'), Highest(), literal=("$maxValue",)))


# Types


def _is(name: str, *kinds: str) -> None:
    def test(v: Val) -> Val:
        return Val(v.col.isNotNull(), BOOL) if v.kind in kinds else lit(False)

    fn(name, n=1)(test)


for _name, _kinds in {
    "IS_INT32": ("int",), "IS_INT": ("int",), "IS_INT64": ("long",), "IS_LONG": ("long",), "IS_DOUBLE": ("double",), "IS_DECIMAL": ("decimal",),
    "IS_NUMBER": NUMBERS, "IS_STRING": ("string",), "IS_DOCUMENT": ("doc",), "IS_ARRAY": ("array",), "IS_BINARY": ("binary",),
    "IS_BOOLEAN": ("bool",), "IS_BOOL": ("bool",), "IS_DATETIME": ("date",), "IS_DATE": ("date",), "IS_MINVALUE": ("min",), "IS_MAXVALUE": ("max",),
}.items():
    _is(_name, *_kinds)
fn("IS_NULL", n=1)(lambda v: Val(v.col.isNull(), BOOL))
#: Functions that take a sequence as it is; all others take one value in each place.
SEQUENCES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "FIRST", "LAST", "ANY", "ARRAY", "JOIN", "ITEMS", "CONCAT", "DISTINCT", "TOP", "UNION", "EXCEPT"}
fn("IS_OBJECTID", n=1)(lambda v: Val(F.coalesce(v.col.rlike("^[0-9a-f]{24}$"), F.lit(False)), BOOL) if v.kind == "string" else lit(False))
fn("IS_GUID", n=1)(lambda v: Val(F.coalesce(v.col.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False)), BOOL) if v.kind == "string" else lit(False))


def contains(items: Val, x: Val) -> Val:
    """IN: any item equal to x; what is no array is compared itself."""
    if items.kind != "array":
        return Val(equal(x, items), BOOL)
    known = items.literal[0] if items.literal else None
    if isinstance(known, list) and known and all(y is not None for y in known) and Val(x.col, items.element).kind == x.kind:
        return Val(F.coalesce(x.col.isin(known), F.lit(False)), BOOL)
    return Val(F.coalesce(F.exists(items.col, lambda y: equal(x, Val(y, items.element))), F.lit(False)), BOOL)
