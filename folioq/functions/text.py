"""Values as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindFault
from .values import Val

#: What a custom date format's letters mean to Spark's formatter.
DATE_FORMATS = {"d": "MM/dd/yyyy", "s": "yyyy-MM-dd'T'HH:mm:ss", "u": "yyyy-MM-dd HH:mm:ss'Z'", "o": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS", "t": "HH:mm", "T": "HH:mm:ss", "D": "EEEE, dd MMMM yyyy", "Y": "yyyy MMMM", "M": "MMMM dd"}
DATE_LETTERS = {"tt": "a", "dddd": "EEEE", "ddd": "EEE", "f": "S", "ff": "SS", "fff": "SSS"}


def double_text(x: Column) -> Column:
    """At least one decimal, at most nine."""
    fixed = F.regexp_replace(F.format_string("%.9f", x), "0+$", "")
    return F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def iso(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json_text(v: Val) -> Column:
    """The value as JSON, with $-keys for what JSON has no notation for."""
    k, c = v.kind, v.col
    if k == "string":
        return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    if k == "int":
        return c.cast("string")
    if k == "long":
        return F.concat(F.lit('{"$numberLong":"'), c.cast("string"), F.lit('"}'))
    if k == "decimal":
        return F.concat(F.lit('{"$numberDecimal":"'), c.cast("string"), F.lit('"}'))
    if k == "double":
        return double_text(c)
    if k == "bool":
        return c.cast("string")
    if k == "date":
        return F.concat(F.lit('{"$date":"'), iso(c), F.lit('"}'))
    if k == "binary":
        return F.concat(F.lit('{"$binary":"'), F.base64(c), F.lit('"}'))
    if k == "null":
        return F.lit("null")
    if k in ("min", "max"):
        return c
    if k == "array":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(json_text(Val(x, v.element)), F.lit("null"))), ","), F.lit("]"))
    if hasattr(v.type, "fields"):
        parts = [F.concat(F.lit(f'"{f.name}":'), F.coalesce(json_text(Val(v.fields(f.name) if v.fields else c.getField(f.name), f.dataType)), F.lit("null"))) for f in v.type.fields]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return F.to_json(c)


def to_text(v: Val) -> Column:
    """Null is empty, a string itself, anything else its JSON."""
    if v.kind == "string":
        return F.coalesce(v.col, F.lit(""))
    if v.kind == "null":
        return F.lit("")
    return F.coalesce(json_text(v), F.lit(""))


def date_pattern(fmt: str) -> str:
    """A date format in the letters of Spark's formatter."""
    if len(fmt) == 1:
        return DATE_FORMATS.get(fmt, fmt)

    def put(m: re.Match) -> str:
        return DATE_LETTERS.get(m[0], m[0])

    return re.sub(r"(.)\1*", put, fmt)


def formatted(v: Val, fmt: str) -> Column:
    """FORMAT for constants of the invariant culture: N, F, D, P, X, E and 0/# patterns for numbers; dates by letters."""
    if v.kind == "date":
        return F.date_format(v.col, date_pattern(fmt))
    if v.kind == "bool":
        return F.when(v.col, F.lit("True")).otherwise(F.lit("False"))
    if "{" in fmt or "}" in fmt:
        raise BindFault(f"no format {fmt!r}")
    if v.kind not in ("int", "long", "double", "decimal"):
        return to_text(v)
    m = re.fullmatch(r"([A-Za-z])(\d*)", fmt)
    digits = int(m[2]) if m and m[2] else 2
    letter = m[1].upper() if m else ""
    if letter == "N":
        return F.format_number(v.col, digits)
    if letter == "F":
        return F.format_string(f"%.{digits}f", v.col.cast("double"))
    if letter == "C":
        return F.concat(F.when(v.col < 0, F.lit("(¤")).otherwise(F.lit("¤")), F.format_number(F.abs(v.col), digits), F.when(v.col < 0, F.lit(")")).otherwise(F.lit("")))
    if letter == "P":
        return F.concat(F.format_number(v.col.cast("double") * 100, digits), F.lit(" %"))
    if letter == "D":
        return F.format_string(f"%0{max(1, digits if m[2] else 1)}d", v.col.cast("long"))
    if letter == "X":
        text = F.hex(v.col.cast("long"))
        return F.concat(F.repeat(F.lit("0"), F.lit(digits if m[2] else 1) - F.length(text)), text)
    if letter == "E":
        return F.format_string(f"%.{digits if m[2] else 6}E", v.col.cast("double"))
    if m and letter == "G" or not fmt:
        return v.col.cast("string")
    whole, _, part = fmt.partition(".")
    least, most = part.count("0"), len(part)
    text = F.format_string(f"%{',' if ',' in whole else ''}.{most}f", v.col.cast("double"))
    if most > least:
        text = F.regexp_replace(text, rf"0{{1,{most - least}}}$", "")
        text = F.regexp_replace(text, r"\.$", "")
    pad = whole.count("0")
    return F.when(F.length(F.substring_index(text, ".", 1)) < pad, F.concat(F.repeat(F.lit("0"), F.lit(pad) - F.length(F.substring_index(text, ".", 1))), text)).otherwise(text) if pad > 1 else text
