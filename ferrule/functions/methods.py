"""The methods that values have in expressions, and how each becomes a Column.

A method is (receiver, name, argument types) -> (result type, whether the result is a bare value that has
no methods itself, lowering). Integer arguments take int expressions only: whole-number literals are
longs. register() adds methods of a caller's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Method:
    receiver: str
    name: str
    args: tuple[str, ...]
    result: str
    bare: bool
    lower: Callable[..., Column]
    #: lower also takes `literals`, the arguments' values where they are literals.
    literals: bool = False


METHODS: dict[tuple[str, str], list[Method]] = {}


def register(receiver: str, name: str, args: tuple[str, ...], result: str, lower: Callable[..., Column], bare: bool = False, literals: bool = False) -> None:
    """lower(target, *args) gives the value; NULL stands for a failed call."""
    METHODS.setdefault((receiver, name), []).append(Method(receiver, name, args, result, bare, lower, literals))


def fits(given: str, wanted: str) -> bool:
    return wanted == "Object" or given == wanted


def find(receiver: str, name: str, args: tuple[str, ...]) -> Method | None:
    for m in METHODS.get((receiver, name), []):
        if len(m.args) == len(args) and all(map(fits, args, m.args)):
            return m
    return None


def _same(kind: str):
    return lambda t, a: (t == a) if a is not None else F.lit(False)


def _slice(t: Column, b: Column, e: Column | None = None) -> Column:
    e = F.length(t) if e is None else e
    return F.when((b >= 0) & (e >= b) & (e <= F.length(t)), F.substring(t, b + 1, e - b))


def _last(t: Column, a: Column) -> Column:
    return F.when(F.length(a) == 0, F.length(t)).otherwise(
        F.when(F.contains(t, a), F.length(t) - F.length(a) - (F.instr(F.reverse(t), F.reverse(a)) - 1)).otherwise(-1)
    )


def _cut(t: Column, kind: str, top: int) -> Column:
    """A double's whole part; what is beyond the type's range becomes its end, NaN 0."""
    whole = F.when(F.isnan(t), F.lit(0)).when(t >= float(top), F.lit(top)).when(t <= -float(top), F.lit(-top - 1)).otherwise(t.try_cast(kind))
    return whole.cast(kind)


def _sign(t: Column, a: Column) -> Column:
    return F.when(t < a, -1).when(t > a, 1).otherwise(0)


def _compare(t: Column, a: Column) -> Column:
    """The difference of the first characters that differ, or of the lengths."""
    n = F.least(F.length(t), F.length(a))
    at = F.array_position(F.transform(F.sequence(F.lit(0), n), lambda i: (i < n) & (F.substring(t, i + 1, F.lit(1)) != F.substring(a, i + 1, F.lit(1)))), True)
    code = lambda x: F.ascii(F.substring(x, at.cast("int"), F.lit(1)))
    return F.when(t == a, 0).when(at > 0, code(t) - code(a)).otherwise(F.length(t) - F.length(a))


def _hash(t: Column) -> Column:
    """31 * h + c over the UTF-16 units, wrapping at 32 bits."""
    units = F.transform(F.split(F.rtrim(F.regexp_replace(F.hex(F.encode(t, "UTF-16BE")), "(.{4})", "$1 ")), " "), lambda x: F.conv(x, 16, 10).cast("long"))
    step = lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295))
    return F.when(F.length(t) == 0, 0).otherwise(wrap_int(F.aggregate(units, F.lit(0).cast("long"), step)))


def _replace(t: Column, a: Column, b: Column) -> Column:
    """An empty text stands between all characters, before the first and after the last."""
    between = F.concat(b, F.array_join(F.split(t, ""), "\x00"), b)
    return F.when(F.length(a) > 0, F.replace(t, a, b)).when(F.length(t) == 0, b).otherwise(F.replace(between, F.lit("\x00"), b))


def _pattern_fault(pattern: str) -> bool:
    """Whether the JVM rejects a pattern."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return True
    return False


def _guarded(pattern: Column, literal: object, value: Column) -> Column:
    """NULL for a pattern that can't be compiled: known at once for a literal, else tried row by row."""
    if isinstance(literal, str):
        return F.lit(None).cast("string") if _pattern_fault(literal) else value
    return F.when(F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull(), value)


def _matches(t: Column, a: Column, literals=(None,)) -> Column:
    [literal] = literals
    if isinstance(literal, str) and _pattern_fault(literal):
        return F.lit(None).cast("boolean")
    return _guarded(a, literal, F.rlike(t, F.concat(F.lit("^(?:"), a, F.lit(")\\z"))))


def _allowed(pattern: object) -> str:
    """What a replacement may be: text, escaped characters and groups that a literal pattern has; of another pattern the whole match only."""
    from pyspark import SparkContext

    groups = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount() if isinstance(pattern, str) else 0
    return rf"(?s:[^$\\]|\\.|\$[0-{min(groups, 9)}])*"


def _replace_all(t: Column, a: Column, b: Column, literals=(None, None)) -> Column:
    """A replacement that names no group of the pattern fails where there is a match, as in the JVM."""
    pattern, replacement = literals
    if isinstance(pattern, str) and _pattern_fault(pattern):
        return F.lit(None).cast("string")
    if isinstance(replacement, str):
        value = F.regexp_replace(t, a, b) if re.fullmatch(_allowed(pattern), replacement) else F.when(~F.rlike(t, a), t)
    else:
        value = F.when(F.rlike(b, F.lit(f"^{_allowed(pattern)}\\z")), F.regexp_replace(t, a, b)).when(~F.rlike(t, a), t)
    return _guarded(a, pattern, value)


def _replace_first(t: Column, a: Column, b: Column, literals=(None, None)) -> Column:
    """The first match, replaced on its own."""
    if isinstance(literals[0], str) and _pattern_fault(literals[0]):
        return F.lit(None).cast("string")
    found, at = F.call_function("regexp_extract", t, a, F.lit(0)), F.regexp_instr(t, a)
    one = _replace_all(found, a, b, literals)
    joined = F.concat(F.substring(t, F.lit(1), at - 1), one, F.substring(t, at + F.length(found), F.length(t)))
    return _guarded(a, literals[0], F.when(F.rlike(t, a), joined).otherwise(t))


_EDGE = "^[\\x00-\\x20]+|[\\x00-\\x20]+$"
S, I, B = "String", "Integer", "Boolean"
for _name, _args, _result, _bare, _lower in (
    ("equalsIgnoreCase", (S,), B, True, lambda t, a: F.lower(F.upper(t)) == F.lower(F.upper(a))),
    ("endsWith", (S,), B, True, lambda t, a: F.endswith(t, a)),
    ("startsWith", (S,), B, True, lambda t, a: F.startswith(t, a)),
    ("contains", (S,), B, True, lambda t, a: F.contains(t, a)),
    ("length", (), I, True, lambda t: F.length(t)),
    ("isEmpty", (), B, True, lambda t: F.length(t) == 0),
    ("isBlank", (), B, True, lambda t: F.rlike(t, F.lit("^\\s*\\z"))),
    ("toLowerCase", (), S, False, lambda t: F.lower(t)),
    ("toUpperCase", (), S, False, lambda t: F.upper(t)),
    ("trim", (), S, False, lambda t: F.regexp_replace(t, _EDGE, "")),
    ("strip", (), S, False, lambda t: F.regexp_replace(t, "^\\s+|\\s+$", "")),
    ("toString", (), S, False, lambda t: t),
    ("concat", (S,), S, False, lambda t, a: F.concat(t, a)),
    ("replace", (S, S), S, False, _replace),
    ("indexOf", (S,), I, True, lambda t, a: F.instr(t, a) - 1),
    ("lastIndexOf", (S,), I, True, _last),
    ("compareTo", (S,), I, True, _compare),
    ("hashCode", (), I, True, lambda t: _hash(t)),
    ("substring", (I,), S, False, _slice),
    ("substring", (I, I), S, False, _slice),
    ("charAt", (I,), "Character", True, lambda t, i: F.when((i >= 0) & (i < F.length(t)), F.substring(t, i + 1, F.lit(1)))),
    ("repeat", (I,), S, False, lambda t, n: F.when(n >= 0, F.repeat(t, n))),
):
    register(S, _name, _args, _result, _lower, _bare)
register(S, "matches", (S,), B, _matches, True, literals=True)
register(S, "replaceAll", (S, S), S, _replace_all, literals=True)
register(S, "replaceFirst", (S, S), S, _replace_first, literals=True)
for _kind in (S, I, "Long", "Double", B):
    register(_kind, "equals", ("Object",), B, _same(_kind), True)
for _kind in (I, "Long", "Double"):
    register(_kind, "toString", (), S, lambda t: t.cast("string"))
    register(_kind, "compareTo", (_kind,), I, _sign, True)
    register(_kind, "doubleValue", (), "Double", lambda t: t.cast("double"), True)
for _kind in (I, "Long"):
    register(_kind, "longValue", (), "Long", lambda t: t.cast("long"), True)
    register(_kind, "intValue", (), I, lambda t: wrap_int(t.cast("long")), True)
register(I, "hashCode", (), I, lambda t: t, True)
register("Long", "hashCode", (), I, lambda t: wrap_int(t.bitwiseXOR(F.shiftrightunsigned(t, 32))), True)
register(B, "hashCode", (), I, lambda t: F.when(t, 1231).otherwise(1237), True)
register("Double", "intValue", (), I, lambda t: _cut(t, "int", 2**31 - 1), True)
register("Double", "longValue", (), "Long", lambda t: _cut(t, "long", 2**63 - 1), True)
register("Double", "isNaN", (), B, lambda t: F.isnan(t), True)
register("Double", "isInfinite", (), B, lambda t: F.abs(t) == F.lit(float("inf")), True)
register(B, "toString", (), S, lambda t: t.cast("string"))
register(B, "booleanValue", (), B, lambda t: t, True)
register("Map", "size", (), I, lambda t: F.size(t), True)
register("Map", "isEmpty", (), B, lambda t: F.size(t) == 0, True)
register("Map", "containsKey", ("Object",), B, lambda t, k: F.map_contains_key(t, k), True)
register("Map", "get", ("Object",), "Object", lambda t, k: F.try_element_at(t, k))
register("List", "size", (), I, lambda t: F.size(t), True)
register("List", "isEmpty", (), B, lambda t: F.size(t) == 0, True)
register("List", "contains", ("Object",), B, lambda t, x: F.coalesce(F.array_contains(t, x), F.lit(False)), True)
register("List", "get", (I,), "Object", lambda t, i: F.when(i >= 0, F.try_element_at(t, i + 1)))


def wrap_int(x: Column) -> Column:
    """The low 32 bits of a long, as an int."""
    return ((x.bitwiseAND(F.lit(4294967295)) + 2147483648).bitwiseAND(F.lit(4294967295)) - 2147483648).cast("int")
