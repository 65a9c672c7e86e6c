"""Expressions as Catalyst columns: a value and an error for each node.

Exactly one of the two is set for a row (a value may be NULL only where a method returned nothing).
Every column built here is total, so no row can fail a query, under ANSI mode too. Arithmetic wraps
like the JVM's, NULL inputs are errors, equality is strict about types unless asked otherwise.
Booleans have a second form for filters, as plain predicates "is true" and "is false" in which failure
is NULL; these reach the data source.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.errors import TypeMismatch
from ferrule.functions.methods import find, wrap_int
from ferrule.plans.syntax import Binary, Call, Literal, Node, Unary, Variable
from ferrule.plans.typing import NUMERIC

KINDS = {
    T.IntegerType: "Integer", T.LongType: "Long", T.DoubleType: "Double", T.FloatType: "Float", T.ShortType: "Short", T.ByteType: "Byte",
    T.DecimalType: "BigDecimal", T.BooleanType: "Boolean", T.StringType: "String", T.MapType: "Map", T.ArrayType: "List", T.DateType: "LocalDate",
    T.TimestampType: "Instant",
}

#: For variables that no column is bound to: they fail in every row, as their declared type.
SPARK = {
    "Integer": "int", "Long": "bigint", "Double": "double", "Float": "float", "Short": "smallint", "Byte": "tinyint", "BigDecimal": "decimal(38,18)",
    "Boolean": "boolean", "String": "string", "LocalDate": "date", "Instant": "timestamp",
}


@dataclass(frozen=True)
class Lowered:
    value: Column
    error: Column | None  # None: can't fail
    kind: str
    literal: object = None


def first(*errors: Column | None) -> Column | None:
    known = [e for e in errors if e is not None]
    return None if not known else known[0] if len(known) == 1 else F.coalesce(*known)


def _guard(value: Column, error: Column | None) -> Column:
    return value if error is None else F.when(error.isNull(), value)


class Lowering:
    """columns: variable -> (Column, Spark type, nullable)."""

    def __init__(self, columns: dict[str, tuple[Column, T.DataType, bool]], equality: str = "strict", declared: dict[str, str] | None = None):
        if equality not in ("strict", "numeric"):
            raise ValueError("equality is 'strict' or 'numeric'")
        self.columns, self.numeric_equality, self.declared = columns, equality == "numeric", declared or {}

    def lower(self, node: Node) -> Lowered:
        if isinstance(node, Literal):
            kind, spark = {bool: ("Boolean", "boolean"), int: ("Long", "bigint"), float: ("Double", "double"), str: ("String", "string")}[type(node.value)]
            return Lowered(F.lit(node.value).cast(spark), None, kind, node.value)
        if isinstance(node, Variable):
            return self._variable(node.name)
        if isinstance(node, Unary):
            return self._unary(node)
        if isinstance(node, Call):
            return self._call(node)
        left, right = self.lower(node.left), self.lower(node.right)
        if node.op in ("&&", "||"):
            return self._logic(node.op, left, right)
        error = first(left.error, right.error)
        if node.op in ("==", "!="):
            same = self._equal(left, right)
            return Lowered(_guard(same if node.op == "==" else ~same, error), error, "Boolean")
        if node.op in (">", "<", ">=", "<="):
            return Lowered(_guard(self._compare(node.op, left, right), error), error, "Boolean")
        if node.op == "+" and "String" in (left.kind, right.kind):
            return Lowered(_guard(F.concat(left.value.cast("string"), right.value.cast("string")), error), error, "String")
        return self._arithmetic(node.op, left, right, error)

    def _variable(self, name: str) -> Lowered:
        message = F.lit(f"Missing variable in execution context: {name}")
        if name not in self.columns:
            kind = self.declared.get(name, "Object")
            return Lowered(F.lit(None).cast(SPARK.get(kind, "void")), message, kind)
        column, kind, nullable = self.columns[name]
        return Lowered(column, F.when(column.isNull(), message) if nullable else None, KINDS.get(type(kind), "Object"))

    def _unary(self, node: Unary) -> Lowered:
        x = self.lower(node.operand)
        if node.op == "!":
            return Lowered(~x.value, x.error, "Boolean")
        if x.kind in ("Double", "Float"):
            return Lowered(-x.value, x.error, x.kind)
        if x.kind == "Integer":
            return Lowered(wrap_int(-x.value.cast("long")), x.error, "Integer")
        if x.kind == "Long":
            return Lowered(F.coalesce(F.try_subtract(F.lit(0).cast("long"), x.value), x.value), x.error, "Long")
        return Lowered(F.lit(None).cast("int"), first(x.error, F.lit("Cannot negate non-numeric value")), "Integer")

    def _logic(self, op: str, left: Lowered, right: Lowered) -> Lowered:
        decides = left.value if op == "&&" else ~left.value  # then the right one counts
        error = first(left.error, None if right.error is None else F.when(decides, right.error))
        value = F.when(decides, right.value).otherwise(F.lit(op == "||"))
        return Lowered(_guard(value, error), error, "Boolean")

    def _equal(self, left: Lowered, right: Lowered) -> Column:
        if left.kind == right.kind or self.numeric_equality and left.kind in NUMERIC and right.kind in NUMERIC:
            if left.kind != right.kind:
                left, right = _double(left), _double(right)
            same = left.value == right.value
            if left.kind in ("Double", "Float") and not _never_zero(left, right) and not self.numeric_equality:
                same = same & (_minus_zero(left) == _minus_zero(right))
            return same
        return F.lit(False)

    @staticmethod
    def _compare(op: str, left: Lowered, right: Lowered) -> Column:
        """By double value; NaN is largest, and -0.0 less than 0.0 where both can occur."""
        signed = {"Double", "Float"} & {left.kind, right.kind} and not _never_zero(left, right)
        whole = {left.kind, right.kind} <= {"Integer", "Long", "Short", "Byte"}
        small = any(isinstance(x.literal, int) and abs(x.literal) < 2**53 for x in (left, right)) or "Long" not in (left.kind, right.kind)
        wanted = "Long" if whole and small else "Double"  # then both order alike, and the column itself reaches the scan
        a, b = (x.value if x.kind == wanted else x.value.cast(wanted.lower()) for x in (left, right))
        plain = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
        if not signed:
            return plain
        x, y = _minus_zero(left), _minus_zero(right)
        if op == "<":
            return plain | ((a == b) & x & ~y)
        if op == ">":
            return plain | ((a == b) & ~x & y)
        return plain & ~((a == b) & ((~x & y) if op == "<=" else (x & ~y)))

    def _arithmetic(self, op: str, left: Lowered, right: Lowered, error: Column | None) -> Lowered:
        if left.kind not in NUMERIC or right.kind not in NUMERIC:
            raise TypeMismatch(f"Operator '{op}' requires numeric operands but got {left.kind} and {right.kind}")
        if "Double" in (left.kind, right.kind):
            a, b = _double(left).value, _double(right).value
            value = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: _ieee(a, b)}[op]()
            return Lowered(_guard(value, error), error, "Double")
        kind = "Long" if "Long" in (left.kind, right.kind) else "Integer"
        a, b = _whole(left, kind), _whole(right, kind)
        if op == "/" and not (right.literal is not None and right.literal != 0):
            error = first(error, F.when(b == 0, F.lit("/ by zero")))
        value = _long(op, a, b) if kind == "Long" else _int(op, a, b)
        return Lowered(_guard(value, error), error, kind)

    def _call(self, node: Call) -> Lowered:
        target, args = self.lower(node.target), [self.lower(a) for a in node.args]
        failed = F.lit(f"Method invocation failed: {node.method}")
        error = first(target.error, *[a.error for a in args])
        method = find(target.kind, node.method, tuple(a.kind for a in args))
        if method is None:
            return Lowered(F.lit(None).cast("boolean"), first(error, failed), "Object")
        values = [a.value for a in args]
        if node.method == "equals" and args[0].kind != target.kind:
            value = F.lit(False)
        else:
            known = {"literals": [a.literal for a in args]} if method.literals else {}
            value = method.lower(target.value, *values, **known)
        if target.kind == "Object" or isinstance(node.target, Call):
            error = first(error, F.when(target.value.isNull(), F.lit(f"Cannot invoke method '{node.method}' on null target")))
        if method.result != "Object":
            error = first(error, F.when(value.isNull(), failed))
        return Lowered(_guard(value, error), error, method.result)

    def truth(self, node: Node, wanted: bool = True) -> Column:
        """A predicate that is TRUE exactly where a boolean expression succeeds with `wanted`."""
        if isinstance(node, Unary) and node.op == "!":
            return self.truth(node.operand, not wanted)
        if isinstance(node, Binary) and node.op in ("&&", "||"):
            both = (node.op == "&&") == wanted
            one, other = self.truth(node.left, wanted), self.truth(node.right, wanted)
            return one & other if both else one | (self.truth(node.left, not wanted) & other)
        x = self.lower(node)
        leaf = x.value
        if isinstance(node, Binary) and node.op in (*"<>", ">=", "<="):
            a, b = self.lower(node.left), self.lower(node.right)
            if not any(isinstance(n, (Call, Binary, Unary)) for n in (node.left, node.right)):
                leaf = self._compare(node.op, a, b)  # NULL operands make it NULL by themselves
        elif isinstance(node, Binary) and node.op in ("==", "!="):
            a, b = self.lower(node.left), self.lower(node.right)
            if a.kind == b.kind and not any(isinstance(n, (Call, Binary, Unary)) for n in (node.left, node.right)):
                leaf = self._equal(a, b)
                leaf = leaf if node.op == "==" else ~leaf
        return leaf if wanted else ~leaf


def _never_zero(*sides: Lowered) -> bool:
    return any(isinstance(x.literal, (int, float)) and not isinstance(x.literal, bool) and x.literal != 0 for x in sides) or all(
        x.kind not in ("Double", "Float") for x in sides
    )


def _minus_zero(x: Lowered) -> Column:
    return x.value.cast("string") == "-0.0" if x.kind in ("Double", "Float") else F.lit(False)


def _double(x: Lowered) -> Lowered:
    return x if x.kind == "Double" else Lowered(x.value.cast("double"), x.error, "Double", x.literal)


def _whole(x: Lowered, kind: str) -> Column:
    """intValue() or longValue() of any number: fractions are cut, floats saturate, decimals wrap."""
    spark, top = ("long", 2**63 - 1) if kind == "Long" else ("int", 2**31 - 1)
    if x.kind in ("Float", "Double"):
        v = x.value.cast("double")
        return F.when(F.isnan(v), F.lit(0)).when(v >= float(top), F.lit(top)).when(v <= -float(top), F.lit(-top - 1)).otherwise(v.try_cast(spark)).cast(spark)
    if x.kind == "BigDecimal":
        low = F.when(x.value < 0, F.ceil(x.value)).otherwise(F.floor(x.value)).cast("decimal(38,0)")
        span = F.lit(Decimal(2 ** (64 if kind == "Long" else 32))).cast("decimal(38,0)")
        half = F.lit(Decimal(top + 1)).cast("decimal(38,0)")
        return (F.pmod(low + half, span) - half).try_cast(spark)
    return x.value.cast(spark)


def _int(op: str, a: Column, b: Column) -> Column:
    x, y = a.cast("long"), b.cast("long")
    if op == "/":
        return wrap_int(F.call_function("div", x, F.nullif(y, F.lit(0).cast("long"))))
    return wrap_int({"+": x + y, "-": x - y, "*": x * y}[op])


def _long(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        zero, minus = F.lit(0).cast("long"), F.lit(-1).cast("long")
        by = F.call_function("div", a, F.nullif(F.nullif(b, zero), minus))
        return F.coalesce(by, F.when(b == -1, F.coalesce(F.try_subtract(zero, a), a)))
    native = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    x, y = (c.cast("decimal(19,0)") for c in (a, b))
    exact = {"+": x + y, "-": x - y, "*": x * y}[op].cast("decimal(38,0)")
    span, half = (F.lit(Decimal(n)).cast("decimal(20,0)") for n in (2**64, 2**63))
    # the sum of a 38-digit product and half may pass 38 digits, so the product is reduced first
    wrapped = F.pmod(F.pmod(exact, span).cast("decimal(21,0)") + half, span.cast("decimal(21,0)")) - half
    return F.coalesce(native, wrapped.cast("decimal(20,0)").try_cast("long"))


def _ieee(a: Column, b: Column) -> Column:
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), nan).when((a > 0) == (b.cast("string") == "0.0"), inf).otherwise(-inf)
