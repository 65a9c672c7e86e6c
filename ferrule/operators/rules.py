"""Rules applied to DataFrames: results row by row, as filters, and many rules at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.errors import CompileError, TypeMismatch
from ferrule.plans.lower import Lowered, Lowering
from ferrule.plans.simplify import simplify
from ferrule.plans.syntax import Node, parse, variables
from ferrule.plans.typing import check
from ferrule.sources.rules import Rule, parse_rule


@dataclass(frozen=True)
class CompiledRule:
    """A checked rule; the columns it is bound to decide how it evaluates."""

    rule: Rule
    node: Node
    result_type: str
    equality: str = "strict"

    @property
    def name(self) -> str:
        return self.rule.name

    def _lowering(self, df: DataFrame, binding: dict[str, str] | None) -> Lowering:
        fields, columns = {f.name: f for f in df.schema.fields}, {}
        for name in variables(self.node):
            source = (binding or {}).get(name, name)
            if source in fields:
                columns[name] = (df[source], fields[source].dataType, fields[source].nullable)
        return Lowering(columns, self.equality, self.rule.types())

    def lowered(self, df: DataFrame, binding: dict[str, str] | None = None) -> Lowered:
        try:
            return self._lowering(df, binding).lower(self.node)
        except TypeMismatch as e:
            raise CompileError("lowering", self.name, e) from e

    def result(self, df: DataFrame, binding: dict[str, str] | None = None) -> Column:
        """struct(success, result, error); a row that fails never fails the query."""
        x = self.lowered(df, binding)
        error = F.lit(None).cast("string") if x.error is None else x.error
        return F.struct(error.isNull().alias("success"), x.value.alias("result"), error.alias("error"))

    def value(self, df: DataFrame, binding: dict[str, str] | None = None) -> Column:
        return self.lowered(df, binding).value

    def error(self, df: DataFrame, binding: dict[str, str] | None = None) -> Column:
        x = self.lowered(df, binding)
        return F.lit(None).cast("string") if x.error is None else x.error

    def where(self, df: DataFrame, binding: dict[str, str] | None = None) -> DataFrame:
        """The rows for which the rule succeeds with true; the predicate is plain, so it is pushed down."""
        if self.result_type != "Boolean":
            raise CompileError("lowering", self.name, TypeMismatch("only a boolean rule can filter"))
        return df.where(self._lowering(df, binding).truth(self.node))


def compile_rule(rule: Rule | str, optimize: bool = True, equality: str = "strict") -> CompiledRule:
    if isinstance(rule, str) or rule is None:
        try:
            rule = parse_rule(rule)
        except ValueError as e:
            raise CompileError("JSON parsing", "?", e) from e
    try:
        node = parse(rule.expression)
    except ValueError as e:
        raise CompileError("AST building", rule.name, e) from e
    try:
        kind = check(node, rule.types())
        node = simplify(node) if optimize else node
    except (TypeError, ValueError) as e:
        raise CompileError("type checking", rule.name, e) from e
    return CompiledRule(rule, node, kind, equality)


def apply_rules(df: DataFrame, rules: list[CompiledRule], binding: dict[str, str] | None = None) -> DataFrame:
    """df plus one struct column a rule, in one projection."""
    return df.select("*", *[r.result(df, binding).alias(r.name) for r in rules])


def apply_rules_long(df: DataFrame, rules: list[CompiledRule], keys: list[str], binding: dict[str, str] | None = None) -> DataFrame:
    """One row for each row and rule: keys, rule, success, result (as text), error. No join and no second scan."""
    each = []
    for r in rules:
        x = r.result(df, binding)
        each.append(F.struct(F.lit(r.name).alias("rule"), x["success"].alias("success"), x["result"].cast("string").alias("result"), x["error"].alias("error")))
    return df.select(*keys, F.explode(F.array(*each)).alias("r")).select(*keys, "r.*")


def rule_summary(results: DataFrame) -> DataFrame:
    """By rule: total, success, failed, and how often the result was true."""
    return results.groupBy("rule").agg(
        F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success") & (F.col("result") == "true")).alias("matched"),
    )
