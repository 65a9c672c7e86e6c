import json
import math
import random

import pytest

from ferrule.errors import CompileError, ParseError, TypeMismatch
from ferrule.operators.catalog import RuleCatalog
from ferrule.operators.execute import Executor
from ferrule.operators.rules import apply_rules, compile_rule
from ferrule.plans.simplify import simplify
from ferrule.plans.syntax import Binary, Call, Literal, Unary, Variable, parse
from ferrule.plans.typing import check
from ferrule.sources.rules import Rule, parse_rule


def run(spark, expression, record, schema, **declared):
    df = spark.createDataFrame([record], schema)
    return df.select(compile_rule(Rule("r", expression, input_schema=declared)).result(df).alias("r")).head()["r"]


def test_parse_shapes():
    assert parse("1 + 2 * 3") == Binary("+", Literal(1), Binary("*", Literal(2), Literal(3)))
    assert parse("-x.f(1, 'a\\'b')") == Unary("-", Call(Variable("x"), "f", (Literal(1), Literal("a'b"))))
    assert parse("a - b - c") == Binary("-", Binary("-", Variable("a"), Variable("b")), Variable("c"))
    assert parse("TRUE || false") == Binary("||", Literal(True), Literal(False))


@pytest.mark.parametrize("text", ["", "  ", None, "'open", "x @ y", "x + y z", "(x", "1.2.3", "x.", "f(", "x + "])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["y > 1", "flag * 5", "x && true", "x.nothing()", "!x", "-s", "s > 'a'", "s.length().toString()", "s.substring(0, 5)"])
def test_type_errors(text):
    with pytest.raises(TypeMismatch):
        check(parse(text), {"x": "Integer", "flag": "Boolean", "s": "String"})


@pytest.mark.parametrize(
    ("text", "value"),
    [("2 + 3", 5), ("'hello ' + 'world'", "hello world"), ("10 > 5", True), ("false && x > 10", False), ("true || x < 5", True), ("5 == 5.0", True), ("x > 1 && false", False), ("-(3)", -3), ("7 / 2", 3), ("-7 / 2", -3), ("9223372036854775807 + 1", -(2**63))],
)
def test_folding(text, value):
    assert simplify(parse(text)) == Literal(value)


def test_folding_leaves_open_operands():
    assert simplify(parse("true && x > 10")) == parse("x > 10")
    with pytest.raises(CompileError, match="by zero"):
        compile_rule(Rule("z", "1 / 0"))


@pytest.mark.parametrize(
    ("expression", "record", "schema", "declared", "expected"),
    [
        ("u + v", (31, -8), "u long, v long", {"u": "int", "v": "int"}, 23),
        ("tag.equals('blue')", ("blue",), "tag string", {"tag": "string"}, True),
        ("k * m - n", (7, 6, 11), "k long, m long, n long", {"k": "int", "m": "int", "n": "int"}, 31),
        ("load / lanes", (9.0, 8.0), "load double, lanes double", {"load": "double", "lanes": "double"}, 1.125),
        ("width * pieces", (2.25, 4), "width double, pieces int", {"width": "double", "pieces": "int"}, 9.0),
        ("p + s", ("A-", "b"), "p string, s string", {"p": "string", "s": "string"}, "A-b"),
        ("!d", (False,), "d boolean", {"d": "boolean"}, True),
        ("-b", (500,), "b long", {"b": "long"}, -500),
        ("x == 5", (5,), "x int", {"x": "int"}, False),
        ("x == 5", (5,), "x long", {"x": "long"}, True),
        ("x != 5", (5,), "x int", {"x": "int"}, True),
        ("email.endsWith('@c.com') && name.equalsIgnoreCase('Admin')", ("a@c.com", "admin"), "email string, name string", {"email": "string", "name": "string"}, True),
        ("x + 1", (2**63 - 1,), "x long", {"x": "long"}, -(2**63)),
        ("x * 3", (2**62,), "x long", {"x": "long"}, -(2**62)),
        ("x * x", (-(2**63),), "x long", {"x": "long"}, 0),
        ("x / y", (-(2**63), -1), "x long, y long", {"x": "long", "y": "long"}, -(2**63)),
        ("x * y", (2**31 - 1, 2), "x int, y int", {"x": "int", "y": "int"}, -2),
        ("-x", (-(2**31),), "x int", {"x": "int"}, -(2**31)),
        ("x / y", (1.0, 0.0), "x double, y double", {"x": "double", "y": "double"}, math.inf),
        ("x / y", (1.0, -0.0), "x double, y double", {"x": "double", "y": "double"}, -math.inf),
        ("x < y", (-0.0, 0.0), "x double, y double", {"x": "double", "y": "double"}, True),
        ("x == y", (-0.0, 0.0), "x double, y double", {"x": "double", "y": "double"}, False),
        ("low + 3 * mid - top / 4 >= 40 && !(left == right) && (spare < 7 || top != top)", (6, 12, 9, 1, 2, 3), "low int, mid int, top int, left int, right int, spare int", dict.fromkeys(("low", "mid", "top", "left", "right", "spare"), "int"), True),
    ],
)
def test_evaluation(spark, expression, record, schema, declared, expected):
    row = run(spark, expression, record, schema, **declared)
    assert (row.success, row.result, row.error) == (True, expected, None)


@pytest.mark.parametrize(
    ("call", "values", "expected"),
    [
        ("s.matches('[')", ("a",), None), ("s.matches('a|b.*')", ("bc",), True), ("s.matches(p)", ("aab", "a+"), False), ("s.matches(p)", ("x", "(x"), None),
        ("s.replaceAll('(a)', '$1$1')", ("aba",), "aabaa"), ("s.replaceAll('a', '$3')", ("aba",), None), ("s.replaceAll('z', '$3')", ("aba",), "aba"),
        ("s.replaceAll(p, 'x')", ("a[", "["), None), ("s.replaceAll(p, '<$0>')", ("ab", "[ab]"), "<a><b>"), ("s.replaceFirst('b+', '-')", ("abbab",), "a-ab"),
        ("s.replaceFirst('(b)(a)', '$2$1')", ("aba",), "aab"), ("s.replaceFirst('z', '$9')", ("ab",), "ab"), ("s.replaceFirst('a', '$9')", ("ab",), None), ("s.replaceFirst('*', 'x')", ("ab",), None),
        ("s.replace('', '.')", ("ab",), ".a.b."), ("s.replace('', '.')", ("",), "."), ("s.replace('a', '$1')", ("aa",), "$1$1"), ("s.hashCode()", ("polygenelubricants",), -(2**31)),
        ("s.hashCode()", ("",), 0), ("s.hashCode()", ("é😀",), (233 * 31 + 0xD83D) * 31 + 0xDE00), ("s.compareTo(p)", ("abc", "abd"), -1), ("s.compareTo(p)", ("abcde", "ab"), 3), ("s.compareTo(p)", ("b", "a"), 1),
    ],
)
def test_string_calls_never_fail_a_query(spark, call, values, expected):
    schema = ", ".join(f"{n} string" for n in "sp"[: len(values)])
    row = run(spark, call, values, schema, s="string", p="string")
    assert (row.success, row.error) == ((False, f"Method invocation failed: {call[2:].partition('(')[0]}") if expected is None else (True, None))
    assert row.result == expected


def test_number_calls(spark):
    for call, value, expected in (("d.intValue()", -7.9, -7), ("d.intValue()", 1e12, 2**31 - 1), ("d.longValue()", -1e30, -(2**63)), ("d.longValue()", math.nan, 0)):
        assert run(spark, call, (value,), "d double", d="double").result == expected
    assert run(spark, "n.hashCode()", (2**40 + 5,), "n long", n="long").result == 256 ^ 5
    assert run(spark, "b.hashCode()", (True,), "b boolean", b="boolean").result == 1231


def test_failures_are_rows(spark):
    missing = "Missing variable in execution context: x"
    assert run(spark, "x + 1", (None,), "x long", x="long").error == missing
    assert run(spark, "x + 1", (1,), "y long", x="long").error == missing
    assert run(spark, "1 / x", (0,), "x long", x="long").error == "/ by zero"
    df = spark.createDataFrame([(1, 15), (2, None), (3, 5)], "id int, x long")
    r = compile_rule(Rule("b", "x > 10", input_schema={"x": "long"}))
    assert [(row.b.success, row.b.result) for row in apply_rules(df, [r]).orderBy("id").collect()] == [(True, True), (False, None), (True, False)]


def _value(node, env):
    """Short-circuit semantics of boolean trees; KeyError stands for failure."""
    if isinstance(node, Variable):
        if env[node.name] is None:
            raise KeyError(node.name)
        return env[node.name]
    if isinstance(node, Unary):
        return not _value(node.operand, env)
    left = _value(node.left, env)
    if node.op == "&&":
        return left and _value(node.right, env)
    return left or _value(node.right, env)


def _tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return Variable(rng.choice("abc"))
    if rng.random() < 0.25:
        return Unary("!", _tree(rng, depth - 1))
    return Binary(rng.choice(["&&", "||"]), _tree(rng, depth - 1), _tree(rng, depth - 1))


def _text(node):
    if isinstance(node, Variable):
        return node.name
    if isinstance(node, Unary):
        return f"!({_text(node.operand)})"
    return f"({_text(node.left)} {node.op} {_text(node.right)})"


def test_random_boolean_trees_agree_with_an_interpreter(spark):
    rng = random.Random(5)
    values = [(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (True, False, None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a boolean, b boolean, c boolean").cache()
    for _ in range(12):
        tree = _tree(rng, 4)
        r = compile_rule(Rule("t", _text(tree), input_schema=dict.fromkeys("abc", "boolean")), optimize=False)
        got = {row.i: row.t for row in apply_rules(df, [r]).collect()}
        kept = {row.i for row in r.where(df).collect()}
        for i, v in enumerate(values):
            try:
                want = (True, _value(tree, dict(zip("abc", v, strict=True))))
            except KeyError:
                want = (False, None)
            assert (got[i].success, got[i].result) == want
            assert (i in kept) == (want == (True, True))


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) as x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    r = compile_rule(Rule("f", "x > 5.0 || id < 3", input_schema={"x": "double", "id": "long"}))
    out = r.where(df)
    assert out.count() == 7
    assert "GreaterThan(x,5.0)" in out._jdf.queryExecution().toString()


def test_rule_json():
    r = parse_rule(json.dumps({"name": "n", "expression": "x > 1", "inputSchema": {"x": " INT "}}))
    assert (r.version, r.category, r.types()) == ("1.0.0", "DEFAULT", {"x": "Integer"})
    assert parse_rule('{"name": "n", "expression": "1 > 0", "inputSchema": []}').input_schema == {}
    for bad in ("", "{", "[]", '{"name": "n"}', '{"expression": "1"}', '{"name": "n", "expression": "x", "inputSchema": {"x": "com.Foo"}}', '{"name": "n", "expression": "x", "inputSchema": {"x": "float"}}'):
        with pytest.raises(ParseError):
            parse_rule(bad)


@pytest.mark.parametrize(("text", "stage"), [("{", "JSON parsing"), ('{"name": "n", "expression": "x +"}', "AST building"), ('{"name": "n", "expression": "x + 1"}', "type checking")])
def test_compile_errors_name_the_stage(text, stage):
    with pytest.raises(CompileError, match=stage):
        compile_rule(text)


def test_executor_and_metrics(spark):
    e, r = Executor(spark), compile_rule(Rule("r", "x > 1", input_schema={"x": "long"}))
    assert e.execute(r, {"x": 5}).result is True
    assert e.submit(r, {"x": 0}, timeout=60).result().result is False
    assert not e.execute(r, {}).success
    assert (e.metrics.total, e.metrics.succeeded, e.metrics.failed) == (3, 2, 1)
    e.close()


def test_catalog_promotes_by_use():
    c, r = RuleCatalog(), compile_rule(Rule("r", "1 > 0"))
    c.put_l3(r)
    for _ in range(21):
        assert c.get(r.rule) is r
    assert (c.stats["l3_hits"], c.stats["l2_hits"], c.stats["l1_hits"], c.stats["promotions"]) == (5, 15, 1, 2)
    c.invalidate(r.rule)
    assert c.get(r.rule) is None
    assert c.hit_rate() == 21 / 22
