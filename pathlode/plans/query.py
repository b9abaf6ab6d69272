"""The path query language, compiled to DataFrame plans.

    expr  = term [op term]            op = > < >= <= == !=
    term  = number | string | name(path) | path
    path  = $ (.key | [*] | .* | .** )*

A path selects the nodes that match; ``.*`` is one step, ``.**`` any number of steps. A function
(entropy, cardinality, rarity, null_rate, instability, count, depth) is that of the first matching path.
A comparison of two scalars gives the left one or nothing; one of a path with a scalar filters paths by
their count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.operators.profile import path_inventory, value_frequency, value_statistics

FUNCTIONS = ("entropy", "cardinality", "rarity", "null_rate", "instability", "count", "depth")
EPSILON = 2.220446049250313e-16
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>\"[^\"]*\")|(?P<path>\$(?:\.\*\*|\.\*|\[\*\]|\.[^\s.\[\]()<>=!]+)*)|(?P<op>>=|<=|==|!=|>|<)|(?P<name>[A-Za-z_]\w*)|(?P<paren>[()]))")


class QueryError(ValueError):
    """Base of all errors of the language."""


class QuerySyntaxError(QueryError):
    pass


class UnknownFunction(QueryError):
    pass


class PathNotFound(QueryError):
    pass


class QueryTypeError(QueryError):
    pass


@dataclass(frozen=True)
class Literal:
    value: float | str


@dataclass(frozen=True)
class PathExpr:
    pattern: str


@dataclass(frozen=True)
class Call:
    function: str
    path: PathExpr


@dataclass(frozen=True)
class Comparison:
    op: str
    left: Literal | PathExpr | Call
    right: Literal | PathExpr | Call


def parse(text: str) -> Literal | PathExpr | Call | Comparison:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected text at {at}: {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()

    def term():
        if not tokens:
            raise QuerySyntaxError("unexpected end")
        kind, value = tokens.pop(0)
        if kind == "num":
            return Literal(float(value))
        if kind == "str":
            return Literal(value[1:-1])
        if kind == "path":
            return PathExpr(value)
        if kind == "name":
            if value not in FUNCTIONS:
                raise UnknownFunction(value)
            if [t[1] for t in (tokens[0:1] + tokens[2:3])] != ["(", ")"] or tokens[1][0] != "path":
                raise QuerySyntaxError(f"{value} takes one path")
            path = PathExpr(tokens[1][1])
            del tokens[:3]
            return Call(value, path)
        raise QuerySyntaxError(f"unexpected {value!r}")

    left = term()
    if not tokens:
        return left
    kind, op = tokens.pop(0)
    if kind != "op":
        raise QuerySyntaxError(f"expected a comparison, found {op!r}")
    right = term()
    if tokens:
        raise QuerySyntaxError(f"unexpected {tokens[0][1]!r}")
    return Comparison(op, left, right)


def path_regex(pattern: str) -> str:
    """A regular expression for the paths that a pattern matches."""
    out, at = r"^\$", 1
    while at < len(pattern):
        for token, regex in ((".**", r"(?:\.[^.\[\]]+|\[\*\])*"), (".*", r"(?:\.[^.\[\]]+|\[\*\])"), ("[*]", r"\[\*\]")):
            if pattern.startswith(token, at):
                out, at = out + regex, at + len(token)
                break
        else:
            m = re.match(r"\.([^.\[\]]+)", pattern[at:])
            if not m:
                raise QuerySyntaxError(f"bad path {pattern!r}")
            out, at = out + r"\." + re.escape(m[1]), at + m.end()
    return out + "$"


def segments(path: Column) -> Column:
    """Segments of a path as a sort key: keys before wildcards, step by step."""
    steps = F.regexp_extract_all(path, F.lit(r"(\.[^.\[\]]+|\[\*\])"), F.lit(1))
    return F.transform(steps, lambda s: F.struct((s == "[*]").cast("int").alias("kind"), s.alias("key")))


def select(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose path matches."""
    if not re.search(r"\.\*", pattern):
        return nodes.where(F.col("path") == pattern)
    return nodes.where(F.col("path").rlike(path_regex(pattern)))


def metric(nodes: DataFrame, call: Call) -> DataFrame:
    """path, value: a function's value at the first matching path; no row without one."""
    found = select(nodes, call.path.pattern)
    if call.function in ("entropy", "cardinality", "rarity"):
        stats = value_statistics(value_frequency(found))
        column = {"entropy": "entropy", "cardinality": "cardinality", "rarity": "max_rarity"}[call.function]
    else:
        stats = path_inventory(found)
        column = {"null_rate": "null_rate", "instability": "type_instability", "count": "count", "depth": "depth"}[call.function]
    first = stats.agg(F.min_by(F.struct("path", F.col(column).cast("double").alias("value")), segments(F.col("path"))).alias("m"))
    return first.select("m.path", "m.value").where("path is not null")


def _compare(op: str, left: Column, right: Column) -> Column:
    if op in ("==", "!="):
        same = F.abs(left - right) < EPSILON
        return same if op == "==" else ~same
    return {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]


def run(nodes: DataFrame, text: str) -> DataFrame:
    """The result of a query: nodes for a path; path and value for a function; what a comparison leaves of its left side."""
    tree = parse(text)
    spark = nodes.sparkSession

    def scalar(term) -> DataFrame:
        if isinstance(term, Literal):
            if isinstance(term.value, str):
                raise QueryTypeError("numbers are compared, not strings")
            return spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(term.value).alias("value"))
        return metric(nodes, term)

    if isinstance(tree, PathExpr):
        return select(nodes, tree.pattern)
    if isinstance(tree, (Call, Literal)):
        return scalar(tree)
    if isinstance(tree.right, PathExpr):
        raise QueryTypeError("a path stands on the left of a comparison")
    right = scalar(tree.right).select("value").scalar()
    if isinstance(tree.left, PathExpr):
        counts = path_inventory(select(nodes, tree.left.pattern)).select("path", F.col("count").cast("double").alias("value"))
        return counts.where(_compare(tree.op, F.col("value"), right))
    return scalar(tree.left).where(_compare(tree.op, F.col("value"), right))
