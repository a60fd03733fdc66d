"""Text to numbers and booleans, with the corner cases defined; all JVM-side but arithmetic."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {getattr(ast, a): f for a, f in zip(("Add", "Sub", "Mult", "Div"), (operator.add, operator.sub, operator.mul, operator.truediv))}
_PLAIN = r"^\s*[-+]?(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+|(?i:inf(?:inity)?|nan))(?:[eE][-+]?[0-9_]++)?\s*$"
#: a number with a point, or an integer so short that a double holds the product of three
_NUMBER = r"([-+]?(?:(?:0|[1-9][0-9]{0,14})\.[0-9]{0,15}|0|[1-9][0-9]{0,4}))"
_OP = r"\s*([-+*/])\s*"
_SHAPE = rf"^\s*(\(?)\s*{_NUMBER}{_OP}{_NUMBER}\s*(\)?)(?:{_OP}{_NUMBER})?\s*$"
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos}


def _without_underscores(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("_")), F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(text)


def is_number(text: Column) -> Column:
    """Whether a text is a number; a trailing d or f is no part of one. A cast of other texts
    would give null too, but by way of an exception each."""
    return text.rlike(_PLAIN)


def try_double(text: Column) -> Column:
    """``1_000`` is 1000."""
    return F.when(is_number(text), _without_underscores(text).try_cast("double"))


def try_long(text: Column) -> Column:
    """Integers as they are, other numbers rounded half away from zero."""
    clean = _without_underscores(text)
    return F.when(is_number(text), F.coalesce(clean.try_cast("bigint"), rounded(clean.try_cast("double"))))


def rounded(number: Column) -> Column:
    """A double to an integer, half away from zero; null beyond the integers and for NaN."""
    return F.when(~F.isnan(number), F.round(number).try_cast("bigint"))


def try_boolean(text: Column) -> Column:
    """Only texts without spaces around them are booleans."""
    return F.when(text == F.trim(text), text.try_cast("boolean"))


def round_to_long(number: Column) -> Column:
    """A double to an integer, half to even."""
    return F.bround(number, 0).cast("bigint")


def resolve_arithmetic(text: str | None) -> str | None:
    """The value of an expression of numbers with + - * / and parentheses, as text; any
    other text as it is."""
    if text is None:
        return None
    try:
        float(text)
        return text
    except ValueError:
        pass

    def value(node: ast.AST) -> float:
        match node:
            case ast.Constant(value=int() | float() as number):
                return number
            case ast.BinOp(left=left, op=op, right=right):
                return _BINARY[type(op)](value(left), value(right))
            case ast.UnaryOp(op=op, operand=operand):
                return _UNARY[type(op)](value(operand))
        raise KeyError

    try:
        return str(float(value(ast.parse(text.strip(), mode="eval").body)))
    except (KeyError, ValueError, SyntaxError, ArithmeticError, RecursionError, MemoryError):
        return text


def _arithmetic(texts: pd.Series) -> pd.Series:
    return texts.map(resolve_arithmetic, na_action="ignore")


def arithmetic(text: Column) -> Column:
    """``resolve_arithmetic`` of a column, in Arrow batches; numbers stay in the JVM's view."""
    return F.pandas_udf(_arithmetic, "string")(text)


def _apply(a: Column, op: Column, b: Column) -> Column:
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise(F.try_divide(a, b))


def maybe_arithmetic(text: Column) -> Column:
    """Whether a text is no number but may be an expression of numbers."""
    sign = r"[0-9.)]\s*[-+*/]|[(]|True|False|^\s*[-+]|0[xXoObB]"
    return text.rlike(sign) & text.rlike(r"^[-+*/().0-9_\sA-Za-z]+$") & ~is_number(text)


def arithmetic_parts(text: Column) -> Column:
    """Parts of ``a op b`` and ``(a op b) op c``: bracket, a, op, b, bracket, op, c. An array
    of another size for other expressions, null for texts that are none."""
    return F.when(maybe_arithmetic(text), F.split(F.regexp_replace(text, _SHAPE, "\x01".join(f"${k}" for k in range(1, 8))), "\x01"))


def common_arithmetic(parts: Column) -> Column:
    """The value of ``arithmetic_parts``, JVM-side; null if there is no common shape, or no result."""
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    part = lambda k: F.get(parts, F.lit(k))
    first = _apply(number(1), part(2), number(3))
    both = (part(0) == "(") & (part(4) == ")")
    return F.when((F.size(parts) == 7) & (part(5) == ""), F.when(both | ((part(0) == "") & (part(4) == "")), first)).when((F.size(parts) == 7) & both, _apply(first, part(5), number(6)))


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
