"""A channel's closed-form response, written in ``v``, as a Spark column.

Formulas keep the spelling used in calibration files (``10**(1.25*v - 8.5)``).
The arithmetic becomes built-in column functions, so it runs inside codegen. A
reading on which the formula is undefined gives NULL or a non-finite number and
is counted as skipped; it never fails the job.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """A formula uses something other than arithmetic in ``v``."""


# --- fixed values: names a formula may use ----------------------------------
_CONSTANTS = {"pi": math.pi, "e": math.e}
_UNARY = {
    "sqrt": F.sqrt, "log1p": F.log1p,
    "exp": F.exp, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "arcsin": F.asin, "asin": F.asin, "arccos": F.acos, "acos": F.acos,
    "arctan": F.atan, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "abs": F.abs, "fabs": F.abs,
    "radians": F.radians, "degrees": F.degrees,
}
_BINARY = {"arctan2": F.atan2, "atan2": F.atan2, "hypot": F.hypot}


def _logarithm(function):
    """Logarithms give -inf at zero and NaN below it, as array libraries do."""

    def guarded(x: Column) -> Column:
        return F.when(x > 0, function(x)).when(x == 0, -math.inf).otherwise(math.nan)

    return guarded


def _power(a: Column, b: Column) -> Column:
    """A power that is not a finite number - a pole, an overflow - is undefined."""
    result = F.pow(a, b)
    return F.when(~F.isnan(result) & (F.abs(result) != math.inf), result)


def _floor(x: Column) -> Column:
    return F.floor(x).cast("double")


_UNARY |= {"log": _logarithm(F.ln), "log10": _logarithm(F.log10), "log2": _logarithm(F.log2)}
_BINARY |= {"pow": _power}

_OPERATORS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.Pow: _power,
    ast.FloorDiv: lambda a, b: _floor(F.try_divide(a, b)),
    ast.Mod: lambda a, b: a - b * _floor(F.try_divide(a, b)),
}
_COMPARISONS = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def formula_column(text: str, v: Column) -> Column:
    """The formula as a double column; raises FormulaError if it is not one."""
    try:
        body = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise FormulaError(f"formula {text!r} is not an expression: {error.msg}") from None
    return _number(body, v).cast("double")


def _number(node: ast.AST, v: Column, names: Mapping[str, Column] = {}) -> Column:
    match node:
        case ast.Constant(value=bool()):
            pass
        case ast.Constant(value=int() | float() as number):
            return F.lit(float(number))
        case ast.Name(id="v"):
            return v
        case ast.Name(id=name) if name in names:
            return names[name]
        case ast.Name(id=name) if name in _CONSTANTS:
            return F.lit(_CONSTANTS[name])
        case ast.Name(id=name):
            raise FormulaError(f"name '{name}' is not defined")
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -_number(inner, v, names)
        case ast.UnaryOp(op=ast.UAdd(), operand=inner):
            return _number(inner, v, names)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _OPERATORS:
            return _OPERATORS[type(op)](_number(left, v, names), _number(right, v, names))
        case ast.Call(func=ast.Name(id=name), args=[one], keywords=[]) if name in _UNARY:
            return _UNARY[name](_number(one, v, names))
        case ast.Call(func=ast.Name(id="floor"), args=[one], keywords=[]):
            return _floor(_number(one, v, names))
        case ast.Call(func=ast.Name(id="ceil"), args=[one], keywords=[]):
            return F.ceil(_number(one, v, names)).cast("double")
        case ast.Call(func=ast.Name(id=name), args=[a, b], keywords=[]) if name in _BINARY:
            return _BINARY[name](_number(a, v, names), _number(b, v, names))
        case ast.Call(func=ast.Name(id="max"), args=[_, _, *_] as args, keywords=[]):
            return F.greatest(*[_number(a, v, names) for a in args])
        case ast.Call(func=ast.Name(id="min"), args=[_, _, *_] as args, keywords=[]):
            return F.least(*[_number(a, v, names) for a in args])
        case ast.IfExp(test=test, body=yes, orelse=no):
            return F.when(_condition(test, v, names), _number(yes, v, names)).otherwise(_number(no, v, names))
    raise FormulaError(f"{ast.unparse(node)!r} is not a number")


def _condition(node: ast.AST, v: Column, names: Mapping[str, Column] = {}) -> Column:
    match node:
        case ast.Compare(left=left, ops=ops, comparators=rights) if all(
            type(op) in _COMPARISONS for op in ops
        ):
            sides = [_number(side, v, names) for side in (left, *rights)]
            tests = [
                _COMPARISONS[type(op)](a, b) for op, a, b in zip(ops, sides, sides[1:])
            ]
            result = tests[0]
            for test in tests[1:]:
                result = result & test
            return result
        case ast.BoolOp(op=op, values=parts):
            result = _condition(parts[0], v, names)
            for part in parts[1:]:
                other = _condition(part, v, names)
                result = result & other if isinstance(op, ast.And) else result | other
            return result
        case ast.UnaryOp(op=ast.Not(), operand=inner):
            return ~_condition(inner, v, names)
    raise FormulaError(f"{ast.unparse(node)!r} is not a condition")


def formula_error(text: str | None) -> str | None:
    """Why a formula cannot be used, or None."""
    if text is None:
        return None
    try:
        formula_column(text, F.lit(1.0))
    except FormulaError as error:
        return str(error)
    return None


# A number that is no part of a name, such as the 10 of log10.
_CONSTANT = r"(?<![\w.])(?:[0-9][0-9_]*[.]?[0-9_]*|[.][0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?(?![\w.])"


def shape_of(formula: Column) -> Column:
    """A formula with a mark for each of its numbers: what channels of one kind share."""
    return F.regexp_replace(formula, _CONSTANT, "#")


def numbers_of(formula: Column) -> Column:
    """The numbers of a formula, in order."""
    found = F.regexp_extract_all(formula, F.lit(f"({_CONSTANT})"))
    return F.transform(found, lambda n: F.replace(n, F.lit("_"), F.lit("")).try_cast("double"))


def shape_column(shape: str, v: Column, numbers: Column) -> Column:
    """A shape as a double column, its numbers taken from an array; may raise FormulaError."""
    parts = shape.split("#")
    text = "".join(f"{p}__n{i}__" for i, p in enumerate(parts[:-1])) + parts[-1]
    try:
        body = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise FormulaError(f"formula {shape!r} is not an expression: {error.msg}") from None
    names = {f"__n{i}__": F.get(numbers, F.lit(i)) for i in range(len(parts) - 1)}
    return _number(body, v, names).cast("double")


def shape_error(shape: str) -> str | None:
    """Why no formula of a shape can be used, or None."""
    try:
        shape_column(shape, F.lit(1.0), F.array().cast("array<double>"))
    except FormulaError as error:
        return str(error)
    return None


def apply_shapes(shape: Column, numbers: Column, v: Column, shapes: Iterable[str]) -> Column:
    """Evaluate, per row, the formula whose shape and numbers it bears.

    One CASE branch per shape, however many channels have numbers of their own; an
    unusable shape yields NULL.
    """
    branches = []
    for text in sorted(set(shapes)):
        try:
            branches.append((shape == F.lit(text), shape_column(text, v, numbers)))
        except FormulaError:
            continue
    return _cases(branches)


def apply_formulas(formula: Column, v: Column, texts: Iterable[str]) -> Column:
    """Evaluate, per row, the formula named by ``formula`` among ``texts``.

    One CASE branch per distinct text; an unusable formula yields NULL. For tables of
    formulas; readings are evaluated by :func:`apply_shapes`.
    """
    usable = [text for text in sorted(set(texts)) if formula_error(text) is None]
    return _cases([(formula == F.lit(text), formula_column(text, v)) for text in usable])


def _cases(branches: list[tuple[Column, Column]]) -> Column:
    """CASE expressions of a hundred branches each, the first that has a value."""
    blocks = []
    for start in range(0, len(branches), 100):
        case = None
        for match, value in branches[start : start + 100]:
            case = F.when(match, value) if case is None else case.when(match, value)
        blocks.append(case)
    return F.coalesce(*blocks) if blocks else F.lit(None).cast("double")
