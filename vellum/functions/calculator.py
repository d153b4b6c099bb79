"""Calculator functions: a stack program compiled to columns.

A program such as ``{ dup 0.5 lt { 2 mul } { pop 1 } ifelse }`` is run once, over columns instead of numbers: its stack holds
expressions, so what comes out is one expression for each value, which Catalyst folds and compiles with the rest of the query.  What must be
known to shape the stack (the counts of ``copy``, ``index`` and ``roll``) has to be a number in the program or come from numbers alone; a branch becomes
CASE, and both its sides must leave stacks of one height.  A program that can't be run has no value: ``Broken`` says why,
and ``calculator`` gives nulls.  What fails for some rows only (a root of a negative number, an overflow, a division by 0) has a defined value there, or null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Broken(ValueError):
    """The program can't be run: an unknown word, too few values, a count that isn't known."""


class Value(NamedTuple):
    """A value on the stack: its column, and its number where that is known."""

    column: Column
    known: float | None = None


Program = list["str | float | Program"]


def parsed(text: str) -> Program:
    """A program as words, numbers and procedures; comments run from % to the end of the line."""
    words = re.findall(r"[{}]|[^\s{}]+", re.sub(r"%[^\r\n]*", " ", text))
    stack: list[Program] = [[]]
    for w in words:
        if w == "{":
            stack.append([])
        elif w == "}":
            if len(stack) == 1:
                raise Broken("a brace closes nothing")
            done = stack.pop()
            stack[-1].append(done)
        elif re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", w):
            stack[-1].append(float(w))
        elif (m := re.fullmatch(r"(\d+)#([0-9A-Za-z]+)", w)) and 2 <= int(m[1]) <= 36:
            stack[-1].append(float(int(m[2], int(m[1]))))
        else:
            stack[-1].append(w)
    if len(stack) > 1:
        raise Broken("a brace isn't closed")
    (program,) = stack
    return program[0] if len(program) == 1 and isinstance(program[0], list) else program


def _whole(x: Column) -> Column:
    """The number as an integer that bits are taken of; null where it is none of 32 bits."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 2**31), x.cast("int"))


def _truth(x: Column) -> Column:
    return x.cast("double")


def _toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _shift(x: Column, by: Column) -> Column:
    n = _whole(by)
    left, right = F.call_function("shiftleft", _whole(x), n), F.call_function("shiftright", _whole(x), -n)
    return F.when(F.abs(n) > 31, F.when((n < 0) & (x < 0), -1.0).otherwise(0.0)).otherwise(F.when(n >= 0, left).otherwise(right).cast("double"))


#: Words that take one value, and two (the one below first); angles are in degrees.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "neg": lambda x: -x, "ceiling": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x: F.floor(x + 0.5).cast("double"),
    "truncate": _toward_zero, "cvi": _toward_zero, "cvr": lambda x: x, "sqrt": lambda x: F.sqrt(F.when(x > 0, x).otherwise(0.0)), "sin": lambda x: F.sin(F.radians(x)),
    "cos": lambda x: F.cos(F.radians(x)), "ln": lambda x: F.when(x > 0, F.ln(x)), "log": lambda x: F.when(x > 0, F.log10(x)),
        "not": lambda x: F.when(x.isin(0.0, 1.0), 1 - x).otherwise(F.bitwise_not(_whole(x)).cast("double")),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.when(y == 0, 0.0).otherwise(F.try_divide(x, y)),
    "idiv": lambda x, y: F.when(y == 0, 0.0).otherwise(_toward_zero(F.try_divide(_toward_zero(x), _toward_zero(y)))), "mod": lambda x,
        y: F.when(y == 0, 0.0).otherwise(x - y * _toward_zero(F.try_divide(x, y))),
    "exp": lambda x, y: F.pow(x, y), "atan": lambda x, y: (lambda d: F.when(d < 0, d + 360).otherwise(d))(F.degrees(F.atan2(x, y))), "eq": lambda x, y: _truth(x == y),
        "ne": lambda x, y: _truth(x != y),
    "lt": lambda x, y: _truth(x < y), "le": lambda x, y: _truth(x <= y), "gt": lambda x, y: _truth(x > y), "ge": lambda x, y: _truth(x >= y),
    "and": lambda x, y: _whole(x).bitwiseAND(_whole(y)).cast("double"), "or": lambda x, y: _whole(x).bitwiseOR(_whole(y)).cast("double"), "xor": lambda x,
        y: _whole(x).bitwiseXOR(_whole(y)).cast("double"), "bitshift": _shift,
}


def _pop(stack: list[Value]) -> Value:
    if not stack:
        raise Broken("too few values")
    return stack.pop()


def _count(stack: list[Value], least: int = 0) -> int:
    n = _pop(stack).known
    if n is None or n != int(n) or n < least:
        raise Broken("a count that isn't a known whole number")
    return int(n)


def _number(x: float) -> Value:
    return Value(F.lit(float(x)), float(x))


def _folded(word: str, args: Sequence[float]) -> float | None:
    """Arithmetic on known numbers, for counts that a program computes."""
    plain = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "neg": lambda x: -x, "abs": abs, "cvi": lambda x: float(int(x)), "cvr": float,
        "truncate": lambda x: float(int(x))}
    return plain[word](*args) if word in plain else None


def run(program: Program, stack: list[Value]) -> list[Value]:
    """The stack after the program."""
    procedures: list[Program] = []
    for token in program:
        if isinstance(token, list):
            procedures.append(token)
        elif isinstance(token, float):
            stack.append(_number(token))
        elif token in ("true", "false"):
            stack.append(_number(token == "true"))
        elif token in ("if", "ifelse"):
            if len(procedures) < (needed := 1 + (token == "ifelse")):
                raise Broken("a branch without its procedure")
            sides, procedures = procedures[-needed:], procedures[:-needed]
            test = _pop(stack)
            stack = _branched(test, sides[0], sides[1] if needed == 2 else [], stack)
        elif token == "pop":
            _pop(stack)
        elif token == "exch":
            y, x = _pop(stack), _pop(stack)
            stack += [y, x]
        elif token == "dup":
            stack += [x := _pop(stack), x]
        elif token == "copy":
            if (n := _count(stack)) > len(stack):
                raise Broken("too few values")
            stack += stack[len(stack) - n :]
        elif token == "index":
            if (n := _count(stack)) >= len(stack):
                raise Broken("too few values")
            stack.append(stack[-1 - n])
        elif token == "roll":
            by, n = _pop(stack).known, _count(stack)
            if by is None or by != int(by) or n > len(stack):
                raise Broken("a roll that isn't known")
            if n:
                top = stack[len(stack) - n :]
                k = -int(by) % n
                stack[len(stack) - n :] = top[k:] + top[:k]
        elif token in UNARY:
            x = _pop(stack)
            stack.append(Value(UNARY[token](x.column), None if x.known is None else _folded(token, [x.known])))
        elif token in BINARY:
            y, x = _pop(stack), _pop(stack)
            stack.append(Value(BINARY[token](x.column, y.column), None if None in (x.known, y.known) else _folded(token, [x.known, y.known])))
        else:
            raise Broken(f"unknown word {token}")
    return stack


def _branched(test: Value, yes: Program, no: Program, stack: list[Value]) -> list[Value]:
    if test.known is not None:
        return run(yes if test.known else no, list(stack))
    a, b = run(yes, list(stack)), run(no, list(stack))
    if len(a) != len(b):
        raise Broken("sides of a branch that leave stacks of different heights")
    holds = test.column != 0
    return [x if x is y or x.known is not None and x.known == y.known else Value(F.when(test.column.isNull(), None).when(holds, x.column).otherwise(y.column)) for x, y in zip(a, b, strict=True)]


def _clamped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def calculator(program: str, inputs: Sequence[Column], outputs: Sequence[tuple[float, float]], domain: Sequence[tuple[float, float]] = ()) -> list[Column]:
    """The values of a program for the inputs, each kept in its range; null for all rows if the program is broken, or leaves too few values.

    Inputs are kept in ``domain`` first, where it is given.  Of the values that are left, the last ones count.
    """
    start = [Value(_clamped(c.cast("double"), *domain[i]) if i < len(domain) else c.cast("double")) for i, c in enumerate(inputs)]
    try:
        left = run(parsed(program), start)
    except Broken:
        left = []
    if len(left) < len(outputs) or not outputs:
        return [F.lit(None).cast("double") for _ in outputs]
    return [_clamped(F.when(~F.isnan(v.column), v.column), *r) for v, r in zip(left[len(left) - len(outputs) :], outputs, strict=True)]
