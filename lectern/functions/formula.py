"""Arithmetic formulas held in a column: syntax, values at points, equivalence.

A formula has numbers, symbols, ``+ - * /``, signs and parentheses. Its tokens are one
array; a fold turns them into postfix order with a stack of waiting operators, and a
second fold over the postfix form keeps a stack of values. Both are built-in expressions,
so a table of formulas is one projection. Equivalence is judged at fixed points, where
every symbol has a value that depends on its name only: numeric evidence, not a proof.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.numeric import DEFAULT_TOLERANCE, numeric_close

# Sample points at which two formulas are compared.
POINTS = 12
_NUMBER = r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+"
_SYMBOL = r"[A-Za-z_][A-Za-z0-9_]*"
_SIGN = "neg()"
_STATE = "struct<out:array<string>,waiting:array<string>,before:string,ok:boolean>"


def formula_tokens(text: Column) -> Column:
    """Numbers, symbols and single other characters, in order; blanks only part them."""
    return F.regexp_extract_all(text, F.lit(rf"({_NUMBER}|{_SYMBOL}|\S)"), F.lit(1))


def _is_number(token: Column) -> Column:
    return token.rlike(f"^(?:{_NUMBER})$")


def _is_operand(token: Column) -> Column:
    return token.rlike(f"^(?:{_NUMBER}|{_SYMBOL})$")


def _rank(operator: Column) -> Column:
    """How tightly an operator binds; an open parenthesis holds all before it back."""
    return F.when(operator.isin("+", "-"), 1).when(operator.isin("*", "/"), 2).when(operator == _SIGN, 3).otherwise(0)


def postfix(text: Column) -> Column:
    """The formula's tokens in postfix order; NULL where it is no formula."""

    def state(out: Column, waiting: Column, before: Column, ok: Column) -> Column:
        return F.struct(out.alias("out"), waiting.alias("waiting"), before.alias("before"), ok.alias("ok"))

    def step(acc: Column, token: Column) -> Column:
        # A value ends where the last token was one or closed a parenthesis.
        ended = _is_operand(acc.before) | (acc.before == ")")
        last_first = F.reverse(acc.waiting)

        def released(stop: Column, also: int) -> tuple[Column, Column]:
            """Output and waiting operators once those before the stopping one have gone."""
            n = F.when(stop > 0, stop - 1).otherwise(F.size(acc.waiting)).cast("int")
            left = F.greatest(F.size(acc.waiting) - n - also, F.lit(0))
            return F.concat(acc.out, F.slice(last_first, F.lit(1), n)), F.slice(acc.waiting, F.lit(1), left)

        opened = F.array_position(last_first, "(")
        inside, outside = released(opened, 1)
        weaker = F.array_position(F.transform(last_first, lambda x: _rank(x) < _rank(token)), F.lit(True))
        out, waiting = released(weaker, 0)
        operand, sign = _is_operand(token), token.isin("+", "-")
        return (
            F.when(~acc.ok, acc)
            .when(operand, state(F.array_append(acc.out, token), acc.waiting, token, ~ended))
            .when(token == "(", state(acc.out, F.array_append(acc.waiting, token), token, ~ended))
            .when(token == ")", state(inside, outside, token, ended & (opened > 0)))
            .when(sign & ~ended, state(
                acc.out,
                F.when(token == "-", F.array_append(acc.waiting, F.lit(_SIGN))).otherwise(acc.waiting),
                token,
                F.lit(True),
            ))
            .when(token.isin("+", "-", "*", "/"), state(out, F.array_append(waiting, token), token, ended))
            .otherwise(state(acc.out, acc.waiting, token, F.lit(False)))
            .cast(_STATE)
        )

    none = F.array().cast("array<string>")
    start = state(none, none, F.lit(""), F.lit(True)).cast(_STATE)

    def finish(acc: Column) -> Column:
        whole = acc.ok & (_is_operand(acc.before) | (acc.before == ")")) & ~F.array_contains(acc.waiting, "(")
        return F.when(whole, F.concat(acc.out, F.reverse(acc.waiting)))

    return F.aggregate(formula_tokens(text), start, step, finish)


def _symbol_value(symbol: Column, point: Column) -> Column:
    """A value between 1 and 5 for every symbol and point."""
    return F.lit(1.0) + F.pmod(F.xxhash64(symbol, point), F.lit(1 << 20)) / F.lit(float(1 << 18))


def value_at(tokens: Column, point: Column) -> Column:
    """Value of a postfix formula at a numbered point; NULL where a divisor is zero."""

    def step(stack: Column, token: Column) -> Column:
        n = F.size(stack)
        a, b = F.get(stack, n - 2), F.get(stack, n - 1)
        two = (
            F.when(token == "+", a + b).when(token == "-", a - b).when(token == "*", a * b)
            .when(token == "/", F.try_divide(a, b))
        )
        one = F.when(_is_number(token), token.cast("double")).otherwise(_symbol_value(token, point))
        rest = F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0)))
        return (
            F.when(token == _SIGN, F.array_append(F.slice(stack, F.lit(1), F.greatest(n - 1, F.lit(0))), -b))
            .when(token.isin("+", "-", "*", "/"), F.array_append(rest, two))
            .otherwise(F.array_append(stack, one))
        )

    stack = F.aggregate(tokens, F.array().cast("array<double>"), step)
    return F.get(stack, F.lit(0))


def formulas_agree(left: Column, right: Column, tol: float = DEFAULT_TOLERANCE, points: int = POINTS) -> Column:
    """Do two postfix formulas have the same values? NULL where either is no formula.

    They agree where both have a value at some point and at no point differ; a point at
    which only one of them has a value counts as a difference.
    """
    pairs = F.transform(
        F.sequence(F.lit(1), F.lit(points)),
        lambda p: F.struct(value_at(left, p).alias("a"), value_at(right, p).alias("b")),
    )
    differ = F.exists(
        pairs,
        lambda x: (x.a.isNull() != x.b.isNull())
        | (x.a.isNotNull() & x.b.isNotNull() & ~F.coalesce(numeric_close(x.a, x.b, tol), F.lit(False))),
    )
    both = F.exists(pairs, lambda x: x.a.isNotNull() & x.b.isNotNull())
    return F.when(left.isNotNull() & right.isNotNull(), both & ~differ)
