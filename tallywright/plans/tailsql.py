"""Tail probabilities as DuckDB expressions: sums of series whose terms are all positive.

They share nothing with ``functions.tails``, which uses continued fractions and the error function.
"""

from __future__ import annotations

TERMS = 1500


def _sum(term: str) -> str:
    return f"list_sum(list_transform(range(0, {TERMS}), lambda k: exp({term})))"


def lower_gamma(a: str, x: str) -> str:
    """The regularised lower incomplete gamma function; 1 from where the upper one is below 1e-30."""
    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} > 600 THEN 1.0 ELSE {_sum(f'({a} + k) * ln({x}) - ({x}) - lgamma({a} + 1 + k)')} END)"


def beta(a: str, b: str, x: str) -> str:
    """The regularised incomplete beta function, for ``x`` well below 1 or a small ``b``."""
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE {_sum(f'lgamma({a} + {b} + k) - lgamma({b}) - lgamma({a} + 1 + k) + ({a} + k) * ln({x}) + ({b}) * ln(1 - ({x}))')} END)"


def chi2(x: str, df: str) -> str:
    return f"greatest(0.0, 1 - {lower_gamma(f'(({df}) / 2.0)', f'(({x}) / 2.0)')})"


def normal(z: str) -> str:
    """Both tails."""
    return chi2(f"({z}) * ({z})", "1")


def t(x: str, df: str) -> str:
    """Both tails; 0 beyond 30 where there are many degrees of freedom."""
    square = f"(({x}) * ({x}))"
    return f"(CASE WHEN {square} > 900 THEN 0.0 ELSE greatest(0.0, 1 - {beta('0.5', f'(({df}) / 2.0)', f'({square} / (({df}) + {square}))')}) END)"


def f(x: str, df1: str, df2: str) -> str:
    """The upper tail; 0 beyond 900."""
    part = f"(({df1}) * ({x}))"
    return f"(CASE WHEN {x} > 900 THEN 0.0 ELSE greatest(0.0, 1 - {beta(f'(({df1}) / 2.0)', f'(({df2}) / 2.0)', f'({part} / ({part} + ({df2})))')}) END)"
