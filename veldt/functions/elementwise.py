"""Element-wise functions as Columns, with IEEE results where Spark's differ.

Spark gives NULL for logarithms outside their domain, raises on division by zero and
calls NaN equal to NaN; these functions give -inf, NaN, and false instead. Each works
on a value column of a matrix or tensor and, through F.transform, on array cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _d(x: Column) -> Column:
    return x.cast("double")


def divide(a: Column, b: Column) -> Column:
    """a / b with IEEE results for b = 0 (zeros are taken as positive)."""
    a, b = _d(a), _d(b)
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _log(of: Callable[[Column], Column], shift: float = 0.0) -> Callable[[Column], Column]:
    def run(x: Column) -> Column:
        x = _d(x)
        return F.when(F.isnan(x), x).when(x == -shift, F.lit(-INF)).when(x < -shift, F.lit(NAN)).otherwise(of(x))

    return run


#: From here on every double is a whole number.
WHOLE = float(1 << 52)


def _whole(of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A rounding by way of a long, for doubles that have a fraction; NaN, infinities and large values stay."""

    def run(x: Column) -> Column:
        x = _d(x)
        return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(of(x))

    return run


def _floor(x: Column) -> Column:
    out = F.floor(x).cast("double")
    return F.when(out == x, x).otherwise(out)  # keeps a negative zero


def _ceil(x: Column) -> Column:
    return -_floor(-x)


def _trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x)).cast("double")


def _round(x: Column) -> Column:
    whole = _trunc(x)
    return F.when(F.abs(x - whole) >= 0.5, whole + F.signum(x)).otherwise(whole)


floor, ceil, trunc, round_away = _whole(_floor), _whole(_ceil), _whole(_trunc), _whole(_round)


def is_inf(x: Column) -> Column:
    return F.abs(_d(x)) == F.lit(INF)


def is_finite(x: Column) -> Column:
    return ~F.isnan(_d(x)) & (F.abs(_d(x)) < F.lit(INF))


UNARY: dict[str, Callable[[Column], Column]] = {
    "negate": lambda x: -x, "abs": F.abs, "abs2": lambda x: x * x, "square": lambda x: x * x, "cube": lambda x: x * x * x,
    "arg": lambda x: F.when(F.isnan(_d(x)), F.lit(NAN)).when(x < 0, F.lit(3.141592653589793)).otherwise(F.lit(0.0)),
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "expm1": F.expm1,
    "log": _log(F.log), "log1p": _log(F.log1p, 1.0), "log10": _log(F.log10), "log2": _log(F.log2),
    "sqrt": F.sqrt, "cbrt": F.cbrt, "rsqrt": lambda x: divide(F.lit(1.0), F.sqrt(x)), "inverse": lambda x: divide(F.lit(1.0), x),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "logistic": lambda x: 1 / (1 + F.exp(-_d(x))), "sign": lambda x: F.signum(_d(x)),
    "round": round_away, "rint": F.rint, "floor": floor, "ceil": ceil, "trunc": trunc,
    "isnan": lambda x: F.isnan(_d(x)), "isinf": is_inf, "isfinite": is_finite, "not": lambda x: ~x, "bitwise_not": F.bitwise_not,
}


def _ieee(op: Callable[[Column, Column], Column], on_nan: bool = False) -> Callable[[Column, Column], Column]:
    """A comparison that NaN fails (on_nan: passes)."""

    def run(a: Column, b: Column) -> Column:
        nan = F.isnan(_d(a)) | F.isnan(_d(b))
        return F.when(nan, F.lit(on_nan)).otherwise(op(a, b))

    return run


def nan_min(a: Column, b: Column, nan: str = "fast") -> Column:
    """nan: 'propagate' gives NaN if either is, 'numbers' the other value, 'fast' either."""
    return _extreme(F.least, a, b, nan)


def nan_max(a: Column, b: Column, nan: str = "fast") -> Column:
    return _extreme(F.greatest, a, b, nan)


def _extreme(of, a: Column, b: Column, nan: str) -> Column:
    a, b = _d(a), _d(b)
    out = of(a, b)
    if nan == "propagate":
        return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(out)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(out)


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide,
    "min": nan_min, "max": nan_max, "absolute_difference": lambda a, b: F.abs(a - b), "pow": F.pow, "atan2": F.atan2, "hypot": F.hypot,
    "mod": lambda a, b: a % b,
    "lt": _ieee(lambda a, b: a < b), "le": _ieee(lambda a, b: a <= b), "gt": _ieee(lambda a, b: a > b), "ge": _ieee(lambda a, b: a >= b), "eq": _ieee(lambda a, b: a == b), "ne": _ieee(lambda a, b: a != b, True),
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b,
    "bitand": lambda a, b: a.bitwiseAND(b), "bitor": lambda a, b: a.bitwiseOR(b), "bitxor": lambda a, b: a.bitwiseXOR(b),
}


def typed(comparison: Callable[[Column, Column], Column], kind: str = "double") -> Callable[[Column, Column], Column]:
    """A comparison whose result is 0 or 1 in the scalar type."""
    return lambda a, b: comparison(a, b).cast(kind)


def clip(x: Column, low: float, high: float) -> Column:
    """Max with low, then min with high; NaN stays."""
    return F.when(F.isnan(_d(x)), _d(x)).otherwise(F.least(F.greatest(_d(x), F.lit(float(low))), F.lit(float(high))))


def ldexp(x: Column, n: int) -> Column:
    return _d(x) * F.pow(F.lit(2.0), F.lit(float(n)))


def shift_left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n)


def shift_right_arithmetic(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def shift_right_logical(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def select(mask: Column, then: Column, other: Column) -> Column:
    return F.when(mask, then).otherwise(other)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def horner(coefficients: Column, x: Column) -> Column:
    """A polynomial with ascending coefficients in an array cell; beyond |x| = 1 in powers of 1/x."""
    step = F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)
    inverse = F.aggregate(coefficients, F.lit(0.0), lambda s, c: s * (1 / F.when(x == 0, F.lit(1.0)).otherwise(x)) + c)
    return F.when(F.abs(x) <= 1, step).otherwise(inverse * F.pow(x, (F.size(coefficients) - 1).cast("double")))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two array cells."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: _d(p) * _d(q)), F.lit(0.0), lambda s, v: s + v)


def array_norm(a: Column, p: float = 2) -> Column:
    """The p-norm of an array cell (p may be infinite); an empty one has 0."""
    if p == INF:
        return F.coalesce(F.array_max(F.transform(a, lambda v: F.abs(_d(v)))), F.lit(0.0))
    total = F.aggregate(F.transform(a, lambda v: F.pow(F.abs(_d(v)), F.lit(float(p)))), F.lit(0.0), lambda s, v: s + v)
    return F.pow(total, F.lit(1.0 / p))
