"""Index expressions that know the extent only when they are used: last, seq, seq_n and lists.

    m.indexed(seq(1, last - 2, 2), [last, 0, last // 2])
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Symbol:
    """An integer expression of the extent n."""

    value: Callable[[int], int]

    def _apply(self, other, f, swap: bool = False) -> Symbol:
        get = other.value if isinstance(other, Symbol) else lambda n: other
        return Symbol((lambda n: f(get(n), self.value(n))) if swap else (lambda n: f(self.value(n), get(n))))

    def __add__(self, other):
        return self._apply(other, lambda a, b: a + b)

    __radd__ = __add__

    def __sub__(self, other):
        return self._apply(other, lambda a, b: a - b)

    def __rsub__(self, other):
        return self._apply(other, lambda a, b: a - b, True)

    def __mul__(self, other):
        return self._apply(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __floordiv__(self, other):
        return self._apply(other, lambda a, b: a // b)

    def __neg__(self):
        return Symbol(lambda n: -self.value(n))


last = Symbol(lambda n: n - 1)
last_p1 = Symbol(lambda n: n)


def _at(x, n: int) -> int:
    return x.value(n) if isinstance(x, Symbol) else int(x)


@dataclass(frozen=True)
class Sequence_:
    """first, first + step, ... of a length that may depend on the extent."""

    first: int | Symbol
    step: int | Symbol
    length: Callable[[int], int]

    def resolve(self, n: int) -> list[int]:
        a, s = _at(self.first, n), _at(self.step, n)
        return [a + k * s for k in range(self.length(n))]

    def reverse(self) -> Sequence_:
        return Sequence_(Symbol(lambda n: _at(self.first, n) + (self.length(n) - 1) * _at(self.step, n)), Symbol(lambda n: -_at(self.step, n)), self.length)


def seq(first, to, step=1) -> Sequence_:
    """From first to `to` (which is reached or just not passed)."""

    def length(n: int) -> int:
        a, b, s = _at(first, n), _at(to, n), _at(step, n)
        return max(0, (b - a) // s + 1)

    return Sequence_(first, step, length)


def seq_n(first, n_items, step=1) -> Sequence_:
    return Sequence_(first, step, lambda n: _at(n_items, n))


def resolve(index, n: int) -> list[int]:
    """The places that an index expression, a list of expressions, a range or one place means in an extent of n."""
    if isinstance(index, Sequence_):
        out = index.resolve(n)
    elif isinstance(index, (Symbol, int)):
        out = [_at(index, n)]
    elif isinstance(index, Sequence) or hasattr(index, "__iter__"):
        out = [_at(x, n) for x in index]
    else:
        raise TypeError(index)
    if any(not 0 <= k < n for k in out):
        raise IndexError(f"an index is outside 0 ... {n - 1}")
    return out
