"""Exact totals of numbers of any size and fineness, as SQL expressions.

A number is cut into limbs of 24 bits: x = unit * (l0 + l1 * 2^24 + l2 * 2^48 + ...), where
``unit`` is a power of two (one, for whole numbers). Cutting loses nothing, the limbs of many
numbers add up in 64 bits (2^37 rows of them), and the sums of two sets of rows can be added
and subtracted limb by limb. So running totals, their differences and totals of totals stay
exact, and rounding happens once, when a total becomes a double.

The square of a double has up to 106 bits. It is cut as the sum of three products, each of
them exact in a double: with x = h + t, where h holds the upper half of the bits, x² is
h² + 2ht + t².
"""

from __future__ import annotations

import math
from dataclasses import dataclass

BITS = 24
# Up to so many limbs the plain expressions, which grow with their square, are short.
PLAIN_LIMBS = 8
_MASK = 2**BITS - 1
_ONE = 2**BITS
# Veltkamp's constant: cuts the 53 bits of a double into 26 and 26 and a sign.
_HALF = 2**27 + 1
# Digits that go into the nearest double; what is below them only matters as being there.
_HEAD = str(2**72)


@dataclass(frozen=True)
class Layout:
    """Limbs of a column: ``low`` is the power of two of its unit, ``limbs`` their number.

    ``whole`` columns are 64-bit integers, of three limbs and a unit of one.
    """

    low: int
    limbs: int
    whole: bool = False

    @property
    def square_limbs(self) -> int:
        return 6 if self.whole else 2 * self.limbs + 1

    @property
    def plain(self) -> bool:
        """Whether totals are finished by plain arithmetic: a few limbs, and no power of two
        on the way that is not a normal double. Others take functions over arrays, which Spark
        does not compile."""
        return (not self.whole and self.limbs <= PLAIN_LIMBS and self.low >= -900
                and self.low + BITS * self.limbs <= 800)

    @property
    def mark(self) -> str:
        return "i" if self.whole else f"e{self.low}_{self.limbs}"


WHOLE = Layout(0, 3, True)


def layout(least: float, most: float) -> Layout:
    """Limbs for doubles whose absolute values, unless zero, are from ``least`` to ``most``."""
    if not most:
        return Layout(0, 1)
    low = max(math.frexp(least)[1] - 53, -1074)
    return Layout(low, -(-(math.frexp(most)[1] - low) // BITS))


def from_mark(mark: str) -> Layout:
    if mark == "i":
        return WHOLE
    low, _, limbs = mark[1:].partition("_")
    return Layout(int(low), int(limbs))


def power(exponent: int) -> str:
    """A power of two, as factors: one alone may not be a double."""
    return f"pow(2D, {exponent // 2}) * pow(2D, {exponent - exponent // 2})"


def _two(exponent: int) -> str:
    """A power of two that is a normal double."""
    return f"{2.0**exponent!r}D"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value that it uses several times."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _split(value: str, body: str) -> str:
    """``body`` over x, a double, as m * 2^e, m from 1/2 to 4 (x is not zero)."""
    exponent = "cast(floor(log2(abs(x))) AS int)"
    # One power of two alone may not be a double.
    scaled = "x * pow(2D, -(e div 2)) * pow(2D, -(e - e div 2))"
    return _let("x", value, _let("e", exponent, _let("m", scaled, body)))


def _bits(part: str, shift: str) -> str:
    """The 24 bits of part * 2^shift above its point, with the sign of ``part``.

    Parts are below 2^5 and end at most 106 bits below that, so far shifts leave nothing.
    """
    within = f"floor((abs({part}) * pow(2D, {shift})) % {_ONE}D)"
    return f"if({shift} BETWEEN -8 AND 140, bigint(signum({part})) * {within}, 0L)"


def _zeros(count: int) -> str:
    return f"array_repeat(0L, {count})"


def limbs(value: str, shape: Layout) -> str:
    """Limbs of a number, as a SQL array of bigint; zeros where it is missing.

    ``value`` is a bigint where the layout is whole, else a finite double.
    """
    if shape.whole:
        cut = f"array(x & {_MASK}, shiftright(x, {BITS}) & {_MASK}, shiftright(x, {2 * BITS}))"
        return _let("x", f"coalesce({value}, 0L)", cut)
    if shape.plain:
        # Remainders and products by powers of two are exact, and keep the sign.
        known = f"coalesce({value}, 0D)"
        cut = [f"bigint(({known} % {_two(shape.low + BITS * (k + 1))}) * "
               f"{_two(-shape.low - BITS * k)})" for k in range(shape.limbs)]
        return f"array({', '.join(cut)})"
    each = _bits("m", f"(e - {shape.low} - {BITS} * k)")
    cut = _split(value, f"transform(sequence(0, {shape.limbs - 1}), k -> {each})")
    return f"if(coalesce({value}, 0D) = 0D, {_zeros(shape.limbs)}, {cut})"


def square_limbs(value: str, shape: Layout) -> str:
    """Limbs of the square of a number, as :func:`limbs`."""
    if shape.whole:
        c, b, a = (f"element_at(l, {k + 1})" for k in range(3))
        products = [f"{c} * {c}", f"2 * {b} * {c}", f"{b} * {b} + 2 * {a} * {c}",
                    f"2 * {a} * {b}", f"{a} * {a}"]
        low = [f"(({p}) & {_MASK})" for p in products] + ["0L"]
        high = ["0L"] + [f"shiftright({p}, {BITS})" for p in products]
        cut = ", ".join(f"{x} + {y}" for x, y in zip(low, high))
        return _let("l", limbs(value, shape), f"array({cut})")
    shift = f"(2 * (e - {shape.low}) - {BITS} * k)"
    each = " + ".join(_bits(part, shift) for part in ("(h * h)", "(2D * h * t)", "(t * t)"))
    cut = f"transform(sequence(0, {shape.square_limbs - 1}), k -> {each})"
    halves = _let("h", f"{_HALF}D * m - ({_HALF}D * m - m)", _let("t", "m - h", cut))
    return (f"if(coalesce({value}, 0D) = 0D, {_zeros(shape.square_limbs)}, "
            f"{_split(value, halves)})")


def _product(limbs: list[str], k: int) -> str:
    """Limb ``k`` of the square of a number, not yet carried."""
    pairs = [f"{limbs[i]} * {limbs[k - i]}" if 2 * i == k else f"2 * {limbs[i]} * {limbs[k - i]}"
             for i in range(max(0, k - len(limbs) + 1), k // 2 + 1)]
    return " + ".join(pairs) or "0L"


def squares_from(column: str, shape: Layout) -> str:
    """:func:`square_limbs` from a column that holds the limbs, of a plain layout.

    Of the limbs of a double at most four next to each other are not zero, so no sum of
    products leaves 3 * 2^48, and no limb of a square 2^26.
    """
    limb = [f"element_at({column}, {k + 1})" for k in range(shape.limbs)]
    products = [_product(limb, k) for k in range(2 * shape.limbs - 1)]
    low = [f"(({p}) & {_MASK}L)" for p in products] + ["0L", "0L"]
    high = ["0L"] + [f"shiftright({p}, {BITS})" for p in products] + ["0L"]
    return "array(" + ", ".join(f"{x} + {y}" for x, y in zip(low, high)) + ")"


def _carried(limbs: str) -> str:
    """Digits below 2^24, from the lowest on, and what is carried out of them last."""
    return (f"aggregate({limbs}, named_struct('c', 0L, 'd', cast(array() AS array<bigint>)), "
            f"(s, x) -> named_struct('c', shiftright(s.c + x, {BITS}), "
            f"'d', array_append(s.d, (s.c + x) & {_MASK})), s -> array_append(s.d, s.c))")


def _padded(totals: list[str]) -> str:
    # Two more limbs take in what sums of 64 bits carry.
    return "array(" + ", ".join([*totals, "0L", "0L"]) + ")"


def digits(totals: list[str]) -> str:
    """Sign and digits of a sum of limbs: struct<negative: boolean, d: array<bigint>>."""
    plain = _padded(totals)
    turned = _padded([f"(-{total})" for total in totals])
    return (f"if(element_at({_carried(plain)}, -1) < 0, "
            f"named_struct('negative', true, 'd', {_carried(turned)}), "
            f"named_struct('negative', false, 'd', {_carried(plain)}))")


def nearest(sign_digits: str, exponent: int) -> str:
    """The double nearest to digits times a power of two.

    The leading digits are one number of 73 bits or more, with another bit that tells whether
    anything but zeros is below them.
    """
    start = ("named_struct('m', cast(0 AS decimal(38,0)), 'e', 0, 'rest', false)")
    step = (f"if(s.m < {_HEAD}, named_struct('m', cast(s.m * {_ONE} + x AS decimal(38,0)), "
            f"'e', s.e, 'rest', s.rest), named_struct('m', s.m, 'e', s.e + {BITS}, "
            "'rest', s.rest OR x <> 0))")
    head = "double(cast(s.m * 2 AS decimal(38,0)) + if(s.rest, 1, 0))"
    half = f"(s.e + {exponent - 1}) div 2"
    scaled = f"{head} * pow(2D, {half}) * pow(2D, s.e + {exponent - 1} - {half})"
    return (f"(if(({sign_digits}).negative, -1D, 1D) * aggregate(reverse(({sign_digits}).d), "
            f"{start}, (s, x) -> {step}, s -> {scaled}))")


def spread(n: str, sum_digits: str, square_digits: str, sum_count: int, square_count: int) -> str:
    """Digits of n * sum of squares - square of the sum, which is never below zero.

    ``sum_count`` and ``square_count`` are the numbers of digits.
    """
    last = max(2 * sum_count - 1, square_count) - 1
    d = f"({sum_digits}).d"
    own = (f"aggregate(sequence(greatest(0, k - {sum_count - 1}), least(k, {sum_count - 1})), 0L, "
           f"(a, i) -> a + element_at({d}, i + 1) * element_at({d}, k - i + 1))")
    first = f"if(k < {square_count}, {n} * element_at(({square_digits}).d, least(k, "\
            f"{square_count - 1}) + 1), 0L)"
    second = f"if(k > {2 * sum_count - 2}, 0L, {own})"
    limbs = f"transform(sequence(0, {last}), k -> {first} - {second})"
    return f"named_struct('negative', false, 'd', {_carried(limbs)})"


# The same with plain arithmetic, for layouts that are plain. Each digit is a column of its
# own, and each step uses columns of the step before.


def _carries(totals: list[str]) -> list[str]:
    """Totals with what is carried into them, and what is carried out of them last."""
    out, carry = [], "0L"
    for total in totals:
        out.append(f"({total} + {carry})")
        carry = f"shiftright({out[-1]}, {BITS})"
    return [*out, carry]


def is_negative(totals: list[str]) -> str:
    """Whether a sum of limbs is below zero."""
    return f"({_carries(totals)[-1]} < 0)"


def plain_digits(totals: list[str], negative: str | None = None) -> list[str]:
    """Digits of a sum of limbs without its sign, two more than it has limbs.

    ``negative`` is the column of :func:`is_negative`, for sums that can be below zero.
    """
    signed = [f"if({negative}, -{t}, {t})" for t in totals] if negative else totals
    *own, last = _carries(signed)
    return [f"({x} & {_MASK}L)" for x in [*own, last, f"shiftright({last}, {BITS})"]]


def plain_nearest(d: list[str], exponent: int, negative: str | None = None) -> str:
    """The double nearest to digits times a power of two.

    From the first digit that is not zero on, four digits are at least 73 bits, in two doubles
    whose sum is rounded once; the last bit also tells whether anything is below them.
    """
    cases = []
    for j in reversed(range(len(d))):
        first, second, third, fourth = (d[i] if i >= 0 else "0L" for i in range(j, j - 4, -1))
        rest = f" | if(({' | '.join(d[:j - 3])}) <> 0, 1L, 0L)" if j > 3 else ""
        head = (f"double({first} * {_ONE}L + {second}) * {_two(2 * BITS)} "
                f"+ double(({third} * {_ONE}L + {fourth}){rest})")
        cases.append(f"WHEN {first} <> 0 THEN ({head}) * {_two(exponent + BITS * (j - 3))}")
    value = f"CASE {' '.join(cases)} ELSE 0D END"
    return f"(if({negative}, -1D, 1D) * {value})" if negative else f"({value})"


def plain_spread(n: str, s: list[str], q: list[str]) -> list[str]:
    """Limbs of n * sum of squares - square of the sum, from their digits."""
    return [f"({n} * {digit} - ({_product(s, k)}))" for k, digit in enumerate(q)]


def as_decimal(totals: list[str]) -> str:
    """A sum of limbs of whole numbers as a decimal; null where 38 digits are too few."""
    parts = [f"try_multiply(cast({total} AS decimal(20, 0)), "
             f"cast('{2 ** (BITS * k)}' AS decimal(38, 0)))" for k, total in enumerate(totals)]
    value = parts[0]
    for part in parts[1:]:
        value = f"try_add({value}, {part})"
    return f"cast({value} AS decimal(38, 0))"


def decimal_spread(n: str, s: str, q: str) -> str:
    """n * q - s * s of decimals; null where 38 digits are too few."""
    return (f"try_subtract(try_multiply(cast({n} AS decimal(20, 0)), {q}), "
            f"try_multiply({s}, {s}))")


def digit_count(totals: int) -> int:
    """Digits that :func:`digits` makes of that many totals."""
    return totals + 3
