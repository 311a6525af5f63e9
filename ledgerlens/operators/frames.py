"""Aggregates over time frames relative to each row.

A frame reaches from ``start`` to ``end`` seconds around the time of a row, both ends
included. Every value is the difference of two running totals,

    total(time + end) - total(time + start - 1),

so the cost is linear in the rows however long the frame is; a sliding window would
re-read the whole frame for every row. The totals are integers, which makes the differences
exact: amounts are counted in units that hold all their decimals, found by one look at the
column (:func:`resolve`). A sum of squares outgrows 64 bits, so it is kept in three totals:
with u = 8192 a + b, u² is 2^26 a² + 2^14 a b + b². Where the look shows that 64 bits are
too few, or that there are more than six decimals, totals are kept in limbs
(:mod:`ledgerlens.operators.exact`): of the units, or, where no unit of ten fits, of the
doubles themselves, whatever their size. They take longer, and are exact as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from itertools import chain

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import bucket_start, guarded_ratio
from ledgerlens.operators import exact
from ledgerlens.operators.skew import DEFAULT_RULE, HotRule, heavy_items, look_up, split_hot

DAY = 86400

# How aggregates are abbreviated in column names.
SHORT = {"count": "cn", "sum": "sum", "avg": "avg", "std": "std", "isnew": "isnew"}


# The three totals a sum of squares is kept in: high, mixed and low.
SQUARES = ("qh", "qm", "ql")


@dataclass(frozen=True)
class Frame:
    """Seconds relative to the row; ``start=None`` reaches back without bound."""

    name: str
    start: int | None
    end: int


def frames(definitions: Mapping[str, tuple[int, int]]) -> tuple[Frame, ...]:
    """Frames from ``{name: (start, end)}``."""
    return tuple(Frame(name, start, end) for name, (start, end) in definitions.items())


def named_windows(
    keys: list[str],
    time: str,
    definitions: Mapping[str, tuple[int, int]],
    prefix: str = "tx",
) -> dict[str, WindowSpec]:
    """Plain Spark window per frame, for use with any window function.

    Peers of the same second belong to the frame. Use these on tables with bounded
    groups; :func:`rolling` is the form that also stands hot keys.
    """
    base = Window.partitionBy(*keys).orderBy(time)
    return {
        f"{prefix}_{name}": base.rangeBetween(start, end)
        for name, (start, end) in definitions.items()
    }


@dataclass(frozen=True)
class Request:
    """Aggregates of one column over some frames.

    ``name`` is a pattern with ``{target}``, ``{agg}`` and ``{frame}``. ``ddof`` is 1 for
    the sample and 0 for the population deviation. ``empty`` is the result of sum, avg and
    std where they have no rows to work on. ``counts`` says what a count counts: all
    ``rows`` of the frame or only the ``values`` that are present.

    ``scale`` promises that the amounts are whole multiples of 1 / scale (100: cents); a
    row that breaks the promise raises an error. Without it the unit is found from the
    values. Amounts that are not finite count as missing. ``units`` is what :func:`resolve`
    found.
    """

    target: str
    frames: tuple[Frame, ...]
    aggs: frozenset[str]
    name: str = "{target}_{agg}_{frame}"
    scale: int | None = None
    ddof: int = 1
    empty: float | None = None
    counts: str = "rows"
    units: str = ""

    def __post_init__(self) -> None:
        if isinstance(self.aggs, str):
            raise TypeError("aggs is a set of names, not a text")
        object.__setattr__(self, "aggs", frozenset(self.aggs))
        unknown = self.aggs - SHORT.keys()
        if unknown:
            raise ValueError(f"unknown aggregates: {sorted(unknown)}")

    def column(self, agg: str, frame: Frame) -> str:
        return self.name.format(target=self.target, agg=SHORT[agg], frame=frame.name)

    @property
    def has_moments(self) -> bool:
        return bool(self.aggs & {"sum", "avg", "std"})

    @property
    def parts(self) -> list[str]:
        """Names of the running totals the requested aggregates are made of."""
        units = self.units or "1"
        values = "present" if _is_fraction(units) else "v"
        names = ["n" if self.counts == "rows" else f"{values}:{self.target}"]
        shape = _shape(units)
        if shape:
            limbs, squares = range(shape.limbs), range(shape.square_limbs)
            if self.has_moments:
                names += [f"l{k}:{units}:{self.target}" for k in limbs]
            if "std" in self.aggs:
                names += [f"r{k}:{units}:{self.target}" for k in squares]
            return names
        if self.has_moments:
            names.append(f"s:{units}:{self.target}")
        if "std" in self.aggs:
            names += [f"{limb}:{units}:{self.target}" for limb in SQUARES]
        return names


@dataclass(frozen=True)
class Group:
    """Requests that share their keys."""

    keys: tuple[str, ...]
    requests: tuple[Request, ...]


# Marks in front of a unit: a fraction that was looked at or promised, units in limbs (of
# whole numbers, or of a fraction where another mark follows), and limbs of doubles.
FOUND, PROMISED, LIMBS, BINARY = "f", "p", "i", "e"
WHOLE = ("tinyint", "smallint", "int", "bigint", "boolean")
DECIMALS = (0, 2, 4, 6)


def _is_fraction(units: str) -> bool:
    return units[0] in (FOUND, PROMISED, BINARY) or units.startswith(LIMBS + FOUND)


def _shape(units: str) -> exact.Layout | None:
    """The limbs that totals are kept in; None where a single total is enough."""
    return exact.from_mark(units[0] if units[0] == LIMBS else units) if (
        units[0] in (LIMBS, BINARY)) else None


def _finite(target: str) -> str:
    """The amount as a double, null if it is not finite."""
    return f"if(abs(double(`{target}`)) < double('Infinity'), double(`{target}`), NULL)"


def _units(target: str, units: str) -> str:
    """Units of an amount, as a SQL expression: a bigint, or a double where it has no unit."""
    mark = units[0]
    if mark == LIMBS:
        return _units(target, units[1:])
    if mark == BINARY:
        return _finite(target)
    if not _is_fraction(units):
        return f"bigint(`{target}`)" if units == "1" else f"bigint(`{target}` * {units})"
    value, size = _finite(target), units[1:]
    rounded = _rounded(f"{value} * {size}")
    if mark == FOUND:
        return f"bigint({rounded})"
    near = f"abs({value} * {size} - {rounded}) < 0.000001"
    broken = f"raise_error('{target} is not a multiple of 1 / {size}')"
    return f"bigint(if({value} IS NULL OR {near}, {rounded}, {broken}))"


def _rounded(amount: str) -> str:
    """``round`` of an amount in units, which lies within a quarter of a whole number: below
    2^50 without making a decimal of it."""
    return f"if(abs({amount}) < {2**50}D, rint({amount}), round({amount}))"


def _per_unit(units: str) -> str:
    """Units in one, as a number in SQL."""
    return "1" if units[0] == BINARY else units.lstrip(LIMBS + FOUND + PROMISED)


def amounts_to_look_at(df: DataFrame, requests: Iterable[Request]) -> dict[str, bool]:
    """Columns whose unit is not known, and whether they can have a fraction.

    Whole numbers of up to 32 bits need no look.
    """
    kinds = dict(df.dtypes)
    return {
        r.target: kinds[r.target] not in WHOLE
        for r in requests
        if r.has_moments and not r.units and r.scale is None
        and kinds[r.target] not in ("tinyint", "smallint", "int", "boolean")
    }


def _has_decimals(value: Column, digits: int) -> Column:
    """Whether an amount is the double nearest to a number of so many decimals.

    Rounding makes a decimal of each amount. Up to 10^15 units, where doubles tell all units
    apart, a division says the same, and from 2^53 on doubles are whole.
    """
    size, units = F.abs(value), value * F.lit(10.0**digits)
    return F.when(F.abs(units) < 1e15, F.rint(units) / F.lit(10.0**digits) == value).when(
        size >= 2.0**53, True).otherwise(F.round(value, digits) == value)


def amount_measures(looked_at: Mapping[str, bool]) -> dict[str, Column]:
    """What has to be known of the amounts, as aggregates: decimals and sizes."""
    measures = {"rows": F.count(F.lit(1))}
    for target, fractional in looked_at.items():
        value = F.expr(_finite(target) if fractional else f"double(`{target}`)")
        size = F.abs(value)
        measures[f"top:{target}"] = F.max(size)
        if fractional:
            measures[f"least:{target}"] = F.min(F.when(size > 0, size))
            for digits in DECIMALS:
                measures[f"{digits}:{target}"] = F.count_if(~_has_decimals(value, digits))
    return measures


def with_units(
    df: DataFrame, requests: Iterable[Request], looked_at: Mapping[str, bool], seen
) -> list[Request]:
    """Requests with the units of their columns; ``seen`` holds the measures."""
    kinds = dict(df.dtypes)

    def found(request: Request) -> str:
        target = request.target
        if request.units:
            return request.units
        if not request.has_moments:
            whole = kinds[target] in WHOLE or request.counts == "rows"
            return "" if whole else FOUND + "1"
        if request.scale is not None:
            return ("" if kinds[target] in WHOLE else PROMISED) + str(request.scale)
        if target not in looked_at:
            return "1"
        rows, top, mark = max(1, seen["rows"]), seen[f"top:{target}"] or 0.0, ""
        needed = 0
        if looked_at[target]:
            mark = FOUND
            fits = [d for d in DECIMALS if not seen[f"{d}:{target}"]]
            if not fits or top * 10 ** fits[0] >= 2**53:
                return exact.layout(seen[f"least:{target}"] or 0.0, top).mark
            needed = fits[0]
        most = top * 10**needed
        small = most < 2**53 and (most / 8192 + 1) ** 2 * rows < 2**62 and most * rows < 2**62
        return ("" if small else LIMBS) + mark + str(10**needed)

    return [replace(r, units=found(r)) for r in requests]


def resolve(df: DataFrame, requests: Iterable[Request]) -> list[Request]:
    """Requests with the units of their columns.

    One pass over the amounts finds how many decimals they have and how large they are, in
    one row. Totals are 64-bit integers if all possible totals fit, else limbs.
    """
    requests = list(requests)
    looked_at = amounts_to_look_at(df, requests)
    seen = None
    if looked_at:
        measures = amount_measures(looked_at)
        seen = df.agg(*[m.alias(name) for name, m in measures.items()]).first()
    return with_units(df, requests, looked_at, seen)


def prepared(df: DataFrame, requests: Iterable[Request]) -> DataFrame:
    """``df`` with the limbs of the amounts whose totals are kept in limbs."""
    added, squares = {}, {}
    for request in requests:
        shape = _shape(request.units or "1")
        if shape and request.has_moments:
            value, name = _units(request.target, request.units), f"{request.units}:{request.target}"
            added[f"_limbs:{name}"] = exact.limbs(value, shape)
            if "std" in request.aggs:
                squares[f"_squares:{name}"] = (
                    exact.squares_from(f"`_limbs:{name}`", shape) if shape.plain
                    else exact.square_limbs(value, shape))
    wide = with_columns(df, df.columns, added) if added else df
    return with_columns(wide, wide.columns, squares) if squares else wide


def check_resolved(df: DataFrame, requests: Iterable[Request]) -> None:
    """Refuses amounts with a fraction whose unit nobody has looked for."""
    kinds = dict(df.dtypes)
    for request in requests:
        if request.has_moments and not request.units and kinds[request.target] not in WHOLE:
            raise ValueError(f"{request.target} has a fraction: resolve the request first")


def part_value(part: str) -> str:
    """Contribution of one row to a total, as a SQL expression."""
    kind, _, rest = part.partition(":")
    if kind == "n":
        return "1L"
    if kind == "v":
        return f"bigint(`{rest}` IS NOT NULL)"
    if kind == "present":
        return f"bigint({_finite(rest)} IS NOT NULL)"
    if kind[0] in "lr":
        column = "_limbs" if kind[0] == "l" else "_squares"
        return f"element_at(`{column}:{rest}`, {int(kind[1:]) + 1})"
    size, _, target = rest.partition(":")
    units = _units(target, size)
    if kind == "s":
        return units
    high, low = f"shiftright(abs({units}), 13)", f"(abs({units}) & 8191)"
    return {"qh": f"{high} * {high}", "qm": f"{high} * {low}", "ql": f"{low} * {low}"}[kind]


def sum_of_squares(high: str, mixed: str, low: str, kind: str) -> str:
    """The sum of squares itself from its three totals, as a number of SQL type ``kind``."""
    return f"(cast({high} AS {kind}) * 67108864 + cast({mixed} AS {kind}) * 16384 + {low})"


def part_column(part: str) -> str:
    """The total itself, where rows have been reduced already."""
    return f"`{part}`"


def all_parts(requests: Iterable[Request]) -> list[str]:
    return list(dict.fromkeys(part for request in requests for part in request.parts))


def totals(parts: Iterable[str]) -> list[Column]:
    """Aggregate expressions that reduce rows to their totals."""
    return [F.expr(f"coalesce(sum({part_value(p)}), 0)").alias(p) for p in parts]


def with_columns(df: DataFrame, keep: Iterable[str], added: Mapping[str, str]) -> DataFrame:
    """``keep`` and the SQL expressions ``added``, in one projection."""
    return df.selectExpr(
        *[f"`{name}`" for name in keep], *[f"{sql} AS `{name}`" for name, sql in added.items()]
    )


class RunningTotals:
    """Running totals of some parts up to some distances from the current time."""

    def __init__(self, requests: Iterable[Request]):
        self.columns: dict[tuple[str, int], str] = {}
        for request in requests:
            for frame in request.frames:
                for part in request.parts:
                    self._register(part, frame.end)
                    if frame.start is not None:
                        self._register(part, frame.start - 1)

    def _register(self, part: str, distance: int) -> None:
        self.columns.setdefault((part, distance), f"_total_{len(self.columns)}")

    def add(self, df: DataFrame, keys: list[str], time: str, value=part_column) -> DataFrame:
        """All totals in one window pass: one shuffle, one sort. Rows without a time, which
        sort before all others, add nothing."""
        by = ", ".join(f"`{key}`" for key in keys)
        added = {}
        for (part, distance), column in self.columns.items():
            bound = f"{distance} FOLLOWING" if distance >= 0 else f"{-distance} PRECEDING"
            frame = f"RANGE BETWEEN UNBOUNDED PRECEDING AND {bound}"
            window = f"(PARTITION BY {by} ORDER BY `{time}` {frame})"
            timed = f"if(`{time}` IS NULL, NULL, {value(part)})"
            added[column] = f"coalesce(sum({timed}) OVER {window}, 0)"
        return with_columns(df, df.columns, added)

    def within(self, part: str, frame: Frame) -> str:
        """Total of the part over the frame, as a SQL expression."""
        upper = self.columns[part, frame.end]
        if frame.start is None:
            return upper
        return f"({upper} - {self.columns[part, frame.start - 1]})"


# From totals to doubles, each step by columns of those before: totals over a frame, their
# signs and digits, limbs and digits of the spread, the doubles.
STEPS = ("part", "sign", "digits", "apart", "spread", "double")
_MADE = re.compile(rf"\b_(?:{'|'.join(STEPS)})_\d+\b")


def finish(df: DataFrame, keep: Iterable[str], wanted: Iterable[tuple]) -> DataFrame:
    """``keep`` and the columns of every (request, total) in ``wanted``, where
    ``total(part, frame)`` is the SQL expression of a total over a frame.

    The totals are computed in a projection of their own: several columns use each, and
    written out in every place they would make code too long to be compiled. So are the
    steps (:data:`STEPS`) from totals in limbs to doubles.
    """
    keep, wanted = list(keep), list(wanted)
    steps: dict[str, dict[str, str]] = {step: {} for step in STEPS}

    def named(step: str, sql: str) -> str:
        return steps[step].setdefault(sql, f"_{step}_{len(steps[step])}")

    added: dict[str, str] = {}
    for request, total in wanted:
        added.update(_columns(
            request, lambda part, frame: named("part", total(part, frame)), named))
    out, made = df, []
    for step, names in steps.items():
        if names or step == STEPS[0]:
            later = [*steps.values()][[*steps].index(step) + 1:]
            used = set(_MADE.findall(" ".join([*added.values(), *chain(*later)])))
            held = [name for name in made if name in used.union(*map(_MADE.findall, names))]
            out = with_columns(out, [*keep, *held], {name: sql for sql, name in names.items()})
            made = [name for name in [*held, *names.values()] if name in used]
    return with_columns(out, keep, added)


def _columns(request: Request, total, named) -> dict[str, str]:
    out: dict[str, str] = {}
    empty = "NULL" if request.empty is None else repr(request.empty)
    units = request.units or "1"
    scale, shape = _per_unit(units), _shape(units)
    for frame in request.frames:
        n, *moments = [total(part, frame) for part in request.parts]
        if shape and moments:
            limbed = _plainly_limbed if shape.plain else _limbed
            values = limbed(n, moments, shape, named, request.ddof)
        elif moments:
            values = {"sum": moments[0], "double": f"double({moments[0]})"}
            if "std" in request.aggs:
                values["std"] = _deviation(n, *moments, request.ddof)
        for agg in sorted(request.aggs, key=list(SHORT).index):
            if agg == "count":
                value = n
            elif agg == "isnew":
                value = f"if({n} = 0, 1, 0)"
            elif agg == "sum":
                whole = not _is_fraction(units) and scale == "1"
                one = values["sum"] if whole else f"{values['double']} / {scale}"
                value = f"if({n} > 0, {one}, {empty})"
            elif agg == "avg":
                mean = f"try_divide({values['double']}, double({n}) * {scale})"
                value = f"coalesce({mean}, double({empty}))"
            else:
                value = f"if({n} > 1, {values['std']} / {scale}, double({empty}))"
            out[request.column(agg, frame)] = value
    return out


def _plainly_limbed(
    n: str, moments: list[str], shape: exact.Layout, named, ddof: int
) -> dict[str, str]:
    """:func:`_limbed` for plain layouts."""
    limbs, squares = moments[: shape.limbs], moments[shape.limbs :]

    def each(step: str, made: list[str]) -> list[str]:
        return [named(step, sql) for sql in made]

    negative = named("sign", exact.is_negative(limbs))
    s = each("digits", exact.plain_digits(limbs, negative))
    values = {"double": named("double", exact.plain_nearest(s, shape.low, negative))}
    if squares:
        q = each("digits", exact.plain_digits(squares))
        d = each("spread", exact.plain_digits(each("apart", exact.plain_spread(n, s, q))))
        high = shape.low + exact.BITS * shape.limbs
        spread = named("double", exact.plain_nearest(d, 2 * (shape.low - high)))
        values["std"] = f"(sqrt({spread} / {_weight(n, ddof)}) * {exact.power(high)})"
    return values


def _limbed(n: str, moments: list[str], shape: exact.Layout, named, ddof: int) -> dict[str, str]:
    """The sum, as a double too, and the deviation, from totals of limbs."""
    limbs, squares = moments[: shape.limbs], moments[shape.limbs :]
    # Whole numbers mostly stay within decimals, which are faster than digits.
    whole = exact.as_decimal(limbs) if shape.whole else ""
    s = exact.digits(limbs) if shape.whole else named("digits", exact.digits(limbs))
    # An error where it does not fit, as sums of whole numbers are.
    values = {"sum": f"bigint({whole})",
              "double": f"double({whole})" if whole else exact.nearest(s, shape.low)}
    if squares:
        q = exact.digits(squares) if shape.whole else named("digits", exact.digits(squares))
        # Scaled by a power of two that no square can leave the doubles with.
        high = shape.low + exact.BITS * shape.limbs
        apart = exact.spread(n, s, q, exact.digit_count(shape.limbs),
                             exact.digit_count(shape.square_limbs))
        spread = exact.nearest(apart, 2 * (shape.low - high))
        values["std"] = f"(sqrt({spread} / {_weight(n, ddof)}) * {exact.power(high)})"
        if whole:
            found = exact.decimal_spread(n, whole, exact.as_decimal(squares))
            small = f"sqrt(double({found}) / {_weight(n, ddof)})"
            values["std"] = f"coalesce({small}, {values['std']})"
    return values


def _weight(n: str, ddof: int) -> str:
    return f"(double({n}) * (double({n}) - {1 if ddof == 1 else 0}))"


def defaults(requests: Iterable[Request]) -> dict[str, str]:
    """The columns, with the values of a frame without rows where they are missing."""
    out = {}
    for request in requests:
        for frame in request.frames:
            for agg in request.aggs:
                name = request.column(agg, frame)
                default = {"count": 0, "isnew": 1}.get(agg, request.empty)
                out[name] = f"`{name}`" if default is None else f"coalesce(`{name}`, {default})"
    return out


def _deviation(n: str, s: str, high: str, mixed: str, low: str, ddof: int) -> str:
    # n * sum of squares - square of the sum: exact, hence never below zero. With totals
    # this small the products fit into 64 bits; decimals are for the rare large ones.
    def spread(kind: str) -> str:
        squares = sum_of_squares(high, mixed, low, kind)
        return f"double(cast({n} AS {kind}) * {squares} - cast({s} AS {kind}) * {s})"

    small = f"{n} < 32768 AND {high} < 1048576"
    found = f"if({small}, {spread('bigint')}, {spread('decimal(19, 0)')})"
    return f"sqrt({found} / {_weight(n, ddof)})"


def rolling_over_rows(df: DataFrame, time: str, groups: Iterable[Group]) -> DataFrame:
    """Frame aggregates by windows over the rows themselves.

    With nested keys and the coarsest first, all groups share one shuffle: rows that are
    together by customer are also together by customer and terminal.
    """
    for group in groups:
        before = df.columns
        running = RunningTotals(group.requests)
        wide = running.add(prepared(df, group.requests), list(group.keys), time, part_value)
        df = finish(wide, before, [(request, running.within) for request in group.requests])
    return df


def second_totals(df: DataFrame, keys: list[str], time: str, requests) -> DataFrame:
    """One row per key and second with all totals the requests need."""
    check_resolved(df, requests)
    ledger = prepared(df, requests).filter(F.col(time).isNotNull()).groupBy(*keys, time)
    return ledger.agg(*totals(all_parts(requests)))


def added_up(totals_table: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by fewer keys, or of several tables: all other columns are sums."""
    parts = [name for name in totals_table.columns if name not in keys]
    return totals_table.groupBy(*keys).agg(*[F.sum(f"`{p}`").alias(p) for p in parts])


def rolling_by_second(df: DataFrame, keys: list[str], time: str, requests) -> DataFrame:
    """Frame aggregates with one row per key and second, safe for keys of any size.

    Rows are reduced to totals per key and second before they are shuffled.
    """
    return rolling_over_seconds(second_totals(df, keys, time, requests), keys, time, requests)


def rolling_over_seconds(
    seconds: DataFrame, keys: list[str], time: str, requests
) -> DataFrame:
    """Frame aggregates from totals by key and second.

    The axis is cut into slices, and a second is copied into the later (or earlier) slices
    that look at it. A window sees one slice of one key: a bounded number of seconds. For
    frames without a start, what lies before the seconds of a slice is added from totals by
    slice.
    """
    shapes = [frame for request in requests for frame in request.frames]
    back = max(0, *(-(f.end if f.start is None else f.start) for f in shapes))
    ahead = max(0, *(frame.end for frame in shapes))
    width = max(back + ahead, DAY)
    parts = all_parts(requests)

    first = bucket_start(F.col(time) - ahead, width)
    last = bucket_start(F.col(time) + back, width)
    step = F.lit(width).cast("bigint")
    copies = seconds.withColumn("_slice", F.explode(F.sequence(first, last, step)))

    running = RunningTotals(requests)
    wide = running.add(copies, [*keys, "_slice"], time)
    home = bucket_start(F.col(time), width)
    own = wide.filter(F.col("_slice") == home)
    if all(frame.start is not None for frame in shapes):
        return finish(own, [*keys, time], [(request, running.within) for request in requests])

    # A second is before the seconds of a slice if the last slice that it is in is earlier.
    gone = seconds.select(*keys, last.alias("_slice"), *[F.col(f"`{p}`") for p in parts])
    here = seconds.select(*keys, home.alias("_slice")).distinct().select(
        "*", *[F.lit(0).cast(kind).alias(p) for p, kind in seconds.dtypes if p in parts])
    by_slice = gone.unionByName(here).groupBy(*keys, "_slice").agg(
        *[F.sum(f"`{p}`").alias(p) for p in parts])
    names = ", ".join(f"`{key}`" for key in keys)
    earlier = f"(PARTITION BY {names} ORDER BY _slice RANGE BETWEEN UNBOUNDED PRECEDING "
    bases = {
        f"_base:{p}": f"coalesce(sum(`{p}`) OVER {earlier} AND 1 PRECEDING), 0)" for p in parts
    }
    based = look_up(own, with_columns(by_slice, [*keys, "_slice"], bases), [*keys, "_slice"])

    def total(part: str, frame: Frame) -> str:
        within = running.within(part, frame)
        return within if frame.start is not None else f"(`_base:{part}` + {within})"

    return finish(based, [*keys, time], [(request, total) for request in requests])


def looked(
    df: DataFrame, requests: list[Request], keys: list[str], rule: HotRule | None
) -> tuple[list[Request], list[int]]:
    """Requests with units, and what may be hot keys, by a look at rows and amounts, and at the
    keys of a table with more rows than a key needs to be hot."""
    looked_at = amounts_to_look_at(df, requests)
    if not looked_at and not rule:
        return with_units(df, requests, {}, None), []
    measures = amount_measures(looked_at)
    seen = df.agg(*[m.alias(name) for name, m in measures.items()]).first()
    hot = rule is not None and seen["rows"] > rule.rows
    items = df.agg(heavy_items(keys, rule)).first()[0] if hot else []
    return with_units(df, requests, looked_at, seen), list(items)


def rolling(
    df: DataFrame, time: str, groups: list[Group], rule: HotRule | None = DEFAULT_RULE
) -> DataFrame:
    """Add frame aggregates to every row; ``time`` is an integer number of seconds.

    The keys of the first group must be part of the keys of all others: they decide
    which rows belong to a hot key (see :mod:`ledgerlens.operators.skew`). Rows without a
    time get the values of a frame without rows.
    """
    coarse = list(groups[0].keys)
    if any(not set(coarse) <= set(group.keys) for group in groups):
        raise ValueError("the first group must have the coarsest keys")
    requests, items = looked(
        df, [request for group in groups for request in group.requests], coarse, rule)
    found = iter(requests)
    groups = [replace(g, requests=tuple(next(found) for _ in g.requests)) for g in groups]
    ordinary, hot = split_hot(df, coarse, rule, items)
    finished = rolling_over_rows(ordinary, time, groups)
    if hot is None:
        return finished
    looked_up = hot
    filled: dict[str, str] = {}
    for group in groups:
        keys = list(group.keys)
        by_second = rolling_by_second(hot, keys, time, group.requests)
        looked_up = look_up(looked_up, by_second, [*keys, time])
        filled |= defaults(group.requests)
    return finished.unionByName(with_columns(looked_up, hot.columns, filled))


def ratio_over_frames(
    df: DataFrame, time: str, group: Group, rule: HotRule | None = DEFAULT_RULE
) -> DataFrame:
    """Target divided by its own fresh frame aggregates, which are not kept."""
    mark = "_fresh_"
    marked = Group(
        group.keys,
        tuple(
            replace(request, name=mark + request.name) for request in group.requests
        ),
    )
    wide = rolling(df, time, [marked], rule)
    ratios = []
    for request in marked.requests:
        for frame in request.frames:
            for agg in sorted(request.aggs, key=list(SHORT).index):
                base = request.column(agg, frame)
                ratio = guarded_ratio(F.col(request.target), F.col(base))
                ratios.append(ratio.alias("ratio_" + base.removeprefix(mark)))
    return wide.select(*df.columns, *ratios)
