"""SQL text of window aggregates, written with plain sliding frames."""

from __future__ import annotations


def bound(seconds: int) -> str:
    return f"{-seconds} PRECEDING" if seconds < 0 else f"{seconds} FOLLOWING"


def over(keys: str, order: str, start: int, end: int) -> str:
    return f"(PARTITION BY {keys} ORDER BY {order} RANGE BETWEEN {bound(start)} AND {bound(end)})"


def mean(n: str, s: str, scale: int, empty: str = "NULL") -> str:
    return (f"CASE WHEN {n} > 0 THEN ({s})::double / ({n} * {scale})::double "
            f"ELSE {empty} END")


def deviation(n: str, s: str, q: str, scale: int, ddof: int, empty: str = "NULL") -> str:
    count = f"({n})::double"
    weight = f"({count} * ({count} - 1))" if ddof else f"({count} * {count})"
    spread = f"(({n})::hugeint * ({q}) - ({s})::hugeint * ({s}))::double"
    return f"CASE WHEN {n} > 1 THEN sqrt({spread} / {weight}) / {scale} ELSE {empty} END"


def row_frames(keys: str, frames: dict, aggs: list[str], pattern: str, value: str = "cents",
               target: str = "tx_amount", scale: int = 100) -> list[str]:
    """Select items for frames over rows of tx."""
    items = []
    for name, (start, end) in frames.items():
        w = over(keys, "unix_time", start, end)
        n = f"count(*) OVER {w}"
        s = f"coalesce(sum({value}) OVER {w}, 0)"
        q = f"coalesce(sum({value}::hugeint * {value}) OVER {w}, 0)"
        made = {
            "cn": n,
            "sum": f"cast(sum({value}) OVER {w} AS bigint)",
            "avg": mean(n, s, scale),
            "std": deviation(n, s, q, scale, 1),
            "isnew": f"cast(CASE WHEN {n} = 0 THEN 1 ELSE 0 END AS int)",
        }
        for agg in aggs:
            items.append(f"{made[agg]} AS {pattern.format(target=target, agg=agg, frame=name)}")
    return items


def bucket_tables(source: str, interval: int, targets: dict[str, str],
                  specs: list[tuple[dict, list[str]]], keys: str = "terminal_id",
                  sums_only: tuple = ()) -> str:
    """CTEs ``bt`` (bucket totals) and ``bh`` (history per bucket).

    ``targets`` maps short names to columns; ``specs`` lists (frames, short names). The
    squares of ``sums_only`` (short names) do not fit and are left out.
    """
    squares = {t: "0" if t in sums_only else f"{c}::hugeint * {c}" for t, c in targets.items()}
    sums = ", ".join(f"sum({c})::hugeint AS s_{t}, sum({squares[t]}) AS q_{t}"
                     for t, c in targets.items())
    used = {short for _, shorts in specs for short in shorts}
    history = []
    for frames, _ in specs:
        for start, end in frames.values():
            tag = f"{-start}_{-end}".replace("-", "m")
            w = over(keys, "b", start, end)
            history.append(f"sum(n) OVER {w} AS n_{tag}")
            for t in sorted(used):
                history.append(f"sum(s_{t}) OVER {w} AS s_{t}_{tag}")
                history.append(f"sum(q_{t}) OVER {w} AS q_{t}_{tag}")
    return f"""br AS (SELECT *, unix_time - unix_time % {interval} AS b FROM {source}),
bt AS (SELECT {keys}, b, count(*) AS n, {sums} FROM br GROUP BY {keys}, b),
bh AS (SELECT {keys}, b, {", ".join(dict.fromkeys(history))} FROM bt)"""


def bucket_items(frames: dict, short: str, target: str, aggs: list[str], pattern: str,
                 column: str, scale: int = 1, current: bool = True,
                 keys: str = "terminal_id") -> list[str]:
    """Select items over ``br r LEFT JOIN bh h``."""
    w = f"(PARTITION BY r.{keys}, r.b ORDER BY r.unix_time RANGE UNBOUNDED PRECEDING)"
    items = []
    for name, (start, end) in frames.items():
        tag = f"{-start}_{-end}".replace("-", "m")
        n, s, q = (f"coalesce(h.{p}_{tag}, 0)" for p in ("n", f"s_{short}", f"q_{short}"))
        if current:
            n = f"({n} + count(*) OVER {w})"
            s = f"({s} + sum(r.{column}) OVER {w})"
            q = f"({q} + sum(r.{column}::hugeint * r.{column}) OVER {w})"
        made = {
            "cn": f"cast({n} AS bigint)",
            "sum": f"cast({s} AS bigint)",
            "avg": mean(n, s, scale, "0"),
            "std": deviation(n, s, q, scale, 0, "0"),
        }
        for agg in aggs:
            items.append(f"{made[agg]} AS {pattern.format(target=target, agg=agg, frame=name)}")
    return items


JOINED = "FROM br r LEFT JOIN bh h ON r.terminal_id = h.terminal_id AND r.b = h.b"
