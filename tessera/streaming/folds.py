"""State that is folded over ordered rows of a key: quality baselines, circuit breakers, backoff."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dedup import fold_scopes

#: Minutes to wait after so many consecutive failures.
BACKOFF = (0, 5, 15, 60, 240, 1440)


def backoff_minutes(failures: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BACKOFF)), (F.least(failures, F.lit(len(BACKOFF) - 1)) + 1).cast("int"))


def next_baseline(old: float | None, value: float, accept: float = 0.9, alarm: float = 0.3) -> tuple[float, bool]:
    """The baseline after a value: values of at least ``accept`` of it replace it where higher or close; a drop of more than ``alarm`` alerts."""
    if old is None or value >= accept * old:
        return value if old is None else max(value, accept * old), False
    return old, value < (1 - alarm) * old


def baseline(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """signal_id, baseline, alert after each row of a key in order; null values change nothing."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        old = None
        for i, v in rows:
            alert = False
            if v is not None:
                old, alert = next_baseline(old, v)
            yield i, old, alert

    return fold_scopes(df, [key], [F.col(c) for c in order], [order[-1], value], f"{order[-1]} long, baseline double, alert boolean", fold)


def breaker_step(state: tuple[str, int, float], failed: bool, now: float, limit: int = 5, cooldown: float = 300, successes: int = 2) -> tuple[str, int, float]:
    """One step of a circuit breaker: (state, count, opened at). The count is of consecutive failures while closed, of consecutive successes
    while half open; ``successes`` of them close it, one failure opens it again."""
    name, n, opened = state
    if name == "open" and now - opened >= cooldown:
        name, n = "half_open", 0
    if name == "open":
        return name, n, opened
    if name == "half_open":
        if failed:
            return "open", 0, now
        return ("closed", 0, opened) if n + 1 >= successes else ("half_open", n + 1, opened)
    if not failed:
        return "closed", 0, opened
    return ("open", 0, now) if n + 1 >= limit else ("closed", n + 1, opened)


def breaker(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """signal_id, state after each check of a key in order of time."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        state = ("closed", 0, 0.0)
        for i, at, failed in rows:
            state = breaker_step(state, bool(failed), at)
            yield i, state[0]

    x = df.withColumn("_at", F.unix_micros(F.col(order[0]).cast("timestamp")) / 1e6)
    return fold_scopes(x, [key], [F.col(c) for c in order], [order[-1], "_at", "failed"], f"{order[-1]} long, state string", fold)


def alert_level(old: tuple[int, float], count: int, confidence: float, warning: float = 0.3, error: float = 0.5, less_sure: float = 0.2) -> list[str]:
    """The alerts of an extraction against its baseline (count, confidence): nothing where there was something is critical and ends the check."""
    n, sure = old
    if count == 0 and n > 0:
        return ["critical"]
    out = []
    if n > 0 and (drop := (n - count) / n) > warning:
        out.append("error" if drop > error else "warning")
    if sure > 0 and sure - confidence > less_sure:
        out.append("less_sure")
    return out


def quality_alerts(df: DataFrame, key: str, order: Sequence[str], count: str, confidence: str, accept: float = 0.9) -> DataFrame:
    """signal_id, alerts after each row of a key in order. The first row is the baseline; later ones replace it if they have ``accept`` of its count."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        old = None
        for i, n, sure in rows:
            if n is None or sure is None:
                yield i, []
                continue
            yield i, [] if old is None else alert_level(old, n, sure)
            if old is None or n >= accept * old[0]:
                old = (n, sure)

    return fold_scopes(df, [key], [F.col(c) for c in order], [order[-1], count, confidence], f"{order[-1]} long, alerts array<string>", fold)
