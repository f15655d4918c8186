"""Fitting the parts of a prompt into a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4.0


@dataclass(frozen=True)
class Limits:
    """What a context window leaves, with the most and the least of each part (links by number, the others in characters)."""

    window: int
    output: int

    @property
    def margin(self) -> int:
        return _between(350, self.window * 0.05, 1200)

    @property
    def prompt(self) -> int:
        return self.window - self.output - self.margin

    @property
    def most(self) -> dict[str, int]:
        p = self.prompt
        return {"links": _between(25, p / 180, 70), "text": _between(6500, p * 2.0, 22000), "memory": _between(1400, p * 0.45, 5000), "profile": _between(3500, p, 9000)}

    @property
    def least(self) -> dict[str, int]:
        return {"links": _between(5, self.most["links"] * 0.2, 10), "text": _between(900, self.prompt * 0.22, 2500), "memory": 600, "profile": 1400}


# How much a part keeps in one step, how often, the last values of links and text, and what is left after them.
PAGE_SHRINK, PAGE_TRIES, LAST = 0.65, 18, {"links": 3, "text": 700}
HARD_FLOOR = {"links": 2, "text": 400, "memory": 500, "profile": 800}
QUERY_SHRINK, QUERY_TRIES, QUERY_LEAST = 0.6, 12, {"memory": 500, "profile": 1200}


def _between(low: int, value: float, high: int) -> int:
    return min(high, max(low, int(value)))


def steps(start: dict[str, int], least: dict[str, int], shrink: float, tries: int, last: dict[str, int] | None = None) -> list[dict[str, int]]:
    """The limits tried one after the other: the first part above its least shrinks, then the last values are taken."""
    out, now = [dict(start)], dict(start)
    while len(out) < tries:
        part = next((k for k in least if now[k] > least[k]), None)
        if part:
            now[part] = max(least[part], int(now[part] * shrink))
        else:
            part = next((k for k in last or {} if now[k] > last[k]), None)
            if part is None:
                break
            now[part] = last[part]
        out.append(dict(now))
    return out


def page_steps(limits: Limits, n_links: int) -> list[dict[str, int]]:
    """Steps of a page prompt with that many links, and behind them the hard floor."""
    start = limits.most | {"links": min(n_links, limits.most["links"])}
    return [*steps(start, limits.least, PAGE_SHRINK, PAGE_TRIES, LAST), HARD_FLOOR | {"links": min(n_links, HARD_FLOOR["links"])}]


def query_steps(limits: Limits) -> list[dict[str, int]]:
    start = {k: limits.most[k] for k in ("memory", "profile")}
    return steps(start, QUERY_LEAST, QUERY_SHRINK, QUERY_TRIES)


def tokens(chars: Column) -> Column:
    return F.ceil(chars / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def first_fitting(tried: list[dict[str, int]], chars, most_tokens: int) -> Column:
    """struct of the first limits under which ``chars(limit)``, the characters of the whole prompt, fit the budget; NULL if none do."""
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()], F.lit(i).alias("step")) for i, s in enumerate(tried)])
    return F.try_element_at(F.filter(table, lambda s: tokens(chars(s)) <= most_tokens), F.lit(1))
