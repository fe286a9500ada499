"""Metrics of runs and rules that raise alerts on them."""

from __future__ import annotations

import operator
import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

_TESTS = {"gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le, "eq": operator.eq, "ne": operator.ne}


@dataclass(frozen=True)
class AlertRule:
    """``metric`` compared with a threshold; quiet for ``cooldown`` seconds after it fires."""

    name: str
    metric: str
    test: str
    threshold: float
    cooldown: float = 300.0

    def __post_init__(self):
        if self.test not in _TESTS:
            raise ValueError(f"test {self.test!r} is none of {', '.join(_TESTS)}")


@dataclass
class Metrics:
    """Counters, gauges and histograms by name, and the rules over them."""

    rules: list[AlertRule] = field(default_factory=list)
    clock: Callable[[], float] = time.time
    values: dict[str, float] = field(default_factory=dict)
    series: dict[str, list[float]] = field(default_factory=lambda: defaultdict(list))
    _fired: dict[str, float] = field(default_factory=dict)

    def count(self, name: str, by: float = 1.0) -> None:
        self.gauge(name, self.values.get(name, 0.0) + by)

    def gauge(self, name: str, value: float) -> None:
        self.values[name] = value

    def observe(self, name: str, value: float) -> None:
        """A value of a histogram; its last value is what rules see."""
        self.series[name].append(value)
        self.gauge(name, value)

    def summary(self, name: str) -> dict[str, float]:
        """count, min, max, mean and 95th percentile of a histogram."""
        s = sorted(self.series[name])
        return {"count": len(s), **({"min": s[0], "max": s[-1], "mean": sum(s) / len(s), "p95": s[min(len(s) - 1, int(0.95 * len(s)))]} if s else {})}

    def alerts(self) -> list[str]:
        """Names of rules that fire now."""
        now, out = self.clock(), []
        for r in self.rules:
            quiet = now - self._fired.get(r.name, float("-inf")) < r.cooldown
            if r.metric in self.values and _TESTS[r.test](self.values[r.metric], r.threshold) and not quiet:
                self._fired[r.name] = now
                out.append(r.name)
        return out


#: A step of more than five seconds is slow.
SLOW_STEP = AlertRule("slow_step", "step_seconds", "gt", 5.0)
