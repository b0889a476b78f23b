"""Steps of a job: one that fails holds up only those that need it."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Step:
    """``run`` gets the results of the steps done so far by name; ``needs`` names the steps whose results it can't do without."""

    name: str
    run: Callable[[dict[str, Any]], Any]
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outcome:
    name: str
    state: str  # done, failed or skipped
    seconds: float = 0.0
    error: str | None = None


def run_steps(steps: Iterable[Step]) -> list[Outcome]:
    """Runs steps in their order. A failing step is noted and logged; steps that need it, directly or not, are skipped, the rest go on."""
    results: dict[str, Any] = {}
    outcomes: list[Outcome] = []
    for step in steps:
        if any(need not in results for need in step.needs):
            outcomes.append(Outcome(step.name, "skipped"))
            continue
        began = time.monotonic()
        try:
            results[step.name] = step.run(results)
            outcomes.append(Outcome(step.name, "done", time.monotonic() - began))
        except Exception as error:  # whatever a step raises is its own affair
            logging.getLogger(__name__).warning("step %s failed: %s", step.name, error)
            outcomes.append(Outcome(step.name, "failed", time.monotonic() - began, str(error)))
    return outcomes
