"""Plan and timing capture, to compare a query before and after a change."""

from __future__ import annotations

import io
import statistics
import time
from contextlib import redirect_stdout
from dataclasses import dataclass

from pyspark.sql import DataFrame


def plan_text(frame: DataFrame) -> str:
    """The formatted physical plan."""
    text = io.StringIO()
    with redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


def plan_nodes(frame: DataFrame, name: str) -> int:
    """How many operators of the physical plan have this name."""
    tree = plan_text(frame).split("\n\n")[0]
    return sum(line.lstrip("* :+-").startswith(name + " ") for line in tree.splitlines())


@dataclass(frozen=True)
class Measurement:
    seconds: float
    scans: int
    exchanges: int
    plan: str


def measure(frame: DataFrame, runs: int = 3) -> Measurement:
    """Median time of full runs whose rows are computed and then dropped."""
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return Measurement(
        seconds=statistics.median(times),
        scans=plan_nodes(frame, "Scan"),
        exchanges=plan_nodes(frame, "Exchange"),
        plan=plan_text(frame),
    )
