"""Supersteps: a state frame is replaced round by round, its lineage cut in shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quillgraph.plans.staging import cut, drop


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, until: Callable[[DataFrame, DataFrame], bool] | None = None, every: int = 3, label: str = "loop") -> DataFrame:
    """``step`` applied up to ``rounds`` times; stops when ``until(old, new)`` says so.

    The state is written to the shared folder every few rounds (each round, if there is a stop test, so
    that the test doesn't compute the round twice).
    """
    written = None  # the last state in storage; what the caller gave is never deleted
    for k in range(rounds):
        new = step(state, k)
        if until is not None or (k + 1) % every == 0:
            new = cut(new, label)
            done = until is not None and until(state, new)
            if written is not None:
                drop(written)
            if done:
                return new
            written = new
        state = new
    return state
