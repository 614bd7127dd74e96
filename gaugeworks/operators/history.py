"""Undo and redo over a log of edits, and versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequential import folded


def replay(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``log`` (key, order, action, state) with (current, n_undo, n_redo) after each row.

    ``push`` makes ``state`` current and forgets what could be redone, unless it is the current state; ``undo`` and
    ``redo`` go one step back and forth as far as there is one. The first push is where undoing ends.
    """

    def step(known, row):
        past, future = known or ([], [])
        action, state = row
        if action == "push" and (not past or past[-1] != state):
            past, future = [*past, state], []
        elif action == "undo" and len(past) > 1:
            past, future = past[:-1], [*future, past[-1]]
        elif action == "redo" and future:
            past, future = [*past, future[-1]], future[:-1]
        return (past, future), (past[-1] if past else None, max(len(past) - 1, 0), len(future))

    kind = dict(log.dtypes)["state"]
    return folded(log, [key], order, ["action", "state"], step, f"current {kind}, n_undo int, n_redo int")


def as_of_version(versions: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The rows of a table at a version: of each key the last row up to it, unless that one is a deletion.

    ``versions``: (keys, version, deleted, columns), a row for each change.
    """
    rest = [c for c in versions.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "version").alias("_last")
    found = versions.where(F.col("version") <= version).groupBy(*keys).agg(last).where("not _last.deleted")
    return found.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest if c not in ("version", "deleted")))
