"""Frame streams: stale and repeated frames, stability, and throttling, as batch forms and as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequential import folded, in_order


def drop_stale(frames: DataFrame, key: str, order: str, generation: str) -> DataFrame:
    """Frames whose generation is not older than the newest seen so far in their session."""
    newest = F.max(generation).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("_newest", newest).where(F.col(generation) >= F.col("_newest")).drop("_newest")


def streaks(frames: DataFrame, key: str, order: str, steady: Column) -> DataFrame:
    """Steady frames with ``streak``, how many steady frames stand together up to this one."""
    w = Window.partitionBy(key).orderBy(order)
    marked = frames.withColumn("_steady", F.coalesce(steady, F.lit(False))).withColumn("_breaks", F.sum((~F.col("_steady")).cast("int")).over(w))
    streak = F.row_number().over(Window.partitionBy(key, "_breaks").orderBy(order))
    return marked.where("_steady").withColumn("streak", streak).drop("_steady", "_breaks")


def latest(requests: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last request of each document."""
    best = F.max(F.struct(order, *columns)).alias("r")
    return requests.groupBy(key).agg(best).select(key, f"r.{order}", *(f"r.{c}" for c in columns))


def throttled(frames: DataFrame, key: str, time: str, order: str, every: str) -> DataFrame:
    """The first frame of each interval of a session."""
    return frames.groupBy(key, F.window(F.col(time).cast("timestamp"), every).alias("w")).agg(F.min(order).alias(order))


def stacked(frames: DataFrame, key: str, order: str, least_light: float, least_sharpness: float) -> DataFrame:
    """Frames (light, sharpness) with (accepted, n_accepted, best): whether each differs from the last accepted one by
    ``least_light`` or ``least_sharpness``, how many were accepted so far, and the sharpest of them."""

    def step(state, row):
        light, sharp, n, best = state or (None, 0.0, 0, float("-inf"))
        if light is not None and abs(row[0] - light) < least_light and abs(row[1] - sharp) < least_sharpness:
            return (light, sharp, n, best), (False, n, best)
        best = max(best, row[1])
        return (row[0], row[1], n + 1, best), (True, n + 1, best)

    return folded(frames, [key], [order], ["light", "sharpness"], step, "accepted boolean, n_accepted int, best double")


def reports(frames: DataFrame, key: str, order: str, time: str, every: int) -> DataFrame:
    """Frames that a report is made at: the first, and each that comes ``every`` or more after the last report."""

    def decide(last, row):
        return (row[0], True) if last is None or row[0] - last >= every else (last, False)

    return in_order(frames, [key], [order], [time], decide)


def without_cancelled(requests: DataFrame, cancelled: DataFrame, keys: list[str]) -> DataFrame:
    """Requests of documents that are not in the cancellation set."""
    return requests.join(cancelled.select(*keys).distinct(), keys, "left_anti")


def running_counters(rejected: DataFrame, key: str, order: str, reason: str) -> DataFrame:
    """Rejected frames with ``n``, how many of their session were rejected for the same reason so far."""
    w = Window.partitionBy(key, reason).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rejected.withColumn("n", F.count(F.lit(1)).over(w))


def accept_changed(frames: DataFrame, least_change: float = 1.2, least_sharpness: float = 0.03) -> DataFrame:
    """Streaming: frames (session_id, seq, sharpness, pixels) that differ from the last accepted one.

    A frame repeats when its mean absolute difference is below ``least_change`` and its sharpness is within
    ``least_sharpness`` of the last accepted frame's. State: that frame. Emits (session_id, seq, accepted, n_accepted).
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sharp, n = state.get if state.exists else (None, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, sharpness, pixels in rows[["seq", "sharpness", "pixels"]].itertuples(index=False, name=None):
            accepted = True
            if last is not None and len(last) == len(pixels):
                a, b = np.frombuffer(last, np.uint8).astype(np.int16), np.frombuffer(pixels, np.uint8).astype(np.int16)
                same_light = abs(sharpness - sharp) < least_sharpness * max(abs(sharp), 1e-9)
                accepted = not (float(np.abs(a - b).mean() if len(a) else 0.0) < least_change and same_light)
            if accepted:
                last, sharp, n = bytes(pixels), float(sharpness), n + 1
            out.append((key[0], seq, accepted, n))
        state.update((last, sharp, n))
        yield pd.DataFrame(out, columns=["session_id", "seq", "accepted", "n_accepted"])

    return frames.groupBy("session_id").applyInPandasWithState(
        run, "session_id string, seq long, accepted boolean, n_accepted long", "last binary, sharp double, n long", "append", GroupStateTimeout.NoTimeout
    )


def gate_stable(motions: DataFrame, short_side: float, least_response: float = 0.015, least_streak: int = 2) -> DataFrame:
    """Streaming: (session_id, seq, dx, dy, response) with whether the view stands still.

    A frame is steady when it moved by at most max(2, 0.5 % of the short side) and its response is high enough;
    the view is stable from the second steady frame on. A stable view forgives a weak response while it moves by no more
    than 0.55 of that. State: generation and streak; stale generations are dropped.
    """
    step = _gate(short_side, least_response, least_streak)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, out = state.get if state.exists else None, []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            known, (streak, stable) = step(known, (row.generation, row.dx, row.dy, row.response))
            if stable is not None:
                out.append((key[0], row.seq, streak, stable))
        state.update(known)
        yield pd.DataFrame(out, columns=["session_id", "seq", "streak", "stable"])

    return motions.groupBy("session_id").applyInPandasWithState(
        run, "session_id string, seq long, streak int, stable boolean", "newest long, streak int", "append", GroupStateTimeout.NoTimeout
    )


def _gate(short_side: float, least_response: float, least_streak: int):
    reach = max(2.0, 0.005 * short_side)

    def step(state, row):
        newest, streak = state or (-1, 0)
        generation, dx, dy, response = row
        if generation < newest:
            return (newest, streak), (0, None)
        if generation > newest:
            newest, streak = int(generation), 0
        moved = float(np.hypot(dx, dy))
        steady = moved <= reach and response >= least_response or streak >= least_streak and moved <= 0.55 * reach
        streak = streak + 1 if steady else 0
        return (newest, streak), (streak, streak >= least_streak)

    return step


def gated(motions: DataFrame, key: str, order: str, short_side: float, least_response: float = 0.015, least_streak: int = 2) -> DataFrame:
    """As :func:`gate_stable`, of all rows of a table."""
    step = _gate(short_side, least_response, least_streak)
    found = folded(motions, [key], [order], ["generation", "dx", "dy", "response"], step, "streak int, stable boolean")
    return found.where("stable is not null")


def capped_tiles(frames: DataFrame, keys: list[str], order: str, most: int = 3) -> DataFrame:
    """(keys, kept, excess, last): how many frames each tile keeps and how many come too late."""
    n = F.count(F.lit(1))
    # the first few frames of a tile are the smallest of each partial list
    first = F.slice(F.sort_array(F.collect_list("_first")), 1, most)
    parts = frames.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(8)))
    ranked = parts.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)))
    few = ranked.withColumn("_first", F.when(F.col("_place") <= most, F.col(order))).groupBy(*keys).agg(n.alias("_n"), first.alias("_kept"))
    return few.select(*keys, F.size("_kept").alias("kept"), (F.col("_n") - F.size("_kept")).alias("excess"), F.element_at("_kept", -1).alias("last"))


def ready_to_finish(sessions: DataFrame, key: str, tile: str, edge: str) -> DataFrame:
    """Sessions with two tiles and an edge between tiles, at least."""
    found = sessions.groupBy(key).agg(F.count_distinct(tile).alias("tiles"), F.count(edge).alias("edges"))
    return found.where("tiles >= 2 and edges >= 1")


def fused(pixels: DataFrame, keys: list[str], value: str, sharpness: str, order: str) -> DataFrame:
    """Of each pixel the value in the frame where it is sharpest; the earliest frame on a tie."""
    return pixels.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(sharpness), -F.col(order))).alias(value))


def build_tiles(
    motions: DataFrame, short_side: float, least_response: float = 0.015, least_streak: int = 2, most_frames: int = 3, least_match: float = 0.5
) -> DataFrame:
    """Streaming: the tile map of a moving view. Rows: session_id, seq, x, y (where the view is), response, match.

    A tile starts once the view stands still, takes ``most_frames`` frames, and is frozen when the view has moved
    max(6, 1.5 % of the short side) from where it began; coming back within 0.65 of that takes the move back. When
    the view stands still at the new place, the tile there is committed if its registration (``match``, made
    before) is good enough, else rejected. Emits (session_id, seq, state, tile, n_frames): state is moving,
    settling, sampling, tile_full, tile_committed or candidate_rejected.
    """
    step = _tiles(short_side, least_response, least_streak, most_frames, least_match)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, out = state.get if state.exists else None, []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            known, new = step(known, (row.x, row.y, row.response, row.match))
            out.append((key[0], row.seq, *new))
        state.update(known)
        yield pd.DataFrame(out, columns=["session_id", "seq", "state", "tile", "n_frames"])

    shape = "last_x double, last_y double, streak int, tile int, x0 double, y0 double, n int, leaving boolean"
    return motions.groupBy("session_id").applyInPandasWithState(
        run, "session_id string, seq long, state string, tile int, n_frames int", shape, "append", GroupStateTimeout.NoTimeout
    )


def _tiles(short_side: float, least_response: float, least_streak: int, most_frames: int, least_match: float):
    still, freeze = max(2.0, 0.005 * short_side), max(6.0, 0.015 * short_side)

    def step(state, row):
        last_x, last_y, streak, tile, x0, y0, n, leaving = state or (None, None, 0, 0, 0.0, 0.0, 0, False)
        x, y, response, match = row
        moved = 0.0 if last_x is None else float(np.hypot(x - last_x, y - last_y))
        # inside a tile a weak response is forgiven when the view hardly moved
        steady = moved <= still and response >= least_response or n > 0 and not leaving and moved <= 0.55 * still
        streak = streak + 1 if steady else 0
        last_x, last_y = float(x), float(y)
        away = float(np.hypot(x - x0, y - y0)) if n else 0.0
        if n and away <= 0.65 * freeze:
            leaving = False
        if n and away >= freeze and not leaving:
            leaving, streak = True, int(steady)
        if streak < least_streak:
            name = "settling" if streak else "moving"
        elif not n:
            tile, x0, y0, n, name = tile + 1, last_x, last_y, 1, "sampling"
        elif leaving and match >= least_match:
            tile, x0, y0, n, leaving, name = tile + 1, last_x, last_y, 1, False, "tile_committed"
        elif leaving:
            streak, name = 0, "candidate_rejected"
        elif n < most_frames:
            n, name = n + 1, "sampling"
        else:
            name = "tile_full"
        return (last_x, last_y, streak, tile, x0, y0, n, leaving), (name, tile, n)

    return step


def tiles(
    motions: DataFrame, key: str, order: str, short_side: float, least_response: float = 0.015, least_streak: int = 2, most_frames: int = 3, least_match: float = 0.5
) -> DataFrame:
    """As :func:`build_tiles`, of all rows of a table."""
    step = _tiles(short_side, least_response, least_streak, most_frames, least_match)
    return folded(motions, [key], [order], ["x", "y", "response", "match"], step, "state string, tile int, n_frames int")
