"""Application states folded from ordered actions, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp
from ..params import MAX_SCALE, MIN_SCALE

STATE = "scale double, points int"


def _step(state: Column, a: Column) -> Column:
    """An action sets the clamped scale and adds a point, undoes one or clears all."""
    n = state["points"]
    points = F.when(a["action"] == "add", n + 1).when(a["action"] == "undo", F.greatest(n - 1, F.lit(0))).when(a["action"] == "clear", F.lit(0)).otherwise(n)
    scale = F.when(a["scale"].isNotNull(), clamp(a["scale"], MIN_SCALE, MAX_SCALE)).otherwise(state["scale"])
    return F.struct(scale.alias("scale"), points.alias("points"))


def fold_states(actions: DataFrame, key: str) -> DataFrame:
    """(key, scale, points): the final state of each key's actions (key, seq,
    action, scale) in order of seq."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "action", "scale")))
    start = F.struct(F.lit(1.0).alias("scale"), F.lit(0).alias("points"))
    return actions.groupBy(key).agg(F.aggregate(ordered, start, _step).alias("s")).select(key, "s.*")


def stream_states(actions: DataFrame, key: str) -> DataFrame:
    """The same fold over a stream of actions (key string, seq, action,
    scale): each trigger gives the new state of the keys that it touched."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(ident: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scale, points = state.get if state.exists else (1.0, 0)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for action, new in zip(rows.action, rows.scale):
            if pd.notna(new):
                scale = min(MAX_SCALE, max(MIN_SCALE, float(new)))
            points = {"add": points + 1, "undo": max(0, points - 1), "clear": 0}.get(action, points)
        state.update((scale, points))
        yield pd.DataFrame({key: [ident[0]], "scale": [scale], "points": [points]})

    return actions.groupBy(key).applyInPandasWithState(
        update, f"{key} string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout
    )
