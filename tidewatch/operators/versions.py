"""Attributes as known at event time.

A change becomes usable on the later of its validity date and its release date. Changes are first reduced to one best
change per (key, day it becomes usable); events to their distinct (key, day). Both sides are then bounded by keys x
days of the calendar, so a key holding a third of all rows is still a few thousand days. They are co-grouped by key:
the running best over the sorted change days is a step function, and a vectorised binary search finds the step at
every event day. The answer joins back to the events on (key, day), where AQE splits a hot day.

Defined cases: changes without validity or release date never count; a change with a null value counts; a key or event
day that is null, or has no earlier change, gives no row; ties are broken by the caller's order of precedence.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _search(key: tuple, steps: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    if not len(steps) or not len(asked):
        return pd.DataFrame({"k": [], "day": [], "chosen": []}).astype({"k": "str", "day": "int32", "chosen": "str"})
    steps = steps.sort_values("usable", kind="stable")
    # rank of each step's precedence; its running maximum names the best step so far
    by = [c for c in steps.columns if c.startswith("p_")]
    order = steps.reset_index(drop=True).sort_values(by, kind="stable").index.to_numpy()
    rank = np.empty(len(steps), dtype=np.int64)
    rank[order] = np.arange(len(steps))
    best = order[np.maximum.accumulate(rank)]
    at = np.searchsorted(steps["usable"].to_numpy(), asked["day"].to_numpy(), side="right") - 1
    hit = at >= 0
    return pd.DataFrame(
        {
            "k": asked["k"].to_numpy()[hit],
            "day": asked["day"].to_numpy()[hit],
            "chosen": steps["chosen"].to_numpy()[best[at[hit]]],
        }
    )


def as_known(
    events: DataFrame,
    event_key: Column,
    event_day: Column,
    changes: DataFrame,
    change_key: Column,
    usable_from: Sequence[Column],
    precedence: Sequence[Column],
    chosen: Column,
) -> DataFrame:
    """Events joined to the best change usable by their day.

    ``usable_from``: dates that must all be no later than the event day. ``precedence``: columns, most significant
    first; larger wins. ``chosen``: the string that names the change. Adds the column ``chosen``.
    """
    epoch = F.lit("1970-01-01").cast("date")
    usable = F.greatest(*usable_from) if len(usable_from) > 1 else usable_from[0]
    ready = F.lit(True)
    for column in usable_from:
        ready = ready & column.isNotNull()
    names = [f"p_{i}" for i in range(len(precedence))]
    steps = (
        changes.where(ready & change_key.isNotNull())
        .select(
            change_key.alias("k"),
            F.datediff(usable, epoch).alias("usable"),
            F.struct(*(c.alias(n) for c, n in zip(precedence, names)), chosen.alias("chosen")).alias("best"),
        )
        .groupBy("k", "usable")
        .agg(F.max("best").alias("best"))
        .select("k", "usable", "best.*")
    )
    keyed = events.select("*", event_key.alias("k"), F.datediff(event_day, epoch).alias("day")).where(
        F.col("k").isNotNull() & F.col("day").isNotNull()
    )
    found = (
        keyed.select("k", "day")
        .distinct()
        .groupBy("k")
        .cogroup(steps.groupBy("k"))
        .applyInPandas(lambda key, asked, step: _search(key, step, asked), "k string, day int, chosen string")
    )
    return keyed.join(found, ["k", "day"]).drop("k", "day")
