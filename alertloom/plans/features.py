"""Events -> the window feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from alertloom.config import DEFAULT_WINDOWS, NOVELTY_SECONDS, WindowSpec
from alertloom.operators.derived import derived_features, fill_and_clip
from alertloom.operators.novelty import novelty_features
from alertloom.operators.rolling import rolling_baseline
from alertloom.operators.windows import window_features


def feature_table(events: DataFrame, windows: Sequence[WindowSpec] = DEFAULT_WINDOWS,
                  timestamp_col: str = "timestamp", memory: DataFrame | None = None,
                  clip: str = "reference", lookback: int = 60) -> DataFrame:
    """One row per ``window_start`` with every feature column, NULLs filled and ratios clipped.

    Plan shape: one scan of the events feeds (a) the multi-size window aggregate (one final
    shuffle on ``window_start``) and (b) the novelty aggregates; the window table (bounded by the
    time span, not by the event volume) is then rolled in row chunks and joined with novelty.
    """
    wf = window_features(events, windows, timestamp_col)
    rolled = rolling_baseline(wf, lookback=lookback)
    ents = [e for e in ("dst_ip", "dst_port") if e in events.columns]
    if ents:
        nov = novelty_features(events, timestamp_col, NOVELTY_SECONDS, ents, memory)
        rolled = rolled.join(nov, "window_start", "left")
    return fill_and_clip(derived_features(rolled), clip)
