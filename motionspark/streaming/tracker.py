"""Association and tracking as streams: state by clip, the same steps as in batch.

A frame that comes after later ones of its clip have been taken is late and left out; frames that come ahead of
others within a batch are put in order first. No time-out is needed, as lost things are counted in frames.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tracker as rasters
from ..operators.tracking import GATE, Association

OUTPUT = "clip_id long, frame int, cand_idx int, x double, y double, track int"


def associate_stream(candidates: DataFrame, gate: float = GATE) -> DataFrame:
    """Rows of OUTPUT from a stream of candidates (clip_id, frame, cand_idx, x, y).

    A frame's candidates arrive together and frames in order, as a capture emits them; live tracks are kept
    between batches and die by the count of frames they miss, so no time-out is needed.
    """

    def clip(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["frame", "cand_idx"])
        tracker = Association(json.loads(state.get[0]) if state.exists else None, gate)
        rows = rows.assign(track=tracker.run(rows))
        state.update((json.dumps(tracker.state()),))
        yield rows[["clip_id", "frame", "cand_idx", "x", "y", "track"]]

    return candidates.groupBy("clip_id").applyInPandasWithState(clip, OUTPUT, "tracks string", "append", GroupStateTimeout.NoTimeout)


def track_stream(seen: DataFrame, mat: tuple[float, float, float, float], h: list[float] | None = None) -> DataFrame:
    """Rows of TRACKED from a stream of sightings (rows of SEEN), as ``tracker.track`` gives them in batch."""
    names = [c.split()[0] for c in rasters.TRACKED.split(", ")]

    def clip(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"last": -1, "tracker": None}
        tracker, out = rasters.Tracker(mat, h, state=held["tracker"]), []
        for r in pd.concat(list(frames)).sort_values("frame").itertuples():
            if r.frame > held["last"]:
                out.append(rasters.tracked_row(r.clip_id, r.frame, r.t, *tracker.step([dict(b) for b in r.balls], [dict(m) for m in r.marks])))
                held["last"] = int(r.frame)
        state.update((json.dumps({"last": held["last"], "tracker": tracker.state}),))
        yield pd.DataFrame(out, columns=names).astype({"bn": "Int32"})

    rows = seen.select("clip_id", "frame", "t", "balls", "marks")
    return rows.groupBy("clip_id").applyInPandasWithState(clip, rasters.TRACKED, "state string", "append", GroupStateTimeout.NoTimeout)
