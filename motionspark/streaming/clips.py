"""Clips as they come in: frames put in order of presentation, tracked, and finished once when their clip ends.

Frames arrive in the order they were decoded. A clip's state holds those that may still be overtaken: a frame is taken when
the latest time of presentation that the clip has shown lies ``delay`` seconds after it. A clip ends with a row whose ``last``
is true, or when nothing of it has come for ``idle`` seconds; its rows then leave the state together, and the second pass,
the same code as in batch, runs over the clips that a micro-batch has closed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import tracker

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = f"{tracker.TRACKED}, balls array<{tracker.BALL}>, late long, ended boolean"
_NAMES = [c.split()[0] for c in tracker.TRACKED.split(", ")]
_BALL = ("cand_idx", "x", "y", "n", "fill", "w", "h")
#: Rows of a closed clip that leave the state at a time.
ROWS = 5_000


class ClipEnds(StatefulProcessor):
    """State by clip: the tracker, the frames that wait for their turn, and what has been taken."""

    def __init__(self, mat: tuple[float, float, float, float], h: list[float] | None, delay: float, idle: float):
        self.mat, self.h, self.delay, self.idle = mat, h, delay, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", "state string")
        self.taken = handle.getListState("taken", "row string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.clip.get()[0]) if self.clip.exists() else {"tracker": None, "waiting": [], "last": None, "late": 0, "ends": False, "closed": False}
        for f in rows:
            for r in f.itertuples():
                if s["closed"] or (s["last"] is not None and (r.t, r.frame) <= tuple(s["last"])):
                    s["late"] += 1  # what came before it has been acted upon
                    continue
                s["ends"] = s["ends"] or bool(r.last)
                s["waiting"].append({"frame": int(r.frame), "t": float(r.t), "balls": [[b[c] for c in _BALL] for b in map(_fields, r.balls)], "marks": [dict(_fields(m)) for m in r.marks]})
        if not s["closed"]:
            self._take(s, key[0])
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            if s["ends"]:
                yield from self._close(s, key[0], True)
            else:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        self.clip.update((json.dumps(s),))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = json.loads(self.clip.get()[0])
        if not s["closed"]:
            s["ends"] = True
            self._take(s, key[0])
            yield from self._close(s, key[0], False)
            self.clip.update((json.dumps(s),))

    def _take(self, s: dict, clip_id: int) -> None:
        """Track the frames that nothing can overtake any more, in order of presentation; of a frame that repeats the first that came."""
        waiting = sorted(s["waiting"], key=lambda w: (w["t"], w["frame"]))
        upto = waiting[-1]["t"] - self.delay if waiting else 0.0
        follow, keep = tracker.Tracker(self.mat, self.h, state=s["tracker"]), []
        for w in waiting:
            if not s["ends"] and w["t"] > upto:
                keep.append(w)
            elif s["last"] is None or (w["t"], w["frame"]) > tuple(s["last"]):
                found = follow.step([dict(zip(_BALL, b)) for b in w["balls"]], w["marks"])
                self.taken.appendValue((json.dumps([*tracker.tracked_row(clip_id, w["frame"], w["t"], *found)[1:], w["balls"]]),))
                s["last"] = [w["t"], w["frame"]]
            else:
                s["late"] += 1
        s["waiting"], s["tracker"] = keep, follow.state

    def _close(self, s: dict, clip_id: int, ended: bool) -> Iterator[pd.DataFrame]:
        out = []
        for (row,) in self.taken.get():
            *values, balls = json.loads(row)
            out.append((clip_id, *values, [dict(zip(_BALL, b)) for b in balls], s["late"], ended))
            if len(out) == ROWS:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        self.taken.clear()
        s.update(waiting=[], tracker=None, closed=True)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*_NAMES, "balls", "late", "ended"]).astype({"bn": "Int32", "frame": "int32", **{c: float for c in _NAMES if c not in ("clip_id", "frame", "bn")}})

    def close(self) -> None:
        pass


def _fields(thing) -> dict:
    return thing.asDict() if hasattr(thing, "asDict") else dict(thing)


def closed_clips(seen: DataFrame, mat: tuple[float, float, float, float], h: list[float] | None = None, delay: float = 0.25, idle: float = 60.0) -> DataFrame:
    """Rows of CLOSED from a stream of sightings (rows of SEEN with ``last``, a boolean): a clip's tracked frames, all at once when it ends.

    ``late``: frames that came after later ones had been taken, left out as the tracker cannot go back; ``ended``: false if the clip was
    closed for want of frames. What comes after a clip's end is not taken. Needs the RocksDB state store (PROVIDER).
    """
    rows = seen.select("clip_id", "frame", "t", "balls", "marks", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("clip_id").transformWithStateInPandas(ClipEnds(mat, h, delay, idle), CLOSED, "Append", "ProcessingTime")


def finish_stream(seen: DataFrame, path: str, mat: tuple[float, float, float, float], h: list[float], mat_width: float, **how) -> DataStreamWriter:
    """A stream writer whose query puts the observations of every clip that ends under ``path``, as ``tracker.finish`` gives them in batch.

    Each micro-batch writes a folder of its own by its number, so one that is run again overwrites itself.
    """

    def second_pass(closed: DataFrame, number: int) -> None:
        kept = closed.persist()
        if not kept.isEmpty():
            found = tracker.finish(kept.select(*_NAMES), tracker.candidates(kept, mat), mat, h, mat_width)
            found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.unpersist()

    return closed_clips(seen, mat, h, **how).writeStream.foreachBatch(second_pass)
