"""Runs that tell how far they are and can be called off: over streams, and over tables.

A run's result appears whole or not at all. Each micro-batch, or the one table of a run over tables, is written beside its place
and moved there when it is complete; what a run that was called off has not completed is deleted. Back-pressure is the
source's own (``maxFilesPerTrigger`` and the like): a micro-batch is not read before the last one is done.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class _Folder:
    """A folder in which tables appear whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        self._system = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def publish(self, df: DataFrame, beside: str, place: str) -> None:
        """Write ``df`` under a name that readers pass over, then move it to its place, instead of what was there."""
        df.write.mode("overwrite").parquet(beside)
        self._system.mkdirs(self._at(place).getParent())
        self.drop(place)
        if not self._system.rename(self._at(beside), self._at(place)):
            raise OSError(f"{beside} could not be moved to {place}")

    def drop(self, path: str) -> None:
        self._system.delete(self._at(path), True)


class _Counting(StreamingQueryListener):
    def __init__(self, run: StreamRun):
        self.run = run

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) == self.run.query_id and p.numInputRows:
            self.run.batches[p.batchId] = p.numInputRows

    def onQueryTerminated(self, event) -> None: ...


class StreamRun:
    """A stream of frames through ``step`` (a DataFrame to a DataFrame) into ``path``, one folder for each micro-batch.

    ``frames`` counts those of completed micro-batches. A run that was aborted goes on where it stopped when a new one is started with the
    same checkpoint.
    """

    def __init__(self, frames: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
        self.spark, self.path = frames.sparkSession, path
        self.batches: dict[int, int] = {}
        self._folder = _Folder(self.spark, path)
        self._beside = f"{path}/_run-{uuid.uuid4().hex}"

        def put(batch: DataFrame, number: int) -> None:
            self._folder.publish(step(batch), f"{self._beside}/{number}", f"{path}/batch={number}")

        self._writer = frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        self.query: StreamingQuery | None = None
        self.query_id = ""

    @property
    def frames(self) -> int:
        return sum(self.batches.values())

    def start(self, **trigger) -> StreamRun:
        self._listener = _Counting(self)
        self.spark.streams.addListener(self._listener)
        self.query = self._writer.trigger(**(trigger or {"availableNow": True})).start()
        self.query_id = str(self.query.id)
        return self

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the run is over; its error, if it had one, is raised."""
        over = self.query.awaitTermination(seconds) if seconds is not None else (self.query.awaitTermination() or True)
        if over:
            self._end()
        return bool(over)

    def abort(self) -> None:
        """Stop, cancel what is running, and delete what is not complete."""
        self.query.stop()
        self._end()

    def _end(self) -> None:
        for p in self.query.recentProgress:  # the last ones may not have been heard of yet
            if p["numInputRows"]:
                self.batches[p["batchId"]] = p["numInputRows"]
        self.spark.streams.removeListener(self._listener)
        self._folder.drop(self._beside)


class TableRun:
    """A table written to ``path`` by jobs of a group of its own, which can be cancelled while they run.

    ``progress`` is the share of tasks that are done; ``frames``, when the run is over, the rows that were written, observed on their way.
    """

    def __init__(self, df: DataFrame, path: str):
        self.spark, self.path = df.sparkSession, path
        self.group = f"run-{uuid.uuid4().hex}"
        self._seen = Observation(self.group)
        self._df = df.observe(self._seen, F.count(F.lit(1)).alias("frames"))
        self._folder = _Folder(self.spark, path)
        self._beside = f"{path.rstrip('/').rsplit('/', 1)[0]}/_{self.group}"
        self.error: BaseException | None = None
        self.aborted = threading.Event()
        self._thread = InheritableThread(target=self._run)

    def start(self) -> TableRun:
        self._thread.start()
        return self

    def _run(self) -> None:
        self.spark.sparkContext.setJobGroup(self.group, f"write {self.path}", interruptOnCancel=True)
        try:
            self._folder.publish(self._df, self._beside, self.path)
        except BaseException as e:  # told to whoever waits
            self.error = e

    def progress(self) -> float:
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in map(tracker.getStageInfo, info.stageIds if info else ()):
                if stage:
                    done, total = done + stage.numCompletedTasks, total + stage.numTasks
        return done / total if total else 0.0

    @property
    def frames(self) -> int:
        return self._seen.get["frames"]

    def abort(self) -> None:
        """Cancel the run's jobs; nothing appears at its place, and what it has written beside is deleted."""
        self.aborted.set()
        while self._thread.is_alive():  # jobs that begin after the call are cancelled too
            self.spark.sparkContext.cancelJobGroup(self.group)
            self._thread.join(0.2)
            time.sleep(0)
        self._folder.drop(self._beside)

    def wait(self) -> None:
        """Until the run is over; its error, if it had one, is raised."""
        self._thread.join()
        if self.error is not None:
            self._folder.drop(self._beside)
            if not self.aborted.is_set():
                raise self.error
