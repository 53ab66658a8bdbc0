"""Live completeness of a run: each image's expected cells are kept as state, closed when full, reported when overdue.

The rows of an image arrive in any order, over any number of batches and restarts. A guard, the fingerprint of the
protocol and its settings, keeps rows of another run out. State is one entry for each cell that an image has, and
it is dropped when the image's time is over, so it is bounded by the images in progress.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

REPORT = "image string, status string, cell string, n_cells int, missing array<string>"


class Progress(StatefulProcessor):
    """The state of one image: cells seen, the latest time at which it may be full, and whether it is.

    Reports: complete (all cells are there, once); overdue (the time passed, with the missing cells); foreign (another
    guard), unexpected (no such cell) and repeated (a cell that is there already), none of which counts as a cell.
    """

    def __init__(self, cells: Sequence[str], guard: str, overdue_ms: int):
        self.cells, self.guard, self.overdue_ms = sorted(cells), guard, overdue_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "cell string", "rows long")
        self.about = handle.getValueState("about", "due long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["time", "cell"])
        reports = []
        about = self.about.get() if self.about.exists() else None
        have = {k[0] for k in self.seen.keys()} if about is not None else set()
        for guard, cell, time in zip(frame.guard, frame.cell, frame.time, strict=True):
            if guard != self.guard:
                reports.append(("foreign", cell))
            elif cell not in self.cells:
                reports.append(("unexpected", cell))
            elif cell in have:
                reports.append(("repeated", cell))
            else:
                self.seen.updateValue((cell,), (1,))
                have.add(cell)
                if about is None:
                    about = (int(time.timestamp() * 1000) + self.overdue_ms, False)
                    self.handle.registerTimer(about[0])
        if about is not None and not about[1] and len(have) == len(self.cells):
            about = (about[0], True)
            reports.append(("complete", None))
        if about is not None:
            self.about.update(about)
        yield self._told(key, reports, have)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed = self.about.get()[1] if self.about.exists() else True
        have = {k[0] for k in self.seen.keys()}
        self.seen.clear()
        self.about.clear()
        yield self._told(key, [] if closed else [("overdue", None)], have)

    def _told(self, key, reports: list[tuple], have: set[str]) -> pd.DataFrame:
        missing = [c for c in self.cells if c not in have]
        rows = [(key[0], status, cell, len(have), missing if status == "overdue" else []) for status, cell in reports]
        return pd.DataFrame(rows, columns=["image", "status", "cell", "n_cells", "missing"])

    def close(self) -> None:
        pass


def live_completeness(rows: DataFrame, cells: Sequence[str], guard: str, late: str = "10 minutes", overdue_ms: int = 3_600_000) -> DataFrame:
    """A stream of rows(image, cell, guard, time) -> REPORT. cells is the protocol, the same few for every image.

    An image whose cells aren't all there overdue_ms after its first row's time is reported once and forgotten.
    """
    keep_state_on_disk(rows.sparkSession)
    given = rows.select(F.col("image").cast("string").alias("image"), "cell", "guard", F.col("time").cast("timestamp").alias("time")).withWatermark("time", late)
    return given.groupBy("image").transformWithStateInPandas(statefulProcessor=Progress(cells, guard, overdue_ms), outputStructType=REPORT, outputMode="Append", timeMode="EventTime")


def keep_state_on_disk(spark: SparkSession) -> None:
    """State with timers needs the state store that spills; its files are in the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the reports to Parquet, exactly once, until the input is used up."""
    return reports.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
