"""Progress of running jobs through observed metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Count the rows a job produces without another pass over them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("completed")), seen


class ProgressListener(StreamingQueryListener):
    """Report rows processed by a streaming query against an expected total."""

    def __init__(self, total: int, report: Callable[[int, int], None]):
        self.total, self.done, self.report = total, 0, report

    def onQueryStarted(self, event) -> None:
        self.report(self.done, self.total)

    def onQueryProgress(self, event) -> None:
        self.done += event.progress.numInputRows
        self.report(min(self.done, self.total), self.total)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
