"""Health of streaming queries as a table: a listener on the driver keeps one small file per
run, replaced at each event, with the run's progress, lag and last error."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = (
    "run_id string, query_id string, name string, state string, started_at string, changed_at string, batches long, last_batch long, "
    "rows long, rows_per_second double, batch_ms long, watermark string, behind_s double, error string"
)


def _seconds(stamp: str) -> float:
    return datetime.fromisoformat(stamp.replace("Z", "+00:00")).timestamp()


class HealthListener(StreamingQueryListener):
    """``behind_s``: how long before the last batch began its watermark lies, if there is one."""

    def __init__(self, path: str):
        self.path = path
        self.runs: dict[str, dict] = {}

    def _keep(self, run_id, **changes) -> None:
        run = self.runs.setdefault(str(run_id), {"run_id": str(run_id), "batches": 0, "rows": 0})
        run |= changes | {"changed_at": datetime.now(timezone.utc).isoformat()}
        files, base = fs.FileSystem.from_uri(self.path)
        files.create_dir(base, recursive=True)
        aside = f"{base}/.{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write((json.dumps(run) + "\n").encode())
        files.move(aside, f"{base}/{run_id}.json")

    def onQueryStarted(self, event) -> None:
        self._keep(event.runId, query_id=str(event.id), name=event.name, state="running", started_at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p, run = event.progress, self.runs.get(str(event.progress.runId), {})
        watermark = p.eventTime.get("watermark")
        self._keep(
            p.runId, query_id=str(p.id), name=p.name, state="running", batches=run.get("batches", 0) + 1, last_batch=p.batchId, rows=run.get("rows", 0) + p.numInputRows,
            rows_per_second=p.processedRowsPerSecond if p.processedRowsPerSecond == p.processedRowsPerSecond else None, batch_ms=p.batchDuration, watermark=watermark,
            behind_s=_seconds(p.timestamp) - _seconds(watermark) if watermark else None,
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._keep(event.runId, state="failed" if event.exception else "stopped", error=event.exception)
        self.runs.pop(str(event.runId), None)


def watch(spark: SparkSession, path: str) -> HealthListener:
    """Keep the health of all queries of this session under ``path`` from now on."""
    listener = HealthListener(path)
    spark.streams.addListener(listener)
    return listener


def health(spark: SparkSession, path: str) -> DataFrame:
    """One row of SCHEMA for each run that was watched."""
    return spark.read.schema(SCHEMA).json(path)
