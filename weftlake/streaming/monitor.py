"""Progress of streaming queries as events and as one state."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener


class Monitor(StreamingQueryListener):
    """Keeps the last state of each query and tells it, as one JSON document, to ``write`` whenever it changes.

    ``on_event`` gets (event, state) as they come; an error in it is kept in
    the state and doesn't end the query.
    """

    def __init__(self, write: Callable[[str], None] | None = None, on_event: Callable[[str, dict], None] | None = None) -> None:
        self.state: dict[str, dict] = {}
        self.write, self.on_event = write, on_event

    def _tell(self, event: str, query: str, **what) -> None:
        own = self.state.setdefault(query, {"rows": 0, "batches": 0})
        own |= what
        own["event"] = event
        if self.on_event:
            try:
                self.on_event(event, dict(own))
            except Exception as error:  # noqa: BLE001 - a hook isn't part of the run
                own["hook_error"] = repr(error)
        if self.write:
            self.write(json.dumps(self.state, sort_keys=True))

    def onQueryStarted(self, event) -> None:
        self._tell("started", str(event.runId), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.state.get(str(p.runId), {})
        self._tell("progress", str(p.runId), name=p.name, batches=p.batchId + 1, rows=own.get("rows", 0) + p.numInputRows, rows_per_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        self._tell("idle", str(event.runId))

    def onQueryTerminated(self, event) -> None:
        self._tell("terminated", str(event.runId), error=event.exception)
