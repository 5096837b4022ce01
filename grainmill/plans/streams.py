"""The windowed sums of events: the batch form, which the stream's equals."""

from __future__ import annotations

from ..streaming.ingest import windowed
from .registry import query, table
from .scores import rounded


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value),6) AS total FROM events GROUP BY 1,2")
def ext_windowed_events(s, d):
    return rounded(windowed(table(s, d, "events")))
