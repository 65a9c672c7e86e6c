"""Typed engine events as a stream: routing to listeners, rules on streams, running counts."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrule.operators.rules import CompiledRule

# The event types.
TYPES = ("COMPILATION_STARTED", "COMPILATION_COMPLETED", "EXECUTION_STARTED", "EXECUTION_COMPLETED", "CACHE_HIT", "CACHE_MISS", "CLASS_LOADED", "CLASS_UNLOADED")
SCHEMA = "type string, rule_name string, ts timestamp, payload map<string,string>"
log = logging.getLogger(__name__)


class EventBus:
    """Listeners by event type, called with each micro-batch's events of that type, in the order they subscribed.

    A listener gets a DataFrame, so its work is distributed; one that fails is logged and hinders no other.
    """

    def __init__(self):
        self.listeners: dict[str, list[Callable[[DataFrame, int], None]]] = defaultdict(list)
        self.queries: list[StreamingQuery] = []

    def subscribe(self, kind: str, listener: Callable[[DataFrame, int], None]) -> None:
        self.listeners[kind].append(listener)

    def unsubscribe(self, kind: str, listener: Callable[[DataFrame, int], None]) -> None:
        if listener in self.listeners[kind]:
            self.listeners[kind].remove(listener)

    def publish(self, events: DataFrame, batch: int = 0) -> None:
        wanted = [(k, ls) for k, ls in self.listeners.items() if ls]
        if len(wanted) > 1 or any(len(ls) > 1 for _, ls in wanted):
            events = events.persist()
        try:
            for kind, listeners in wanted:
                own = events.where(F.col("type") == kind)
                for listener in list(listeners):
                    try:
                        listener(own, batch)
                    except Exception:  # noqa: BLE001  listeners are isolated from each other
                        log.exception("listener for %s failed", kind)
        finally:
            events.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.publish).option("checkpointLocation", checkpoint)
        query = writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
        self.queries.append(query)
        return query

    def close(self) -> None:
        for q in self.queries:
            q.processAllAvailable() if q.isActive else None
            q.stop()


def apply_rule_stream(stream: DataFrame, rule: CompiledRule, binding: dict[str, str] | None = None, name: str = "outcome") -> DataFrame:
    """The batch operator on a stream: a projection, so it is stateless and exactly the same."""
    return stream.select("*", rule.result(stream, binding).alias(name))


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts by tumbling window and type; late events are dropped after the watermark, so state is bounded."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
