"""Consumer groups as a stateful stream: the machine of the batch replay behind transformWithStateInPandas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.groups import MAX_MEMBERS, REBALANCE_DELAY_MS, RESULTS, Group, Machine

_COLUMNS = [x.split(" ")[0] for x in RESULTS.split(", ")]


class GroupProcessor(StatefulProcessor):
    """State: the group as JSON. Timers of the machine become processing-time timers."""

    def __init__(self, delay_ms: int = REBALANCE_DELAY_MS, max_members: int = MAX_MEMBERS) -> None:
        self.delay_ms, self.max_members = delay_ms, max_members

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "json string")

    def _load(self, key) -> Machine:
        group = Group.load(self.state.get()[0]) if self.state.exists() else None
        return Machine(key[0], group, self.delay_ms, self.max_members)

    def _store(self, machine: Machine) -> None:
        self.state.update((machine.g.dump(),))
        due, set_ = machine.g.next_timer(), list(self.handle.listTimers())
        if due and due not in set_:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq").to_dict("records")
        machine = self._load(key)
        out = [r for e in events for r in machine.apply(_plain(e))]
        self._store(machine)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._load(key)
        out = machine.advance(expiredTimerInfo.getExpiryTimeInMs())
        self._store(machine)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        """Nothing is held open."""


def _plain(e: dict) -> dict:
    """Values as the machine takes them: numbers without pandas types, no missing values."""
    number = lambda x: 0 if x is None or x != x else int(x)
    text = lambda x: x if isinstance(x, str) else None
    return {
        "seq": number(e["seq"]), "ts_ms": number(e["ts_ms"]), "group": e["group"], "member": text(e["member"]), "event": e["event"], "generation": number(e["generation"]),
        "session_ms": number(e["session_ms"]), "protocols": list(e["protocols"]) if e["protocols"] is not None else [], "payload": text(e["payload"]),
    }


def group_results(events: DataFrame, delay_ms: int = REBALANCE_DELAY_MS, max_members: int = MAX_MEMBERS) -> DataFrame:
    """The RESULTS rows of a stream of group events. Needs the RocksDB state store."""
    return events.groupBy("group").transformWithStateInPandas(
        statefulProcessor=GroupProcessor(delay_ms, max_members), outputStructType=RESULTS, outputMode="append", timeMode="processingTime"
    )
