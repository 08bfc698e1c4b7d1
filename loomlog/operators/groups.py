"""Consumer groups: one pure transition function, used by batch replay and by the streaming operator.

A group's state is plain JSON-like data. Blocking calls of a broker become output rows: a join or sync that
waits gives its row when the round completes, its timer fires or the group rebalances.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import errors

MAX_MEMBERS = 256
REBALANCE_DELAY_MS = 3000
SESSION_MS = 30_000
STATE = "state"
EMPTY, JOINING, AWAITING, STABLE = "Empty", "Joining", "AwaitingSync", "Stable"

EVENTS = "seq long, ts_ms long, group string, member string, event string, generation int, session_ms int, protocols array<string>, payload string"
RESULTS = "group string, seq long, ts_ms long, event string, member string, error int, generation int, state string, protocol string, leader string, members string, assignment string, metadata string"


@dataclass
class Member:
    session_ms: int = SESSION_MS
    protocols: list[str] = field(default_factory=list)
    #: what the member says of each protocol, for the leader
    metadata: dict[str, str] = field(default_factory=dict)
    assignment: str | None = None
    expires: int = 0


@dataclass
class Group:
    state: str = EMPTY
    generation: int = 0
    protocol: str = ""
    leader: str = ""
    members: dict[str, Member] = field(default_factory=dict)
    #: member -> (seq, deadline) of joins and syncs without an answer so far
    joins: dict[str, list[int]] = field(default_factory=dict)
    syncs: dict[str, list[int]] = field(default_factory=dict)
    #: when the round completes by its delay, 0 for no timer
    round_at: int = 0
    seen: bool = False

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Group:
        raw = json.loads(text)
        raw["members"] = {k: Member(**m) for k, m in raw["members"].items()}
        return cls(**raw)

    def next_timer(self) -> int:
        """The earliest time at which something happens by itself, 0 for never."""
        due = [m.expires for k, m in self.members.items() if k not in self.joins and m.expires]
        due += [d for _, d in (*self.joins.values(), *self.syncs.values())] + ([self.round_at] if self.round_at else [])
        return min(due, default=0)


def preferred(members: dict[str, Member]) -> str:
    """The protocol that all members support and the member of the lowest id likes best; "" if there is none."""
    ranked = members[min(members)].protocols if members else []
    return next((p for p in ranked if all(p in m.protocols for m in members.values())), "")


def _texts(payload: str | None) -> dict[str, str]:
    """The members of a JSON object; empty for anything else."""
    try:
        found = json.loads(payload or "{}")
    except ValueError:
        return {}
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in found.items()} if isinstance(found, dict) else {}


class Machine:
    """Applies events to a group; every call returns the rows (see RESULTS) that it answers."""

    def __init__(self, name: str, group: Group | None = None, delay_ms: int = REBALANCE_DELAY_MS, max_members: int = MAX_MEMBERS) -> None:
        self.name, self.g, self.delay_ms, self.max_members = name, group or Group(), delay_ms, max_members

    def _row(self, seq: int, ts: int, event: str, member: str, error: int, members: str | None = None, assignment: str | None = None, metadata: str | None = None) -> dict:
        g = self.g
        return {
            "group": self.name, "seq": seq, "ts_ms": ts, "event": event, "member": member, "error": error, "generation": g.generation, "state": g.state,
            "protocol": g.protocol, "leader": g.leader, "members": members, "assignment": assignment, "metadata": metadata,
        }

    def _rebalance(self, ts: int) -> list[dict]:
        """Back to joining; syncs that wait are told so."""
        self.g.state = JOINING
        waiting, self.g.syncs = self.g.syncs, {}
        return [self._row(s, ts, "sync", m, errors.REBALANCE_IN_PROGRESS) for m, (s, _) in sorted(waiting.items())]

    def _remove(self, member: str, ts: int) -> list[dict]:
        g = self.g
        g.members.pop(member, None)
        g.joins.pop(member, None)
        g.syncs.pop(member, None)
        if not g.members:
            g.state, g.leader, g.round_at = EMPTY, "", 0
            return []
        return self._rebalance(ts)

    def _complete(self, ts: int) -> list[dict]:
        """Ends the joining round: a new generation, its protocol and leader; the leader learns the members and what they say of the protocol."""
        g = self.g
        g.generation += 1
        g.protocol = preferred(g.members)
        g.leader = g.leader if g.leader in g.members else min(g.members)
        g.state, g.round_at = AWAITING, 0
        waiting, g.joins = g.joins, {}
        listed = ",".join(sorted(g.members))
        said = json.dumps({m: g.members[m].metadata.get(g.protocol) for m in sorted(g.members)})
        return [self._row(s, ts, "join", m, errors.NONE, listed if m == g.leader else "", None, said if m == g.leader else None) for m, (s, _) in sorted(waiting.items())]

    def advance(self, ts: int) -> list[dict]:
        """Everything that is due up to ``ts``, in order of time."""
        out: list[dict] = []
        while (due := self.g.next_timer()) and due <= ts:
            out += self._timer(due)
        return out

    def _timer(self, due: int) -> list[dict]:
        g = self.g
        if g.round_at == due:
            g.round_at = 0
            return self._complete(due) if g.joins else []
        for m, (seq, deadline) in sorted(g.joins.items()):
            if deadline == due:
                gone = self._remove(m, due)
                return [self._row(seq, due, "join", m, errors.REBALANCE_IN_PROGRESS), *gone]
        for m, (seq, deadline) in sorted(g.syncs.items()):
            if deadline == due:
                del g.syncs[m]
                return [self._row(seq, due, "sync", m, errors.REBALANCE_IN_PROGRESS)]
        member = next(m for m in sorted(g.members) if g.members[m].expires == due and m not in g.joins)
        gone = self._remove(member, due)
        return [self._row(-1, due, "expire", member, errors.NONE), *gone]

    def apply(self, e: dict) -> list[dict]:
        """One event, after what was due before it."""
        out = self.advance(e["ts_ms"])
        handle = getattr(self, f"_on_{e['event']}", None)
        return out + (handle(e) if handle else [self._row(e["seq"], e["ts_ms"], e["event"], e["member"] or "", errors.INVALID_REQUEST)])

    def _on_join(self, e: dict) -> list[dict]:
        g, ts, member = self.g, e["ts_ms"], e["member"] or ""
        if not member:
            if len(g.members) >= self.max_members:
                return [self._row(e["seq"], ts, "join", "", errors.GROUP_FULL)]
            member = f"member-{self.name}-{e['seq']}"
        g.seen = True
        m = g.members.setdefault(member, Member())
        m.session_ms, m.protocols, m.metadata = e["session_ms"] or SESSION_MS, list(e["protocols"] or []), _texts(e["payload"])
        m.expires = ts + m.session_ms  # from the join on, whenever the round completes
        out = self._rebalance(ts) if g.state in (STABLE, AWAITING) else []
        g.state = JOINING
        g.joins[member] = [e["seq"], ts + m.session_ms]
        if len(g.joins) == len(g.members):
            if self.delay_ms <= 0:
                out += self._complete(ts)
            elif not g.round_at:
                g.round_at = ts + self.delay_ms
        return out

    def _known(self, e: dict) -> int:
        """Error of a request that needs a member of the present generation."""
        if not self.g.seen:
            return errors.COORDINATOR_UNAVAILABLE
        if e["member"] not in self.g.members:
            return errors.UNKNOWN_MEMBER
        if e["event"] != "leave" and e["generation"] != self.g.generation:
            return errors.ILLEGAL_GENERATION
        return errors.NONE

    def _on_sync(self, e: dict) -> list[dict]:
        g, ts, member = self.g, e["ts_ms"], e["member"]
        if error := self._known(e):
            return [self._row(e["seq"], ts, "sync", member, error)]
        own = g.members[member]
        if g.state == STABLE:
            return [self._row(e["seq"], ts, "sync", member, errors.NONE, None, own.assignment)]
        if g.state != AWAITING:
            return [self._row(e["seq"], ts, "sync", member, errors.REBALANCE_IN_PROGRESS)]
        own.expires = ts + own.session_ms
        assigned = _texts(e["payload"])
        if member != g.leader or not assigned:
            g.syncs[member] = [e["seq"], ts + own.session_ms]
            return []
        for k in assigned.keys() & g.members.keys():  # others keep theirs
            g.members[k].assignment = assigned[k]
        g.state = STABLE
        waiting, g.syncs = {**g.syncs, member: [e["seq"], 0]}, {}
        rows = []
        for k, (seq, _) in sorted(waiting.items()):
            got = g.members[k].assignment
            missing = got is None and k != member
            rows.append(self._row(seq, ts, "sync", k, errors.REBALANCE_IN_PROGRESS if missing else errors.NONE, None, got))
        return rows

    def _on_heartbeat(self, e: dict) -> list[dict]:
        g, member = self.g, e["member"]
        error = self._known(e)
        if not error:
            g.members[member].expires = e["ts_ms"] + g.members[member].session_ms
            error = errors.REBALANCE_IN_PROGRESS if g.state in (JOINING, AWAITING) else errors.NONE
        return [self._row(e["seq"], e["ts_ms"], "heartbeat", member, error)]

    def _on_leave(self, e: dict) -> list[dict]:
        if error := self._known(e):
            return [self._row(e["seq"], e["ts_ms"], "leave", e["member"], error)]
        gone = self._remove(e["member"], e["ts_ms"])
        return [self._row(e["seq"], e["ts_ms"], "leave", e["member"], errors.NONE), *gone]

    def _on_commit(self, e: dict) -> list[dict]:
        return [self._row(e["seq"], e["ts_ms"], "commit", e["member"], self._known(e), None, e["payload"])]


def replay(events: DataFrame, delay_ms: int = REBALANCE_DELAY_MS, until_ms: int | None = None, max_members: int = MAX_MEMBERS, states: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """The RESULTS rows of group events (see EVENTS), each group's in order of seq.

    Tasks stream over sorted events and hold the state of one group. ``until_ms`` lets timers run on after a group's last event.
    With ``states`` (group, state) groups go on from there; with ``keep`` the rows of event "state" have each group's state in
    assignment, see ``states_of``.
    """
    names = [x.split(" ")[0] for x in EVENTS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in RESULTS.split(", "))])

    def end(machine: Machine | None) -> list[dict]:
        if machine is None:
            return []
        rows = machine.advance(until_ms) if until_ms is not None else []
        return rows + ([machine._row(-1, 0, STATE, "", errors.NONE, None, machine.g.dump())] if keep else [])

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine | None = None
        for part in parts:
            rows: list[dict] = []
            for e in part.to_pylist():
                if machine is None or machine.name != e["group"]:
                    rows += end(machine)
                    machine = Machine(e["group"], Group.load(e["payload"]) if e["event"] == STATE else None, delay_ms, max_members)
                rows += machine.apply(e) if e["event"] != STATE else []
            yield pa.RecordBatch.from_pylist(rows, schema)
        yield pa.RecordBatch.from_pylist(end(machine), schema)

    events = events.select(*names)
    if states is not None:  # a state comes before its group's events
        first = {"group": F.col("group"), "event": F.lit(STATE), "seq": F.lit(-1).cast("long"), "payload": F.col("state")}
        kinds_ = dict(x.split(" ") for x in EVENTS.split(", "))
        events = states.select(*(first.get(n, F.lit(None).cast(kinds_[n])).alias(n) for n in names)).unionByName(events)
    return events.repartition("group").sortWithinPartitions("group", "seq").mapInArrow(fold, RESULTS)


def states_of(results: DataFrame) -> DataFrame:
    """(group, state) after a replay that keeps them."""
    return results.filter(F.col("event") == STATE).select("group", F.col("assignment").alias("state"))


def committed(results: DataFrame) -> DataFrame:
    """(group, member, seq, payload) of commits that were accepted."""
    return results.filter((F.col("event") == "commit") & (F.col("error") == 0)).select("group", "member", "seq", F.col("assignment").alias("payload"))
