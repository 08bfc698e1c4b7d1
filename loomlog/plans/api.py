"""The thirteen requests of the log API as typed calls on one object; answers are DataFrames.

An engine holds its state as DataFrames and gives each call's answer as a query over them. Calls that change
state return a new engine next to the answer; nothing is modified in place. With a ``state_path`` a call writes what it adds to
the log and the other tables anew, so plans do not grow with the number of calls.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_schema
from ..operators import catalog, fetch, groups, offsets, produce, replication
from ..operators.logview import log_ends

RECORDS = "topic string, partition int, batch long, seq long, value string"
LOG = "topic string, partition int, offset long, value string, bytes long"


@dataclass(frozen=True)
class ProduceBatch:
    topic: str
    partition: int
    values: tuple[str, ...]


@dataclass(frozen=True)
class FetchPartition:
    partition: int
    fetch_offset: int
    topic: str = ""
    topic_id: str | None = None
    epoch: int = -1


@dataclass(frozen=True)
class GroupEvent:
    group: str
    member: str
    event: str
    ts_ms: int
    generation: int = 0
    session_ms: int = groups.SESSION_MS
    protocols: tuple[str, ...] = ()
    payload: str | None = None


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    broker_id: int
    brokers: DataFrame
    topics: DataFrame
    partitions: DataFrame
    log: DataFrame
    schemas: DataFrame
    commits: DataFrame
    members: DataFrame
    groups: DataFrame
    #: log ends of replicas (topic, partition, broker_id, leo); the leader's own is its log's
    replicas: DataFrame
    seq: int = 0
    state_path: str | None = None

    @classmethod
    def create(cls, spark: SparkSession, topics: dict[str, int], brokers: Sequence[tuple[int, str, int]] = ((1, "localhost", 9092),), state_path: str | None = None) -> Engine:
        """An empty engine with topics of so many partitions, led by the first broker that their placement names."""
        json_schema.allow_duplicate_keys(spark)
        wanted = spark.createDataFrame(list(topics.items()), "name string, partitions int")
        made, parts = catalog.create_topics(wanted, [b[0] for b in brokers])
        empty = lambda schema: spark.createDataFrame([], schema)
        return cls(
            spark, brokers[0][0], spark.createDataFrame(list(brokers), "broker_id int, host string, port int"), made, parts, empty(LOG),
            empty("topic string, schema map<string,string>"), empty("group string, topic string, partition int, seq long, offset long"), empty("group string, member string, generation int"),
            empty("group string, state string"), empty("topic string, partition int, broker_id int, leo long"), 0, state_path,
        )

    def _after(self, log: DataFrame | None = None, **tables: DataFrame) -> Engine:
        """The engine with new rows of the log and new tables, written if there is a place for them."""
        n = self.seq + 1
        if not self.state_path:
            return replace(self, seq=n, **tables, **({"log": self.log.unionByName(log)} if log is not None else {}))
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.state_path}/{name}/{n}")
            tables[name] = self.spark.read.schema(df.schema).parquet(f"{self.state_path}/{name}/{n}")
        if log is not None:
            log.select(*self.log.columns).write.mode("overwrite").parquet(f"{self.state_path}/log/call={n}")
            tables["log"] = self.spark.read.schema(LOG).parquet(f"{self.state_path}/log").drop("call")
        return replace(self, seq=n, **tables)

    def _state(self) -> DataFrame:
        """Partitions with their present ends; the high watermark is the least end over the in-sync replicas."""
        ends = log_ends(self.log).withColumnRenamed("next_offset", "end_")
        end = F.coalesce("end_", F.lit(0).cast("long"))
        now = self.partitions.join(ends, ["topic", "partition"], "left").withColumns({"next_offset": end, "leo": end}).drop("end_")
        own = now.select("topic", "partition", F.col("leader_id").alias("broker_id"), "leo")
        others = self.replicas.join(own, ["topic", "partition", "broker_id"], "left_anti")
        marks = replication.high_watermark(now, own.unionByName(others))
        return now.drop("hw").join(marks, ["topic", "partition"])

    def replica_fetched(self, ends: Sequence[tuple[str, int, int, int]]) -> Engine:
        """The engine after replicas (topic, partition, broker, log end) have fetched up to their ends."""
        new = self.spark.createDataFrame(list(ends), "topic string, partition int, broker_id int, leo long")
        old = self.replicas.join(new, ["topic", "partition", "broker_id"], "left_anti")
        return self._after(replicas=old.unionByName(new))

    def api_versions(self, version: int = 4) -> DataFrame:
        return catalog.api_versions(self.spark, version)

    def metadata(self, names: Sequence[str] | None = None) -> DataFrame:
        wanted = None if names is None else self.spark.createDataFrame([(n,) for n in names], "name string")
        return catalog.metadata(wanted, self.topics, self.partitions)

    def describe_topic_partitions(self, names: Sequence[str]) -> DataFrame:
        return catalog.describe_topics(self.spark.createDataFrame([(n,) for n in names], "name string"), self.topics, self.partitions)

    def find_coordinator(self) -> DataFrame:
        return catalog.find_coordinator(self.brokers, self.broker_id)

    def produce(self, batches: Sequence[ProduceBatch], now_ms: int) -> tuple[Engine, DataFrame]:
        """(engine after, response). A topic's first value sets its schema; invalid values go to its dead-letter topic."""
        rows = [(b.topic, b.partition, i, i * 1_000_000 + k, v) for i, b in enumerate(batches) for k, v in enumerate(b.values)]
        records = self.spark.createDataFrame(rows, RECORDS)
        routed = produce.route(produce.validate(records, self.schemas), batch=("topic", "partition", "batch"))
        failed = routed.groupBy("batch").agg((~F.max("to_log")).alias("all_failed"))
        asked = self.spark.createDataFrame([(i, b.topic, b.partition, len(b.values)) for i, b in enumerate(batches)], "req_id long, topic string, partition int, n_records int")
        asked = asked.join(failed, F.col("req_id") == F.col("batch"), "left").drop("batch").withColumn("all_failed", F.coalesce("all_failed", F.lit(False)))
        answer = produce.respond(asked, self._state(), self.broker_id, now_ms)
        written = routed.join(answer.filter("written").select(F.col("req_id").alias("batch"), "base_offset"), "batch")
        rows_ = written.select("topic", "partition", F.col("base_offset").alias("offset"), "value", (F.lit(61) + F.octet_length("value")).cast("long").alias("bytes"))
        dead = produce.dead_letters(routed)
        ends = log_ends(self.log).select("topic", F.col("next_offset").alias("start"))
        dead = dead.join(ends, "topic", "left").select("topic", "partition", (F.coalesce("start", F.lit(0)) + F.row_number().over(_by_seq()) - 1).alias("offset"), "value", (F.lit(61) + F.octet_length("value")).cast("long").alias("bytes"))
        known = self.schemas.select("topic")
        new = produce.infer_schemas(records.join(known, "topic", "left_anti"))
        made, parts = catalog.create_topics(produce.missing_dlq_topics(routed, self.topics).withColumn("partitions", F.lit(1)), [self.broker_id])
        after = self._after(
            rows_.unionByName(dead), schemas=produce.register(self.schemas, new), topics=self.topics.unionByName(made), partitions=self.partitions.unionByName(parts.select(*self.partitions.columns))
        )
        return after, answer

    def fetch(self, wanted: Sequence[FetchPartition], max_bytes: int = 0, replica_id: int = -1) -> tuple[DataFrame, DataFrame]:
        """(response rows, records)."""
        rows = [(0, i, w.topic, w.topic_id, w.partition, w.fetch_offset, w.epoch, replica_id) for i, w in enumerate(wanted)]
        schema = "topic_pos int, part_pos int, topic string, topic_id string, partition int, fetch_offset long, epoch int, replica_id int"
        return fetch.fetch(self.spark.createDataFrame(rows, schema), self.topics, self._state(), self.log, max_bytes)

    def list_offsets(self, wanted: Sequence[tuple[str, int, int]]) -> DataFrame:
        """Offsets of (topic, partition, timestamp)."""
        rows = [(i, *w) for i, w in enumerate(wanted)]
        return offsets.list_offsets(self.spark.createDataFrame(rows, "req_id int, topic string, partition int, timestamp long"), self._state().select("topic", "partition", "next_offset"))

    def group(self, *events: GroupEvent, delay_ms: int = groups.REBALANCE_DELAY_MS, until_ms: int | None = None) -> tuple[Engine, DataFrame]:
        """(engine after, results): join, sync, heartbeat, leave and commit events after all earlier ones."""
        rows = [(i, e.ts_ms, e.group, e.member, e.event, e.generation, e.session_ms, list(e.protocols), e.payload) for i, e in enumerate(events)]
        results = groups.replay(self.spark.createDataFrame(rows, groups.EVENTS), delay_ms, until_ms, states=self.groups, keep=True)
        joined = results.filter("event = 'join' AND error = 0").select("group", "member", "generation").unionByName(self.members)
        joined = joined.groupBy("group", "member").agg(F.max("generation").alias("generation"))
        after = self._after(members=joined, groups=groups.states_of(results))
        return after, results.filter(F.col("event") != groups.STATE)

    def offset_commit(self, commits: Sequence[tuple[str, str, int, str, int, int]]) -> tuple[Engine, DataFrame]:
        """(engine after, response) of commits (group, member, generation, topic, partition, offset)."""
        rows = [(self.seq * 1_000_000 + i, *c) for i, c in enumerate(commits)]
        asked = self.spark.createDataFrame(rows, "seq long, group string, member string, generation int, topic string, partition int, offset long")
        answer = offsets.commit(asked, self.members)
        good = answer.filter("error = 0").select("group", "topic", "partition", "seq", "offset")
        return self._after(commits=self.commits.unionByName(good)), answer.select("seq", "topic", "partition", "error")

    def offset_fetch(self, wanted: Sequence[tuple[str, str, int]]) -> DataFrame:
        """Committed offsets of (group, topic, partition)."""
        return offsets.fetch_offsets(self.spark.createDataFrame(list(wanted), "group string, topic string, partition int"), offsets.replay(self.commits))


def _by_seq() -> Window:
    return Window.partitionBy("topic").orderBy("seq")
