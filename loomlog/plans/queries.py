"""The library's queries over the shared tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_schema, names
from ..operators import catalog, fetch, groups, offsets, produce, replication, storage
from ..operators.logview import event_log, log_ends
from ..sources import batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# What both engines start from: the log view and states that are derived from it.
_LOG = """
WITH log AS (SELECT CAST(user_id % 3 AS INTEGER) AS part, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS off, CAST(user_id AS VARCHAR) AS k,
             props AS val, epoch_us(ts) // 1000 AS ts_ms, CAST(61 + strlen(props) AS BIGINT) AS bytes, event_id, user_id, event_type,
             CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 6 END AS broker FROM events),
ends AS (SELECT part, max(off) + 1 AS next_offset FROM log GROUP BY part),
state AS (SELECT part, broker, max(off) + 1 AS leo, max(ts_ms) AS seen FROM log GROUP BY part, broker),
parts AS (SELECT * FROM (VALUES (0), (1), (2)) p(part)),
hw AS (SELECT p.part, min(coalesce(s.leo, 0)) AS hw FROM parts p CROSS JOIN (VALUES (1), (2), (3)) b(broker) LEFT JOIN state s USING (part, broker) GROUP BY p.part),
payloads AS (SELECT *, CASE event_id % 10 WHEN 0 THEN 'not json' WHEN 1 THEN '{"k": "x"}' WHEN 2 THEN '{"k": 1.5}' WHEN 3 THEN val || ' x' WHEN 4 THEN '{"k": 3, "more": null}' ELSE val END AS body FROM log)
"""
_KINDS = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 6 END"
_BODIES = "CASE event_id % 10 WHEN 0 THEN 'not json' WHEN 1 THEN '{\"k\": \"x\"}' WHEN 2 THEN '{\"k\": 1.5}' WHEN 3 THEN value || ' x' WHEN 4 THEN '{\"k\": 3, \"more\": null}' ELSE value END"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("broker_id", F.expr(_KINDS))


def _state(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition", "broker_id").agg((F.max("offset") + 1).alias("leo"), F.max("ts_ms").alias("last_seen_ms"))


def _partitions(spark: SparkSession, replicas: str = "1, 2, 3, 4, 5") -> DataFrame:
    """Three partitions of the topic: led by brokers 1, 2, 3, in sync on 1, 2, 3, leader epoch 2."""
    return spark.sql(
        f"SELECT 'events' AS topic, id AS partition, id + 1 AS leader_id, array({replicas}) AS replicas, array(1, 2, 3) AS isr, 2 AS leader_epoch, 7 AS partition_epoch, 0L AS hw "
        "FROM VALUES (0), (1), (2) AS p(id)"
    )


def _with_marks(log: DataFrame, spark: SparkSession) -> DataFrame:
    """The partitions with high watermark and log end."""
    partitions = _partitions(spark)
    marks = replication.high_watermark(partitions, _state(log))
    ends = log_ends(log).withColumnRenamed("next_offset", "leo")
    return partitions.drop("hw").join(marks, ["topic", "partition"]).join(ends, ["topic", "partition"], "left").withColumn("leo", F.coalesce("leo", F.lit(0)))


def _topics(spark: SparkSession) -> DataFrame:
    topics = spark.sql("SELECT * FROM VALUES ('events', false), ('orders', false), ('zebra', false), ('__internal', true) AS t(name, is_internal)")
    return topics.select("name", names.name_uuid(F.col("name")).alias("topic_id"), "is_internal")


_UUID = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"


@query(_LOG + "SELECT event_id, part AS partition, off AS \"offset\" FROM log")
def log_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("event_id", "partition", "offset")


@query(_LOG + "SELECT part AS partition, off AS \"offset\", k AS key, val AS value FROM log JOIN hw USING (part) JOIN (VALUES (0, 100), (1, 0), (2, 250)) r(part, start) USING (part) WHERE off >= start AND off < hw")
def fetch_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    requests = spark.sql(
        "SELECT 0 AS topic_pos, part_pos, 'events' AS topic, CAST(null AS string) AS topic_id, partition, start AS fetch_offset, -1 AS epoch, -1 AS replica_id "
        "FROM VALUES (0, 0, 100L), (1, 1, 0L), (2, 2, 250L) AS r(part_pos, partition, start)"
    )
    planned = fetch.plan(fetch.resolve_topics(requests, _topics(spark)), _with_marks(log, spark))
    return fetch.scan(planned, log).select("partition", "offset", "key", "value")


@query(_LOG + """, c AS (SELECT part, off, bytes, coalesce(sum(bytes) OVER (ORDER BY part, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log)
SELECT part AS partition, off AS "offset", bytes, CAST(least(bytes, 300000 - before) AS BIGINT) AS returned_bytes FROM c WHERE before < 300000""")
def fetch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _log(spark, sf_dir).withColumns({"topic_pos": F.lit(0), "part_pos": F.col("partition")})
    return fetch.within_budget(records, 300_000, 1024).select("partition", "offset", "bytes", "returned_bytes")


_FENCED = "(1, 'events', 0, -1, -1), (2, 'events', 0, 1, -1), (3, 'events', 1, 2, -1), (4, 'events', 2, 3, -1), (5, 'events', 2, 3, 4), (6, 'events', 9, 2, -1), (7, 'nothing', 0, 2, -1), (8, 'events', 1, 1, 4)"


@query(_LOG + f"""SELECT r.id AS part_pos, r.topic, r.p AS partition,
CASE WHEN r.topic <> 'events' THEN 100 WHEN h.part IS NULL THEN 3 WHEN e >= 0 AND e < 2 THEN 74 WHEN e > 2 AND rep < 0 THEN 6 ELSE 0 END AS error, coalesce(h.hw, -1) AS hw
FROM (VALUES {_FENCED}) r(id, topic, p, e, rep) LEFT JOIN hw h ON r.topic = 'events' AND h.part = r.p""")
def fetch_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(
        f"SELECT 0 AS topic_pos, id AS part_pos, topic, CAST(null AS string) AS topic_id, p AS partition, 0L AS fetch_offset, e AS epoch, rep AS replica_id FROM VALUES {_FENCED} AS r(id, topic, p, e, rep)"
    )
    log = _log(spark, sf_dir)
    planned = fetch.plan(fetch.resolve_topics(requests, _topics(spark)), _with_marks(log, spark))
    none = log.limit(0).withColumns({"topic_pos": F.lit(0), "part_pos": F.lit(0), "returned_bytes": F.lit(0)})
    return fetch.response(planned, none).select("part_pos", "topic", "partition", "error", "hw")


@query(_LOG + """, c AS (SELECT part, off, bytes, coalesce(sum(bytes) OVER (ORDER BY part, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log JOIN hw USING (part) WHERE off < hw)
SELECT part AS partition, 0 AS error, any_value(hw.hw) AS hw, any_value(hw.hw) AS last_stable, 0::BIGINT AS log_start, -1 AS preferred_replica, count(c.off) AS n_records,
CAST(coalesce(sum(least(bytes, 200000 - before)), 0) AS BIGINT) AS bytes FROM hw LEFT JOIN (SELECT * FROM c WHERE before < 200000) c USING (part) GROUP BY part""")
def fetch_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(
        "SELECT 0 AS topic_pos, id AS part_pos, '' AS topic, topic_id, id AS partition, 0L AS fetch_offset, 2 AS epoch, -1 AS replica_id FROM VALUES (0), (1), (2) AS p(id)"
        f" CROSS JOIN (SELECT {_UUID.format("'events'")} AS topic_id)"
    )
    log = _log(spark, sf_dir)
    out, _ = fetch.fetch(requests, _topics(spark), _with_marks(log, spark), log, 200_000)
    return out.select("partition", "error", "hw", "last_stable", "log_start", "preferred_replica", "n_records", "bytes")


_LISTED = "(1, 'events', 0, -2), (2, 'events', 1, -1), (3, 'events', 2, 12345), (4, 'events', 7, -1), (5, 'nothing', 0, -2)"


@query(_LOG + f"""SELECT r.id AS req_id, r.topic, r.p AS partition, CASE WHEN e.part IS NULL THEN 3 ELSE 0 END AS error, CAST(CASE WHEN e.part IS NOT NULL AND t = -2 THEN -2 ELSE -1 END AS BIGINT) AS timestamp,
CASE WHEN e.part IS NULL THEN -1 WHEN t = -2 THEN 0 ELSE next_offset END AS "offset" FROM (VALUES {_LISTED}) r(id, topic, p, t) LEFT JOIN ends e ON r.topic = 'events' AND e.part = r.p""")
def list_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(f"SELECT id AS req_id, topic, p AS partition, CAST(t AS bigint) AS timestamp FROM VALUES {_LISTED} AS r(id, topic, p, t)")
    return offsets.list_offsets(requests, log_ends(_log(spark, sf_dir)))


def _commits(log: DataFrame) -> DataFrame:
    group = F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string"))
    return log.select(group.alias("group"), "topic", "partition", F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 1000).alias("offset"))


_COMMITTED = ", done AS (SELECT 'g' || (user_id % 5) AS grp, part, arg_max(event_id * 7919 % 1000, event_id) AS committed FROM log GROUP BY 1, 2)"


@query(_LOG + _COMMITTED + "SELECT grp AS \"group\", 'events' AS topic, part AS partition, committed AS \"offset\" FROM done")
def offset_commit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.replay(_commits(_log(spark, sf_dir)))


@query(_LOG + _COMMITTED + """SELECT r.grp AS "group", 'events' AS topic, p.part AS partition, coalesce(committed, -1) AS "offset", '' AS metadata, 0 AS error
FROM (VALUES ('g0'), ('g4'), ('none')) r(grp) CROSS JOIN (VALUES (0), (2), (8)) p(part) LEFT JOIN done d ON d.grp = r.grp AND d.part = p.part""")
def offset_fetch_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql("SELECT g AS group, 'events' AS topic, p AS partition FROM VALUES ('g0'), ('g4'), ('none') AS r(g) CROSS JOIN VALUES (0), (2), (8) AS q(p)")
    return offsets.fetch_offsets(requests, offsets.replay(_commits(_log(spark, sf_dir))))


@query(_LOG + _COMMITTED + "SELECT grp AS \"group\", 'events' AS topic, part AS partition, greatest(next_offset - committed, 0) AS lag FROM done JOIN ends USING (part)")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return offsets.lag(offsets.replay(_commits(log)), log_ends(log))


@query(_LOG + "SELECT 'events' AS topic, part AS partition, hw FROM hw")
def high_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.high_watermark(_partitions(spark), _state(_log(spark, sf_dir)))


@query(_LOG + """SELECT part AS partition, broker AS broker_id, max(off) + 1 AS leo, arg_max(ts_ms, event_id) AS last_seen_ms FROM log WHERE event_id % 7 <> 0 GROUP BY part, broker""")
def replica_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    fetches = log.select(
        "topic", "partition", "broker_id", (F.col("offset") + 1).alias("delivered"), F.when(F.col("event_id") % 7 == 0, 6).otherwise(0).alias("error"), F.col("event_id").alias("seq"), "ts_ms"
    )
    none = _state(log).limit(0)
    return replication.replica_progress(none, fetches).select("partition", "broker_id", "leo", "last_seen_ms")


_AS_OF = 1_706_658_000_000  # 2024-01-30 23:40:00 UTC


@query(_LOG + f""", led AS (SELECT part, leo AS leader_leo FROM state WHERE broker = part + 1),
ok AS (SELECT p.part, b.broker FROM parts p CROSS JOIN (VALUES (1), (2), (3), (4), (5)) b(broker) LEFT JOIN state s USING (part, broker) LEFT JOIN led l USING (part)
       WHERE b.broker = p.part + 1 OR ({_AS_OF} - seen <= 1800000 AND coalesce(leader_leo, 0) - leo <= 30))
SELECT part AS partition, string_agg(CAST(broker AS VARCHAR), ',' ORDER BY broker) AS isr, CAST(7 + CASE WHEN count(*) <> 3 THEN 1 ELSE 0 END AS INTEGER) AS partition_epoch FROM ok GROUP BY part""")
def isr_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replication.in_sync(_partitions(spark), _state(_log(spark, sf_dir)), _AS_OF, 1_800_000, 30)
    return out.select("partition", F.array_join(F.col("isr").cast("array<string>"), ",").alias("isr"), "partition_epoch")


_PROBES = "SELECT CAST(user_id AS INTEGER) AS broker_id, event_id AS seq, event_type <> 'error' AS reachable FROM events"


@query(f"""WITH p AS ({_PROBES}), r AS (SELECT *, sum(CAST(reachable AS INTEGER)) OVER (PARTITION BY broker_id ORDER BY seq) AS run FROM p),
s AS (SELECT broker_id, seq, CAST(sum(CASE WHEN reachable THEN 0 ELSE 1 END) OVER (PARTITION BY broker_id, run ORDER BY seq) AS BIGINT) AS streak FROM r)
SELECT broker_id, seq, streak, streak >= 3 AS dead, streak = 3 AS newly_dead, streak = 0 AND coalesce(lag(streak) OVER (PARTITION BY broker_id ORDER BY seq), 0) >= 3 AS revived FROM s""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("loomlog_events")
    return replication.failure_streaks(spark.sql(_PROBES.replace("FROM events", "FROM loomlog_events")))


@query(f"""WITH p AS ({_PROBES}), l AS (SELECT broker_id, max(CASE WHEN reachable THEN seq END) AS ok FROM p GROUP BY broker_id)
SELECT broker_id FROM p JOIN l USING (broker_id) WHERE ok IS NULL OR seq > ok GROUP BY broker_id HAVING count(*) >= 2""")
def dead_brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("loomlog_events")
    return replication.dead_brokers(spark.sql(_PROBES.replace("FROM events", "FROM loomlog_events")), 2)


@query("""WITH t AS (SELECT 'topic-' || o_orderpriority AS topic, CAST(count(*) % 7 AS INTEGER) AS n FROM orders GROUP BY 1),
p AS (SELECT topic, CAST(unnest(range(n)) AS INTEGER) AS partition FROM t), r AS (SELECT topic, partition, CAST(unnest(range(3)) AS INTEGER) AS r FROM p)
SELECT topic, partition, string_agg(CAST([2, 5, 9][(partition + r) % 3 + 1] AS VARCHAR), ',' ORDER BY r) AS replicas FROM r GROUP BY topic, partition""")
def replica_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    wanted = orders.groupBy(F.concat(F.lit("topic-"), "o_orderpriority").alias("name")).agg((F.count(F.lit(1)) % 7).cast("int").alias("partitions"))
    _, partitions = catalog.create_topics(wanted, [9, 2, 5])
    return partitions.select("topic", "partition", F.array_join(F.col("replicas").cast("array<string>"), ",").alias("replicas"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with broken payloads by event id; batches of ten offsets; the schema asks for an integer k."""
    json_schema.allow_duplicate_keys(spark)
    return _log(spark, sf_dir).withColumn("value", F.expr(_BODIES)).withColumn("batch", F.expr("offset div 10"))


def _schema(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'events' AS topic, map('k', 'integer') AS schema")


@query(_LOG + """, f AS (SELECT event_type, arg_min(val, event_id) AS v FROM log GROUP BY event_type)
SELECT event_type AS topic, unnest(json_keys(v)) AS field, CASE json_type(v, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS type FROM f""")
def schema_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    json_schema.allow_duplicate_keys(spark)
    records = _log(spark, sf_dir).select(F.col("event_type").alias("topic"), "value", "event_id")
    return produce.schema_fields(produce.infer_schemas(records, "event_id"))


_VALID = "coalesce(json_type(try_cast(body AS JSON), '$.k') IN ('UBIGINT', 'BIGINT'), false)"


@query(_LOG + f"SELECT event_id, {_VALID} AS valid FROM payloads")
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return produce.validate(_payloads(spark, sf_dir), _schema(spark)).select("event_id", "valid")


@query(_LOG + f"SELECT 'events.dlq' AS topic, 0 AS partition, event_id, body AS value FROM payloads WHERE NOT {_VALID}")
def dlq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = produce.route(produce.validate(_payloads(spark, sf_dir), _schema(spark)))
    return produce.dead_letters(routed).select("topic", "partition", "event_id", "value")


@query(_LOG + f""", v AS (SELECT part, off // 10 AS batch, bool_or({_VALID}) AS any_ok, count(*) AS n, count(*) FILTER (NOT {_VALID}) AS bad FROM payloads GROUP BY 1, 2)
SELECT part AS partition, batch, CAST(CASE WHEN any_ok THEN n ELSE 0 END AS BIGINT) AS written, CAST(bad AS BIGINT) AS dead FROM v""")
def produce_batch_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = produce.route(produce.validate(_payloads(spark, sf_dir), _schema(spark)))
    count = lambda c: F.sum(F.col(c).cast("long"))
    return routed.groupBy("partition", "batch").agg(count("to_log").alias("written"), count("to_dlq").alias("dead"))


@query(_LOG + f"SELECT part AS partition, CAST(count(*) FILTER ({_VALID}) AS BIGINT) AS written, CAST(count(*) FILTER (NOT {_VALID}) AS BIGINT) AS dead FROM payloads GROUP BY part")
def produce_record_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = produce.route(produce.validate(_payloads(spark, sf_dir), _schema(spark)), "record")
    return routed.groupBy("partition").agg(F.sum(F.col("to_log").cast("long")).alias("written"), F.sum(F.col("to_dlq").cast("long")).alias("dead"))


_PRODUCED = "(1, 'events', 0, 3, false), (2, 'events', 0, 2, false), (3, 'events', 1, 1, false), (4, 'events', 0, 0, false), (5, 'events', 0, 4, true), (6, 'none', 0, 1, false), (7, 'events', 0, 1, false)"


@query(_LOG + f"""SELECT r.id AS req_id, r.topic, r.p AS partition, CASE WHEN r.topic <> 'events' THEN 3 WHEN r.p <> 0 THEN 6 ELSE 0 END AS error,
CASE WHEN r.topic <> 'events' OR r.p <> 0 THEN -1 ELSE next_offset + CASE r.id WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 2 END END AS base_offset,
CAST(CASE WHEN r.topic <> 'events' OR r.p <> 0 THEN -1 ELSE 1000 END AS BIGINT) AS log_append_time_ms, CAST(CASE WHEN r.topic <> 'events' OR r.p <> 0 THEN -1 ELSE 0 END AS BIGINT) AS log_start_offset,
r.topic = 'events' AND r.p = 0 AND r.n > 0 AND NOT r.bad AS written FROM (VALUES {_PRODUCED}) r(id, topic, p, n, bad) LEFT JOIN ends e ON r.topic = 'events' AND e.part = r.p""")
def produce_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(f"SELECT id AS req_id, topic, p AS partition, n AS n_records, bad AS all_failed FROM VALUES {_PRODUCED} AS r(id, topic, p, n, bad)")
    partitions = _partitions(spark).join(log_ends(_log(spark, sf_dir)), ["topic", "partition"], "left")
    return produce.respond(requests, partitions, 1, 1000)


_FOLD = _LOG.replace("WITH log", "WITH RECURSIVE log", 1) + """,
fold AS (SELECT part, off, bytes, CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS pos FROM log WHERE off = 0
         UNION ALL SELECT l.part, l.off, l.bytes, CASE WHEN f.pos + f.bytes >= 20000 THEN l.off ELSE f.segment END, CASE WHEN f.pos + f.bytes >= 20000 THEN 0 ELSE f.pos + f.bytes END
         FROM fold f JOIN log l ON l.part = f.part AND l.off = f.off + 1)
"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.assign_segments(_log(spark, sf_dir), 20_000)


@query(_FOLD + "SELECT part AS partition, segment AS base_offset, lpad(CAST(segment AS VARCHAR), 20, '0') || '.log' AS file, count(*) AS batches, CAST(sum(bytes) AS BIGINT) AS bytes FROM fold GROUP BY part, segment")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.segments(_assigned(spark, sf_dir)).drop("topic")


@query(_FOLD + "SELECT part AS partition, segment, off AS \"offset\", pos AS file_pos FROM fold")
def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.sparse_index(_assigned(spark, sf_dir)).drop("topic")


_SOUGHT = "(1, 0, 0), (2, 0, 3), (3, 0, 250), (4, 1, 299), (5, 2, 100000000), (6, 1, 257)"


@query(_FOLD + f"SELECT r.id AS req_id, r.p AS partition, r.t AS target, max(segment) AS segment, arg_max(pos, off) AS file_pos FROM (VALUES {_SOUGHT}) r(id, p, t) JOIN fold f ON f.part = r.p AND f.off <= r.t GROUP BY 1, 2, 3")
def index_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(f"SELECT id AS req_id, 'events' AS topic, p AS partition, t AS target FROM VALUES {_SOUGHT} AS r(id, p, t)")
    return storage.seek(requests, storage.sparse_index(_assigned(spark, sf_dir))).drop("topic")


@query(_LOG + "SELECT part AS partition, next_offset FROM ends")
def next_offset_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.next_offsets(_assigned(spark, sf_dir)).drop("topic")


def _told(column: str) -> F.Column:
    """Partition lists as text: partition:leader:in-sync replicas."""
    one = lambda p: F.concat_ws(":", p["partition"].cast("string"), p["leader_id"].cast("string"), F.array_join(p["isr"].cast("array<string>"), "/"))
    return F.array_join(F.transform(column, one), ",")


@query(_LOG + "SELECT part AS partition, count(*) AS to_copy, min(off) AS first FROM log JOIN (SELECT part, leo FROM state WHERE broker = 4) s USING (part) WHERE off >= leo GROUP BY part")
def follower_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    todo = replication.replicate(log.drop("broker_id"), _state(log), 4)
    return todo.groupBy("partition").agg(F.count(F.lit(1)).alias("to_copy"), F.min("offset").alias("first"))


@query()
def group_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of events as group events: users join, sync, beat, commit and leave."""
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("signup", "join", "purchase", "sync", "view", "heartbeat", "click", "commit", "error", "leave"))), F.col("event_type"))
    events = _log(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "ts_ms", F.concat(F.lit("g"), (F.col("user_id") % 20).cast("string")).alias("group"), F.concat(F.lit("m"), (F.col("user_id") % 60).cast("string")).alias("member"),
        kind.alias("event"), F.expr("int(event_id div 400)").alias("generation"), F.lit(7_200_000).alias("session_ms"), F.array(F.lit("range"), F.lit("sticky")).alias("protocols"),
        F.lit('{"m0": "0", "m1": "1"}').alias("payload"),
    )
    return groups.replay(events)


@query(_LOG + "SELECT part AS partition, off // 100 AS batch, count(*) FILTER (strlen(val) > 0) AS n_values, CAST(sum(strlen(val)) AS BIGINT) AS value_bytes FROM log GROUP BY 1, 2")
def batch_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records encoded in batches of a hundred, and decoded again."""
    log = _log(spark, sf_dir).withColumn("batch", F.expr("offset div 100"))

    values = log.groupBy("partition", "batch").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("rows"))
    values = values.select("partition", "batch", F.transform("rows", lambda r: r["value"].cast("binary")).alias("records"))
    found = batches.decode_values(batches.encode_values(values, "records", "data"), "data", "found")
    return found.select("partition", "batch", F.size("found").cast("long").alias("n_values"), F.aggregate("found", F.lit(0).cast("long"), lambda s, v: s + F.octet_length(v)).alias("value_bytes"))


# A catalog made of the customers: a topic for each nation and segment, those of every eleventh customer internal; partitions, leaders and
# in-sync replicas on five brokers by the number of customers. Some in-sync sets lack the leader, some are empty.
_CATALOG = """
WITH cust AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN '__' ELSE '' END || 'topic-' || c_nationkey || '-' || c_mktsegment AS name, c_custkey FROM customer),
topics AS (SELECT name, starts_with(name, '__') AS is_internal, count(*) AS n, {uuid} AS topic_id FROM cust GROUP BY name),
spread AS (SELECT name AS topic, n, CAST(unnest(range(n % 4 + 1)) AS INTEGER) AS partition FROM topics),
led AS (SELECT *, CAST((n + partition) % 5 + 1 AS INTEGER) AS leader_id, CAST(n % 6 AS INTEGER) AS leader_epoch, CAST(n % 9 AS INTEGER) AS partition_epoch FROM spread),
held AS (SELECT *, [leader_id, leader_id % 5 + 1, (leader_id + 1) % 5 + 1] AS replicas FROM led),
parts AS (SELECT *, list_filter(replicas, lambda r: (n * 7 + partition * 3 + r) % 4 <> 0) AS isr FROM held),
dead AS (SELECT CAST(s_suppkey % 5 + 1 AS INTEGER) AS broker FROM supplier WHERE s_acctbal < 0 GROUP BY 1 HAVING count(*) % 2 = 1)
""".replace("{uuid}", _UUID.format("name"))
_JOINED = "array_to_string({0}, ',')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(topics, partitions) of ``_CATALOG``; both also have n, the topic's number of customers."""
    marked = F.when(F.col("c_custkey") % 11 == 0, "__").otherwise("")
    topics = _table(spark, sf_dir, "customer").groupBy(F.concat(marked, F.lit("topic-"), "c_nationkey", F.lit("-"), "c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    topics = topics.select("name", names.name_uuid(F.col("name")).alias("topic_id"), F.col("name").startswith("__").alias("is_internal"), "n")
    led = topics.select(F.col("name").alias("topic"), "n", F.explode(F.expr("sequence(0, int(n % 4))")).alias("partition")).withColumn("leader_id", F.expr("int((n + partition) % 5 + 1)"))
    held = led.withColumn("replicas", F.expr("array(leader_id, leader_id % 5 + 1, (leader_id + 1) % 5 + 1)"))
    return topics, held.withColumns({
        "isr": F.expr("filter(replicas, r -> (n * 7 + partition * 3 + r) % 4 <> 0)"), "leader_epoch": F.expr("int(n % 6)"), "partition_epoch": F.expr("int(n % 9)"), "hw": F.lit(0).cast("long"),
    })


def _text(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query(_CATALOG + f"""SELECT topic, partition, {_JOINED.format("list_filter(isr, lambda r: r <> n % 5 + 1)")} AS shrunk,
{_JOINED.format("CASE WHEN n >= 20 AND NOT list_contains(isr, n % 5 + 1) THEN list_append(isr, n % 5 + 1) ELSE isr END")} AS expanded FROM parts""")
def isr_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker n % 5 + 1 leaves every in-sync set, or joins those whose leader's end, 20, it has reached."""
    _, partitions = _catalog(spark, sf_dir)
    broker = F.expr("int(n % 5 + 1)")
    out = partitions.withColumns({"shrunk": replication.shrink(F.col("isr"), broker), "expanded": replication.expand(F.col("isr"), broker, F.col("n"), F.lit(20))})
    return out.select("topic", "partition", _text("shrunk"), _text("expanded"))


@query(_CATALOG + """, c AS (SELECT *, coalesce(list_filter(isr, lambda r: r <> leader_id)[1], isr[1]) AS chosen FROM parts)
SELECT topic, partition, coalesce(chosen, leader_id) AS leader_id, leader_epoch + CASE WHEN chosen IS NULL THEN 0 ELSE 1 END AS leader_epoch, CASE WHEN chosen IS NULL THEN 1 ELSE 0 END AS error FROM c""")
def leader_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.elect(_catalog(spark, sf_dir)[1])


@query(_CATALOG + f""", g AS (SELECT p.*, coalesce((SELECT list(broker) FROM dead), []) AS gone FROM parts p),
l AS (SELECT *, list_filter(isr, lambda r: NOT list_contains(gone, r)) AS rest, list_contains(gone, leader_id) AS led FROM g),
c AS (SELECT *, CASE WHEN led THEN list_filter(rest, lambda r: r <> leader_id)[1] END AS chosen FROM l)
SELECT topic, partition, coalesce(chosen, leader_id) AS leader_id, leader_epoch + CASE WHEN chosen IS NULL THEN 0 ELSE 1 END AS leader_epoch, {_JOINED.format("rest")} AS isr,
partition_epoch + CASE WHEN len(rest) <> len(isr) THEN 1 ELSE 0 END AS partition_epoch, CASE WHEN led AND chosen IS NULL THEN 1 ELSE 0 END AS error FROM c""")
def failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brokers with an odd number of indebted suppliers die."""
    dead = _table(spark, sf_dir, "supplier").filter("s_acctbal < 0").groupBy(F.expr("int(s_suppkey % 5 + 1)").alias("broker_id")).count().filter("count % 2 = 1").select("broker_id")
    out = replication.fail_over(_catalog(spark, sf_dir)[1], dead)
    return out.select("topic", "partition", "leader_id", "leader_epoch", _text("isr"), "partition_epoch", "error")


@query(_CATALOG + f"""SELECT leader_id, topic, {_JOINED.format("list(partition ORDER BY partition)")} AS partitions FROM parts WHERE list_contains(replicas, 3) AND leader_id <> 3 GROUP BY leader_id, topic""")
def replica_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.replica_work(_catalog(spark, sf_dir)[1], 3).select("leader_id", "topic", _text("partitions"))


@query(_LOG + f"SELECT DISTINCT event_type || '.dlq' AS name FROM payloads WHERE NOT {_VALID} AND event_type <> 'view'")
def dlq_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type is a topic, all without a dead-letter topic but view."""
    records = _payloads(spark, sf_dir).withColumn("topic", F.col("event_type"))
    schemas = records.select("topic").distinct().withColumn("schema", F.create_map(F.lit("k"), F.lit("integer")))
    known = schemas.select(F.col("topic").alias("name")).unionByName(spark.sql("SELECT 'view.dlq' AS name"))
    return produce.missing_dlq_topics(produce.route(produce.validate(records, schemas)), known)


_LISTS = """, lists AS (SELECT topic, string_agg(partition || ':' || leader_id || ':' || array_to_string(isr, '/'), ',' ORDER BY partition) AS partitions FROM parts GROUP BY topic)"""


def _told(column: str) -> F.Column:
    """Partition lists as text: partition:leader:in-sync replicas."""
    one = lambda p: F.concat_ws(":", p["partition"].cast("string"), p["leader_id"].cast("string"), F.array_join(p["isr"].cast("array<string>"), "/"))
    return F.array_join(F.transform(column, one), ",")


_WANTED = ", wanted AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'none-' || c_custkey ELSE name END AS name FROM cust WHERE c_custkey % 3 = 0)"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that every third customer asks for; those of every 21st do not exist, many are asked for twice."""
    marked = F.when(F.col("c_custkey") % 11 == 0, "__").otherwise("")
    name = F.concat(marked, F.lit("topic-"), "c_nationkey", F.lit("-"), "c_mktsegment")
    return _table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("none-"), "c_custkey")).otherwise(name).alias("name"))


@query(_CATALOG + _LISTS + _WANTED + f"""SELECT w.name, CASE WHEN t.name IS NULL THEN 3 ELSE 0 END AS error, coalesce(topic_id, '{catalog.ZERO_UUID}') AS topic_id, coalesce(is_internal, false) AS is_internal,
partitions FROM wanted w LEFT JOIN topics t USING (name) LEFT JOIN lists l ON l.topic = w.name""")
def describe_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.describe_topics(_wanted(spark, sf_dir), *_catalog(spark, sf_dir))
    return out.select("name", "error", "topic_id", "is_internal", _told("partitions").alias("partitions"))


@query(_CATALOG + _LISTS + _WANTED + """, d AS (SELECT DISTINCT name FROM wanted)
SELECT name, partitions, CASE WHEN t.name IS NULL THEN 0 ELSE 3576 END AS operations, CASE WHEN t.name IS NULL THEN 3 ELSE 0 END AS error FROM d LEFT JOIN topics t USING (name) LEFT JOIN lists ON topic = name""")
def metadata_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.metadata(_wanted(spark, sf_dir).distinct(), *_catalog(spark, sf_dir), unknown=True)
    return out.select("name", _told("partitions").alias("partitions"), "operations", "error")


@query(_CATALOG + _LISTS + """SELECT name, partitions FROM topics LEFT JOIN lists ON topic = name WHERE name > 'topic-2' ORDER BY name LIMIT 20""")
def describe_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty topics behind a cursor, as a page of the description."""
    topics, partitions = _catalog(spark, sf_dir)
    out, _ = catalog.describe_page(topics.select("name"), topics, partitions, 20, "topic-2")
    return out.select("name", _told("partitions").alias("partitions"))


@query(_CATALOG + "SELECT name FROM topics WHERE starts_with(name, 'topic-1')")
def topic_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_topics(_catalog(spark, sf_dir)[0], "topic-1").select("name")


@query(_CATALOG + _WANTED + f"""SELECT {_UUID.format("w.name")} AS topic_id, t.name, CASE WHEN t.name IS NULL THEN 100 ELSE 0 END AS error FROM wanted w LEFT JOIN topics t USING (name)""")
def topic_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.topic_by_id(_wanted(spark, sf_dir).select(names.name_uuid(F.col("name")).alias("topic_id")), _catalog(spark, sf_dir)[0])


@query("""SELECT s_nationkey AS broker_id, arg_max(s_name, s_suppkey) AS host, CAST(arg_max(9000 + s_suppkey % 100, s_suppkey) AS INTEGER) AS port FROM supplier GROUP BY 1""")
def broker_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.brokers_now(_registrations(spark, sf_dir))


def _registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as brokers that register one after another under their nation's number."""
    return _table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("broker_id"), F.col("s_name").alias("host"), F.expr("int(9000 + s_suppkey % 100)").alias("port"), F.col("s_suppkey").alias("seq")
    )


@query("""WITH b AS (SELECT s_nationkey AS id, arg_max(s_name, s_suppkey) AS host, CAST(arg_max(9000 + s_suppkey % 100, s_suppkey) AS INTEGER) AS port FROM supplier GROUP BY 1),
r AS (SELECT unnest([3, 12, 77]) AS id) SELECT 0 AS error, CASE WHEN b.id IS NULL THEN 1 ELSE b.id END AS node_id, coalesce(host, 'localhost') AS host, coalesce(port, 9092) AS port FROM r LEFT JOIN b USING (id)""")
def find_coordinator(spark: SparkSession, sf_dir: str) -> DataFrame:
    brokers = catalog.brokers_now(_registrations(spark, sf_dir))
    answers = [catalog.find_coordinator(brokers, i) for i in (3, 12, 77)]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


# Group members of the orders: each member's first order says which protocols it supports, three in turned order, or the first two of them.
_MEMBERS = """
WITH m AS (SELECT 'g' || (o_custkey % 50) AS grp, 'm' || (o_orderkey % 9) AS member, min(o_orderkey) AS o FROM orders GROUP BY 1, 2),
p AS (SELECT grp, member, o, CASE o % 3 WHEN 0 THEN ['range', 'sticky', 'round'] WHEN 1 THEN ['sticky', 'round', 'range'] ELSE ['round', 'range', 'sticky'] END AS every FROM m),
members AS (SELECT grp, member, CASE WHEN o % 4 = 0 THEN every[1:2] ELSE every END AS protocols FROM p),
leaders AS (SELECT 'g' || (o_custkey % 50) AS grp, 'm' || max(o_orderkey) % 13 AS leader FROM orders GROUP BY 1)
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    first = orders.groupBy(F.expr("concat('g', o_custkey % 50)").alias("group"), F.expr("concat('m', o_orderkey % 9)").alias("member")).agg(F.min("o_orderkey").alias("o"))
    every = F.expr("CASE o % 3 WHEN 0 THEN array('range', 'sticky', 'round') WHEN 1 THEN array('sticky', 'round', 'range') ELSE array('round', 'range', 'sticky') END")
    return first.select("group", "member", F.when(F.col("o") % 4 == 0, F.slice(every, 1, 2)).otherwise(every).alias("protocols"))


@query(_MEMBERS + """, f AS (SELECT grp, min(member) AS first, count(*) AS n FROM members GROUP BY grp),
u AS (SELECT m.grp, m.member, unnest(protocols) AS protocol, unnest(range(len(protocols))) AS place FROM members m),
k AS (SELECT grp, protocol, count(*) AS k FROM u GROUP BY 1, 2),
b AS (SELECT f.grp, arg_min(u.protocol, u.place) AS protocol FROM f JOIN k ON k.grp = f.grp AND k.k = f.n JOIN u ON u.grp = f.grp AND u.member = f.first AND u.protocol = k.protocol GROUP BY f.grp)
SELECT f.grp AS "group", coalesce(b.protocol, '') AS protocol, CASE WHEN EXISTS (SELECT 1 FROM members m WHERE m.grp = f.grp AND m.member = l.leader) THEN l.leader ELSE f.first END AS leader
FROM f LEFT JOIN b USING (grp) LEFT JOIN leaders l USING (grp)""")
def protocol_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    leaders = _table(spark, sf_dir, "orders").groupBy(F.expr("concat('g', o_custkey % 50)").alias("group")).agg(F.expr("concat('m', max(o_orderkey) % 13)").alias("leader"))
    return catalog.choose_protocol(members).join(catalog.choose_leader(members, leaders), "group")


@query(_MEMBERS + """SELECT o_orderkey AS req_id, 'g' || (o_custkey % 60) AS "group", 'm' || (o_orderkey % 11) AS member,
CASE WHEN o_custkey % 60 NOT IN (SELECT CAST(substr(grp, 2) AS BIGINT) FROM members) THEN 15 WHEN m.member IS NULL THEN 25 WHEN o_orderkey % 3 <> o_custkey % 60 % 3 THEN 22 ELSE 0 END AS error
FROM orders LEFT JOIN members m ON m.grp = 'g' || (o_custkey % 60) AND m.member = 'm' || (o_orderkey % 11)""")
def offset_commit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for every order; groups from 50 on do not exist, a group's generation is its number modulo 3."""
    requests = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("req_id"), F.expr("concat('g', o_custkey % 60)").alias("group"), F.expr("concat('m', o_orderkey % 11)").alias("member"), F.expr("o_orderkey % 3").alias("generation")
    )
    members = _members(spark, sf_dir).withColumn("generation", F.expr("bigint(substring(group, 2)) % 3"))
    return offsets.commit(requests, members).select("req_id", "group", "member", "error")


_FILE = "CASE event_id % 5 WHEN 0 THEN {0} || '.log' WHEN 1 THEN {0} || '.index' WHEN 2 THEN event_id || '.log' WHEN 3 THEN {0} || '.log.part' ELSE {0} || '.log' END"


@query(f"""WITH f AS (SELECT 'events-' || (user_id % 3) AS directory, {_FILE.format("lpad(CAST(event_id AS VARCHAR), 20, '0')")} AS name FROM events)
SELECT directory, CAST(substr(name, 1, 20) AS BIGINT) AS base_offset, name FROM f WHERE regexp_full_match(name, '[0-9]{{20}}\\.log')""")
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "events").select(F.expr("concat('events-', user_id % 3)").alias("directory"), F.expr(_FILE.format("lpad(string(event_id), 20, '0')")).alias("name"))
    return storage.list_segments(files)


@query(_CATALOG + f""", d AS (SELECT topic || '-' || partition AS n FROM parts WHERE (n + partition) % 3 <> 0 UNION SELECT 'broker-' || s_suppkey FROM supplier UNION SELECT s_name FROM supplier),
x AS (SELECT regexp_extract(n, '^(.+)-([0-9]+)$', 1) AS t, CAST(regexp_extract(n, '^(.+)-([0-9]+)$', 2) AS INTEGER) AS p FROM d WHERE regexp_full_match(n, '.+-[0-9]+') AND NOT starts_with(n, 'broker-') AND NOT starts_with(n, '__')),
e AS (SELECT t, unnest(range(max(p) + 1)) AS p FROM x GROUP BY t),
i AS (SELECT name, arg_max(CAST(c_custkey AS VARCHAR), c_custkey) AS id FROM cust WHERE c_custkey % 2 = 0 GROUP BY name)
SELECT e.t AS topic, coalesce(i.id, {_UUID.format('e.t')}) AS topic_id, CAST(e.p AS INTEGER) AS partition, x.t IS NOT NULL AS on_disk, CASE WHEN x.t IS NULL THEN 0 ELSE 1 END AS present
FROM e LEFT JOIN x ON x.t = e.t AND x.p = e.p LEFT JOIN i ON i.name = e.t""")
def topic_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of two thirds of the partitions next to brokers' and others'; even customers register ids of their topics."""
    _, partitions = _catalog(spark, sf_dir)
    supplier, customer = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    folders = partitions.filter("(n + partition) % 3 <> 0").select(F.concat("topic", F.lit("-"), "partition").alias("name"))
    folders = folders.unionByName(supplier.select(F.concat(F.lit("broker-"), "s_suppkey").alias("name"))).unionByName(supplier.select(F.col("s_name").alias("name")))
    marked = F.when(F.col("c_custkey") % 11 == 0, "__").otherwise("")
    ids = customer.filter("c_custkey % 2 = 0").select(
        F.concat(marked, F.lit("topic-"), "c_nationkey", F.lit("-"), "c_mktsegment").alias("name"), F.col("c_custkey").cast("string").alias("topic_id"), F.col("c_custkey").alias("position")
    )
    found = storage.recover_catalog(folders, storage.cluster_topics(ids))
    return found.withColumn("present", F.col("on_disk").cast("int"))


@query("""SELECT * FROM (VALUES (0, 0, 'Produce', 0, 11), (0, 1, 'Fetch', 0, 16), (0, 2, 'ListOffsets', 0, 1), (0, 3, 'Metadata', 0, 12), (0, 8, 'OffsetCommit', 0, 2), (0, 9, 'OffsetFetch', 0, 1),
(0, 10, 'FindCoordinator', 0, 0), (0, 11, 'JoinGroup', 0, 0), (0, 12, 'Heartbeat', 0, 0), (0, 13, 'LeaveGroup', 0, 0), (0, 14, 'SyncGroup', 0, 0), (0, 18, 'ApiVersions', 0, 4),
(0, 75, 'DescribeTopicPartitions', 0, 0)) v(error, api_key, name, min_version, max_version)""")
def api_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.api_versions(spark)
