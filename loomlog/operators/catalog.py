"""Topics, partitions and brokers: listing, description, creation, static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors
from ..functions.names import name_uuid
from .logview import latest

ZERO_UUID = "00000000-0000-0000-0000-000000000000"
# What clients read as the allowed operations, and the fallback broker.
TOPIC_OPERATIONS = 0xDF8
FALLBACK_BROKER = (1, "localhost", 9092)
#: Api key, name, lowest and highest version.
APIS = [
    (0, "Produce", 0, 11), (1, "Fetch", 0, 16), (2, "ListOffsets", 0, 1), (3, "Metadata", 0, 12), (8, "OffsetCommit", 0, 2), (9, "OffsetFetch", 0, 1),
    (10, "FindCoordinator", 0, 0), (11, "JoinGroup", 0, 0), (12, "Heartbeat", 0, 0), (13, "LeaveGroup", 0, 0), (14, "SyncGroup", 0, 0), (18, "ApiVersions", 0, 4),
    (75, "DescribeTopicPartitions", 0, 0),
]


def api_versions(spark: SparkSession, version: int = 4) -> DataFrame:
    """(error, api_key, name, min_version, max_version); a version outside 0 to 4 is error 35."""
    error = errors.NONE if 0 <= version <= 4 else errors.UNSUPPORTED_VERSION
    return spark.createDataFrame([(error, *a) for a in APIS], "error int, api_key int, name string, min_version int, max_version int")


def brokers_now(registrations: DataFrame) -> DataFrame:
    """(broker_id, host, port) by id: of registrations with a seq the last one of each id."""
    return latest(registrations.select("broker_id", "host", "port", "seq"), ["broker_id"], "seq").drop("seq").orderBy("broker_id")


def find_coordinator(brokers: DataFrame, local_id: int) -> DataFrame:
    """(error, node_id, host, port): the local broker whatever the key is, or the fallback if it is not registered."""
    fallback = brokers.sparkSession.createDataFrame([FALLBACK_BROKER], "node_id int, host string, port int")
    own = brokers.filter(F.col("broker_id") == local_id).select(F.col("broker_id").alias("f_id"), F.col("host").alias("f_host"), F.col("port").alias("f_port"))
    out = fallback.join(own, F.lit(True), "left")  # one row and at most one
    return out.select(
        F.lit(errors.NONE).alias("error"), F.coalesce("f_id", "node_id").alias("node_id"), F.coalesce("f_host", "host").alias("host"), F.coalesce("f_port", "port").alias("port")
    )


def list_topics(topics: DataFrame, prefix: str = "") -> DataFrame:
    """Topics in the order of their names, by prefix."""
    return topics.filter(F.col("name").startswith(prefix)).orderBy("name")


def topic_exists(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names of ``wanted`` that exist."""
    return wanted.join(topics, "name", "left_semi")


def topic_by_id(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic_id, name, error): names of ids; an unknown one is error 100."""
    found = requests.join(topics.select("topic_id", "name"), "topic_id", "left")
    return found.select("topic_id", "name", F.when(F.col("name").isNull(), errors.UNKNOWN_TOPIC_ID).otherwise(errors.NONE).alias("error"))


def _partition_lists(partitions: DataFrame) -> DataFrame:
    more = ["offline"] if "offline" in partitions.columns else []
    shape = F.struct(F.lit(errors.NONE).alias("error"), "partition", "leader_id", "leader_epoch", "replicas", "isr", *more)
    return partitions.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("partition", shape.alias("p")))).alias("ps")).select(
        F.col("topic").alias("name"), F.transform("ps", lambda x: x["p"]).alias("partitions")
    )


def describe_topics(requests: DataFrame, topics: DataFrame, partitions: DataFrame, alive: list[int] | None = None) -> DataFrame:
    """(name, error, topic_id, is_internal, partitions, operations) of each requested name, by name.

    Unknown names are error 3 with the zero id and no partitions. A name asked for twice is answered twice. With ``alive`` each
    partition also lists its replicas on other brokers as offline.
    """
    if alive is not None:
        partitions = partitions.withColumn("offline", F.filter("replicas", lambda r: ~r.isin(alive)))
    found = requests.join(topics.select("name", "topic_id", "is_internal"), "name", "left").join(_partition_lists(partitions), "name", "left")
    known = F.col("topic_id").isNotNull()
    return found.select(
        "name", F.when(known, errors.NONE).otherwise(errors.UNKNOWN_TOPIC_OR_PARTITION).alias("error"), F.coalesce("topic_id", F.lit(ZERO_UUID)).alias("topic_id"),
        F.coalesce("is_internal", F.lit(False)).alias("is_internal"), F.when(known, F.col("partitions")).alias("partitions"), F.lit(0).alias("operations"),
    ).orderBy("name")


def describe_page(requests: DataFrame, topics: DataFrame, partitions: DataFrame, limit: int, after: str | None = None, alive: list[int] | None = None) -> tuple[DataFrame, str | None]:
    """(the first ``limit`` rows of ``describe_topics`` with names behind ``after``, the cursor of the next page, null after the last one).

    A name counts once. A page is a limit over the sorted names; only its topics are described.
    """
    names = requests.select("name").distinct()
    names = names.filter(F.col("name") > after) if after is not None else names
    page = [r[0] for r in names.orderBy("name").limit(limit + 1).collect()]  # a page and one name
    chosen = requests.sparkSession.createDataFrame([(n,) for n in page[:limit]], "name string")
    return describe_topics(chosen, topics, partitions, alive), page[limit - 1] if len(page) > limit else None


def metadata(requests: DataFrame | None, topics: DataFrame, partitions: DataFrame, unknown: bool = False) -> DataFrame:
    """(name, topic_id, is_internal, partitions, operations, error) of the named topics, or of all.

    Unknown names are left out or, with ``unknown``, answered with error 3 and no id.
    """
    lists = _partition_lists(partitions)
    chosen = topics if requests is None else requests.select("name").distinct().join(topics, "name", "left" if unknown else "inner")
    known = F.col("topic_id").isNotNull()
    return chosen.join(lists, "name", "left").select(
        "name", "topic_id", F.coalesce("is_internal", F.lit(False)).alias("is_internal"), "partitions", F.when(known, TOPIC_OPERATIONS).otherwise(0).alias("operations"),
        F.when(known, errors.NONE).otherwise(errors.UNKNOWN_TOPIC_OR_PARTITION).alias("error"),
    )


def metadata_answer(requests: DataFrame | None, topics: DataFrame, partitions: DataFrame, brokers: DataFrame, local_id: int, cluster_id: str = "log-cluster") -> DataFrame:
    """The whole answer in one row: brokers, cluster_id, controller_id and topics (as ``metadata`` has them) as arrays."""
    told = metadata(requests, topics, partitions).agg(F.sort_array(F.collect_list(F.struct("name", "topic_id", "is_internal", "partitions", "operations", "error"))).alias("topics"))
    nodes = brokers.agg(F.sort_array(F.collect_list(F.struct("broker_id", "host", "port", F.lit("").alias("rack")))).alias("brokers"))
    return told.join(nodes, F.lit(True)).select("brokers", F.lit(cluster_id).alias("cluster_id"), F.lit(local_id).alias("controller_id"), "topics")  # one row each


def cluster(brokers: DataFrame, local_id: int, cluster_id: str = "log-cluster") -> DataFrame:
    """(broker_id, host, port, rack, cluster_id, controller_id), one row per broker."""
    return brokers.select("broker_id", "host", "port", F.lit("").alias("rack"), F.lit(cluster_id).alias("cluster_id"), F.lit(local_id).alias("controller_id"))


def create_topics(requests: DataFrame, broker_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(topics, partitions) of new topics (name, partitions): replicas go round the sorted brokers.

    Replica r of partition i is broker (i + r) modulo their number; every broker holds a replica, the first one
    leads, all are in sync.
    """
    ids = sorted(broker_ids)
    topics = requests.select("name", name_uuid(F.col("name")).alias("topic_id"), F.col("name").startswith("__").alias("is_internal"))
    spread = requests.filter("partitions > 0").select(F.col("name").alias("topic"), F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
    every = F.array(*map(F.lit, ids))
    replicas = F.transform(F.sequence(F.lit(0), F.lit(len(ids) - 1)), lambda r: F.element_at(every, F.pmod(F.col("partition") + r, F.lit(len(ids))) + 1))
    placed = spread.withColumn("replicas", replicas).select(
        "topic", "partition", F.get("replicas", 0).alias("leader_id"), "replicas", F.col("replicas").alias("isr"), F.lit(0).alias("leader_epoch"),
        F.lit(0).alias("partition_epoch"), F.lit(0).cast("long").alias("next_offset"), F.lit(0).cast("long").alias("hw"), F.lit(0).cast("long").alias("leo"),
    )
    return topics, placed


def choose_protocol(members: DataFrame) -> DataFrame:
    """(group, protocol) of members (group, member, protocols): relational division.

    Of the protocols that all members support, the one that the member of the lowest id prefers most; "" if there is none.
    """
    sizes = members.groupBy("group").agg(F.count_distinct("member").alias("n"), F.min("member").alias("first"))
    spread = members.select("group", "member", F.posexplode("protocols").alias("place", "protocol"))
    shared = spread.groupBy("group", "protocol").agg(F.count_distinct("member").alias("k")).join(sizes, "group").filter("k = n")
    liked = spread.withColumnRenamed("member", "first").groupBy("group", "first", "protocol").agg(F.min("place").alias("place"))
    best = shared.join(liked, ["group", "first", "protocol"]).groupBy("group").agg(F.min_by("protocol", "place").alias("protocol"))
    return sizes.join(best, "group", "left").select("group", F.coalesce("protocol", F.lit("")).alias("protocol"))


def choose_leader(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(group, leader): the present leader while it is a member, else the lowest member id."""
    least = members.groupBy("group").agg(F.min("member").alias("least"))
    kept = leaders.select("group", F.col("leader").alias("member")).join(members, ["group", "member"], "left_semi")
    return least.join(kept, "group", "left").select("group", F.coalesce("member", "least").alias("leader"))
