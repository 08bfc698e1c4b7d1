"""Error codes of the log API."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes that clients of the protocol expect.
NONE = 0
UNKNOWN_SERVER = 1
UNKNOWN_TOPIC_OR_PARTITION = 3
NOT_LEADER = 6
COORDINATOR_UNAVAILABLE = 15
NOT_COORDINATOR = 16
ILLEGAL_GENERATION = 22
UNKNOWN_MEMBER = 25
REBALANCE_IN_PROGRESS = 27
UNSUPPORTED_VERSION = 35
INVALID_REQUEST = 42
FENCED_EPOCH = 74
MEMBER_ID_REQUIRED = 79
GROUP_FULL = 81
UNKNOWN_TOPIC_ID = 100

NAMES = {v: k.lower() for k, v in dict(globals()).items() if k.isupper() and isinstance(v, int)}


def error_name(code: Column) -> Column:
    """Name of an error code, null for codes that are not in use."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair)), code)
