"""loomlog: a PySpark-native analytics engine for partitioned, append-only logs."""
