"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

DataFrame functions only. Each source's documents are dealt by hash into blocks; a source's target is met by
whole passes over its blocks and by one partial pass in permuted order, whose last block and last document
are cut to the word. That fixes an exact quota of blocks per source. The tree divides the quotas of all
sources among the output shards: a node draws its left half from its blocks without replacement
(multivariate hypergeometric, as a chain of exact hypergeometric draws), down to single shards. Each shard
then takes its quota from the source's permuted blocks, disjointly, and orders its documents by a hash.

A block has BLOCK_DOCS documents or, where these would be more than MAX_BLOCKS blocks, as many more; so the table of blocks has
at most MAX_BLOCKS + (number of sources) rows whatever the input's size, and no row is left out; only
documents travel in numbers that grow with it, in one shuffle by (source, block), which splits hot sources.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, word_count, write_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SHARDS = 16
BLOCK_DOCS = 64
MAX_BLOCKS = 65_536
SEED = 20_240_501


def targets(stats: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Adds rank, weight and target to (source, source_size, ...), one row per source.

    The targets are the water level at which min(limit * source_size, level * weight) sums up to the
    share of all sizes: the fixed point of resharing every excess by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy()
    out = stats.withColumn("rank", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double"))
    out = out.withColumn("cap_", (limit * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("cap_") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap_").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    out = out.withColumn("level_", (F.lit(float(share)) * F.sum("source_size").over(every) - before) / rest)
    out = out.withColumn("full_", F.col("cap_") / F.col("weight") <= F.col("level_"))
    level = F.max(F.when(~F.col("full_"), F.col("level_"))).over(every)
    out = out.withColumn("target", F.when(F.col("full_"), F.col("cap_")).otherwise(level * F.col("weight")))
    return out.drop("cap_", "level_", "full_")


def _uniform(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(2**52)) / F.lit(float(2**52))


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values that are computed once; keeps nested expressions small."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 0)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The draw at uniform ``u`` from Hypergeometric(total, good, draws), by inversion outward from the mode.

    Terms beyond twelve standard deviations are under double precision and are left out, so the work grows
    with the square root of the number of blocks.
    """
    long = lambda x: F.lit(x).cast("long")

    def up(a: Column, x: Column) -> Column:  # weight of x + 1 over that of x
        return (a["k"] - x) * (a["d"] - x) / ((x + 1) * (a["n"] - a["k"] - a["d"] + x + 1))

    def down(a: Column, x: Column) -> Column:  # weight of x - 1 over that of x
        return x * (a["n"] - a["k"] - a["d"] + x) / ((a["k"] - x + 1) * (a["d"] - x + 1))

    def walk(a: Column, b: Column, left: Column, stop: Column, step: int, ratio: Callable[[Column, Column], Column]) -> Column:
        """(sum of the weights from the mode to ``stop``, the x at which the sum passes ``left``, or -1)."""
        return F.aggregate(
            F.sequence(b["mode"], stop, long(step)), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w"), long(-1).alias("x")),
            lambda s, x: F.struct(
                (s["sum"] + s["w"]).alias("sum"), F.when(x == stop, 0.0).otherwise(s["w"] * ratio(a, x.cast("double"))).alias("w"),
                F.when((s["x"] < 0) & (left < s["sum"] + s["w"]), x).otherwise(s["x"]).alias("x"),
            ),
        )

    def pick(a: Column, b: Column, c: Column) -> Column:
        over = walk(a, b, F.lit(0.0), c["top"], 1, up)["sum"]
        under = walk(a, b, F.lit(0.0), c["bottom"], -1, down)["sum"]

        def search(e: Column) -> Column:
            first = walk(a, b, e["goal"], c["top"], 1, up)["x"]
            second = walk(a, b, e["goal"] - e["over"] + 1, c["bottom"], -1, down)["x"]  # its first step is the mode again
            return F.when(b["low"] == b["high"], b["low"]).otherwise(F.coalesce(F.when(first >= 0, first), F.when(second >= 0, second), c["bottom"]))

        return _let({"over": over, "under": under}, lambda w: _let({"over": w["over"], "goal": a["u"] * (w["over"] + w["under"] - 1)}, search))

    def bounded(a: Column) -> Column:
        low, high = F.greatest(long(0), a["draws"] - (a["total"] - a["good"])), F.least(a["draws"], a["good"])
        mode = F.floor((a["d"] + 1) * (a["k"] + 1) / (a["n"] + 2)).cast("long")
        spread = F.when(a["total"] > 1, F.sqrt(a["d"] * (a["k"] / a["n"]) * (1 - a["k"] / a["n"]) * (a["n"] - a["d"]) / (a["n"] - 1)))
        width = F.ceil(12 * F.coalesce(spread, F.lit(0.0))).cast("long") + 12
        return _let(
            {"low": low, "high": high, "mode": F.least(F.greatest(mode, low), high), "width": width},
            lambda b: _let({"top": F.least(b["high"], b["mode"] + b["width"]), "bottom": F.greatest(b["low"], b["mode"] - b["width"])}, lambda c: pick(a, b, c)),
        )

    given = {"total": total, "good": good, "draws": draws, "u": u, "n": total.cast("double"), "k": good.cast("double"), "d": draws.cast("double")}
    return _let(given, bounded)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, rank, quota) from (rank, quota): the splitting tree, one level after another."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("qs")).select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), "qs"
    )
    for _ in range(max(0, (shards - 1).bit_length())):
        middle = F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int")
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda s, q: s + q["quota"])
        left_total = F.floor((total * (middle - F.col("low")) + F.floor((F.col("high") - F.col("low")) / 2)) / (F.col("high") - F.col("low"))).cast("long")

        def draw(s: Column, q: Column) -> Column:
            x = hypergeometric(s["total"], q["quota"], s["draws"], _uniform(F.lit(seed), F.col("low"), F.col("high"), q["rank"]))
            return _let({"x": x}, lambda v: F.struct((s["total"] - q["quota"]).alias("total"), (s["draws"] - v["x"]).alias("draws"), F.concat(s["out"], F.array(v["x"])).alias("out")))

        start = F.struct(F.col("total").alias("total"), F.col("left_total").alias("draws"), F.array().cast("array<bigint>").alias("out"))
        nodes = nodes.withColumns({"total": total, "left_total": left_total})
        nodes = nodes.withColumn("left", F.aggregate("qs", start, draw, lambda s: s["out"]))
        side = lambda sign: F.transform(
            "qs", lambda q, i: F.struct(q["rank"].alias("rank"), (F.element_at("left", i + 1) if sign else q["quota"] - F.element_at("left", i + 1)).alias("quota"))
        )
        halves = F.array(
            F.struct(F.col("low"), middle.alias("high"), side(True).alias("qs")), F.struct(middle.alias("low"), F.col("high"), side(False).alias("qs"))
        )
        split = nodes.filter("high - low > 1").select(F.explode(halves).alias("h")).select("h.*")
        nodes = split.unionByName(nodes.filter("high - low <= 1").select("low", "high", "qs"))
    return nodes.select(F.col("low").alias("shard"), F.explode("qs").alias("q")).select("shard", "q.rank", "q.quota")


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, shards: int = SHARDS,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, row, size, source_size, target, taken, copies.

    ``copies`` is an array of (shard, words, place): for each time that the mix takes the document its
    shard, the number of its first words taken, and its place in the shard's order. ``row`` is a hash of
    the text that tells rows of one doc_id apart. Null sources form one source, the last in order; null and
    blank texts have size 0 and are never taken. Repeated rows count each, with equal places. An empty table
    gives an empty result. The same rows give the same result, whatever their order or partitioning.
    """
    key = F.struct(F.lit(seed), F.col("doc_id"), F.col("row"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("row"), word_count(F.col(text_col)).alias("size"))
    base = write_table(base.withColumn("h", F.xxhash64(key)), "mix-sizes")
    stats = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(stats, weights, share, limit)
    per_block = F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.sum("n").over(W.partitionBy()) / MAX_BLOCKS))
    want = F.floor(F.col("target") + 0.5).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
    plan = write_table(
        plan.withColumns({"n_blocks": F.ceil(F.col("n") / per_block).cast("long"), "full": full, "want": want})
        .withColumn("rest", F.col("want") - F.col("full") * F.col("source_size"))
        .drop("n", "weight", "want"),
        "mix-plan",
    )
    dealt = base.join(plan.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    dealt = dealt.withColumn("block", F.pmod("h", "n_blocks"))

    blocks = dealt.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    permuted = W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "block"), "block")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(permuted.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    passes = F.transform(F.sequence(F.lit(0), F.col("full")), lambda p: F.struct(p.cast("int").alias("pass"), F.when(p == F.col("full"), F.col("rest") - F.col("before")).alias("room")))
    tickets = blocks.select("rank", "block", "words", F.explode(passes).alias("t")).select("rank", "block", "words", "t.*")
    tickets = tickets.filter("words > 0 AND (room IS NULL OR room > 0)").withColumn("room", F.when(F.col("room") < F.col("words"), F.col("room")))
    shuffled = W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "block", "pass"), "block", "pass")
    tickets = write_table(tickets.withColumn("r", (F.row_number().over(shuffled) - 1).cast("long")), "mix-tickets")

    quotas = split_quotas(tickets.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    ends = F.sum("quota").over(W.partitionBy("rank").orderBy("shard"))
    places = quotas.withColumn("end", ends).filter("quota > 0")
    places = places.select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("r"))
    drawn = tickets.join(places, ["rank", "r"]).groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "room"))).alias("draws"))

    joined = dealt.join(drawn, ["rank", "block"], "left")
    inside = W.partitionBy("rank", "block").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = lambda d: F.when(d["room"].isNull(), F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), d["room"] - F.col("before"))))
    copies = F.transform(
        F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int,room:bigint>>")),
        lambda d: F.struct(d["shard"].alias("shard"), words(d).alias("words"), F.xxhash64(F.lit(seed + 3), d["pass"], "h").alias("place")),
    )
    joined = joined.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return joined.select("doc_id", "source", "row", "size", "source_size", "target", taken.alias("taken"), "copies")


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` once per copy, cut to the words taken, with shard and place appended.

    Write it with ``partitionBy`` on the shard; rows are ordered by place within each task. Columns of
    ``docs`` that are called shard_ or place_ are replaced. Rows that repeat id, text and source are numbered, and each gets the
    copies of one of the equal rows of ``mixed``, so together they give the words that the mix takes.
    """
    of = lambda *key: {"__ll_a": F.xxhash64(F.lit(1), *key), "__ll_b": F.xxhash64(F.lit(2), *key)}
    names = [c for c in docs.columns if c not in ("shard_", "place_")]
    equal = W.partitionBy("__ll_a", "__ll_b")
    keyed = docs.select(*names).withColumns(of(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(source_col)))
    keyed = keyed.withColumn("__ll_n", F.row_number().over(equal.orderBy(F.lit(1))))
    alike = mixed.withColumns(of(F.col("doc_id"), F.col("row"), F.col("source"))).groupBy("__ll_a", "__ll_b", F.col("size").alias("__ll_size"), "copies").agg(F.count(F.lit(1)).alias("__ll_k"))
    upto = F.sum("__ll_k").over(equal.orderBy(F.size("copies").desc(), "copies").rowsBetween(W.unboundedPreceding, W.currentRow))
    copies = alike.withColumn("__ll_end", upto).filter(F.size("copies") > 0)
    mine = (F.col("__ll_n") <= F.col("__ll_end")) & (F.col("__ll_n") > F.col("__ll_end") - F.col("__ll_k"))
    out = keyed.join(copies, ["__ll_a", "__ll_b"]).filter(mine).withColumn("__ll_c", F.explode("copies"))
    head = F.call_function(
        "regexp_extract", F.col(text_col), F.concat(F.lit(f"^(?:(?:{SPACE})?{WORD}){{"), F.col("__ll_c.words"), F.lit("}+")), F.lit(0)
    )
    text = F.when(F.col("__ll_c.words") >= F.col("__ll_size"), F.col(text_col)).otherwise(head)
    cols = [text.alias(c) if c == text_col else F.col(c) for c in names]
    return out.select(*cols, F.col("__ll_c.shard").alias("shard_"), F.col("__ll_c.place").alias("place_")).sortWithinPartitions("shard_", "place_")
