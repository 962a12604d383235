"""Consistent hashing, replicas and the state of peers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ring_position

VNODES = 160
EWMA = 0.25


def ring(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(node, position): every node's points on the ring."""
    return nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v")).select("node", ring_position(F.concat("node", F.lit("#"), F.col("v").cast("string"))).alias("position"))


def placement_input(collection: Column, key: Column, shard: Column) -> Column:
    """What is hashed: collection and shard value if there is one, else collection and key."""
    return F.when(shard != "", F.concat(collection, F.lit("|"), shard)).otherwise(F.concat(collection, F.lit("/"), key))


def arcs(points: DataFrame, copies: int) -> DataFrame:
    """(low, high, replicas): for each arc of the ring, the first ``copies`` distinct nodes clockwise.

    The ring has nodes * VNODES rows (``replicas`` bounds them). It is walked backwards twice: each point's list is its own node
    and the list of the point after it without that node.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring_ = sorted((p, n) for b in batches for p, n in zip(b.column("position").to_pylist(), b.column("node").to_pylist(), strict=True))
        after: list[str] = []
        lists = []
        for turn in range(2):
            for _, node in reversed(ring_):
                after = [node, *(x for x in after if x != node)][:copies]
                if turn:
                    lists.append(after)
        if ring_:
            lists.reverse()
            positions = [p for p, _ in ring_]
            columns = [["", *positions], [*positions, "g"], [*lists, lists[0]]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.string()))], ["low", "high", "replicas"])

    return points.select("position", "node").coalesce(1).mapInArrow(walk, "low string, high string, replicas array<string>")


def replicas(keys: DataFrame, nodes: DataFrame, copies: int, max_nodes: int = 4096) -> DataFrame:
    """Add ``replicas`` to keys (collection, key, shard).

    The ring is broadcast: it has at most ``max_nodes`` * VNODES arcs, checked here. Keys meet the
    arcs by the first byte of their position, so the join is an equality with a short range check.
    """
    if nodes.count() > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    cut = arcs(ring(nodes), copies)
    low_byte = F.when(F.col("low") == "", 0).otherwise(F.conv(F.substring("low", 1, 2), 16, 10).cast("int"))
    high_byte = F.when(F.col("high") == "g", 255).otherwise(F.conv(F.substring("high", 1, 2), 16, 10).cast("int"))
    spread = cut.withColumn("byte", F.explode(F.sequence(low_byte, high_byte)))
    at = keys.withColumn("position", ring_position(placement_input(F.col("collection"), F.col("key"), F.col("shard")))).withColumn("byte", F.conv(F.substring("position", 1, 2), 16, 10).cast("int"))
    # an arc holds positions above its low end up to its high end
    hit = at.join(F.broadcast(spread), "byte").where((F.col("position") > F.col("low")) & (F.col("position") <= F.col("high")))
    return hit.drop("byte", "low", "high")


def plan(placed: DataFrame, holders: DataFrame, copies: int) -> DataFrame:
    """(collection, key, primary, missing, under_replicated, displaced) against live holders (collection, key, held)."""
    both = placed.join(holders, ["collection", "key"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    return both.select(
        "collection", "key", F.element_at("replicas", 1).alias("primary"), F.array_sort(F.array_except("replicas", "held")).alias("missing"), (F.size(F.array_intersect("replicas", "held")) < copies).alias("under_replicated"), F.array_sort(F.array_except("held", "replicas")).alias("displaced")
    )


def by_primary(placed: DataFrame) -> DataFrame:
    """(primary, keys): how many keys each node is first for."""
    return placed.groupBy(F.element_at("replicas", 1).alias("primary")).agg(F.count(F.lit(1)).alias("keys"))


def candidates(peers: DataFrame, now_ms: int, stale_ms: int) -> DataFrame:
    """(node, excluded): why a peer may not hold data; null if it may."""
    reason = F.when(F.col("role") == "bootstrap", "bootstrap").when(F.col("role") == "supervisor", "supervisor").when(F.col("state") == "reclaimed", "reclaimed").when(F.col("state") == "degraded", "degraded").when(F.lit(now_ms) - F.col("seen_ms") > stale_ms, "stale")
    return peers.select("node", reason.alias("excluded"))


def transit_holders(messages: DataFrame, nodes: DataFrame, copies: int) -> DataFrame:
    """(key_hash, chunk, rank, node): per chunk the holders by rendezvous hashing, turned by the chunk's number.

    A message is weighed against every other node than its owner, in one expression over a single broadcast row
    of node names (4096 at most, checked): no row per message and node, no shuffle. Without such a node it has no holder.
    """
    if nodes.count() > 4096:
        raise ValueError("too many candidate nodes")
    names = nodes.agg(F.collect_set("node").alias("names"))
    others = F.filter("names", lambda n: n != F.col("owner"))
    weighed = F.transform(others, lambda n: F.struct(F.sha2(F.concat_ws("|", "owner", "key_hash", n).cast("binary"), 256).alias("w"), n.alias("node")))
    top = F.transform(F.slice(F.reverse(F.array_sort(weighed)), 1, copies), lambda x: x["node"])
    per = messages.join(F.broadcast(names)).withColumn("top", top).where(F.size("top") > 0)
    turned = F.transform(F.sequence(F.lit(0), F.size("top") - 1), lambda i: F.element_at("top", F.pmod(i + F.col("chunk"), F.size("top")).cast("int") + 1))
    return per.select("key_hash", "chunk", F.posexplode(turned).alias("rank", "node"))


def stale(peers: DataFrame, now_ms: int, stale_ms: int) -> DataFrame:
    """(node): peers last seen more than ``stale_ms`` ago; one never seen is not listed."""
    return peers.where(F.lit(now_ms) - F.col("seen_ms") > stale_ms).select("node")


def ingest_node(peers: DataFrame, preferred: str) -> DataFrame:
    """(node): where a write goes, one row at most: the preferred peer if active, else the active one with most space left, ties by name."""
    left = F.col("quota") - F.col("used")
    return peers.where("state = 'active'").orderBy((F.col("node") == preferred).cast("int").desc(), left.desc(), "node").limit(1).select("node")


def suspicion(silence_ms: Column, timeout_ms: int, failures: Column, upgrade_at: int = 3) -> Column:
    """alive, suspect or dead by silence; failing probes raise it one step."""
    step = F.when(silence_ms > 3 * timeout_ms, 2).when(silence_ms > timeout_ms, 1).otherwise(0) + F.when(failures >= upgrade_at, 1).otherwise(0)
    return F.when(step >= 2, "dead").when(step == 1, "suspect").otherwise("alive")


def fitness(reliability: Column, latency_ms: Column, freshness: Column, capacity: Column) -> Column:
    return 0.45 * reliability + 0.25 / (1 + latency_ms / 50) + 0.20 * freshness + 0.10 * capacity


def ranked(peers: DataFrame) -> DataFrame:
    """Peers in order of score, ties by node; the peer table is small by nature."""
    return peers.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node")))


def _fold(alpha: float):
    """One row per task and node: the first value, and what the task's probes do to an average that enters them."""
    keep = 1.0 - alpha

    def run(values: np.ndarray) -> tuple:
        n = len(values)
        return (float(values[0]) if n else None, keep**n, float((alpha * keep ** np.arange(n - 1, -1, -1.0)) @ values))

    def then(one: tuple, two: tuple) -> tuple:
        return (two[0] if one[0] is None else one[0], one[1] * two[1], one[2] * two[1] + two[2])

    def row(node, state) -> pd.DataFrame:
        return pd.DataFrame([(node, *state[0], *state[1])], columns=["node", "l0", "ld", "la", "s0", "sd", "sa"])

    def fold(batches):
        at, state = None, None
        for batch in batches:
            for node, probes in batch.groupby("node", sort=False):
                timed = probes["ok"] & probes["ms"].notna()
                new = (run(probes["ms"][timed].to_numpy(float)), run(probes["ok"].to_numpy(float)))
                if state is not None and node != at:
                    yield row(at, state)
                    state = None
                at, state = node, new if state is None else (then(state[0], new[0]), then(state[1], new[1]))
        if state is not None:
            yield row(at, state)

    return fold


def ewma(probes: DataFrame, alpha: float = EWMA) -> DataFrame:
    """(node, latency, success): moving averages over probes in order of (at, ms, ok).

    Failed probes and those without ms leave the latency; probes without a node or ok don't count.
    A run of probes acts on an average as x -> decay * x + add, so every task folds its part of
    a range-partitioned order, and one row per task and node is left to fold by node: a node with
    most of the probes is spread over all tasks.
    """
    spark = probes.sparkSession
    known = probes.where("node is not null and ok is not null").select(F.col("node").cast("string").alias("node"), F.col("at").cast("long").alias("at"), F.col("ms").cast("double").alias("ms"), F.col("ok").cast("boolean").alias("ok"))
    order = ["node", "at", "ms", "ok"]
    dealt = known.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    runs = dealt.mapInPandas(_fold(alpha), "node string, l0 double, ld double, la double, s0 double, sd double, sa double")
    numbered = runs.withColumn("run", F.monotonically_increasing_id())  # partitions are in the order of the probes
    per = numbered.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("run", "l0", "ld", "la", "s0", "sd", "sa"))).alias("r"))
    nothing = F.lit(None).cast("double")
    last = F.aggregate("r", F.struct(nothing.alias("l"), nothing.alias("s")), lambda acc, x: F.struct(
        F.when(x["l0"].isNull(), acc["l"]).otherwise(F.coalesce(acc["l"], x["l0"]) * x["ld"] + x["la"]).alias("l"),
        (F.coalesce(acc["s"], x["s0"]) * x["sd"] + x["sa"]).alias("s"),
    ))
    return per.select("node", last.alias("f")).select("node", F.col("f.l").alias("latency"), F.col("f.s").alias("success"))


# The life cycle of a node.
TRANSITIONS = (("joining", "active"), ("active", "degraded"), ("degraded", "active"), ("active", "draining"), ("degraded", "draining"), ("draining", "reclaimed"), ("degraded", "reclaimed"))


def invalid_transitions(changes: DataFrame) -> DataFrame:
    """Changes (node, from_state, to_state) that the life cycle does not have."""
    allowed = changes.sparkSession.createDataFrame(TRANSITIONS, "from_state string, to_state string")
    return changes.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")  # a few fixed rows


def sweep(peers: DataFrame, now_ms: int, stale_ms: int, quota_ratio: float) -> DataFrame:
    """(node, action): degrade silent peers, warn those near their quota."""
    action = F.when(F.lit(now_ms) - F.col("seen_ms") > stale_ms, "degrade").when(F.col("used") >= quota_ratio * F.col("quota"), "quota")
    return peers.select("node", action.alias("action")).where("action is not null")


def convergence(summaries: DataFrame) -> DataFrame:
    """(collection, nodes, versions, converged) of (node, collection, checksum)."""
    per = summaries.groupBy("collection").agg(F.count_distinct("node").alias("nodes"), F.count_distinct("checksum").alias("versions"))
    return per.withColumn("converged", F.col("versions") == 1)
