"""Hash-chained ledgers: building, checking, feeding and pruning, and held envelopes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import latest
from .runs import previous

GENESIS = "0" * 64
FEED_LIMIT = 256


def content(prev, lsn, kind, collection, key, payload):
    """The hashed text of an entry: each field with its length in characters before it."""
    fields = [prev, lsn.cast("string"), kind, collection, key, payload]
    return F.concat(*[F.concat(F.char_length(F.coalesce(f, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(f, F.lit(""))) for f in fields])


def build_chain(entries: DataFrame) -> DataFrame:
    """Add prev_hash and entry_hash per node in order of lsn.

    A chain is sequential, so each node's entries pass through one task; they are sorted by the engine, which
    can spill, and stream by in Arrow batches. The task holds one batch and one hash.
    """
    fields = ["node", "lsn", "type", "collection", "key", "payload"]
    rows = entries.select(*fields)
    schema = rows.schema.add("prev_hash", "string").add("entry_hash", "string")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, last, begun = None, GENESIS, False
        for batch in batches:
            prevs, hashes = [], []
            for who, *rest in zip(*(batch.column(f).to_pylist() for f in fields), strict=True):
                if not begun or who != node:
                    node, last, begun = who, GENESIS, True
                prevs.append(last)
                text = "".join(f"{len(x)}:{x}" for x in (last, *("" if v is None else str(v) for v in rest)))
                last = hashlib.sha256(text.encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*fields, "prev_hash", "entry_hash"])

    return rows.repartition("node").sortWithinPartitions("node", "lsn").mapInArrow(chain, schema)


def links(chain: DataFrame) -> DataFrame:
    """Add ``linked``: whether prev_hash is the hash of the node's entry before (zeros for the first one)."""
    before = F.when(F.col("before_").isNull(), F.lit(GENESIS)).otherwise(F.col("before_.entry_hash"))
    return previous(chain, "node", "lsn", "entry_hash", "before_").withColumn("linked", F.col("prev_hash").eqNullSafe(before)).drop("before_")


def segment_linked(chain: DataFrame) -> DataFrame:
    """(node, entries, linked): whether every entry of a peer's segment but its first follows the one before."""
    before = F.col("before_.entry_hash")
    marked = previous(chain, "node", "lsn", "entry_hash", "before_").withColumn("ok", before.isNull() | (F.col("prev_hash") == before))
    return marked.groupBy("node").agg(F.count(F.lit(1)).alias("entries"), F.bool_and("ok").alias("linked"))


def replica_tips(chains: DataFrame) -> DataFrame:
    """(node, lsn, entry_hash): the last entry of every peer whose segment holds together; what ``quorum`` counts."""
    return tips(chains).join(segment_linked(chains).where("linked").select("node"), "node", "left_semi")


def signature_counts(chain: DataFrame) -> DataFrame:
    """One row: entries checked, those with a signature, those without."""
    signed = F.coalesce(F.col("signature"), F.lit("")) != ""
    return chain.agg(F.count(F.lit(1)).alias("checked"), F.count_if(signed).alias("signed"), F.count_if(~signed).alias("unsigned"))


def verify(chain: DataFrame) -> DataFrame:
    """(node, checked, bad_links, bad_content, first_bad): links by the entry before, content by hashing anew."""
    good_link = F.when(F.col("before_").isNull(), F.col("prev_hash").isNotNull()).otherwise(F.col("prev_hash") == F.col("before_.entry_hash"))
    good_body = F.col("entry_hash") == F.sha2(content(F.col("prev_hash"), F.col("lsn"), F.col("type"), F.col("collection"), F.col("key"), F.col("payload")).cast("binary"), 256)
    marked = previous(chain, "node", "lsn", "entry_hash", "before_").withColumn("link", F.coalesce(good_link, F.lit(False))).withColumn("body", F.coalesce(good_body, F.lit(False)))
    return marked.groupBy("node").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("link")).alias("bad_links"), F.count_if(~F.col("body")).alias("bad_content"), F.min(F.when(~F.col("link") | ~F.col("body"), F.col("lsn"))).alias("first_bad")
    )


def tips(chain: DataFrame) -> DataFrame:
    """(node, lsn, entry_hash) of each node's last entry."""
    return chain.groupBy("node").agg(F.max("lsn").alias("lsn"), F.max_by("entry_hash", "lsn").alias("entry_hash"))


def entry_range(ledger: DataFrame, first: int, last: int, limit: int = 0) -> DataFrame:
    """Entries with ``first`` <= lsn <= ``last`` in order of lsn, ``limit`` of them at most unless it is 0."""
    rows = ledger.where(F.col("lsn").between(first, last)).orderBy("lsn")
    return rows.limit(limit) if limit else rows


def entries_of(ledger: DataFrame, kind: str = "", collection: str = "", node: str = "") -> DataFrame:
    """Entries of a type, a collection and a node; an empty string asks for any."""
    for column, wanted in (("type", kind), ("collection", collection), ("node", node)):
        ledger = ledger.where(F.col(column) == wanted) if wanted else ledger
    return ledger


def tallest(ledger: DataFrame) -> DataFrame:
    """One row (height, node): the highest lsn and the node that holds it, of several the last by name."""
    heights = ledger.groupBy("node").agg(F.max("lsn").alias("lsn"))
    return heights.agg(F.max("lsn").alias("height"), F.max_by("node", F.struct("lsn", "node")).alias("node"))


def changes(ledger: DataFrame, since: int, limit: int = FEED_LIMIT) -> DataFrame:
    """Entries after ``since`` in order; the cursor of the next call is the last lsn returned."""
    return ledger.where(F.col("lsn") > since).orderBy("lsn").limit(limit)


def truncated(ledger: DataFrame, since: int) -> DataFrame:
    """One row: whether a reader at ``since`` must start anew (it is past the tip, or entries are gone)."""
    ends = ledger.agg(F.min("lsn").alias("oldest"), F.max("lsn").alias("tip"))
    return ends.select("oldest", "tip", F.coalesce((F.lit(since) > F.col("tip")) | (F.lit(since + 1) < F.col("oldest")), F.lit(since >= 0)).alias("truncated"))


def recover(ledger: DataFrame) -> DataFrame:
    """Latest PUT of every key."""
    return latest(ledger.where("type = 'PUT'"), ["collection", "key"], "lsn")


def unclaimed(ledger: DataFrame, below: int) -> DataFrame:
    """Distinct intents below an lsn that no claim settles."""
    intents = ledger.where((F.col("type") == "INTENT") & (F.col("lsn") <= below)).select("key_hash").distinct()
    return intents.join(ledger.where("type = 'CLAIM'").select("key_hash"), "key_hash", "left_anti")


def settled(ledger: DataFrame, below: int) -> DataFrame:
    """Intents up to an lsn that a claim up to it settles."""
    claims = ledger.where((F.col("type") == "CLAIM") & (F.col("lsn") <= below)).select("key_hash")
    return ledger.where((F.col("type") == "INTENT") & (F.col("lsn") <= below)).join(claims, "key_hash", "left_semi")


def prune(ledger: DataFrame, below: int) -> DataFrame:
    """Entries that stay: all but intents and claims settled up to an lsn."""
    gone = settled(ledger, below).select("key_hash").distinct()
    transit = F.col("type").isin("INTENT", "CLAIM") & (F.col("lsn") <= below)
    return ledger.where(~transit).unionByName(ledger.where(transit).join(gone, "key_hash", "left_anti").select(ledger.columns))


def quorum_size(replicas: int) -> int:
    return 2 * ((replicas - 1) // 2) + 1


def quorum(tips: DataFrame, own_lsn: int, own_hash: str, replicas: int) -> DataFrame:
    """One row: peers that agree, conflict, or cannot be checked at the own height, and the decision."""
    same = F.col("lsn") == own_lsn
    votes = tips.agg(F.count_if(same & (F.col("entry_hash") == own_hash)).alias("agreeing"), F.count_if(same & (F.col("entry_hash") != own_hash)).alias("conflicting"), F.count_if(~same).alias("unverified"))
    need = quorum_size(replicas)
    reason = F.when(F.col("conflicting") > 0, "conflict").when(F.col("agreeing") + 1 < need, "short").otherwise("ok")
    return votes.withColumn("required", F.lit(need).cast("long")).withColumn("decision", reason)


def digest(docs: DataFrame) -> DataFrame:
    """(collection, key, hlc, hash): what replicas compare."""
    return docs.select("collection", "key", "hlc", F.substring(F.sha2(F.col("doc").cast("binary"), 256), 1, 16).alias("hash"))


def digest_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(collection, key, action): ``push`` what the other side lacks or has older, ``want`` the reverse.

    Equal clocks with different hashes go both ways.
    """
    l = local.select("collection", "key", F.col("hlc").alias("l"), F.col("hash").alias("lh"))  # noqa: E741
    r = remote.select("collection", "key", F.col("hlc").alias("r"), F.col("hash").alias("rh"))
    both = l.join(r, ["collection", "key"], "full")
    tie = (F.col("l") == F.col("r")) & (F.col("lh") != F.col("rh"))
    actions = F.array_compact(F.array(F.when(F.col("r").isNull() | (F.col("l") > F.col("r")) | tie, "push"), F.when(F.col("l").isNull() | (F.col("r") > F.col("l")) | tie, "want")))
    return both.select("collection", "key", F.explode(actions).alias("action"))


def held_by_owner(envelopes: DataFrame) -> DataFrame:
    """(owner, held, bytes, next_expiry): expiry 0 means none."""
    return envelopes.groupBy("owner").agg(F.count(F.lit(1)).alias("held"), F.sum("bytes").cast("long").alias("bytes"), F.min(F.nullif("expires_ms", F.lit(0))).alias("next_expiry"))


def expire(envelopes: DataFrame, now_ms: int) -> DataFrame:
    """Envelopes that stay."""
    return envelopes.where((F.col("expires_ms") == 0) | (F.col("expires_ms") > now_ms))


def undelivered(staged: DataFrame, drained: DataFrame) -> DataFrame:
    """Staged messages that have not been replayed."""
    return staged.join(drained, "message_id", "left_anti")


def durable(receipts: DataFrame, requested: int) -> DataFrame:
    """(message_id, appliers, met): distinct appliers and the writer itself against what was asked."""
    return receipts.groupBy("message_id").agg(F.count_distinct("applier").alias("appliers")).withColumn("met", F.col("appliers") + 1 >= requested)


def hold_chunks(messages: DataFrame, chunk_bytes: int, budget: int) -> DataFrame:
    """(owner, key_hash, chunk_index, chunk_total, bytes): a message's chunks, if all its owner's fit the budget."""
    total = F.greatest(F.ceil(F.col("bytes") / chunk_bytes), F.lit(1)).cast("int")
    fits = messages.groupBy("owner").agg(F.sum("bytes").alias("all")).where(F.col("all") <= budget).select("owner")
    cut = messages.join(fits, "owner", "left_semi").select("owner", "key_hash", "bytes", total.alias("chunk_total"), F.explode(F.sequence(F.lit(0), total - 1)).alias("chunk_index"))
    return cut.select("owner", "key_hash", "chunk_index", "chunk_total", F.least(F.lit(chunk_bytes), F.col("bytes") - F.col("chunk_index") * chunk_bytes).cast("long").alias("bytes"))


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """(key_hash, payload) of messages all of whose chunks are there."""
    per = chunks.dropDuplicates(["key_hash", "chunk_index"]).groupBy("key_hash", "chunk_total").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("chunk_index", "payload"))).alias("p"))
    return per.where("n = chunk_total").select("key_hash", F.array_join(F.transform("p", lambda x: x["payload"]), "").alias("payload"))


def pending(events: DataFrame) -> DataFrame:
    """Held envelopes: (owner, key_hash) whose newest event is a HOLD."""
    return latest(events, ["owner", "key_hash"], "lsn").where("type = 'HOLD'")


def checkpoint_plan(ledger: DataFrame, votes: DataFrame, below: int) -> DataFrame:
    """One row: the quorum's decision, intents that wait for a claim, entries that pruning removes, and whether it may go on."""
    waiting = unclaimed(ledger, below).agg(F.count(F.lit(1)).alias("waiting"))
    kept = prune(ledger, below).agg(F.count(F.lit(1)).alias("kept"))
    whole = ledger.agg(F.count(F.lit(1)).alias("entries"))
    row = votes.select("decision").join(waiting, F.lit(True)).join(kept, F.lit(True)).join(whole, F.lit(True))  # four single rows
    return row.select("decision", "waiting", (F.col("entries") - F.col("kept")).alias("removed"), ((F.col("decision") == "ok") & (F.col("waiting") == 0)).alias("allowed"))


def first_deliveries(messages: DataFrame) -> DataFrame:
    """Each message id once, as first sent (by ``at``); an empty or null id is never a repeat."""
    named = F.coalesce(F.col("message_id"), F.lit("")) != ""
    once = messages.where(named).groupBy("message_id").agg(F.min_by(F.struct(*messages.columns), "at").alias("r")).select("r.*")
    return once.unionByName(messages.where(~named))


def claims_by_holder(intents: DataFrame) -> DataFrame:
    """(holder, claims, first, last): what each holder is to be asked for, summed up before the shuffle."""
    return intents.groupBy("holder").agg(F.count(F.lit(1)).alias("claims"), F.min("key_hash").alias("first"), F.max("key_hash").alias("last"))
