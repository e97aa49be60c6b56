"""Shards of near equal bytes that keep linked documents together: balanced label propagation.

Documents with equal texts are linked. Labels (shards) start at random. In each round every linked document looks at its
neighbours' shards - counted per group and shard, so a group sends at most one row per shard, however large it is - and wants
to move to the one that most of its group's bytes are in; a group that is larger than a shard has as many homes as it
needs. How many bytes want to go where is a table of shards by shards. Each shard admits the share of them that its quota
leaves room for, and a hash decides which documents those are. Linked documents never fill a shard beyond its even
share, so documents without links, moved last, can level all shards.

Levelling and slots need running sums over a shard. They are taken within hash buckets of bounded size and added up over
buckets, so no task holds a whole shard.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tritempo.llm.common import Scratch

SHARDS, ROUNDS, LEVELLINGS = 40, 8, 4
#: bytes that a document counts beside its text
OVERHEAD = 16
#: rows of a bucket, about
BUCKET_ROWS = 50_000


def _share(rows: Column, parts: int = 1_000_000) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(rows, F.lit(parts)) / parts


def running_sum(rows: DataFrame, shard: str, first: list[str], id_: str, value: Column, name: str, total: int, shards: int) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same shard up to this one, ordered by ``first``, a hash bucket and id."""
    buckets = max(1, -(-total // (BUCKET_ROWS * shards)))
    rows = rows.withColumn("_value", value.cast("long")).withColumn("_bucket", F.pmod(F.xxhash64(id_), F.lit(buckets)))
    keys = [shard, *first, "_bucket"]
    sums = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    ahead = Window.partitionBy(shard).orderBy(*first, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    own = Window.partitionBy(*keys).orderBy(id_).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_own", F.sum("_value").over(own)).join(sums, keys)
    return summed.withColumn(name, F.col("_ahead") + F.col("_own")).drop("_value", "_bucket", "_ahead", "_own")


def _bytes(rows: DataFrame, *by: str) -> dict:
    """Bytes by shard, or by pair of shards: a row for each on the driver."""
    return {tuple(row)[:-1] if len(by) > 1 else row[0]: row[-1] for row in rows.groupBy(*by).agg(F.sum("size")).collect()}


def propagate(scratch: Scratch, rows: DataFrame, shards: int, share: float, rounds: int = ROUNDS) -> DataFrame:
    """Labels of linked documents after the rounds. ``rows``: (id, size, group, shard); ``share``: bytes of an even shard."""
    for turn in range(rounds):
        votes = rows.groupBy("group", "shard").agg(F.sum("size").alias("bytes"))
        ranked = Window.partitionBy("group").orderBy(F.desc("bytes"), F.xxhash64("group", "shard"))
        whole = Window.partitionBy("group")
        votes = votes.withColumn("n", F.row_number().over(ranked)).withColumn("homes", F.ceil(F.sum("bytes").over(whole) / share))
        homes = votes.filter("n <= homes").groupBy("group").agg(F.array_sort(F.collect_list("shard")).alias("homes"))
        # written, so that the join's partitions are not those of the votes and a group with very many documents can be split
        homes = scratch.put(homes, f"homes-{turn}")
        pick = F.col("homes")[F.pmod(F.xxhash64("id"), F.size("homes")).cast("int")]
        target = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(pick)
        wish = scratch.put(rows.join(homes, "group").withColumn("target", target), f"wish-{turn}")
        flows = _bytes(wish.filter("target <> shard"), "shard", "target")
        if not flows:
            return rows
        held = _bytes(rows, "shard")
        wanted = {shard: sum(size for (_, to), size in flows.items() if to == shard) for shard in range(shards)}
        quota = [min(1.0, max(0.0, share - held.get(shard, 0)) / wanted[shard]) if wanted[shard] else 0.0 for shard in range(shards)]
        admitted = _share(F.xxhash64("id", F.lit(turn))) < F.array(*map(F.lit, quota))[F.col("target")]
        moved = wish.withColumn("shard", F.when(admitted, F.col("target")).otherwise(F.col("shard"))).select("id", "size", "group", "shard")
        rows = scratch.put(moved, f"labels-{turn}")
        scratch.drop(f"wish-{turn}", f"homes-{turn}", *([f"labels-{turn - 1}"] if turn else []))
    return rows


def level(scratch: Scratch, rows: DataFrame, shards: int, total: int, count: int) -> DataFrame:
    """Moves documents, those without links first, out of shards above the even share into those below."""
    share = total / shards
    for turn in range(LEVELLINGS):
        held = _bytes(rows, "shard")
        surplus = [max(0.0, held.get(shard, 0) - share) for shard in range(shards)]
        lack = [max(0.0, share - held.get(shard, 0)) for shard in range(shards)]
        over = F.array(*map(F.lit, surplus))[F.col("shard")]
        # small parts are enough for what is left after the first turn
        able = rows.filter((over > 0) & (F.col("size") <= (over if not turn else over / 2)))
        order = running_sum(able, "shard", ["linked"], "id", F.col("size"), "reach", count, shards)
        leaving = scratch.put(order.filter(F.col("reach") <= over), f"leaving-{turn}")
        sent = _bytes(leaving, "shard")
        if not sent:
            break
        begin = list(accumulate((sent.get(shard, 0) for shard in range(shards)), initial=0))[:shards]
        place = F.array(*map(F.lit, begin))[F.col("shard")] + F.col("reach") - F.col("size") / 2
        # what leaves is dealt out in proportion to what the others lack
        part = sum(sent.values()) / sum(lack)
        edges = list(accumulate(each * part for each in lack))
        last = max(shard for shard in range(shards) if lack[shard])
        target = sum((place >= edge).cast("int") for edge in edges)
        moves = leaving.select("id", F.least(target, F.lit(last)).alias("to"))
        rows = scratch.put(rows.join(moves, "id", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), f"level-{turn}")
        scratch.drop(f"leaving-{turn}", *([f"level-{turn - 1}"] if turn else []))
    return rows


def balanced_shards(docs: DataFrame, *, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; slots count from 0 without gaps in each shard.

    Sizes of shards differ by no more than the largest of the documents that level them. Null texts have no bytes and, like
    texts that occur once, no links; empty texts are equal. Every row is a document, also with a null or repeated key.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    digest = F.when(F.col(text).isNotNull(), F.xxhash64(text))
    rows = docs.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), digest.alias("group"),
    ).withColumn("id", F.monotonically_increasing_id())
    rows = scratch.put(rows, "rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    linked = rows.filter("group is not null").groupBy("group").count().filter("count > 1").select("group")
    linked = scratch.put(linked, "linked")  # for the same reason as the homes
    start = F.pmod(F.xxhash64("key", "id"), F.lit(shards)).cast("int")
    labels = rows.select("id", "size", "group", start.alias("shard"))
    # which rows are linked is one join with the repeated groups
    labels = scratch.put(labels.join(linked.withColumn("linked", F.lit(1)), "group", "left").withColumn("linked", F.coalesce("linked", F.lit(0))), "start")
    moved = propagate(scratch, labels.filter("linked = 1").select("id", "size", "group", "shard"), shards, max(1.0, total / shards))
    labels = labels.filter("linked = 0").select("id", "size", "linked", "shard").union(moved.select("id", "size", F.lit(1), "shard"))
    labels = level(scratch, scratch.put(labels, "propagated"), shards, total, count)
    placed = running_sum(labels.select("id", "shard"), "shard", [], "id", F.lit(1), "slot", count, shards)
    placed = placed.select("id", "shard", (F.col("slot") - 1).alias("slot"))
    return rows.join(placed, "id").select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def shard_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of near equal bytes."""
    return balanced_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
