"""Mixing sources to target weights.

Every source's token stream is cut into blocks. Block j of a source of weight w
is released at slot floor(j / w) and due by slot ceil((j + 1) / w) (Pfair
windows); the earliest deadline among the released blocks gets the slot, so that
no source is ever a whole block ahead of or behind its share.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tokens import VOCABULARY, token_count

#: Slots of one period of the schedule, which is small at every size; finer blocks come from more periods.
SLOTS = 10_000
#: Documents of one (source, bucket) in the running sums.
BUCKET_DOCS = 20_000


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens. Null texts have 0 tokens; null sources stay (they count towards the size of the corpus)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text), vocabulary).alias("tokens"))


def supply(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of targets: what it has, what it may give and what the mix takes.

    Columns: source, target_share, max_repeats, tokens, capacity (tokens times
    max_repeats), wanted (target_share of a mix as large as all rows of sizes),
    used = least(wanted, capacity), is_short. A source without documents has
    capacity 0; null shares and repeats count as 0. Sources outside targets give
    nothing. An empty corpus makes every wanted 0 and nothing short.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    wanted = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    return (
        wanted.join(have, "source", "left")
        .crossJoin(total)  # one row
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint"))
        .withColumn("capacity", F.col("tokens") * F.col("max_repeats"))
        .withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("used", F.least(F.col("wanted"), F.col("capacity").cast("double")))
        .withColumn("is_short", F.col("capacity") < F.col("wanted") - 1e-6)
        .drop("total")
    )


def schedule(weights: dict[str, float], slots: int = SLOTS) -> list[tuple[str, int]]:
    """Slot -> (source, number of its block), by earliest Pfair deadline. weights need not sum to 1; sources of weight 0 get no slot.

    Blocks are apportioned to whole slots first (largest remainder, and at least one
    for each source), so the schedule ends with every lag at 0. Ties of deadlines go to the earlier
    release, then to the name.
    """
    total = sum(weights.values())
    if total <= 0 or slots <= 0:
        return []
    exact = {s: w / total * slots for s, w in weights.items() if w > 0}
    n = {s: max(1, int(x)) for s, x in exact.items()}
    for _ in range(sum(n.values()) - slots):  # slots that tiny sources took beyond their due
        n[max(n, key=lambda s: (n[s] - exact[s] if n[s] > 1 else -1.0, s))] -= 1
    for s in sorted(exact, key=lambda s: (n[s] - exact[s], s))[: slots - sum(n.values())]:
        n[s] += 1
    # integer windows of block j of a source with n blocks: release floor(j * slots / n), deadline ceil((j + 1) * slots / n)
    waiting = [(0, s, 0) for s in n if n[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // n[s]), release, s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if j + 1 < n[s]:
            heapq.heappush(waiting, ((j + 1) * slots // n[s], s, j + 1))
    return out


def mix(sizes: DataFrame, targets: DataFrame, slots: int = SLOTS, seed: int = 7, block_tokens: float | None = None) -> DataFrame:
    """The mix itself: slot, place (order inside the slot), doc_id, source, repeat, tokens.

    A source's tokens are cut into equal blocks, about block_tokens each (without it, a
    slots-th of the mix), and the schedule of ``slots`` slots is gone through as often as
    that needs. A document belongs to the block that its first token falls into, so no
    source deviates from its share by more than two blocks and a document. Documents follow
    in an order hashed by seed; no document comes more than max_repeats times.
    Running sums are taken per (source, bucket) and shifted by the sums of the
    buckets before, so that a source with a third of all rows is spread out. The
    driver gets one row per source.
    """
    spark = sizes.sparkSession
    plan = supply(sizes, targets).where(F.col("used") > 0).select("source", "tokens", "used").collect()  # one row per source of targets
    weights = {r["source"]: r["used"] for r in plan}
    periods = max(1, math.ceil(sum(weights.values()) / (block_tokens * slots))) if block_tokens else 1
    planned = schedule(weights, slots)
    order = spark.createDataFrame([(s, j, i) for i, (s, j) in enumerate(planned)], "source string, turn bigint, at bigint")  # SLOTS rows
    blocks = Counter(s for s, _ in planned)  # of each source in a period
    limits = spark.createDataFrame([(r["source"], int(r["tokens"]), float(r["used"]), blocks[r["source"]]) for r in plan], "source string, all_tokens bigint, used double, n_blocks bigint")

    n_docs = sizes.select("source").count()
    buckets = max(1, -(-n_docs // BUCKET_DOCS))
    spread = sizes.where(F.col("tokens") > 0).join(F.broadcast(limits), "source").withColumn("_key", F.xxhash64("doc_id", F.lit(seed))).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["source", "_bucket"]).withColumn("_at", F.col("_start") + F.col("_in"))
    last = F.floor((F.col("used") - 1e-6 - F.col("_at")) / F.col("all_tokens"))  # last repeat that still begins inside the share
    return (
        placed.where(last >= 0)
        .select("doc_id", "source", "tokens", "all_tokens", "used", "n_blocks", "_at", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("repeat"))
        .withColumn("_offset", F.col("_at") + F.col("repeat") * F.col("all_tokens"))
        .withColumn("_block", F.least(F.floor(F.col("_offset") * F.col("n_blocks") * periods / F.col("used")), F.col("n_blocks") * periods - 1))
        .withColumn("turn", F.col("_block") % F.col("n_blocks"))
        .join(F.broadcast(order), ["source", "turn"])
        .select((F.floor(F.col("_block") / F.col("n_blocks")) * slots + F.col("at")).alias("slot"), F.col("_offset").alias("place"), "doc_id", "source", "repeat", "tokens")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: source, target_share, tokens, share, max_repeat_used. Sources that gave nothing have 0."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("repeat") + 1).alias("repeats"))
    total = got.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "target_share").join(got, "source", "left").crossJoin(total)  # one row
    return out.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"))


def short(sizes: DataFrame, targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Sources of targets that the mix leaves below their wanted tokens: source, wanted, given, blocks (slots of the schedule that hold some of it).

    A source that can give enough is placed until its share is reached, so only
    short ones end below it; supply checks them exactly.
    """
    got = mix(sizes, targets, slots).groupBy("source").agg(F.sum("tokens").alias("given"), F.count_distinct("slot").alias("blocks"))
    out = supply(sizes, targets).join(got, "source", "left").where((F.coalesce("given", F.lit(0)) < F.col("wanted") - 1e-6) & F.col("is_short"))
    return out.select("source", "wanted", F.coalesce("given", F.lit(0)).alias("given"), F.coalesce("blocks", F.lit(0)).alias("blocks"))
