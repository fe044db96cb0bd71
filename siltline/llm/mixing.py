"""Mixing sources to target weights by balanced sampling (cube method)."""

from __future__ import annotations

import hashlib
import itertools
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltline.llm.tokens import BYTE_BPE_50K, FOLDER, encode_documents
from siltline.session import cut

#: Documents of one source that one task balances at a time; what stays fractional goes into the next round.
BLOCK_DOCS = 4_000
_EPS = 1e-9
#: Tasks of a round at most; each takes several blocks beyond that.
_MOST_TASKS = 10_000


def flight(chance: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Moves inclusion probabilities to 0 or 1 keeping their sum and the expected size, until at most two are left open.

    Three open units at a time move along the null space of the two constraints (count and size), in either direction
    with the odds that keep every expectation.
    """
    chance = [0.0 if p <= _EPS else 1.0 if p >= 1 - _EPS else p for p in chance]
    waiting = [i for i, p in enumerate(chance) if 0 < p < 1]
    active: list[int] = []
    at = 0
    while True:
        while len(active) < 3 and at < len(waiting):
            active.append(waiting[at])
            at += 1
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            move = (c - b, a - c, b - a)
            if move == (0, 0, 0):
                move = (1, -1, 0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            move = (1, -1)
        else:
            return chance
        up = min(((1 - chance[i]) / u if u > 0 else -chance[i] / u) for i, u in zip(active, move) if u)
        down = min((chance[i] / u if u > 0 else (chance[i] - 1) / u) for i, u in zip(active, move) if u)
        step = up if rng.random() * (up + down) < down else -down
        rest = []
        for i, u in zip(active, move):
            p = chance[i] + step * u
            chance[i] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
            if 0 < chance[i] < 1:
                rest.append(i)
        active = rest


def landing(chance: list[float], size: list[int]) -> list[float]:
    """The last open units take the whole values that come nearest to the expected size; ties take the first in order."""
    open_units = [i for i, p in enumerate(chance) if 0 < p < 1]
    want = sum(chance[i] * size[i] for i in open_units)
    best = min(itertools.product((0, 1), repeat=len(open_units)), key=lambda x: (abs(sum(b * size[i] for b, i in zip(x, open_units)) - want), x))
    out = list(chance)
    for i, b in zip(open_units, best):
        out[i] = float(b)
    return out


def _balance(last: bool, seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["_order", "_id"])
        name = "|".join(map(str, (block["plan"].iloc[0], block["source"].iloc[0], block["_block"].iloc[0], seed)))
        rng = random.Random(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        sizes = block["tokens"].tolist()
        chance = flight(block["_chance"].tolist(), sizes, rng)
        return block.assign(_chance=landing(chance, sizes) if last else chance)

    return run


def mix_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per plan and source: target share, documents, tokens, reachable share and copies wanted per document.

    Weights are scaled to sum 1 over the sources of a plan; sources without documents of any size can't contribute, so
    the others share theirs (reachable_share). Without a total the size is the greatest at which no source needs more
    than max_repeats; with one, sources give what they can up to max_repeats. Repeated targets count once; null and
    negative weights count as 0, a null max_repeats as 1.
    """
    stock = sizes.where("tokens > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("stock_tokens"))
    plans = targets.groupBy("plan", "source").agg(F.greatest(F.lit(0.0), F.coalesce(F.max("weight"), F.lit(0.0))).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    rows = plans.join(stock, "source", "left").fillna(0, ["documents", "stock_tokens"])
    plan = Window.partitionBy("plan")  # a row per source
    usable = F.when((F.col("documents") > 0) & (F.col("max_repeats") > 0), F.col("weight")).otherwise(0.0)
    rows = rows.withColumn("target_share", F.try_divide("weight", F.sum("weight").over(plan))).withColumn("reachable_share", F.coalesce(F.try_divide(usable, F.sum(usable).over(plan)), F.lit(0.0)))
    limit = F.min(F.when(F.col("reachable_share") > 0, F.col("stock_tokens") * F.col("max_repeats") / F.col("reachable_share"))).over(plan)
    rows = rows.withColumn("_total", F.lit(total) if total is not None else limit)
    wanted = F.try_divide(F.col("_total") * F.col("reachable_share"), F.col("stock_tokens"))
    copies = F.when(F.col("reachable_share") > 0, F.least(wanted, F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.withColumn("copies", copies).drop("_total")


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, path: str = f"{FOLDER}/{BYTE_BPE_50K}") -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): plan, source, doc_id, tokens, repeats; and per plan and source the shares wanted and reached.

    A document is used floor(copies) times, and once more if the balanced sample takes it. Documents without tokens
    (null or empty text) and with a null source aren't chosen. Of the deliveries of a doc_id the one loaded last counts
    (without loaded_at, or at a tie, the one with the greatest hash).
    """
    at = F.col("loaded_at") if "loaded_at" in documents.columns else F.lit(None).cast("timestamp")
    rows = documents.select("doc_id", "source", "text", at.alias("_at"), F.xxhash64("source", "text").alias("_hash"))
    # texts become numbers where they are read; only those are shuffled to tell deliveries apart
    counted = encode_documents(rows, keep=("doc_id", "source", "_at", "_hash"), path=path, count=True)
    latest = F.max_by(F.struct("source", "tokens"), F.struct(F.col("_at").isNotNull(), "_at", "_hash")).alias("d")
    sizes = cut(counted.groupBy("doc_id").agg(latest).select("doc_id", "d.*").where("source is not null and tokens > 0"))
    rates = cut(mix_rates(sizes, targets, total))
    used = rates.where("copies > 0").select("plan", "source", "copies", "documents")
    # a row per plan and source: the targets' own size, which grows with plans, not with documents
    blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / BLOCK_DOCS)).cast("int")
    whole = F.floor("copies").cast("int")
    left = sizes.join(used, "source").select(
        "plan", "source", F.col("doc_id").alias("_id"), "tokens", whole.alias("_whole"), (F.col("copies") - whole).alias("_chance"),
        F.xxhash64("plan", "doc_id", F.lit(seed)).alias("_order"), F.pmod(F.xxhash64("doc_id", "plan", F.lit(seed + 1)), blocks.cast("long")).cast("int").alias("_block"),
    )
    schema = left.schema
    done: list[DataFrame] = []
    used_plans = used.groupBy("plan").agg(F.max("documents").alias("documents")).collect()  # a row a plan
    n = max((r["documents"] for r in used_plans if r["documents"]), default=0)
    while True:
        parts = -(-n // BLOCK_DOCS)
        last = parts <= 1
        # blocks are bound by rows, not bytes: the number of tasks is given, so that small rows don't all end in one
        placed = left.repartition(max(1, min(_MOST_TASKS, parts * len(used_plans))), "plan", "source", "_block")
        moved = cut(placed.groupBy("plan", "source", "_block").applyInPandas(_balance(last, seed), schema))
        settled = moved.where("_chance <= 0 or _chance >= 1")
        done.append(settled)
        if last:
            break
        n = 2 * (parts + parts)  # at most two stay open in a block, and blocks vary in size, not in number
        fewer = max(1, -(-n // BLOCK_DOCS))
        left = moved.where("_chance > 0 and _chance < 1").withColumn("_block", F.pmod("_order", F.lit(fewer).cast("long")).cast("int"))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    chosen = every.select("plan", "source", F.col("_id").alias("doc_id"), "tokens", (F.col("_whole") + F.col("_chance").cast("int")).alias("repeats")).where("repeats > 0")
    reached = chosen.groupBy("plan", "source").agg(F.count("*").alias("chosen_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    shares = rates.join(reached, ["plan", "source"], "left").fillna(0, ["chosen_documents", "mixed_tokens", "most_repeats"])
    shares = shares.withColumn("actual_share", F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy("plan"))))
    return chosen, shares.select("plan", "source", "target_share", "reachable_share", "max_repeats", "documents", "stock_tokens", "chosen_documents", "mixed_tokens", "most_repeats", "actual_share")
