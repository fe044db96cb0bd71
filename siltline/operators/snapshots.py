"""Changes between consecutive full snapshots, found through content-defined chunks.

The rows of all snapshots of a group are range-partitioned by (group, key), so a hot group is spread over as many
tasks as its size asks for while all snapshots of one key meet in one task. Within a task the key-sorted rows are cut
wherever the hash of a key falls on a multiple of ``chunk_rows``: cut points depend on keys alone, so an insertion or
deletion moves no other cut. A chunk of a snapshot is represented by its row count and two 64-bit sums of row hashes.
Chunks whose digests agree with the same chunk of the snapshot before are dropped; the rows of unmatched chunks are
joined by key there and then. So there is one shuffle, of keys and row hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltline.session import cut

_ABSENT = -(2**62)
#: Snapshots of all groups up to which their list (four numbers and names each) is broadcast.
_FEW_SNAPSHOTS = 100_000


def _chunk_ids(batch: pd.DataFrame, chunk_rows: int) -> tuple[np.ndarray, np.ndarray]:
    group, key = batch["_g"].to_numpy(), batch["_k"].to_numpy()
    new_group = np.r_[True, group[1:] != group[:-1]]
    new_key = new_group | np.r_[True, key[1:] != key[:-1]]
    starts = new_group | (new_key & (batch["_kh"].to_numpy() % chunk_rows == 0))
    return np.cumsum(starts), new_key


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another hash of a hash, so that two sums of a chunk are independent."""
    u = h.astype(np.uint64)
    u = (u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (u ^ (u >> np.uint64(29))).astype(np.int64)


def _changes(batch: pd.DataFrame, chunk_rows: int) -> pd.DataFrame:
    """The changes among the rows of whole chunks."""
    batch = batch.reset_index(drop=True)
    chunk, new_key = _chunk_ids(batch, chunk_rows)
    version = batch["_v"].to_numpy()
    last = np.r_[new_key[1:] | (version[1:] != version[:-1]), True]  # the latest delivery of an entry counts
    with np.errstate(over="ignore"):
        batch = batch.assign(_c=chunk, _n=np.cumsum(new_key), _m=_mixed(batch["_h"].to_numpy()))[last]
        chunks = batch.groupby(["_c", "_v"], as_index=False).agg(_rows=("_h", "size"), _s1=("_h", "sum"), _s2=("_m", "sum"), _p=("_p", "first"), _q=("_q", "first"))
    other = chunks[["_c", "_v", "_rows", "_s1", "_s2"]]

    def differs(neighbour: str) -> np.ndarray:
        both = chunks.merge(other, left_on=["_c", neighbour], right_on=["_c", "_v"], how="left", suffixes=("", "_o"))
        same = (both["_rows"] == both["_rows_o"]) & (both["_s1"] == both["_s1_o"]) & (both["_s2"] == both["_s2_o"])
        return ((both[neighbour] != _ABSENT) & ~same).to_numpy()

    chunks = chunks.assign(_now=differs("_p"), _then=differs("_q"))
    rows = batch.merge(chunks[["_c", "_v", "_now", "_then"]], on=["_c", "_v"])
    now, then = rows[rows["_now"]], rows[rows["_then"]]
    # a row counts under its own snapshot and, as the old side, under the next one
    both = now[["_n", "_v", "_h", "_g", "_k"]].merge(then[["_n", "_q", "_h", "_g", "_k"]].rename(columns={"_q": "_v"}), on=["_n", "_v"], how="outer", suffixes=("", "_o"), indicator=True)
    side = both["_merge"].to_numpy()
    kind = np.where(side == "left_only", "added", np.where(side == "right_only", "removed", np.where(both["_h"] != both["_h_o"], "changed", "")))
    found = pd.DataFrame({"_g": both["_g"].where(side != "right_only", both["_g_o"]), "_at": both["_v"], "_k": both["_k"].where(side != "right_only", both["_k_o"]), "change": kind})
    return found[kind != ""]


def _scan(chunk_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            both = pd.concat([*open_rows, batch], ignore_index=True)
            chunk, _ = _chunk_ids(both, chunk_rows)
            closed = int(np.searchsorted(chunk, chunk[-1]))  # the last chunk may go on in the next batch
            if closed:
                yield _changes(both.iloc[:closed], chunk_rows)
            open_rows = [both.iloc[closed:]]
        if open_rows:
            yield _changes(open_rows[0], chunk_rows)

    return run


def snapshot_changes(
    df: DataFrame,
    group: str,
    version: str,
    key: str | Column,
    compared: Sequence[str | Column],
    latest_by: str | None = None,
    chunk_rows: int = 16,
) -> DataFrame:
    """(group, version, key, change) for every snapshot but the first of each group, against the delivered one before.

    Repeated rows count once; if one key has different rows within a snapshot, the one with the greatest ``latest_by``
    counts (ties: greatest row hash). Rows are compared by a 64-bit hash of their values. Nulls are values, in keys, groups and compared columns alike; a row without a
    version belongs to no snapshot. An empty table gives no rows; other columns are ignored whatever their names.
    """
    key = F.col(key) if isinstance(key, str) else key
    compared = [F.col(c) if isinstance(c, str) else c for c in compared]
    values = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(compared)]), {"ignoreNullFields": "false"})
    rows = df.where(F.col(version).isNotNull()).select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("_g"),
        F.col(version).cast("long").alias("_v"),
        F.coalesce(F.concat(F.lit("="), key), F.lit("")).alias("_k"),
        F.xxhash64(key, values).alias("_h"),
        (F.col(latest_by) if latest_by else F.lit(0)).alias("_t"),
    )
    ordered = Window.partitionBy("_g").orderBy("_v")  # one row per snapshot
    versions = cut(
        rows.select("_g", "_v").distinct()
        .select("_g", "_v", F.lag("_v", 1, _ABSENT).over(ordered).alias("_p"), F.lead("_v", 1, _ABSENT).over(ordered).alias("_q"))
    )
    if versions.count() <= _FEW_SNAPSHOTS:  # a checked size: broadcast after the one shuffle, which so carries less
        placed = rows.repartitionByRange("_g", "_k").join(F.broadcast(versions), ["_g", "_v"])
    else:
        placed = rows.join(versions, ["_g", "_v"]).repartitionByRange("_g", "_k")
    placed = placed.sortWithinPartitions("_g", "_k", "_v", "_t", "_h").select("_g", "_v", "_k", F.xxhash64("_k").alias("_kh"), "_h", "_p", "_q")
    found = placed.mapInPandas(_scan(chunk_rows), "_g string, _at long, _k string, change string")
    value = lambda c: F.when(F.col(c) != "", F.expr(f"substring({c}, 2)"))
    return found.select(value("_g").alias(group), F.col("_at").cast(df.schema[version].dataType).alias(version), value("_k").alias("key"), "change")


def baseline_changes(snapshots: DataFrame, chunk_rows: int = 16) -> DataFrame:
    """Added, removed and changed baseline entries: (repo, snapshot_no, fingerprint, change)."""
    file = F.translate("file", "\\", "/")
    return snapshot_changes(
        snapshots, "repo", "snapshot_no", F.lower("fingerprint"), ["rule_id", file, "line", "title", "note"], "loaded_at", chunk_rows
    ).withColumnRenamed("key", "fingerprint")
