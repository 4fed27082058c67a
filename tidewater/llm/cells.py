"""Verification of candidate buckets in bounded cells.

A bucket is the set of members that share one signature key. Buckets with the
same member set are kept once. A bucket of more than BLOCK members is dealt
into blocks, and each pair of blocks is one cell, so that no task ever holds
more than two blocks of one bucket however large it grows. A cell emits no
more links than a spanning forest of its members needs, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, partitions

#: Members in one block of a bucket.
BLOCK = 128


def cells_of(members: DataFrame, block: int | str = BLOCK) -> DataFrame:
    """Members (key long, vid long), distinct, to rows (key, vid, blk, n_blk) of the buckets worth verifying. `block` may name a column of members, equal in a bucket."""
    size = F.first(block) if isinstance(block, str) else F.lit(block)
    stats = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("vid").alias("x"), F.bit_xor(F.xxhash64("vid")).alias("y"), size.alias("size")).where("n >= 2")
    kept = stats.groupBy("n", "x", "y").agg(F.min(F.struct("key", "size")).alias("of")).select("of.*", "n")
    blocks = F.ceil(F.col("n") / F.col("size")).cast("int")
    return members.select("key", "vid").join(kept, "key").select("key", "vid", F.pmod(F.xxhash64("vid", F.lit(7)), blocks).cast("int").alias("blk"), blocks.alias("n_blk"))


class Forest:
    """Union-find over the members of one cell."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spread(cells: DataFrame) -> DataFrame:
    """Rows (key, lo, hi, vid, blk): each member in the cells of its block with every block of its bucket."""
    rows = cells.select("key", "vid", "blk", F.explode(F.expr("sequence(0, n_blk - 1)")).alias("other"))
    return rows.select("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "vid", "blk")


def once(rows: DataFrame) -> DataFrame:
    """Only one of the cells that have the same members on the same sides, and none of a single member."""
    side = F.xxhash64("vid", F.when(F.col("lo") == F.col("hi"), 2).otherwise((F.col("blk") == F.col("lo")).cast("int")))
    stats = rows.groupBy("key", "lo", "hi").agg(F.count("*").alias("n"), F.bit_xor(side).alias("x"), F.bit_xor(F.xxhash64(side)).alias("y"))
    kept = stats.where("n >= 2").groupBy("n", "x", "y").agg(F.min(F.struct("key", "lo", "hi")).alias("c")).select("c.*")
    return rows.join(kept, ["key", "lo", "hi"])


def whole_groups(rows: DataFrame, by: list[str], fn, schema: str, at_least: int = 0) -> DataFrame:
    """Run fn(table) on tables of all rows that are equal in the columns `by`, the first ones of rows, sorted by them and vid; it returns a batch of `schema`.

    Groups are gathered up to `at_least` bytes; beyond that a task holds one batch of rows and one group at a time.
    """
    every = rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "vid")

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(len(by))]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
            if held and size >= at_least and tuple(x[0] for x in columns) != last:
                yield fn(pa.Table.from_batches(held))
                held, size = [], 0
            if len(new) and size + batch.nbytes >= at_least:
                cut_at = int(new[-1])
                yield fn(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held, size, batch = [], 0, batch.slice(cut_at)
            held.append(batch)
            size += batch.nbytes
            last = tuple(x[-1] for x in columns)
        if held:
            yield fn(pa.Table.from_batches(held))

    return every.transform(arrow_map, run, schema)


def whole_cells(rows: DataFrame, payload: DataFrame, columns: list[str], fn, schema: str, at_least: int = 0) -> DataFrame:
    """Run fn(table) on tables of whole cells, sorted, with columns (key, lo, hi, vid, blk, *columns); it returns a batch of `schema`.

    `payload` has one or more equal rows (vid, *columns) of each member. A task
    holds one batch of rows and one cell at a time, two blocks of members at most,
    or `at_least` bytes of smaller cells.
    """
    every = rows.join(payload, "vid").select("key", "lo", "hi", "vid", "blk", *columns)
    return whole_groups(every, ["key", "lo", "hi"], fn, schema, at_least)


def starts(table: pa.Table) -> np.ndarray:
    """Where each cell of a sorted table begins."""
    key, lo, hi = (table.column(k).to_numpy() for k in range(3))
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))


def in_cells(rows: DataFrame, payload: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """whole_cells() with a fn(key, lo, hi, vid, blk, side, *columns) for one cell, which yields rows of `schema`."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [pa.int32() if n in ("lo", "hi", "blk") else pa.int64() for n in names]

    def cells(table):
        found = []
        table = table.combine_chunks()
        edges = [*starts(table).tolist(), table.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if j - i > 1:
                found += cell(table.slice(i, j - i))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

    def cell(group):
        vid = group["vid"].to_numpy()
        new = np.ones(len(vid), bool)
        new[1:] = vid[1:] != vid[:-1]
        at = np.flatnonzero(new)
        if len(at) < 2:
            return []
        key, lo, hi = (group[c][0].as_py() for c in ("key", "lo", "hi"))
        blk = group["blk"].to_numpy()[at]
        if lo != hi and (blk == lo).all() | (blk == hi).all():
            return []
        taken = [group[c].take(pa.array(at)).combine_chunks() for c in columns]
        return list(fn(key, lo, hi, vid[at], blk, None if lo == hi else blk == lo, *taken))

    return whole_cells(rows, payload, columns, cells, schema)


def pairs_mask(side: np.ndarray | None, n: int) -> np.ndarray:
    """Which pairs a cell has to look at, as an upper triangle."""
    mask = np.triu(np.ones((n, n), bool), 1)
    return mask if side is None else mask & np.not_equal.outer(side, side)


def common(owner: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all pairwise intersections in one cell, over tokens that more than one member has, a slab of tokens at a time."""
    out = np.zeros((n, n), np.int64)
    by = np.argsort(tokens, kind="stable")
    owner, tokens = owner[by], tokens[by]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    code = np.cumsum(new) - 1
    keep = np.bincount(code, minlength=1)[code] > 1
    owner, code = owner[keep], code[keep]
    if not len(code):
        return out
    code = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]]))
    slab = max(1, (1 << 22) // n)
    for lo in range(0, int(code[-1]) + 1, slab):
        a, b = np.searchsorted(code, (lo, lo + slab))
        m = np.zeros((n, min(slab, int(code[-1]) + 1 - lo)), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    return out


def first_shared(key: int, keys: pa.ListArray) -> np.ndarray:
    """Which pairs of a cell share no smaller key than the cell's, so that a pair is looked at in one bucket only; keys has those of each member."""
    mine, owner = keys.flatten().to_numpy(), np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
    return common(owner[mine < key], mine[mine < key], len(keys)) == 0
