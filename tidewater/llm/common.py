"""Helpers shared by the corpus operators: shared storage, block merging, Bloom filters, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots in one block of a merged counter array or bitmap.
BLOCK = 1 << 13


#: Rows that Spark hands to a Python worker at once, where the session has Spark's own default of 10,000: texts are large.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that has none configured."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of tables that saved() wrote and discard() has not removed.
_written: dict[str, SparkSession] = {}


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write as Parquet in the shared folder and read back; removed by discard(), or when the driver exits."""
    spark = df.sparkSession
    lean(spark)
    path = f"{shared_dir(spark)}/tidewater-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewater_path = path
    return out


def read_together(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one schema that saved() returned, in one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._tidewater_path for t in tables])


def discard(*tables: DataFrame) -> None:
    """Remove tables that saved() returned and that nothing reads any more, and shuffle files that nothing refers to."""
    for df in tables:
        _remove(df._tidewater_path)
    spark = tables[0].sparkSession
    spark.sparkContext._jvm.System.gc()


def _remove(path: str) -> None:
    if (spark := _written.pop(path, None)) is not None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session is already gone
            pass


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(block: np.ndarray) -> bytes:
    return zlib.compress(block.tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=dtype)


def blocks_of(values: np.ndarray):
    """(block number, packed block) of every block of a dense array that is not all zero."""
    for k in range(0, len(values), BLOCK):
        part = values[k : k + BLOCK]
        if part.any():
            yield k // BLOCK, pack(part)


def merge_blocks(parts: DataFrame, dtype: str) -> DataFrame:
    """Sum rows (block int, data binary) by block. One task holds a part of the blocks, each of fixed size."""

    def merge(frames):
        held: dict[int, np.ndarray] = {}
        for pdf in frames:
            for block, data in zip(pdf["block"], pdf["data"], strict=True):
                part = unpack(data, dtype)
                held[block] = held[block] + part if block in held else part
        yield pd.DataFrame({"block": list(held), "data": [pack(x) for x in held.values()]})

    n = min(16, partitions(parts.sparkSession))
    return parts.repartition(n, "block").mapInPandas(merge, "block int, data binary")


#: Bits for each key of a bitmap and the limits of its size (128 KB to 64 MB), and its hash functions.
KEY_BITS, MIN_BITS, MAX_BITS = 12, 1 << 20, 1 << 29
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Bit numbers that a task gathers before it sorts and sends them, and bits of one block.
MARKS, BLOCK_BITS = 1 << 22, 1 << 16


def slots(keys: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """Bit numbers of 64-bit keys in a bitmap of `size` bits, a power of two."""
    return (keys * odd) >> np.uint64(64 - (size.bit_length() - 1))


class Bitmap:
    """A Bloom filter of 64-bit keys: a fixed size, false positives only; later joins are exact."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits) * 8

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys that may be in the set."""
        at = np.arange(len(keys))
        for odd in ODD:
            s = slots(keys[at], self.size, odd)
            at = at[(self.bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
        return at

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        out[self.find(keys)] = True
        return out


def bit_size(n: int, limit: int = MAX_BITS, bits: int = KEY_BITS) -> int:
    """A power of two: `bits` for each of n keys or up to twice as many, within the limits."""
    return min(limit, max(MIN_BITS, 1 << int(max(1, bits * n) - 1).bit_length()))


def marked(df: DataFrame, keys_of, size: int, twice: bool = False) -> np.ndarray:
    """Bits of a Bitmap of the uint64 keys that keys_of yields from the Arrow batches of a partition of df; with `twice`, of those yielded more than once (or taken for one).

    Tasks send bit numbers within blocks, two bytes each; the driver takes one
    partition of finished blocks at a time. What the driver and any task holds
    is bounded by `size`.
    """
    import pyarrow as pa

    def flush(held):
        at = np.sort(np.concatenate(held))
        if twice:
            at = at[np.concatenate([[True, True], at[2:] != at[:-2]])[: len(at)]]
        else:
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        block = (at >> np.uint64(16)).astype(np.int32)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        offsets = np.append(first, len(at)) * 2
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(at.astype(np.uint16))])
        return pa.RecordBatch.from_arrays([pa.array(block[first]), data.cast(pa.binary())], ["block", "data"])

    def mark(batches):
        held, n = [], 0
        for keys in keys_of(batches):
            if len(keys):
                held += [slots(keys, size, odd) for odd in ODD]
                n += len(ODD) * len(keys)
            if n >= MARKS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                once, more = held.setdefault(block, (np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS if twice else 0, bool)))
                at = np.frombuffer(data.as_buffer(), np.uint16)
                if twice:
                    more[at[once[at]]] = True
                    more[at[1:][at[1:] == at[:-1]]] = True
                once[at] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x[twice], bitorder="little").tobytes() for x in held.values()], pa.binary())], ["block", "data"])

    schema = "block int, data binary"
    n = min(16, partitions(df.sparkSession), -(-size // BLOCK_BITS // 64))
    out = np.zeros(size // 8, np.uint8)
    for row in df.transform(arrow_map, mark, schema).repartition(n, "block").transform(arrow_map, merge, schema).toLocalIterator():
        at = row["block"] * BLOCK_BITS // 8
        out[at : at + BLOCK_BITS // 8] = np.frombuffer(row["data"], np.uint8)
    return out


def joined_key(k: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One key of two long columns."""
    k = (k.view(np.uint64) ^ (other.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


def bitmap(keys: DataFrame, bits: int = KEY_BITS):
    """Broadcast bits of a Bitmap of the one long column of `keys`, or of the joined_key of two. Beyond MAX_BITS it only lets more rows pass."""

    def keys_of(batches):
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            yield joined_key(*columns) if len(columns) > 1 else columns[0].view(np.uint64)

    return keys.sparkSession.sparkContext.broadcast(marked(keys, keys_of, bit_size(keys.count(), MAX_BITS, bits)))


#: Links that one task takes, 4 MB; more of them are put together by steps of joins.
FEW_EDGES = 1 << 18


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the smallest vertex reachable from each) of the links a - b."""
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertices))
    while len(a):
        x, y = label[a], label[b]
        left = np.flatnonzero(x != y)
        a, b, x, y = a[left], b[left], x[left], y[left]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return vertices, vertices[label]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long), which are written already: rows (v, label), label the smallest vertex reachable; a vertex that is its own label is absent.

    FEW_EDGES links or fewer are solved by one task. For more of them it alternates
    large-star and small-star steps; every step is a groupBy with map-side
    combine and a join that adaptive execution can split, and no vertex's
    neighbours meet in one row.
    """
    import pyarrow as pa

    def solve(batches):
        held = [np.zeros((2, 0), np.int64), *(np.array([c.to_numpy() for c in batch.columns]) for batch in batches)]
        v, label = smallest_reachable(*np.concatenate(held, axis=1))
        ok = v != label
        yield pa.RecordBatch.from_arrays([pa.array(v[ok]), pa.array(label[ok])], ["v", "label"])

    if edges.count() <= FEW_EDGES:
        return edges.select("a", "b").coalesce(1).transform(arrow_map, solve, "v long, label long")
    e = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").union(low.selectExpr("u", "m AS v"))
        e = cut(small.where("u <> v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.groupBy(F.col("u").alias("v")).agg(F.min(F.col("v")).alias("label"))


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow in small batches that gives memory back when its partition ends."""
    from tidewater.llm.kernels import release

    lean(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, inputs: list, outputs: list[tuple[str, str]], fn, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of df (all by default) and new columns that fn computes from Arrow arrays of the `inputs` columns, batch by batch.

    Columns are handled by position, so names of df may clash with anything here;
    a kept column that has the name of a new one is replaced.
    """
    import pyarrow as pa

    names = [n for n, _ in outputs]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    n_in, kinds = len(inputs), {f.name: f.dataType for f in df.schema.fields}
    inner = df.select(*[x.alias(f"i{k}") for k, x in enumerate(inputs)], *[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)])
    columns = [f"k{k}" for k in range(len(keep))] + [f"o{k}" for k in range(len(outputs))]
    schema = ", ".join([f"k{k} {kinds[c].simpleString()}" for k, c in enumerate(keep)] + [f"o{k} {t}" for k, (_, t) in enumerate(outputs)])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                new = fn(*batch.columns[:n_in])
                yield pa.RecordBatch.from_arrays([*batch.columns[n_in:], *new], columns)

    out = arrow_map(inner, run, schema)
    return out.select(*[F.col(c).alias(n) for c, n in zip(columns, [*keep, *names], strict=True)])
