"""Operator 7: n-gram Jaccard join by filtering under several global token orders.

Tokens are 64-bit hashes of the k-word shingles of a text. Two sets whose
Jaccard similarity reaches the threshold must share a token among the first
n - ceil(t * n) + 1 of either, under *any* global order of tokens. Three orders
are used; the first two put rare tokens first, by a count sketch of fixed size
over all documents. The prefixes under the first order are indexed together
with a class of the set's size (sizes that the threshold allows to pair are at
most one class apart, so each text stands in its own class and the next): only
texts that share a prefix token and a class meet. Within such a bucket the
prefixes under the second order must intersect and may differ only as far as
linked sets do; members that still have a partner come with their whole sets,
whose prefixes must intersect under the third order too before they are
compared.

Texts with equal sets are one node, so copies cost nothing; hot buckets are
verified block by block (see cells.py). Sets and texts are identified by
64-bit hashes: among n distinct texts n * n / 2**65 accidental merges are
expected (0.03 at a billion).

Defined results: null and empty texts have no words, an empty set, and link
with nothing (n_shingles 0, component_id the row's own doc_id). A null doc_id
gives a null component_id only where its whole group has none. Repeated rows
give repeated result rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import kernels as K
from tidewater.llm.cells import Forest, cells_of, common, first_shared, in_cells, once, pairs_mask, spread
from tidewater.llm.common import BLOCK, Bitmap, arrow_map, bitmap, blocks_of, components, cut, joined_key, merge_blocks, saved, table, unpack, unused

#: Slots of the count sketch (4 bytes each while counting, 1 byte when broadcast).
SKETCH_SLOTS = 1 << 21
#: Members in one block of a bucket; a cell holds the sets of two blocks at most.
CELL_BLOCK = 384
_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


def _rank_keys(h: np.ndarray, rarity: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of tokens under one global order: a coarse frequency class, then a hash of its own."""
    mixed = K.mix(h ^ _SEEDS[order])
    if order == 2:
        return mixed
    level = rarity[(h >> np.uint64(40)) & np.uint64(SKETCH_SLOTS - 1)].astype(np.uint64)
    return (level << np.uint64(56)) | (mixed >> np.uint64(8))


def _prefix_len(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _index_len(n: np.ndarray, percent: int) -> np.ndarray:
    """Of two linked sets the smaller one shares a token among as many of its first with the prefix of the larger."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _may_match(fronts: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose prefixes share a token and differ in no more tokens than linked sets may.

    Prefixes are sorted ranks, cut to 32 bits: equal ranks may be different tokens, so that
    only what lies below the end of both prefixes, and is not equal, counts as a difference.
    """
    size = np.array([len(x) for x in fronts])
    owner, every = np.repeat(np.arange(len(fronts)), size), np.concatenate(fronts)
    shared = common(owner, every, len(fronts))
    whole = size == n
    last = np.array([np.inf if w else x[-1] for x, w in zip(fronts, whole, strict=True)])
    below = np.stack([np.searchsorted(x, np.minimum(last, last[i])) for i, x in enumerate(fronts)])
    differ = below + below.T - 2 * shared
    return (shared > 0) & (differ * (100 + percent) <= np.add.outer(n, n) * (100 - percent))


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Frequency class (log2 of the count, in half steps) of each slot, over all documents."""

    def count(batches):
        slots, held, size = np.zeros(SKETCH_SLOTS, np.uint32), [], 0
        for batch in batches:
            for i, j, data, offsets in K.pieces(batch.column(0)):
                row, _, _, h = K.words(data, offsets, K.NOT_SPACE)
                _, tokens = K.shingles(row, h, j - i, k)
                held.append(((tokens >> np.uint64(40)) & np.uint64(SKETCH_SLOTS - 1)).astype(np.int32))
                size += len(tokens)
                if size > SKETCH_SLOTS:
                    slots += np.bincount(np.concatenate(held), minlength=SKETCH_SLOTS).astype(np.uint32)
                    held, size = [], 0
        if held:
            slots += np.bincount(np.concatenate(held), minlength=SKETCH_SLOTS).astype(np.uint32)
        rows = list(blocks_of(slots))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["block", "data"])

    parts = docs.select("text").transform(arrow_map, count, "block int, data binary")
    out = np.zeros(SKETCH_SLOTS, np.uint8)
    for row in merge_blocks(parts, "uint32").toLocalIterator():
        part = unpack(row["data"], "uint32")
        at = row["block"] * BLOCK
        out[at : at + len(part)] = np.round(2 * np.log2(part.astype(np.float64) + 1)).astype(np.uint8)
    return out


def _sets(batch_column, k):
    """For each chunk: first row, rows, and per row the count, the offsets and the sorted distinct tokens."""
    for i, j, data, offsets in K.pieces(batch_column):
        row, _, _, h = K.words(data, offsets, K.NOT_SPACE)
        owner, tokens = K.shingles(row, h, j - i, k)
        n = np.bincount(owner, minlength=j - i)
        yield i, j, n, np.concatenate([[0], np.cumsum(n)]), tokens


def _vids(n, at, tokens):
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = K.mix(np.add.reduceat(K.mix(tokens ^ _SEEDS[0]), at[:-1][some]) + n[some].astype(np.uint64) * _SEEDS[1])
    return out


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """Rows (doc_id long, n_shingles long, component_id long), one for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rarity = spark.sparkContext.broadcast(sketch(docs, k))

    def describe(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, n, at, tokens in _sets(batch.column(1), k):
                p = np.where(n > 0, _prefix_len(n, percent), 0)
                q = np.where(n > 0, _index_len(n, percent), 0)
                rank0, rank1 = (_rank_keys(tokens, rarity.value, order) for order in (0, 1))
                first, front = [np.zeros(0, np.uint64)], []
                for lo, hi, m in zip(at[:-1].tolist(), at[1:].tolist(), p.tolist(), strict=True):
                    least = np.argpartition(rank0[lo:hi], m - 1)[:m] if 0 < m < hi - lo else np.arange(hi - lo)
                    first.append(tokens[lo:hi][least[np.argsort(rank0[lo:hi][least])]])
                    least = np.partition(rank1[lo:hi], m - 1)[:m] if 0 < m < hi - lo else rank1[lo:hi]
                    front.append(np.sort(least >> np.uint64(32)).astype(np.uint32).tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]).astype(np.int32)), K.i64(np.concatenate(first)))
                vid = pa.array(_vids(n, at, tokens).view(np.int64), mask=n == 0)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n.astype(np.int64)), vid, pa.array(q.astype(np.int32)), lists, pa.array(front, pa.binary())], ["doc_id", "n_shingles", "vid", "n_index", "tokens", "front"])

    rows = saved(docs.transform(arrow_map, describe, "doc_id long, n_shingles long, vid long, n_index int, tokens array<long>, front binary"))
    some = rows.where("vid IS NOT NULL")
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-1.000001 * math.log(percent / 100))).cast("long")
    placed = some.select("vid", "n_index", F.posexplode("tokens").alias("at", "key")).select("key", "vid", (F.col("at") < F.col("n_index")).alias("indexed"))
    shared = placed.groupBy("key").agg(F.min("vid").alias("a"), F.max("vid").alias("b"), F.max("indexed").alias("indexed"))
    wanted_tokens = bitmap(saved(shared.where("a <> b AND indexed").select("key")))

    def candidates(batches):
        want = Bitmap(wanted_tokens.value)
        for batch in batches:
            counts = np.diff(batch.column(2).offsets.to_numpy())
            token = batch.column(2).flatten().to_numpy()
            ok = want.has(token.view(np.uint64))
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts)[ok])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(token[ok])], ["vid", "step", "token"])

    keyed = some.select("vid", step.alias("step"), "tokens").transform(arrow_map, candidates, "vid long, step long, token long")
    keyed = keyed.select(F.explode(F.array(F.xxhash64("token", "step"), F.xxhash64("token", F.col("step") + 1))).alias("key"), "vid")
    buckets = cut(cells_of(cut(keyed.distinct()), CELL_BLOCK))
    # A pair is looked at in one bucket only, the smallest key that it shares.
    small = some.select("vid", "n_shingles", "front").join(buckets.groupBy("vid").agg(F.collect_list("key").alias("keys")), "vid")

    def survive(key, lo, hi, vid, blk, side, size, keys, front):
        n = size.to_numpy()
        able = pairs_mask(side, len(n)) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
        if not able.any():
            return
        able &= first_shared(key, keys)
        if able.any():
            able &= _may_match([np.frombuffer(x, np.uint32) for x in front.to_pylist()], n, percent)
        for m in np.flatnonzero(able.any(0) | able.any(1)).tolist():
            yield key, lo, hi, int(vid[m]), int(blk[m])

    cells = cut(once(cut(in_cells(spread(buckets), small, ["n_shingles", "keys", "front"], survive, "key long, lo int, hi int, vid long, blk int"))))
    first = some.groupBy("vid").agg(F.min("doc_id").alias("least"))
    wanted = bitmap(cells.select("vid").distinct().join(first, "vid").select("vid", F.coalesce("least", F.lit(0))))

    def fetch(batches):
        want = Bitmap(wanted.value)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, n, at, tokens in _sets(batch.column(1), k):
                vid = _vids(n, at, tokens)
                hit = np.flatnonzero((n > 0) & want.has(joined_key(vid.view(np.int64), ids[i:j])))
                _, once = np.unique(vid[hit], return_index=True)
                hit = hit[once]
                sets = [tokens[at[r] : at[r + 1]].tobytes() for r in hit]
                yield pa.RecordBatch.from_arrays([K.i64(vid[hit]), pa.array(sets, pa.binary())], ["vid", "tokens"])

    def verify(key, lo, hi, vid, blk, side, column):
        sets = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        n = np.array([len(x) for x in sets])
        able = pairs_mask(side, len(sets)) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
        p = _prefix_len(n, percent)
        for order in (0, 1, 2):
            heads = [x[np.argpartition(_rank_keys(x, rarity.value, order), m - 1)[:m]] if m < len(x) else x for x, m in zip(sets, p.tolist(), strict=True)]
            able &= common(np.repeat(np.arange(len(sets)), p), np.concatenate(heads), len(sets)) > 0
            if not able.any():
                return
        inter = common(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), len(sets))
        able &= 100 * inter >= percent * (np.add.outer(n, n) - inter)
        forest = Forest(len(sets))
        for i, j in zip(*np.nonzero(able), strict=True):
            if forest.join(int(i), int(j)):
                yield int(vid[i]), int(vid[j])

    payload = docs.select(F.coalesce("doc_id", F.lit(0)), "text").transform(arrow_map, fetch, "vid long, tokens binary")
    edges = cut(in_cells(cells, payload, ["tokens"], verify, "a long, b long").distinct())
    label = components(edges)
    nodes = cut(first.join(label.withColumnRenamed("v", "vid"), "vid", "left").select("vid", "least", F.coalesce("label", "vid").alias("label")))
    groups = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    of = nodes.join(groups, "label").select("vid", "component_id")
    out = rows.select("doc_id", "n_shingles", "vid").join(of, "vid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, without near duplicates: of each group the row of the smallest doc_id stays.

    Of rows that repeat a doc_id one with the smallest text stays; rows with a null doc_id cannot be told apart and stay.
    """
    found = ngram_components(docs.select("doc_id", "text"), k, percent)
    mark = unused(docs, "__id")
    own = F.col("doc_id").cast("long")
    gone = cut(found.where("component_id <> doc_id").select(F.col("doc_id").alias(mark)).distinct())
    out = docs.join(gone, own == F.col(mark), "left_anti")
    repeated = cut(docs.where("doc_id IS NOT NULL").groupBy(own.alias(mark)).agg(F.count("*").alias(f"{mark}n")).where(F.col(f"{mark}n") > 1).select(mark))
    if repeated.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = out.join(repeated, own == F.col(mark), "left_semi").groupBy(own.alias(f"{mark}n")).agg(F.min_by(row, F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(mark)).select(f"{mark}.*")
    return out.join(repeated, own == F.col(mark), "left_anti").unionByName(one)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
e AS (SELECT r, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, l.y FROM reach JOIN l ON reach.b = l.x),
c AS (SELECT reach.a AS r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c USING (r)
"""
