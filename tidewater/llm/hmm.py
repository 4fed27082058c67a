"""Operator 4: scoring by a hidden Markov language model.

Tokens are lower-cased words (A-Z only) and one end token for each text.
Counts of all training tokens are exact. The MODEL_WORDS most frequent tokens
are symbols of their own; every other token belongs to one of TAIL_CLASSES
symbols by its last two bytes (a space before a single one), and has the add-one probability
(c + 1) / (N + V + 1) within its class, which leaves mass for unseen ones. So
a state's emissions are one distribution over a fixed number of symbols and
the model one over all texts.

Training: parameters start at random, each state nearer to the beginning of one
of a few texts; then PASSES Baum-Welch iterations run, each over all training
texts: a task sums expected counts of its own texts and the sums are merged
across partitions. Texts are turned into symbols once, in a table that all
iterations read. Training cuts texts into segments of SEGMENT tokens; a segment
that continues a text starts in the stationary distribution. Scoring never cuts: the scaled forward
recursion runs over each whole text, many texts in step.

Memory: the counts of at most HEAD most frequent tokens are broadcast; the
counts of all others meet the texts in a join, which is free of hot keys since
those are broadcast.

Defined results: null and empty texts are the end token alone; a null doc_id
hashes as empty text; equal rows get equal scores; without training rows the
model is uniform over its symbols and counts are 0; texts of any length are
scored whole, a task holding one batch's tokens or one text's; other columns,
whatever their names, are not looked at and not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import kernels as K
from tidewater.llm.common import BLOCK, arrow_map, blocks_of, merge_blocks, saved, table, unpack

STATES, MODEL_WORDS, TAIL_CLASSES, HEAD = 8, 8192, 256, 1 << 17
PASSES, SEGMENT = 9, 128
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x51ED270B7F4A7C15)
#: Tokens that one call of a Baum-Welch step takes, unless one text is longer.
AT_ONCE = 1 << 17
#: Tokens whose texts are scored in step.
IN_STEP = 1 << 20


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def tokens_of(data: np.ndarray, offsets: np.ndarray):
    """(row, hash, tail class) of all tokens, the end token last in each row."""
    row, start, end, h = K.words(data, offsets, K.NOT_SPACE)
    rows = len(offsets) - 1
    last = K.LOWER[data[end - 1]].astype(np.int32) if len(end) else np.zeros(0, np.int32)
    # Before a word of one byte a space is taken, whatever stands there: the class follows from the token alone.
    before = np.where(end - start > 1, K.LOWER[data[np.maximum(end - 2, 0)]], 0x20).astype(np.int32) if len(end) else last
    kind = (last * 37 + before * 101) % TAIL_CLASSES
    place = np.arange(len(row)) + row
    out_row = np.empty(len(row) + rows, np.int64)
    out_h, out_kind = np.full(len(row) + rows, END), np.zeros(len(row) + rows, np.int32)
    ends = np.cumsum(np.bincount(row, minlength=rows) + 1) - 1
    out_row[place], out_row[ends] = row, np.arange(rows)
    out_h[place], out_kind[place] = h, kind
    return out_row, out_h, out_kind


def count_tokens(docs: DataFrame) -> DataFrame:
    """Rows (h long, kind int, n long) of every token of docs (text)."""

    def flush(h, kind):
        h, kind = np.concatenate(h), np.concatenate(kind)
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([K.i64(u), pa.array(kind[first]), pa.array(n.astype(np.int64))], ["h", "kind", "n"])

    def count(batches):
        held: tuple[list, list] = ([], [])
        size = 0
        for batch in batches:
            for _, _, data, offsets in K.pieces(batch.column(0)):
                _, h, kind = tokens_of(data, offsets)
                held[0].append(h)
                held[1].append(kind)
                size += len(h)
                if size > 3_000_000:
                    yield flush(*held)
                    held, size = ([], []), 0
        if size:
            yield flush(*held)

    # The kind follows from the token, so that grouping by both is grouping by the token.
    return docs.select("text").transform(arrow_map, count, "h long, kind int, n long").groupBy("h", "kind").agg(F.sum("n").alias("n"))


class Model:
    """Symbols, tail-class sizes and HMM parameters; what a worker needs to score."""

    def __init__(self, head_h, head_n, kinds_n, kinds_v, total, vocabulary):
        self.head_h, self.head_n, self.total, self.vocabulary = head_h, head_n, total, vocabulary
        self.own = min(MODEL_WORDS, len(head_h))
        self.kinds_n, self.kinds_v = kinds_n, kinds_v
        self.symbols = MODEL_WORDS + TAIL_CLASSES
        self.start = self.step = self.emit = None

    def open(self):
        self.index = K.HashIndex(self.head_h)
        self.exact = [x if x is None else x.astype(np.float64) for x in (self.start, self.step, self.emit)]
        return self

    def symbols_of(self, h, kind):
        """(symbol, place in the head or -1)."""
        at = self.index.find(h)
        return np.where((at >= 0) & (at < self.own), at, MODEL_WORDS + kind), at


def segments(row: np.ndarray, symbol: np.ndarray):
    """Segments of at most SEGMENT tokens: (matrix of symbols padded with -1, whether each starts a text)."""
    n = np.bincount(row)
    first = np.cumsum(n) - n
    place = np.arange(len(row)) - first[row]
    per = -(-n // SEGMENT)
    seg = (np.cumsum(per) - per)[row] + place // SEGMENT
    out = np.full((int(per.sum()), SEGMENT), -1, np.int32)
    out[seg, place % SEGMENT] = symbol
    starts = np.zeros(len(out), bool)
    starts[(np.cumsum(per) - per)[n > 0]] = True
    return out, starts


def expected(start, step, emit, seg: np.ndarray, begins: np.ndarray):
    """Baum-Welch sums of segments: (log10 likelihood, start, transition, emission counts). Arrays hold states in rows and segments in columns."""
    states = len(start)
    order = np.argsort(-(seg >= 0).sum(1), kind="stable")
    seg, begins = np.ascontiguousarray(seg[order].T), begins[order]
    width, n = seg.shape
    live = (seg >= 0).sum(1).tolist()  # those longer than t, which come first
    rest, by_state, back = stationary(step), np.ascontiguousarray(emit.T), np.ascontiguousarray(step.T)
    alpha, given, norm = [], [], []
    for t in range(width):
        m = live[t]
        if not m:
            break
        given.append(by_state.take(seg[t, :m], axis=1))
        a = (np.where(begins[:m], start[:, None], rest[:, None]) if t == 0 else back @ alpha[t - 1][:, :m]) * given[t]
        norm.append(a.sum(0))
        a /= norm[t]
        alpha.append(a)
    counts, moves = np.zeros((emit.shape[0], states)), np.zeros((states, states))
    gammas: list[np.ndarray] = []
    beta = np.ones((states, n), np.float32)
    for t in range(len(alpha) - 1, -1, -1):
        if t + 1 < len(alpha):
            k = live[t + 1]
            right = given[t + 1] * beta[:, :k]
            right /= norm[t + 1]
            moves += (alpha[t][:, :k] @ right.T).astype(np.float64) * step
            beta[:, :k] = step @ right
        gammas.append(alpha[t] * beta[:, : live[t]])
    if not alpha:
        return 0.0, np.zeros(states), moves, counts
    # Two bytes hold every symbol, and are sorted by counting.
    symbol = np.concatenate([seg[t, : live[t]] for t in range(len(alpha) - 1, -1, -1)]).astype(np.uint16)
    by = np.argsort(symbol, kind="stable")
    at = np.flatnonzero(np.diff(symbol[by].astype(np.int32), prepend=-1))
    counts[symbol[by[at]]] = np.add.reduceat(np.concatenate(gammas, 1).take(by, axis=1), at, axis=1, dtype=np.float64).T
    return float(sum(np.log10(x).sum(dtype=np.float64) for x in norm)), gammas[-1][:, begins[: live[0]]].sum(1, dtype=np.float64), moves, counts


def stationary(step: np.ndarray) -> np.ndarray:
    out = np.full(len(step), 1 / len(step), np.float64)
    for _ in range(64):
        out = out @ step.astype(np.float64)
        out /= out.sum()
    return out.astype(np.float32)


def maximise(first, moves, counts, unigram):
    """Parameters of the expected counts, smoothed towards the unigram so that nothing is impossible."""
    start = first + 0.1
    step = moves + 0.1
    emit = counts + 5.0 * unigram[:, None]
    return (start / start.sum()).astype(np.float32), (step / step.sum(1, keepdims=True)).astype(np.float32), (emit / emit.sum(0)).astype(np.float32)


def first_guess(unigram: np.ndarray, seeds: list[np.ndarray]):
    """Parameters to start from; `seeds` are the symbols of the texts that states start near to, STATES at most."""
    rng = np.random.Generator(np.random.PCG64(11))
    emit = np.repeat(unigram[:, None], STATES, 1) * rng.uniform(0.5, 1.5, (len(unigram), STATES))
    for s, symbol in enumerate(seeds):
        emit[:, s] += np.bincount(symbol, minlength=len(unigram)) / len(symbol)
    emit /= emit.sum(0)
    step = np.full((STATES, STATES), 0.05 / (STATES - 1))
    np.fill_diagonal(step, 0.95)
    return np.full(STATES, 1 / STATES, np.float32), step.astype(np.float32), emit.astype(np.float32)


_models: list[tuple] = []


def opened(shared) -> Model:
    if not _models or _models[0][0] is not shared.value:
        _models[:] = [(shared.value, shared.value.open())]
    return _models[0][1]


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """(model, counts of all training tokens) from docs (doc_id, text), without the held-out fold."""
    spark = docs.sparkSession
    train = docs.where(~held_out())
    counts = saved(count_tokens(train))
    vocabulary, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # The head is whole eighths of octaves of counts, as many as have HEAD tokens at most together.
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    least, size = None, 0
    for at, n in sorted(counts.groupBy(level.alias("at")).agg(F.count("*")).collect(), reverse=True):
        if size + n > HEAD:
            break
        least, size = at, size + n
    top = counts.where(level >= least if least is not None else F.lit(False)).select("h", "kind", "n").toPandas()
    top = top.sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    # Tail classes are of all tokens but the model's own words.
    kinds_n, kinds_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for kind, n, v in counts.groupBy("kind").agg(F.sum("n"), F.count("*")).collect():
        kinds_n[kind], kinds_v[kind] = n, v
    own = top.head(MODEL_WORDS)
    np.subtract.at(kinds_n, own["kind"].to_numpy(np.int64), own["n"].to_numpy(float))
    np.subtract.at(kinds_v, own["kind"].to_numpy(np.int64), 1.0)
    model = Model(top["h"].to_numpy(np.int64).view(np.uint64).copy(), top["n"].to_numpy(np.int64).copy(), kinds_n, kinds_v, int(total), int(vocabulary))
    unigram = np.zeros(model.symbols)
    unigram[: model.own] = model.head_n[: model.own]
    unigram[MODEL_WORDS:] = kinds_n
    unigram = (unigram + 1e-3) / (unigram + 1e-3).sum()
    # Where states start: the beginnings of the first texts by a hash of their content. Nothing is fitted here.
    head = F.substring("text", 1, 8 * SEGMENT).alias("head")
    drawn = train.select(head).where("head IS NOT NULL").distinct().orderBy(F.xxhash64("head"), "head").limit(STATES).collect()
    model.open()
    seeds = []
    for (text,) in drawn:
        _, h, kind = tokens_of(*K.utf8(pa.array([text], pa.string())))
        seeds.append(model.symbols_of(h, kind)[0][:SEGMENT])
    model.start, model.step, model.emit = first_guess(unigram, seeds)
    del model.index, model.exact
    symbols = encoded(train, model)
    for _ in range(PASSES):
        first, moves, emitted = _pass(symbols, model)
        if emitted.sum() > 0:
            model.start, model.step, model.emit = maximise(first, moves, emitted, unigram)
    return model, counts


def encoded(train: DataFrame, model: Model) -> DataFrame:
    """A table of one row (symbols binary) for each text of train: its symbols, two bytes each, which all iterations read."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = opened(shared)
        for batch in batches:
            for i, j, data, offsets in K.pieces(batch.column(0)):
                row, h, kind = tokens_of(data, offsets)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]) * 2
                data = m.symbols_of(h, kind)[0].astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())], ["symbols"])

    return saved(train.select("text").transform(arrow_map, run, "symbols binary"))


def _pass(symbols: DataFrame, model: Model):
    """Expected counts of one Baum-Welch iteration, summed within tasks and then across them."""
    spark = symbols.sparkSession
    sizes = (STATES, STATES * STATES, model.symbols * STATES)
    shared = spark.sparkContext.broadcast((model.start, model.step, model.emit))

    def run(batches):
        start, step, emit = shared.value
        total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(emit), STATES))]
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
            data = np.frombuffer(column.buffers()[2] or b"", np.uint16)
            for i, j in K.chunks(offsets, AT_ONCE):
                n = np.diff(offsets[i : j + 1])
                seg, begins = segments(np.repeat(np.arange(j - i), n), data[offsets[i] : offsets[j]])
                for x, y in zip(total, expected(start, step, emit, seg, begins)[1:], strict=True):
                    x += y
        rows = list(blocks_of(np.concatenate([x.ravel() for x in total])))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["block", "data"])

    merged = merge_blocks(symbols.transform(arrow_map, run, "block int, data binary"), "float64")
    total = np.zeros(sum(sizes))
    for row in merged.collect():
        part = unpack(row["data"], "float64")
        total[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    a, b = sizes[0], sizes[0] + sizes[1]
    return total[:a], total[a:b].reshape(STATES, STATES), total[b:].reshape(-1, STATES)


def forward(model: Model, row: np.ndarray, symbol: np.ndarray, rows: int) -> np.ndarray:
    """log10 likelihood of each row's symbols by the scaled forward recursion, all rows in step."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    out = np.zeros(rows)
    start, step, emit = model.exact
    alpha = np.repeat(start[None], rows, 0)
    for t in range(int(n[0]) if rows else 0):
        m = int(np.searchsorted(-n, -t, "left"))
        a = alpha[:m] if t == 0 else alpha[:m] @ step
        a = a * emit[symbol[first[:m] + t]]
        norm = a.sum(1)
        alpha[:m] = a / norm[:, None]
        out[:m] += np.log10(norm)
    back = np.empty(rows)
    back[order] = out
    return back


def score(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model, counts = fit(docs)
    shared = spark.sparkContext.broadcast(model)
    below = float(np.log10(model.total + model.vocabulary + 1))

    def run(batches):
        m = opened(shared)
        of_kind = np.log10(m.kinds_n + m.kinds_v + 1)
        for batch in batches:
            ids = batch.column(0)
            _, all_offsets = K.utf8(batch.column(1))
            for i, j in K.chunks(all_offsets, 4 * IN_STEP):
                part = [tokens_of(d, o) for _, _, d, o in K.pieces(batch.column(1).slice(i, j - i))]
                shift = np.cumsum([0, *(p[0][-1] + 1 for p in part)])
                row = np.concatenate([p[0] + s for p, s in zip(part, shift, strict=False)])
                h, kind = np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part])
                rows = j - i
                symbol, at = m.symbols_of(h, kind)
                value = forward(m, row, symbol, rows)
                known = at >= 0
                logc = np.zeros(len(at))
                logc[known] = np.log10(m.head_n[at[known]] + 1.0)
                base = np.bincount(row, weights=logc, minlength=rows)
                within = np.where(symbol >= MODEL_WORDS, logc - of_kind[kind], 0.0)
                value += np.bincount(row, weights=within, minlength=rows)
                n = np.bincount(row, minlength=rows)
                order = np.lexsort((h[~known], row[~known]))
                tail_row, tail_h = row[~known][order], h[~known][order]
                new = np.ones(len(tail_h), bool)
                new[1:] = (tail_row[1:] != tail_row[:-1]) | (tail_h[1:] != tail_h[:-1])
                first = np.flatnonzero(new)
                tf = np.diff(np.concatenate([first, [len(tail_h)]])).astype(np.int32)
                per = np.bincount(tail_row[first], minlength=rows) if len(first) else np.zeros(rows, np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
                whole = np.zeros(rows, np.uint64)
                np.add.at(whole, row, K.mix(h + np.arange(len(h)).astype(np.uint64) - np.repeat((np.cumsum(n) - n).astype(np.uint64), n)))
                id64 = ids.slice(i, rows).cast(pa.int64()).fill_null(-1).to_numpy().view(np.uint64)
                key = K.mix(whole ^ K.mix(id64 + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, rows).cast(pa.int64()), K.i64(key), pa.array(n.astype(np.int64)), pa.array(np.bincount(row[known], minlength=rows).astype(np.int64)), pa.array(base), pa.array(value), pa.ListArray.from_arrays(offsets, K.i64(tail_h[first])), pa.ListArray.from_arrays(offsets, pa.array(tf))],
                    ["doc_id", "key", "n_tokens", "n_known", "base", "value", "tail", "tf"],
                )

    rows = saved(docs.transform(arrow_map, run, "doc_id long, key long, n_tokens long, n_known long, base double, value double, tail array<long>, tf array<int>"))
    tail = rows.where("size(tail) > 0").select("key", F.explode(F.arrays_zip("tail", "tf")).alias("t")).select("key", F.col("t.tail").alias("h"), F.col("t.tf").alias("tf"))
    met = tail.join(counts.select("h", "n"), "h")
    sums = met.groupBy("key").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("log"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    sums = sums.join(copies, "key").select("key", (F.col("known") / F.col("copies")).cast("long").alias("known"), (F.col("log") / F.col("copies")).alias("log"))
    more, extra = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return rows.join(sums, "key", "left").select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + extra).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("value") + more).alias("score"),
    )


def op4_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
