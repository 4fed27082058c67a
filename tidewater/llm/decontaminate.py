"""Operator 9: benchmark decontamination by suffix arrays over the training texts.

Every shard (about a megabyte of whole documents) gets a suffix array of its
words, restricted to suffixes that begin with a word sequence some test item
has (others can match nothing) and sorted to DEPTH words, which is more than
a window has. All suffixes of all test items are looked up in it by binary
search; the interval that agrees on a window gives all its occurrences, and
each is extended to the longest verbatim match. Nothing is shuffled: a
document lies in one shard, and test items are broadcast in blocks of at most
BLOCK_WORDS words, one pipelined pass for each block.

Words are compared by 64-bit hashes. Defined results: null and empty texts
have no words and no hits; null items and items without words match nothing;
items with a null item_id hit words but are left out of the list of items;
repeated items count once; repeated documents give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import kernels as K
from tidewater.llm.common import table, unused, with_columns

#: Words in a window; shorter items are one window.
WINDOW = 13
#: Words to which suffixes are sorted: 3 in each of DEPTH // 3 integers of 63 bits.
DEPTH, WORD_BITS = 15, 21
#: Occurrences that are looked at at once: a passage that many items share has as many for each place.
MATCHES = 1 << 20
#: Test words in one broadcast block (their ids fit WORD_BITS).
BLOCK_WORDS = 1 << 19


class Tests:
    """One block of test items: word ids and the windows to look for."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.names = [n for n, _ in items]
        lengths = np.array([len(w) for _, w in items])
        every = np.concatenate([w for _, w in items])
        self.vocab = np.unique(every)
        self.end = np.cumsum(lengths)
        first = self.end - lengths
        self.ids = np.concatenate([np.searchsorted(self.vocab, every) + 1, np.zeros(DEPTH, np.int64)])
        item = np.repeat(np.arange(len(items)), lengths)
        width = np.minimum(lengths, window)
        at = np.arange(len(every))
        whole = at + width[item] <= self.end[item]
        self.at, self.item, self.width = at[whole], item[whole], width[item[whole]]
        self.gram = int(min(3, width.min()))
        keep = at + self.gram <= self.end[item]
        self.grams = np.unique(_pack(self.ids, at[keep], self.gram))
        self.low, self.high = _keys(self.ids, self.at, self.width, 0), _keys(self.ids, self.at, self.width, (1 << WORD_BITS) - 1)
        self.first = first


def _pack(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(n):
        out = (out << WORD_BITS) | ids[at + k]
    return out


def _keys(ids: np.ndarray, at: np.ndarray, width=None, fill: int = 0) -> list[np.ndarray]:
    """Suffixes as DEPTH // 3 integers; beyond `width` words each is filled."""
    out = []
    for k in range(0, DEPTH, 3):
        key = np.zeros(len(at), np.int64)
        for i in range(k, k + 3):
            word = ids[at + i]
            key = (key << WORD_BITS) | (word if width is None else np.where(i < width, word, fill))
        out.append(key)
    return out


def _search(suffixes: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Lexicographic binary search of all wanted keys at once."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(suffixes[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        probe = np.minimum(mid, len(suffixes[0]) - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for have, want in zip(suffixes, wanted, strict=True):
            h = have[probe]
            less |= same & (h < want)
            same &= h == want
        go = open_ & (less | same if right else less)
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def search_shard(tests: Tests, row: np.ndarray, h: np.ndarray):
    """(window, word, longest) of every occurrence of a test window among the words of a shard, at most MATCHES at once."""
    n = len(h)
    where = np.minimum(np.searchsorted(tests.vocab, h), len(tests.vocab) - 1)
    known = np.where(tests.vocab[where] == h, where + 1, 0)
    # A word that no item has stands between documents, so that no match crosses them.
    gap = row + np.arange(n)
    ids = np.zeros((gap[-1] if n else 0) + 1 + 2 * DEPTH, np.int64)
    ids[gap] = known
    start = gap[known > 0]
    gram = _pack(ids, start, tests.gram)
    near = np.minimum(np.searchsorted(tests.grams, gram), len(tests.grams) - 1)
    start = start[tests.grams[near] == gram]
    if not len(start):
        return
    keys = _keys(ids, start)
    order = np.lexsort(keys[::-1])
    suffixes, start = [k[order] for k in keys], start[order]
    lo, hi = _search(suffixes, tests.low, False), _search(suffixes, tests.high, True)
    last = np.cumsum(hi - lo)
    for begin in range(0, int(last[-1]), MATCHES):
        at = np.arange(begin, min(begin + MATCHES, int(last[-1])))
        window = np.searchsorted(last, at, "right")
        place = start[hi[window] - (last[window] - at)]
        length = tests.width[window].copy()
        room = tests.end[tests.item[window]] - tests.at[window]
        live = np.flatnonzero(length < room)
        while len(live):
            live = live[ids[np.minimum(place[live] + length[live], len(ids) - 1)] == tests.ids[tests.at[window[live]] + length[live]]]
            length[live] += 1
            live = live[length[live] < room[live]]
        yield window, np.searchsorted(gap, place), length


def test_blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS):
    """Test items, streamed to the driver and cut into blocks of a bounded number of words."""
    held, size, seen = [], 0, set()
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct()
    for name, text in rows.toLocalIterator():
        data, offsets = K.utf8(pa.array([text]))
        h = K.words(data, offsets, K.ALNUM)[3]
        if not len(h) or (name, h.tobytes()) in seen:
            continue
        for part in range(0, len(h), block_words):  # an item longer than a block: overlapping parts lose no window
            piece = h[part : part + block_words + window - 1]
            if part and len(piece) < window:
                continue
            if held and size + len(piece) > block_words:
                yield Tests(held, window)
                held, size, seen = [], 0, set()
            held.append((name, piece))
            size += len(piece)
        seen.add((name, h.tobytes()))
    if held:
        yield Tests(held, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """Columns of docs (those in `keep`; the text must be among all of them) with n_words, n_hit, items array<string>,
    longest (words of the longest verbatim match) and longest_at (its first word in the document, -1: none); the new names begin with prefix."""
    spark = docs.sparkSession
    new = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("longest", "bigint"), ("longest_at", "bigint"), ("__hit", "binary")]
    new = [(prefix + n, t) for n, t in new]
    wanted = list(docs.columns if keep is None else keep)
    blocks = test_blocks(benchmark, window, block_words)
    block, k = next(blocks, None), 0
    while True:
        held, block = spark.sparkContext.broadcast(block), next(blocks, None)

        def mark(text, *old, held=held):
            found = [_mark(held.value, data, offsets, i, old) for i, j, data, offsets in K.pieces(text)]
            return [pa.concat_arrays([f[c] for f in found]) for c in range(len(new))]

        text = F.col("text").cast("string")
        old = [F.col(c) for c, _ in new[2:]] if k else []
        docs, k = with_columns(docs, [text, *old], new, mark, wanted if block is None else None), k + 1
        if block is None:
            break
    return docs.drop(f"{prefix}__hit")


def _mark(tests, data, offsets, at, old):
    rows = len(offsets) - 1
    row, _, _, h = K.words(data, offsets, K.ALNUM)
    n_words = np.bincount(row, minlength=rows)
    first = np.cumsum(n_words) - n_words
    hit = np.zeros(len(h) + 1, np.int64)
    items, longest, where = [set() for _ in range(rows)], np.zeros(rows, np.int64), np.full(rows, -1)
    if old:
        for r in range(rows):
            items[r] |= set(old[0][at + r].as_py() or ())
            longest[r], where[r] = old[1][at + r].as_py(), old[2][at + r].as_py()
            if (bits := old[3][at + r].as_py()) is not None:
                was = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n_words[r])).astype(np.int64)
                edge = np.diff(np.concatenate([[0], was, [0]]))
                hit[first[r] : first[r] + len(edge)] += edge
    if tests is not None and len(h):
        found = search_shard(tests, row, h)
    else:
        found = ()
    for window, word, length in found:
        np.add.at(hit, word, 1)
        np.add.at(hit, word + tests.width[window], -1)
        owner = row[word]
        for r, item in np.unique(np.stack([owner, tests.item[window]], 1), axis=0).tolist():
            if tests.names[item] is not None:
                items[r].add(tests.names[item])
        best = np.lexsort((word, -length, owner))
        lead = best[np.concatenate([[True], owner[best][1:] != owner[best][:-1]])] if len(best) else best
        better = length[lead] > longest[owner[lead]]
        longest[owner[lead[better]]] = length[lead[better]]
        where[owner[lead[better]]] = (word - first[owner])[lead[better]]
    is_hit = np.cumsum(hit[:-1]) > 0
    n_hit = np.bincount(row[is_hit], minlength=rows) if len(h) else np.zeros(rows, np.int64)
    bits = [np.packbits(is_hit[first[r] : first[r] + n_words[r]]).tobytes() if n_hit[r] else None for r in range(rows)]
    return [pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest), pa.array(where.astype(np.int64)), pa.array(bits, pa.binary())]


#: A document is contaminated where at least one in this many of its words is hit.
SHARE = 20


def is_contaminated() -> F.Column:
    n_hit, n_words = F.col("n_hit"), F.col("n_words")
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, in which no window of a benchmark item occurs."""
    mark = unused(docs, "__ct_")
    found = contamination(docs, benchmark, prefix=mark).where(F.col(f"{mark}n_hit") == 0)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        "longest",
        "longest_at",
    )


def _sql() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
iw AS (SELECT k, item, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM i WHERE len(w) > 0) x, unnest(range(1, len(w) - n + 2)) u(s)),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT d.*, n FROM d, (SELECT DISTINCT n FROM iw) z WHERE len(w) >= n) x, unnest(range(1, len(w) - n + 2)) u(p)),
m AS (SELECT r, k, item, n, s, p FROM dw JOIN iw USING (n, t)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + n)) u(q) GROUP BY r),
runs AS (SELECT r, count(*) + n - 1 AS length, min(p) - 1 AS first_word FROM (SELECT *, p - row_number() OVER (PARTITION BY r, k, n, p - s ORDER BY p) AS island FROM m) x GROUP BY r, k, n, p - s, island),
best AS (SELECT r, max(length) AS longest, min(first_word) FILTER (WHERE length = most) AS longest_at FROM (SELECT *, max(length) OVER (PARTITION BY r) AS most FROM runs) x GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(coalesce(longest_at, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN h USING (r) LEFT JOIN best USING (r) LEFT JOIN t USING (r)
"""


OP9_SQL = _sql()
