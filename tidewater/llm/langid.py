"""Operator 8: language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get one probability in each language.
A word's likelihood is the sum over all its segmentations into pieces, by a
forward recursion; a text's is the product over its words, and the prediction
is the language of highest posterior. The probabilities are learned by
expectation maximisation over the same lattices, from a bounded sample:
SAMPLE_DOCS documents of each language in expectation, chosen by a hash of
doc_id among the rows allowed for learning. Prediction reads whole texts.

Words are runs of letters, lower-cased, with the vocabulary's word-start
marker before them. Defined results: a null text or one without letters gives
`und` and score 0, as does a table without a row to learn from; rows with a
null lang are predicted but not learned from; ties go to the smaller name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import kernels as K
from tidewater.llm import piece_model
from tidewater.llm.common import arrow_map, table, unused, with_columns

SAMPLE_DOCS = 600
FOLDS, ITERATIONS = 5, 4
#: Longest piece in code points, its word-start marker included.
MAX_PIECE = 10
MARK = 0x2581
CACHE_BITS = 18
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        n = 0x40000  # no letters beyond plane 3
        chars = [chr(c) for c in range(n)]
        _tables["letter"] = np.array([c.isalpha() for c in chars])
        _tables["lower"] = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    return _tables["letter"], _tables["lower"]


def code_hash(code: np.ndarray) -> np.ndarray:
    return K.prefix_hash(K.mix(code.astype(np.uint64) + np.uint64(1)))


class Vocabulary:
    def __init__(self, data: bytes):
        pieces = {p.lower() for p, _, kind in piece_model.parse(data).pieces if kind == piece_model.NORMAL}
        keep = sorted(p for p in pieces if len(p) <= MAX_PIECE and all(c.isalpha() or ord(c) == MARK for c in p) and chr(MARK) not in p[1:] and p != chr(MARK))
        code = np.frombuffer("".join(keep).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(p) for p in keep])
        self.index = K.HashIndex(K.span_hash(code_hash(code), end - [len(p) for p in keep], end))
        self.longest = max(map(len, keep))
        self.size = len(keep)


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(row, start, end, code, prefix): words with their markers, in an array of code points."""
    letter, lower = _letters()
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = lead[offsets]
    code = np.where(code < len(letter), code, 0)
    code = np.where(letter[code], lower[code], MARK).astype(np.uint32)
    code = np.insert(code, edges, MARK)  # one before each row and one at the end
    edges = edges + np.arange(len(edges))
    inside = code != MARK
    start = np.flatnonzero(inside[1:] & ~inside[:-1])  # the marker's place
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return np.searchsorted(edges, start, "right") - 1, start, end, code, code_hash(code)


def lattice(vocabulary: Vocabulary, prefix: np.ndarray, start: np.ndarray, length: np.ndarray, j: int):
    """For words of at least j code points: piece numbers ending at j by piece length, -1 where none."""
    for n in range(1, min(j, vocabulary.longest) + 1):
        at = start + (j - n)
        yield n, vocabulary.index.find(K.span_hash(prefix, at, at + n))


def log_likelihoods(vocabulary: Vocabulary, prob: np.ndarray, floor: np.ndarray, prefix, start, length) -> np.ndarray:
    """(word, language) log-likelihoods, all segmentations summed. prob: (piece + 1, language), the last row 0; floor: of a lone unknown letter."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    n, width = len(start), prob.shape[1]
    ring = np.zeros((vocabulary.longest + 1, n, width))
    ring[0] = 1
    scale, out = np.zeros((n, width)), np.zeros((n, width))
    size = vocabulary.longest + 1
    active = n
    for j in range(1, int(length[0]) + 1 if n else 0):
        active = int(np.searchsorted(-length[:active], -j, "right"))
        total = np.zeros((active, width))
        for m, piece in lattice(vocabulary, prefix, start[:active], length[:active], j):
            p = prob[piece]
            if m == 1:
                p = np.where((piece < 0)[:, None], floor, p)
            total += ring[(j - m) % size, :active] * p
        ring[j % size, :active] = total
        if j % 8 == 0:
            top = ring[:, :active].max(0)
            ring[:, :active] /= top
            scale[:active] += np.log(top)
        done = length[:active] == j
        if done.any():
            at = np.flatnonzero(done)
            out[at] = np.log(ring[j % size, at]) + scale[at]
    back = np.empty_like(out)
    back[order] = out
    return back


def train(counts: list[tuple[str, str, int]], vocabulary: Vocabulary, iterations: int = ITERATIONS):
    """(languages, prob, floor) from rows (language, word with marker, count)."""
    languages = sorted({x[0] for x in counts})
    width = len(languages)
    of = {x: i for i, x in enumerate(languages)}
    prob = np.full((vocabulary.size + 1, width), 1.0 / vocabulary.size)
    prob[-1] = 0
    floor = np.full(width, 1e-7)
    rows = sorted(((len(w), w, of[lang], n) for lang, w, n in counts if len(w) <= 48), key=lambda x: x[:3])
    for _ in range(iterations):
        expected = np.zeros((vocabulary.size + 1, width))
        for b in range(0, len(rows), 8192):
            part = rows[b : b + 8192]
            code = np.frombuffer("".join(r[1] for r in part).encode("utf-32-le"), np.uint32)
            length = np.array([r[0] for r in part])
            start = np.cumsum(length) - length
            lang, weight = np.array([r[2] for r in part]), np.array([float(r[3]) for r in part])
            prefix, longest = code_hash(code), int(length.max())
            alpha = np.zeros((longest + 1, len(part)))
            alpha[0] = 1
            edges = []
            for j in range(1, longest + 1):
                live = np.flatnonzero(length >= j)
                for m, piece in lattice(vocabulary, prefix, start[live], length[live], j):
                    p = prob[piece, lang[live]]
                    if m == 1:
                        p = np.where(piece < 0, floor[lang[live]], p)
                    use = p > 0
                    alpha[j, live[use]] += alpha[j - m, live[use]] * p[use]
                    edges.append((j, m, live[use], piece[use], p[use]))
            beta = np.zeros_like(alpha)
            beta[length, np.arange(len(part))] = 1
            total = alpha[length, np.arange(len(part))]
            for j, m, live, piece, p in reversed(edges):
                gain = p * beta[j, live]
                share = alpha[j - m, live] * gain / total[live] * weight[live]
                known = piece >= 0
                np.add.at(expected, (piece[known], lang[live[known]]), share[known])
                beta[j - m, live] += gain
        prob = (expected + 0.01) / (expected + 0.01).sum(0)
        prob[-1] = 0
    return languages, prob, floor


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, model_path: str = piece_model.DEFAULT_MODEL, sample_docs: int = SAMPLE_DOCS):
    """Broadcast (vocabulary file, languages, prior, prob, floor), learned from docs (doc_id, text, lang) outside the held-out fold."""
    spark = docs.sparkSession
    data = piece_model.load(model_path)
    vocabulary = Vocabulary(data)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    counts = []
    if sizes:
        share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))]), F.col("lang"))
        draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.lit(1 << 20)) / float(1 << 20)
        sample = rows.where(draw < share).select("lang", "text")

        def count(batches):
            for batch in batches:
                lang = batch.column(0).to_pylist()
                found: dict[tuple[str, str], int] = {}
                for i, _, d, offsets in K.pieces(batch.column(1)):
                    row, start, end, code, _ = words_of(d, offsets)
                    text = code.tobytes().decode("utf-32-le")
                    for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
                        key = (lang[i + r], text[a:b])
                        found[key] = found.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

        words = sample.transform(arrow_map, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        counts = [tuple(r) for r in words.toLocalIterator()]
    total = sum(sizes.values())
    languages, prob, floor = train(counts, vocabulary) if counts else ([], None, None)
    prior = np.log(np.array([sizes[x] / total for x in languages])) if languages else None
    return spark.sparkContext.broadcast((data, languages, prior, prob, floor))


class Scorer:
    """Predictions of whole texts; a direct-mapped cache of bounded size remembers words."""

    def __init__(self, data, languages, prior, prob, floor):
        self.vocabulary, self.languages, self.prior, self.prob, self.floor = Vocabulary(data), languages, prior, prob, floor
        self.seen = np.zeros(1 << CACHE_BITS, np.uint64)
        self.value = np.zeros((1 << CACHE_BITS, len(languages)), np.float32)

    def __call__(self, text: pa.Array):
        rows = len(text)
        total, n = np.zeros((rows, len(self.languages))), np.zeros(rows, np.int64)
        for i, j, data, offsets in K.pieces(text):
            row, start, end, _, prefix = words_of(data, offsets)
            if not len(row):
                continue
            h, where, back = np.unique(K.span_hash(prefix, start, end), return_index=True, return_inverse=True)
            slot = (h & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int64)
            value = self.value[slot]
            new = np.flatnonzero(self.seen[slot] != h)
            if len(new):
                first = where[new]
                value[new] = log_likelihoods(self.vocabulary, self.prob, self.floor, prefix, start[first], (end - start)[first])
                _, one = np.unique(slot[new], return_index=True)  # of words that share a slot one is remembered
                self.seen[slot[new[one]]], self.value[slot[new[one]]] = h[new[one]], value[new[one]]
            for c in range(len(self.languages)):
                total[i:j, c] += np.bincount(row, weights=value[back, c], minlength=j - i)
            n[i:j] += np.bincount(row, minlength=j - i)
        total += self.prior
        best = total.argmax(1)
        with np.errstate(over="ignore"):
            score = 1 / np.exp(total - total[np.arange(rows), best][:, None]).sum(1)
        names = [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(n > 0, score, 0.0))]


#: The scorer of this Python worker's current model.
_scorers: list[tuple] = []


def identify(docs: DataFrame, model, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The rows of docs with lang_pred and score, names that begin with prefix; `model` comes from fit()."""

    def predict(text):
        if not model.value[1]:
            return [pa.array(["und"] * len(text), pa.string()), pa.array(np.zeros(len(text)))]
        if not _scorers or _scorers[0][0] is not model.value:
            _scorers[:] = [(model.value, Scorer(*model.value))]
        return _scorers[0][1](text)

    return with_columns(docs, [F.col("text").cast("string")], [(f"{prefix}lang_pred", "string"), (f"{prefix}score", "double")], predict, keep)


def with_language(docs: DataFrame, model_path: str = piece_model.DEFAULT_MODEL) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language (not `und`)."""
    model = fit(docs.select("doc_id", "text", "lang"), model_path)
    mark = unused(docs, "__li_")
    found = identify(docs, model, prefix=mark).where(F.col(f"{mark}lang_pred") != "und")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
