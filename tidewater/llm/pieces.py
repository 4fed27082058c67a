"""Operator 10: SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here; its normaliser, word-start marker, scores,
unknown piece and byte fallback are rebuilt as a tokenizers pipeline. A file
of unigram type becomes a Unigram model with its scores; a file of BPE type
(such as the default one) becomes a BPE model whose merges are all pairs of
pieces that make a piece, ranked by its score. Where no piece has the marker
after another character, texts are cut before runs of markers first, which
changes no result and lets the library remember words. Batches are encoded on
several threads. Decoding joins the pieces' bytes.

Defined results: a null text gives null ids, an empty one none; whatever
the normaliser removes (with this model, nothing) is not restored by decoding.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import kernels as K
from tidewater.llm import piece_model as P
from tidewater.llm.common import table, with_columns

MARK = "▁"
#: Texts' bytes in one call of the library.
BATCH_BYTES = 1 << 19


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (P.NORMAL, P.USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-pieces[i][1], ids[left], ids[right], left, right))
    found.sort(key=lambda x: x[:3])
    return [x[3:] for x in found]


class Codec:
    def __init__(self, data: bytes):
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        self.model = m = P.parse(data)
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        if m.model_type == P.UNIGRAM:
            scored = [(p, s if kind != P.BYTE else -1e9) for p, s, kind in m.pieces]
            core = models.Unigram(scored, unk_id=m.unk_id, byte_fallback=m.byte_fallback)
        else:
            core = models.BPE(vocab, _merges(m.pieces), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.add_dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if m.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        if not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind == P.NORMAL):
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        self.bytes = []
        for p, _, kind in m.pieces:
            if kind == P.BYTE:
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif kind == P.CONTROL:
                self.bytes.append(b"")
            elif kind == P.UNKNOWN:
                self.bytes.append(" ⁇ ".encode())
            else:
                self.bytes.append(p.replace(MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids))
        if self.model.add_dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


#: The codec of this Python worker's current model.
_codecs: list[tuple] = []


def codec(data: bytes) -> Codec:
    if not _codecs or _codecs[0][0] != data:
        _codecs[:] = [(data, Codec(data))]
    return _codecs[0][1]


def _batches(text: pa.Array):
    _, offsets = K.utf8(text)
    for i, j in K.chunks(offsets, BATCH_BYTES):
        yield text.slice(i, j - i).to_pylist()


def encode(docs: DataFrame, model_path: str = P.DEFAULT_MODEL, threads: int = 2, keep: list[str] | None = None) -> DataFrame:
    """The rows of docs with ids array<int> of each text."""
    model = docs.sparkSession.sparkContext.broadcast(P.load(model_path))

    def run(text):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        c = codec(model.value)
        flat, counts = [], []
        for texts in _batches(text):
            for ids in c.encode([t or "" for t in texts]):
                flat.append(np.array(ids, np.int32))
                counts.append(len(ids))
        null = np.asarray(text.is_null())
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.concatenate([null, [False]]))
        return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat or [np.zeros(0, np.int32)]).astype(np.int32)))]

    return with_columns(docs, [F.col("text").cast("string")], [("ids", "array<int>")], run, keep)


def decode(docs: DataFrame, model_path: str = P.DEFAULT_MODEL, keep: list[str] | None = None) -> DataFrame:
    """The rows of docs (with ids array<int>) with the decoded text; null ids give a null text."""
    model = docs.sparkSession.sparkContext.broadcast(P.load(model_path))

    def run(ids):
        c = codec(model.value)
        return [pa.array([None if x is None else c.decode(x) for x in ids.to_pylist()], pa.string())]

    return with_columns(docs, [F.col("ids")], [("text", "string")], run, keep)


def digests(docs: DataFrame, model_path: str = P.DEFAULT_MODEL, threads: int = 2, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """The rows of docs with the ids themselves (if asked for), n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), n_bytes (ids of byte pieces)
    and round_trip (whether decoding the ids gives the text again); all null for a null text."""
    model = docs.sparkSession.sparkContext.broadcast(P.load(model_path))
    new = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("n_bytes", "bigint"), ("round_trip", "boolean")]
    new += [("ids", "array<int>")] * with_ids

    def run(text):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        c = codec(model.value)
        is_byte = np.array([kind == P.BYTE for _, _, kind in c.model.pieces])
        out = []
        for texts in _batches(text):
            for t, ids in zip(texts, c.encode([t or "" for t in texts]), strict=True):
                if t is None:
                    out.append((None,) * 5)
                    continue
                a = np.array(ids, "<i4")
                out.append((len(ids), hashlib.sha256(a.tobytes()).hexdigest(), int(is_byte[a].sum()), c.decode(ids) == t, a if with_ids else None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))[: len(new)]
        return [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]

    return with_columns(docs, [F.col("text").cast("string")], new, run, keep)


def parity(docs: DataFrame, model_path: str = P.DEFAULT_MODEL, keep: list[str] | None = None) -> DataFrame:
    """The rows of docs with `same`: whether the sentencepiece library gives the same ids and the same decoded text; null for a null text."""
    model = docs.sparkSession.sparkContext.broadcast(P.load(model_path))

    def run(text):
        import sentencepiece

        c, other = codec(model.value), sentencepiece.SentencePieceProcessor(model_proto=model.value)
        out = []
        for texts in _batches(text):
            plain = [t or "" for t in texts]
            ours, theirs = c.encode(plain), other.encode(plain)
            out += [None if t is None else a == b and c.decode(a) == other.decode(b) for t, a, b in zip(texts, ours, theirs, strict=True)]
        return [pa.array(out, pa.bool_())]

    return with_columns(docs, [F.col("text").cast("string")], [("same", "boolean")], run, keep)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
