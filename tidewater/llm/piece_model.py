"""Reading a SentencePiece model file (a protocol buffer) without its library."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Where the public tokenizer files are; a parameter of all that uses them.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, type
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def parse(data: bytes) -> PieceModel:
    m = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    return m


def load(path: str = DEFAULT_MODEL) -> bytes:
    """The file's bytes, read by the driver; executors get them by broadcast."""
    with open(path, "rb") as f:
        return f.read()
