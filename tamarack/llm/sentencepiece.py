"""SentencePiece encoding and decoding on the `tokenizers` library.

The model's protobuf is read here, without the sentencepiece package: pieces with scores and kinds, the kind of
model, and the normaliser's settings. From it are rebuilt

- the normaliser (the compiled character map, if the model has one; removal of extra white space; the dummy prefix),
- the metaspace marker, U+2581 in place of spaces,
- the model: unigram scores, or for BPE models the merges in the order of their scores, both with byte fallback.

No piece of a usual model has the marker after another character, so a text may be cut before each run of markers
without any change to the result; this is checked when the model is loaded. Encoding cuts a batch so, encodes
each distinct part once with encode_batch (multithreaded, RAYON_NUM_THREADS) and puts the ids together.
A model where the check fails is encoded text by text.

`parity` compares with the sentencepiece package. A null or empty text has no ids and decodes to the
empty text. Decoding gives the normalised text: for an identity normaliser the text itself, apart from the
symbols U+2581, which become spaces.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keeps, require, text_of, trim, trim_after

MARK = "▁"
#: Begins the names of pieces that no text spells, and what stands for it where a text has it: neither is in a vocabulary.
HIDDEN, SHOWN = "\uf8ff", "\uf8fe"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct parts whose ids a worker remembers between batches; beyond that it starts anew.
KNOWN_PARTS = 1 << 18
#: Parts that are encoded at a time: the library's results take about a kilobyte each until they are arrays.
ENCODED_PARTS = 1 << 12


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        match key & 7:
            case 0:
                yield key >> 3, varint()
            case 1:
                yield key >> 3, data[at : at + 8]
                at += 8
            case 2:
                n = varint()
                yield key >> 3, data[at : at + n]
                at += n
            case 5:
                yield key >> 3, data[at : at + 4]
                at += 4
            case other:
                raise ValueError(f"a protobuf field of wire type {other}")


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    model.unk_id = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError(f"models of kind {model.kind} are not supported")
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Each normal piece as all pairs of pieces that make it, in order of falling scores."""
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
    out = []
    for i, (p, s, kind) in enumerate(pieces):
        if kind == NORMAL and len(p) > 1:
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in score and b in score:
                    out.append((-s, i, cut, a, b))
    return [(a, b) for *_, a, b in sorted(out)]


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, models, normalizers

        self.model = m = parse_model(data)
        self.charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        vocab = [p for p, _, _ in m.pieces]
        unk = vocab[m.unk_id]
        if m.kind == BPE:
            own = models.BPE(vocab={p: i for i, p in enumerate(vocab)}, merges=merges_of(m.pieces), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            # Text spells normal and user pieces only. The others keep their ids under names with a character that is
            # taken out of texts before; bytes are put in for what is unknown. User pieces win, by their length.
            best = max((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
            least = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
            own = models.Unigram([self._spelled(i, *piece, best, least) for i, piece in enumerate(m.pieces)], unk_id=m.unk_id, byte_fallback=False)
        self.tokenizer = Tokenizer(own)
        self.cuttable = not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER))
        self.parts = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        bytes_of = []
        for p, _, kind in m.pieces:
            bytes_of.append(bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.encode())
        self.piece_bytes = np.array(bytes_of, dtype=object)
        self._forget()

    @staticmethod
    def _spelled(i: int, piece: str, score: float, kind: int, best: float, least: float) -> tuple[str, float]:
        if kind == NORMAL:
            return piece, score
        if kind == USER:
            return piece, len(piece.encode()) * best - 0.1
        return f"{HIDDEN}{i}", least

    def _ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts, without those that were met before."""
        m = self.model
        shown = [p.replace(HIDDEN, SHOWN) for p in parts] if m.kind == UNIGRAM else parts
        out = [e.ids for e in self.tokenizer.encode_batch_fast(shown, add_special_tokens=False)]
        if m.kind == UNIGRAM and m.byte_fallback:
            for i, ids in enumerate(out):
                if m.unk_id in ids:
                    e = self.tokenizer.encode(shown[i], add_special_tokens=False)
                    out[i] = [x for k, (a, b) in zip(e.ids, e.offsets, strict=True) for x in ([self.byte_ids[c] for c in parts[i][a:b].encode("utf-8", "surrogatepass")] if k == m.unk_id else [k])]
        return out

    def _forget(self) -> None:
        self.number = _Numbers()
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def normalised(self, text: str) -> str:
        m = self.model
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if m.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        if m.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if m.escape else text

    def _cut(self, plain: str) -> list[str]:
        """Keys of the parts of a normalised text: of a marker and a word the word, of any other part the part after a marker."""
        if not plain:
            return []
        if not self.cuttable:
            return [MARK + plain]
        if plain.startswith(MARK) and MARK + MARK not in plain:
            return plain.split(MARK)[1:]
        return [MARK + p for p in self.parts.findall(plain)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin (with the end)."""
        return self.encode_normalised([self.normalised(t) for t in texts])

    def encode_normalised(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self._cut(t) for t in plain]
        if len(self.number) > KNOWN_PARTS:
            self._forget()
        known, number = len(self.number), self.number
        order = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64)
        if len(number) > known:
            keys, new_ids, new_sizes = islice(number, known, None), [self.ids], [self.sizes]
            while some := [k[1:] if k.startswith(MARK) else MARK + k for k in islice(keys, ENCODED_PARTS)]:
                new = self._ids(some)
                new_ids.append(np.fromiter(chain.from_iterable(new), np.int32))
                new_sizes.append(np.fromiter(map(len, new), np.int64))
            self.ids, self.sizes = np.concatenate(new_ids), np.concatenate(new_sizes)
        ids, size = self.ids, self.sizes
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        n = size[order]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        out = ids[np.repeat(at[order] - ends[:-1], n) + np.arange(ends[-1])] if len(order) else np.zeros(0, np.int32)
        return out, ends[np.concatenate([np.zeros(1, np.int64), np.cumsum([len(c) for c in cut], dtype=np.int64)])]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.piece_bytes[ids]).decode("utf-8", "replace")
        if self.model.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decoded(self, text: str) -> str:
        """What decoding the ids of a normalised text has to give."""
        if self.model.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix else text


@keeps
@lru_cache(maxsize=1)
def encoder_of(data: bytes) -> Encoder:
    return Encoder(data)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes, read by Spark's own reader where the path is not a local one of the driver."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def encode(docs: DataFrame, model: bytes, parity: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip, parity.

    round_trip: decoding gives the normalised text. parity: the sentencepiece package gives the same ids; null where it was not asked.
    """
    require(docs, "doc_id", "text")
    rows = docs.select("doc_id", text_of().alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Threads of its own, one for each core of the machine, cost memory that the worker doesn't get back.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        own, other = encoder_of(known.value), None
        if parity:
            from sentencepiece import SentencePieceProcessor

            other = SentencePieceProcessor(model_proto=known.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                plain = [own.normalised(t) for t in texts]
                ids, ends = own.encode_normalised(plain)
                each = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                same = [other.encode(t) == x.tolist() for t, x in zip(texts, each, strict=True)] if other else [None] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in each]), pa.array([own.decode(x) == own.decoded(t) for t, x in zip(plain, each, strict=True)]), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "round_trip", "parity"],
                )
                trim_after(part.nbytes)
        trim()

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids are none."""
    require(encoded, "doc_id", "ids")
    known = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder_of(known.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
