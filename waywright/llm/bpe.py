"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import SHOW, ChunkEncoder, without_collector

SLICE = 256


def read_ranks(content: bytes) -> list[tuple[bytes, int]]:
    """(token bytes, rank) of a rank file, in ascending rank."""
    rows = (line.split() for line in content.splitlines() if line.strip())
    return sorted(((base64.b64decode(a), int(b)) for a, b in rows), key=lambda x: x[1])


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: list[tuple[bytes, int]]) -> bytes:
    """A serialised sentencepiece BPE model: byte-mapped pieces in rank order, scored by
    negative rank, one unknown piece after them, and identity normalisation."""
    # Field numbers and enum values of the public sentencepiece model format.
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for token, rank in ranks:
        piece = token.decode("latin-1").translate(SHOW).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    out += _field(2, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(n, -1) for n in (41, 42, 43)))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes with a model from ``model_bytes``; built once in each worker process."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.ids = [r for _, r in ranks]
        self.straight = self.ids == list(range(len(ranks)))
        self.bytes = {r: t for t, r in ranks}
        self.whole = self._not_reached(ranks)
        self.encode = ChunkEncoder(pattern, self._encode_pieces, "I")

    def _not_reached(self, ranks: list[tuple[bytes, int]]) -> dict[str, int]:
        """Tokens that merging alone doesn't reach: a pre-token equal to one gets its id all the same."""
        shown = [t.decode("latin-1").translate(SHOW) for t, _ in ranks]
        return {s: i for i, (s, got) in enumerate(zip(shown, self.pieces.encode(shown, num_threads=1), strict=True)) if got != [i]}

    def _encode_pieces(self, parts: list[str]) -> list[list[int]]:
        found = self.pieces.encode(parts, num_threads=1) if parts else []
        if self.whole:
            found = [[self.whole[p]] if p in self.whole else got for p, got in zip(parts, found, strict=True)]
        return found if self.straight else [[self.ids[i] for i in got] for got in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec_for(content: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(content), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Encode every whole ``text`` and decode it again, without any shuffle.

    Returns ``keep`` columns, ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256``
    strings and, if asked for, ``token_ids`` binary (little-endian uint32).  A null text
    counts as an empty one; repeated rows give repeated rows; other columns, whatever
    their names, are ignored.  The vocabulary's bytes, of a fixed size, are broadcast.
    """
    keep = tuple(c for c in keep if c != "text")
    content = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [docs.schema[c] for c in keep]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("token_ids", T.BinaryType())] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(content.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                with without_collector():
                    coded = codec.encode(part.column(len(keep)).to_pylist())
                columns = [part.column(i) for i in range(len(keep))]
                columns += [
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in coded], pa.string()),
                ]
                if ids:
                    columns.append(pa.array(coded, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        codec.encode.kept = {}  # the worker process lives on, beside other operators' memory

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, T.StructType(fields))
