"""Token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import PieceEncoder, without_collector

SLICE = 256
#: Documents, and ids beyond one document's, that are read together.
READ_DOCS, READ_TOKENS = 10_000, 4_000_000


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's URI; a mounted folder may be given as ``file:`` or as a path."""
    return pafs.FileSystem.from_uri(re.sub(r"^(?:file:/*)?/", "file:///", folder))


_encoders: dict[str, TextEncoder] = {}


class TextEncoder:
    """Texts to the bytes of their ids, through the library's model; texts with an added token in them through its ``encode``."""

    def __init__(self, tokenizer_json: str, pattern: str, width: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        tokenize = self.library.model.tokenize
        self.width = width
        self.pieces = PieceEncoder(pattern, lambda piece: [t.id for t in tokenize(piece)], "H" if width == "<u2" else "I")
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        found = {i for i, t in enumerate(texts) if t and self.added and self.added.search(t)}
        plain = iter(self.pieces(t for i, t in enumerate(texts) if i not in found))
        return [self._whole(t) if i in found else next(plain) for i, t in enumerate(texts)]


def _encoder(tokenizer_json: str, pattern: str, width: str) -> TextEncoder:
    """One in each worker process."""
    key = hashlib.sha256((tokenizer_json + pattern + width).encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = TextEncoder(tokenizer_json, pattern, width)
    return _encoders[key]


def write_token_files(docs: DataFrame, folder: str, tokenizer_json: str, pattern: str, end_id: int | None = None) -> list[dict]:
    """Encode every whole text and write ids in ascending ``doc_id`` order; returns the manifest.

    Rows are range-partitioned and sorted by ``doc_id`` (nulls first, equal ids by a hash of their
    text), so that an id of many rows spreads over tasks.
    Each task writes ``<name>.ids`` (flat unsigned integers, 16 bits wide if the vocabulary
    allows, else 32), ``<name>.off`` (64-bit offsets, one more than documents) and
    ``<name>.doc`` (64-bit document ids; a mask byte each for null ids in ``<name>.nul``).
    A name holds the task's attempt, and only the attempt that Spark accepts returns its
    name, so retried or speculative tasks do no harm.  Partition bases are prefix sums of
    the counts that tasks return, one row a partition.

    The vocabulary is a byte-level BPE without normaliser whose pre-tokenizer splits by
    ``pattern``; added tokens written out in a text get their ids, as the library's
    ``encode(add_special_tokens=False)`` gives them.  A null text counts as empty; an empty
    table gives an empty manifest; repeated rows are written each; other columns, whatever
    their names, are ignored.
    """
    spec = json.loads(tokenizer_json)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), end_id or 0])
    width = "<u2" if top < 1 << 16 else "<u4"
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = ["part", "name", "width", "n_docs", "n_tokens"]
    schema = "part long, name string, width string, n_docs long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(content.value, pattern, width)
        end = b"" if end_id is None else np.array([end_id], width).tobytes()
        task, fs, root = TaskContext.get(), *_open(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        size, n_docs, n_tokens = np.dtype(width).itemsize, 0, 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}.ids") as ids, fs.open_output_stream(f"{root}/{name}.off") as off, fs.open_output_stream(f"{root}/{name}.doc") as doc, fs.open_output_stream(f"{root}/{name}.nul") as nul:
            off.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    with without_collector():
                        coded = [x + end for x in encode(part.column(1).to_pylist())]
                    ends = n_tokens + np.cumsum([len(x) // size for x in coded])
                    ids.write(b"".join(coded))
                    off.write(ends.astype("<i8").tobytes())
                    key = part.column(0)
                    doc.write(key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    nul.write(key.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                    n_docs, n_tokens = n_docs + part.num_rows, int(ends[-1])
        if n_docs:
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([task.partitionId()], [name], [width], [n_docs], [n_tokens]), strict=True)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Ranges may cut between rows of one id, and between rows that are alike in all.
    rows = rows.withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    parts = sorted((r.asDict() for r in rows.mapInArrow(run, schema).collect()), key=lambda r: r["part"])
    base = 0
    for p in parts:
        p["base"] = base
        base += p["n_tokens"]
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(parts).encode())
    return parts


class Ints:
    """A file of integers, sliced like an array: memory-mapped if it is mounted here, else read a range at a time."""

    def __init__(self, fs: pafs.FileSystem, path: str, width: str):
        self.type = np.dtype(width)
        self.size = fs.get_file_info(path).size // self.type.itemsize
        self.mapped = None
        if isinstance(fs, pafs.LocalFileSystem):
            self.mapped = np.memmap(path, width, "r") if self.size else np.zeros(0, width)
        else:
            self.file = fs.open_input_file(path)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> np.ndarray:
        start, stop, _ = at.indices(self.size)
        if self.mapped is not None:
            return np.asarray(self.mapped[start:stop])
        return np.frombuffer(self.file.read_at(max(0, stop - start) * self.type.itemsize, start * self.type.itemsize), self.type)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, part.

    One task reads one partition's files, a block of documents at a time.
    """
    fs, root = _open(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        parts = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part long"
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            stem = f"{root}/{row['name']}"
            ids, off, doc, nul = (Ints(fs, stem + end, w) for end, w in ((".ids", row["width"]), (".off", "<i8"), (".doc", "<i8"), (".nul", "u1")))
            at = 0
            while at < len(doc):
                ends = off[at : at + READ_DOCS + 1]
                n = max(1, int(np.searchsorted(ends, ends[0] + READ_TOKENS, "right")) - 1)  # documents whose ids are read together
                ends = ends[: n + 1]
                own = ids[int(ends[0]) : int(ends[-1])].astype("<u4")
                inside = (ends - ends[0]).tolist()
                crc = [zlib.crc32(own[a:b].tobytes()) for a, b in zip(inside, inside[1:], strict=False)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[at : at + n], pa.int64(), mask=nul[at : at + n] > 0), pa.array(row["base"] + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array([row["part"]] * n, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                )
                at += n

    table = spark.createDataFrame([(p["name"], p["width"], p["base"], p["part"]) for p in parts], "name string, width string, base long, part long")
    return table.repartition(len(parts)).mapInArrow(run, schema)
