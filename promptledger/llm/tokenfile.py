"""Token-id files of patched frame-of-reference blocks.

Ids of consecutive documents form blocks of 1024. A block stores its minimum and the
differences from it in as many bits as all but a share of them need; the few that need
more stand in an exception list of positions and values. An index holds where each block
and each document starts, so a document is read without decoding what precedes it.

File, little-endian::

    "PFORTOK1"
    block*     minimum u32, width u8, 0 u8, exceptions u16,
               16 * width u64 of packed differences, positions u16*, values u32*
    index      document ids i64*, first id number of each document u64*,
               byte position of each block u64*
    footer     documents u64, ids u64, blocks u64, byte position of the index u64,
               "PFORTOK1"

``write`` sorts documents by id over range partitions; each task writes files under names
nothing else uses, and the table of contents names those of finished tasks only. A lost
executor leaves an unnamed file at most. The folder may be in any store pyarrow can open.

Null and empty texts hold the end id only. A null id is kept and sorts first. Repeated
rows are all written; rows of one id are ordered by text. An empty table writes no file.
Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptledger.llm.tables import stored
from promptledger.llm.tokens import token_chunks

MAGIC = b"PFORTOK1"
BLOCK = 1024
#: Share of a block's differences, in percent, that the packed width must hold.
PERCENTILE = 99
END_ID = 1
#: Blocks encoded or decoded at a time, and ids after which a task starts another file.
RUN_BLOCKS = 256
FILE_IDS = 1 << 27
NULL_ID = np.iinfo(np.int64).min

_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])
_FOOTER = np.dtype([("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8"), ("index", "<u8"), ("magic", "S8")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, 1024) values below 2 ** width to (rows, 16 * width) words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    words = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(len(values), 16 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    values = np.empty((64, lanes.shape[1]), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        part = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            part = part | (lanes[word + 1] << np.uint64(64 - shift))
        values[k] = part & mask
    return np.ascontiguousarray(values.T).reshape(-1, BLOCK)


def _bit_length(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """One byte string per 1024 ids; the last block is filled up with its minimum."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return []
    padded = np.full(blocks * BLOCK, ids[(blocks - 1) * BLOCK :].min(), dtype=np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(blocks, BLOCK)
    minimum = grid.min(axis=1)
    above = grid - minimum[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = _bit_length(np.partition(above, rank, axis=1)[:, rank])
    outlier = above >> width[:, None] > 0
    heads = np.zeros(blocks, dtype=_HEAD)
    heads["minimum"], heads["width"], heads["exceptions"] = minimum, width, outlier.sum(axis=1)
    kept = np.where(outlier, 0, above)
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for row, words in zip(rows, _pack(kept[rows], int(w)), strict=True):
                body[row] = words.tobytes()
    result = []
    for row in range(blocks):
        where = np.flatnonzero(outlier[row])
        patch = where.astype("<u2").tobytes() + above[row, where].astype("<u4").tobytes()
        result.append(heads[row].tobytes() + body[row] + patch)
    return result


def decode_blocks(data: bytes, positions: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these positions of the data."""
    heads = np.concatenate([np.frombuffer(data, _HEAD, 1, int(p)) for p in positions])
    grid = np.zeros((len(positions), BLOCK), dtype=np.int64)
    for w in np.unique(heads["width"]):
        if w:
            rows = np.flatnonzero(heads["width"] == w)
            words = np.stack([np.frombuffer(data, "<u8", 16 * int(w), int(positions[r]) + _HEAD.itemsize) for r in rows])
            grid[rows] = _unpack(words, int(w))
    for row in np.flatnonzero(heads["exceptions"]):
        count = int(heads["exceptions"][row])
        at = int(positions[row]) + _HEAD.itemsize + 128 * int(heads["width"][row])
        where = np.frombuffer(data, "<u2", count, at)
        grid[row, where] = np.frombuffer(data, "<u4", count, at + 2 * count)
    return (grid + heads["minimum"].astype(np.int64)[:, None]).reshape(-1)


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file named by a path or an address."""
    if folder.startswith("file:/"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(folder)


class TokenWriter:
    """Appends documents to one file; blocks leave memory as they fill."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path = path
        self._out = store.open_output_stream(path)
        self._out.write(MAGIC)
        self._at = len(MAGIC)
        self._open = np.zeros(0, dtype=np.uint32)
        self._doc_ids: list[np.ndarray] = []
        self._starts: list[np.ndarray] = []
        self._blocks: list[int] = []
        self.docs = self.ids = 0

    def append(self, doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        self._doc_ids.append(doc_ids)
        self._starts.append(bounds[:-1] + self.ids)
        self.docs += len(doc_ids)
        self.ids += len(ids)
        self._open = np.concatenate([self._open, ids])
        full = len(self._open) // (RUN_BLOCKS * BLOCK) * RUN_BLOCKS * BLOCK
        for at in range(0, full, RUN_BLOCKS * BLOCK):
            self._write(self._open[at : at + RUN_BLOCKS * BLOCK])
        self._open = self._open[full:]

    def _write(self, ids: np.ndarray) -> None:
        encoded = encode_blocks(ids)
        for block in encoded:
            self._blocks.append(self._at)
            self._at += len(block)
        self._out.write(b"".join(encoded))

    def close(self) -> None:
        self._write(self._open)
        index = [*self._doc_ids, *self._starts, np.array(self._blocks, dtype=np.int64)]
        for part in index:
            self._out.write(part.astype("<i8").tobytes())
        footer = np.array([(self.docs, self.ids, len(self._blocks), self._at, MAGIC)], dtype=_FOOTER)
        self._out.write(footer.tobytes())
        self._out.close()


class TokenReader:
    """Reads the index of a file, then documents or runs of blocks."""

    def __init__(self, store: fs.FileSystem, path: str):
        self._file = store.open_input_file(path)
        size = self._file.size()
        footer = np.frombuffer(self._file.read_at(_FOOTER.itemsize, size - _FOOTER.itemsize), _FOOTER)[0]
        if footer["magic"] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.docs, self.ids = int(footer["docs"]), int(footer["ids"])
        blocks, self._end = int(footer["blocks"]), int(footer["index"])
        index = np.frombuffer(self._file.read_at(8 * (2 * self.docs + blocks), self._end), "<i8")
        self.doc_ids = index[: self.docs]
        self.bounds = np.append(index[self.docs : 2 * self.docs], self.ids)
        self._blocks = np.append(index[2 * self.docs :], self._end)

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of blocks first to end - 1, without what fills up the last."""
        lo, hi = int(self._blocks[first]), int(self._blocks[end])
        ids = decode_blocks(self._file.read_at(hi - lo, lo), self._blocks[first:end] - lo)
        return ids[: self.ids - first * BLOCK].astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        lo, hi = int(self.bounds[k]), int(self.bounds[k + 1])
        if lo == hi:
            return np.zeros(0, dtype=np.uint32)
        first = lo // BLOCK
        ids = self.blocks(first, -(-hi // BLOCK))
        return ids[lo - first * BLOCK : hi - first * BLOCK]

    def scan(self) -> Iterator[np.ndarray]:
        for first in range(0, len(self._blocks) - 1, RUN_BLOCKS):
            yield self.blocks(first, min(first + RUN_BLOCKS, len(self._blocks) - 1))


CONTENTS_SCHEMA = "path STRING, part INT, number INT, docs BIGINT, ids BIGINT"


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, keeps_blanks: bool = False, end_id: int = END_ID
) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the table of contents:
    path, documents, ids and start (ids in the files before it) of each file."""

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        writer, done = None, []
        for batch in batches:
            doc_ids = batch.column(0).fill_null(int(NULL_ID)).to_numpy()
            for lo, hi, ids, bounds in token_chunks(batch.column(1), tokenizer_path, keeps_blanks):
                if writer is None:
                    writer = TokenWriter(store, f"{base}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.pfor")
                ended = np.insert(ids, bounds[1:], np.uint32(end_id))
                writer.append(doc_ids[lo:hi], ended, bounds + np.arange(len(bounds)))
                if writer.ids >= FILE_IDS:
                    writer.close()
                    done.append(writer)
                    writer = None
        if writer is not None:
            writer.close()
            done.append(writer)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([w.path for w in done], pa.string()),
                pa.array([part] * len(done), pa.int32()),
                pa.array(range(len(done)), pa.int32()),
                pa.array([w.docs for w in done], pa.int64()),
                pa.array([w.ids for w in done], pa.int64()),
            ],
            ["path", "part", "number", "docs", "ids"],
        )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    contents = stored(ordered.mapInArrow(save, CONTENTS_SCHEMA), "token-files")
    # One row per file.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return contents.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(spark: SparkSession, contents: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenReader(store, path)
                crc = np.zeros(file.docs, dtype=np.int64)
                at = doc = 0
                for ids in file.scan():
                    while doc < file.docs and file.bounds[doc] < at + len(ids):
                        lo, hi = max(file.bounds[doc] - at, 0), min(file.bounds[doc + 1] - at, len(ids))
                        crc[doc] = zlib.crc32(ids[lo:hi].astype("<u4", copy=False), int(crc[doc]))
                        if file.bounds[doc + 1] > at + len(ids):
                            break
                        doc += 1
                    at += len(ids)
                known = pa.array(file.doc_ids, pa.int64(), mask=file.doc_ids == NULL_ID)
                for lo in range(0, file.docs, 65_536):
                    hi = min(lo + 65_536, file.docs)
                    yield pa.RecordBatch.from_arrays(
                        [
                            known.slice(lo, hi - lo),
                            pa.array(file.bounds[lo:hi] + start),
                            pa.array(np.diff(file.bounds[lo : hi + 1])),
                            pa.array(crc[lo:hi]),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = contents.select("path", "start")
    files = files.repartition(max(1, contents.count()))
    return files.mapInArrow(load, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
