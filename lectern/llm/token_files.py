"""Flat files of token ids with 64-bit document offsets, written and read in parallel.

A range partition of the documents becomes one file group: ``.ids`` holds nothing but
unsigned little-endian ids, ``.off`` one unsigned 64-bit offset per document and one
for the end, ``.doc`` one signed 64-bit document id per document. The manifest, one row
per group, gives each group's base: the running sum of the groups before it.

Files are written under a temporary name and renamed, by their partition's number, so
a task that runs twice leaves the same file. They go to any store that pyarrow can
open; readers map them into memory where the store is a file system.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import blocks_for
from lectern.llm.tokens import encode_all

# Documents per file group, so that a group's ids stay near a hundred megabytes.
DOCS_PER_FILE = 20_000
_MANIFEST = "part int, path string, docs long, null_ids long, tokens long"
_READ = "doc_id long, start long, n_tokens long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class _Group:
    """The three open files of one partition."""

    def __init__(self, folder: str, part: int, width: int):
        self.store, root = _store(folder)
        self.store.create_dir(root, recursive=True)
        self.final = f"{root}/part-{part:06d}"
        self.temp = f"{root}/_{part:06d}-{uuid.uuid4().hex}"
        self.files = {k: self.store.open_output_stream(f"{self.temp}.{k}") for k in ("ids", "off", "doc")}
        self.width, self.tokens, self.docs, self.nulls = width, 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.files["off"].write(np.uint64(self.tokens).tobytes())
        self.files["doc"].write(np.int64(doc_id or 0).tobytes())
        self.files["ids"].write(ids)
        self.tokens += len(ids) // self.width
        self.docs += 1
        self.nulls += doc_id is None

    def close(self) -> None:
        self.files["off"].write(np.uint64(self.tokens).tobytes())
        for kind, file in self.files.items():
            file.close()
            self.store.move(f"{self.temp}.{kind}", f"{self.final}.{kind}")


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    width: int = 2,
    tokenizer: str | None = None,
    docs_per_file: int = DOCS_PER_FILE,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in ascending id order.

    Returns the manifest ``part, path, docs, null_ids, tokens, base``: ``base`` is the
    number of ids in the groups before. It has one row per file group and is the only
    thing that reaches the driver. A null text is empty; rows with a null id come
    first; rows of one id are ordered by their text. An empty table writes no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = blocks_for(rows.count(), docs_per_file)
    end = np.array([end_id], f"<u{width}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = (t.as_py() for t in batch.column("text"))
            for doc_id, raw in zip(ids, encode_all(texts, tokenizer, width), strict=True):
                group = group or _Group(folder, part, width)
                group.add(doc_id, raw + end)
        if group is not None:
            group.close()
            path = f"{folder.rstrip('/')}/part-{part:06d}"
            row = [[part], [path], [group.docs], [group.nulls], [group.tokens]]
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)],
                names=["part", "path", "docs", "null_ids", "tokens"],
            )

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = sorted(ordered.mapInArrow(write, _MANIFEST).collect())
    bases = np.cumsum([0, *[m.tokens for m in manifest]])
    full = [(*m, int(b)) for m, b in zip(manifest, bases, strict=False)]
    return spark.createDataFrame(full, _MANIFEST + ", base long")


def _open(path: str) -> np.ndarray:
    """A file's bytes: mapped where the store is a file system, read otherwise."""
    store, name = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, np.uint8, "r") if os.path.getsize(name) else np.zeros(0, np.uint8)
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read(), np.uint8)


def read_token_files(
    manifest: DataFrame, width: int = 2, rows_per_batch: int = 2000, checksums: bool = False
) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids``.

    ``start`` counts the ids of all documents before it, in all files; ``ids`` are the
    little-endian bytes, end id included. With ``checksums`` their place takes
    ``ids_crc32``, the checksum of the ids as 32-bit integers. One task reads one group.
    """
    last, kind = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())

    def of(ids: np.ndarray) -> bytes | int:
        if not checksums:
            return ids.tobytes()
        return zlib.crc32(ids.view(f"<u{width}").astype("<u4").tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets = _open(row["path"] + ".off").view("<u8").astype(np.int64)
                names = _open(row["path"] + ".doc").view("<i8")
                ids = _open(row["path"] + ".ids")
                for at in range(0, row["docs"], rows_per_batch):
                    to = min(at + rows_per_batch, row["docs"])
                    bounds = offsets[at : to + 1]
                    spans = zip(bounds * width, bounds[1:] * width, strict=False)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[at:to], mask=np.arange(at, to) < row["null_ids"]),
                            pa.array(bounds[:-1] + row["base"]),
                            pa.array(np.diff(bounds)),
                            pa.array([of(ids[i:j]) for i, j in spans], kind),
                        ],
                        names=["doc_id", "start", "n_tokens", last],
                    )

    files = manifest.count()
    schema = f"{_READ}, {last} {'long' if checksums else 'binary'}"
    return manifest.repartition(max(1, files)).mapInArrow(read, schema)


def token_files(docs: DataFrame, folder: str) -> DataFrame:
    """Write the documents' token files to ``folder`` and read them back as digests."""
    return read_token_files(write_token_files(docs, folder), checksums=True)
