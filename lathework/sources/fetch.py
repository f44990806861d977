"""Bulk download of the files that a manifest lists, in parallel and with retries; a run continues what an earlier one left."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.sources.remote import Refused, place, read, retried

RESULT = "file_id string, path string, bytes long, md5 string, status string, error string"


def _held(system: fs.FileSystem, path: str, size: int | None, md5: str | None) -> tuple[int, str] | None:
    """Size and digest of a file that is there and as the manifest has it."""
    info = system.get_file_info(path)
    if info.type != fs.FileType.File or (size is not None and info.size != size):
        return None
    digest = hashlib.md5()
    with system.open_input_stream(path) as f:
        while block := f.read(2**20):
            digest.update(block)
    return None if md5 is not None and digest.hexdigest() != md5 else (info.size, digest.hexdigest())


def _one(root: str, file_id: str, name: str, url: str, size: int | None, md5: str | None, retries: int, backoff: float) -> tuple:
    system, base = place(root)
    folder = f"{base.rstrip('/')}/{file_id}"
    path = f"{folder}/{name}"

    def get() -> tuple[int, str]:
        body = read(url)
        digest = hashlib.md5(body).hexdigest()
        if (size is not None and len(body) != size) or (md5 is not None and digest != md5):
            raise OSError(f"{len(body)} bytes with md5 {digest}, not as the manifest has it")
        system.create_dir(folder, recursive=True)
        # readers skip names with a dot; the move puts the whole file in place, also if two attempts of a task meet
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(body)
        system.move(part, path)
        return len(body), digest

    held = _held(system, path, size, md5)
    if held:
        return file_id, path, *held, "present", None
    try:
        return file_id, path, *retried(get, retries, backoff), "fetched", None
    except (OSError, Refused) as e:
        return file_id, path, None, None, "failed", str(e)


def fetch(manifest: DataFrame, root: str, tasks: int = 5, retries: int = 3, backoff: float = 5.0) -> DataFrame:
    """A row per file of ``manifest (file_id, file_name, url[, size, md5])``: where it is, its size and MD5, and ``present``, ``fetched`` or ``failed`` with the error.

    Files go to ``root/file_id/file_name``, which readers of the library take by
    glob; ``tasks`` are downloaded at a time, so many connections the service sees. A file
    that is there with the manifest's size and digest (where it gives them) is
    not asked for again. One that differs after all tries has failed and leaves nothing
    behind. A file is held in memory whole while it is checked. The frame is lazy:
    write it, and the downloads take place. Rows are taken once for each ``file_id``.
    """
    there = manifest.columns
    own = manifest.dropDuplicates(["file_id"]).select("file_id", "file_name", "url", *[(F.col(c) if c in there else F.lit(None)).cast(k).alias(c) for c, k in (("size", "long"), ("md5", "string"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                done = _one(root, *(row[c] for c in ("file_id", "file_name", "url", "size", "md5")), retries, backoff)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done, kinds, strict=True)], names=["file_id", "path", "bytes", "md5", "status", "error"])

    return own.repartition(tasks, "file_id").mapInArrow(work, RESULT)
