"""The helpers that write rows into files of their own and read them back. They run inside tasks on Arrow batches."""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa

# How folders are named for a value, as by Spark's writer.
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"[\x01-\x1f\x22#%'*/:=?\\\x7f{\[\]^]")


def written(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes rows, in the order of folder and name, into their files and gives the number of files. A file gets its name when it is
    whole, so a task that runs again or twice leaves the same files."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    n = 0
    for (folder, name), same in groupby(rows, key=itemgetter(0, 1)):
        part = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name) if name else _NO_NAME
        at = f"{root}/folder={folder}/name={part}"
        os.makedirs(at, exist_ok=True)
        whole = f"{at}/.{uuid.uuid4().hex}"
        with open(whole, "wb") as f:
            f.writelines((value or "").encode() + b"\n" for _, _, value in same)
        os.replace(whole, f"{at}/part.txt")
        n += 1
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


#: Bytes, and files, of a batch that is read.
_BATCH_BYTES, _BATCH_FILES = 4 << 20, 1000


def _hidden(name: str) -> bool:
    """Names that Spark's scans pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _files(folder: str) -> Iterator[os.DirEntry]:
    """All files below a folder that are not empty, as Spark's scans find them."""
    below = [folder]
    while below:
        with os.scandir(below.pop()) as entries:
            for entry in entries:
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    below.append(entry.path)
                elif entry.stat().st_size:
                    yield entry


def contents_of(root: str, folders: list[str], glob: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path below ``root`` and bytes of each file in the folders whose numbers are given. Nobody holds a list of the files: each is
    read where its folder is listed."""
    fits = re.compile(fnmatch.translate(glob or "*")).match
    names, texts, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "content": pa.array(texts, pa.binary())})

    for numbers in batches:
        for number in numbers.column(0).to_pylist():
            for entry in _files(folders[number]):
                if not fits(entry.name):
                    continue
                with open(entry.path, "rb") as f:
                    text = f.read()
                if names and (size + len(text) > _BATCH_BYTES or len(names) == _BATCH_FILES):
                    yield batch()
                    names, texts, size = [], [], 0
                names.append(os.fsencode(entry.path[len(root):]).decode(errors="replace"))
                texts.append(text)
                size += len(text)
    yield batch()
