"""Arrays in files of the shared folder, memory-mapped by workers.

A file takes its name only when it is whole, so a task that runs twice leaves
the same files. Which files there are is told by a manifest, made when all are
written: a file that is named there and can't be opened is an error, never an
empty one.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections import OrderedDict

import numpy as np

#: Files of one kind that a task keeps mapped. From Python 3.13 on a map holds no descriptor.
LIMIT = 512 if sys.version_info >= (3, 13) else 64


def store(path: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file: a line of names, types and lengths, then the bytes."""
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in arrays.items()).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    part = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part, "wb") as f:
        f.write(head)
        for v in arrays.values():
            f.write(v.tobytes())
            f.write(b"\0" * (-v.nbytes % 8))
    os.replace(part, path)


def whole(path: str) -> mmap.mmap:
    with open(path, "rb") as f:
        more = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **more)


def read(path: str) -> dict[str, np.ndarray]:
    data = whole(path)
    at = data.find(b"\n") + 1
    out = {}
    for part in data[: at - 1].decode().strip().split(";"):
        name, kind, n = part.split(",")
        dtype = np.dtype(kind)
        out[name] = np.frombuffer(data, dtype=dtype, count=int(n), offset=at)
        at += int(n) * dtype.itemsize
        at += -at % 8
    return out


class Recent:
    """What `load` gives for a key; the `limit` last used are kept."""

    def __init__(self, load, limit: int = LIMIT) -> None:
        self.load, self.limit, self.held = load, limit, OrderedDict()

    def __getitem__(self, key):
        if key not in self.held:
            if len(self.held) >= self.limit:
                self.held.popitem(last=False)
            self.held[key] = self.load(key)
        self.held.move_to_end(key)
        return self.held[key]


class Folder:
    """The files `path`-k; there: whether there is a k-th. None where there is none; one that should be there and isn't is an error."""

    def __init__(self, path: str, there: np.ndarray, limit: int = LIMIT) -> None:
        self.there = there
        self.files = Recent(lambda k: read(f"{path}-{k}"), limit)

    def __getitem__(self, k: int) -> dict[str, np.ndarray] | None:
        return self.files[k] if self.there[k] else None


def manifest(folder: str, kind: str, size: int, written: int) -> np.ndarray:
    """Which of the files kind-0 to kind-(size - 1) there are; `written`: as how many the tasks say that they wrote."""
    there = np.zeros(size, dtype=bool)
    for name in os.listdir(folder) if os.path.isdir(folder) else ():
        head, _, k = name.rpartition("-")
        if head == kind and k.isdigit():
            there[int(k)] = True
    if there.sum() != written:
        raise OSError(f"{there.sum()} of {written} files {kind} are in {folder}; spark.checkpoint.dir must be one folder on all machines")
    return there
