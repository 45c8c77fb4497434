"""MATLAB level 5 files of real matrices and texts: reading and writing, and as a data source over many files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: numbers of the element types.
_INT8, _UINT16, _INT32, _UINT32, _DOUBLE, _MATRIX, _COMPRESSED = 1, 4, 5, 6, 9, 14, 15
_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8", 16: "u1"}
_CHAR_CLASS, _DOUBLE_CLASS = 4, 6


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def write(values: dict[str, np.ndarray | str]) -> bytes:
    """A file of named matrices of doubles, or texts."""
    out = [b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H2s", 0x0100, b"IM")]
    for name, value in values.items():
        text = isinstance(value, str)
        a = np.array([[ord(c) for c in value]], float) if text else np.atleast_2d(np.asarray(value, float))
        flags = _element(_UINT32, struct.pack("<II", _CHAR_CLASS if text else _DOUBLE_CLASS, 0))
        data = _element(_UINT16, a.astype("<u2").tobytes()) if text else _element(_DOUBLE, a.astype("<f8").tobytes(order="F"))
        out.append(_element(_MATRIX, flags + _element(_INT32, struct.pack("<2i", *a.shape)) + _element(_INT8, name.encode()) + data))
    return b"".join(out)


def _elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:  # a small element: size and kind share one word
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == _COMPRESSED else -size % 8)


def read(data: bytes) -> dict[str, np.ndarray | str]:
    """Named real matrices and texts of a file; other classes raise ValueError."""
    out: dict[str, np.ndarray | str] = {}
    for kind, body in _elements(data[128:]):
        if kind == _COMPRESSED:
            ((kind, body),) = _elements(zlib.decompress(body))
        if kind != _MATRIX:
            continue
        (_, flags), (_, dims), (_, name), *parts = _elements(body)
        of = flags[0]
        if of == 5 or of < _CHAR_CLASS or not parts:
            raise ValueError(f"{name.decode()} is of class {of}")
        shape = np.frombuffer(dims, "<i4").tolist()
        values = np.frombuffer(parts[0][1], _TYPES[parts[0][0]])
        out[name.decode()] = "".join(map(chr, values.tolist())) if of == _CHAR_CLASS else values.astype(float).reshape(shape, order="F")
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, i, j, v): the cells of the matrices of all files of a path."""

    def run(frames):
        for frame in frames:
            cells = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                for name, a in read(bytes(content)).items():
                    if not isinstance(a, str):
                        cells += [(p, name, int(i), int(j), float(a[i, j])) for i, j in np.ndindex(*a.shape)]
            yield pd.DataFrame(cells, columns=["path", "name", "i", "j", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, i long, j long, v double")
