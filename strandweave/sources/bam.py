"""Compressed alignment files as a Python data source: ``spark.dataSource.register(BamDataSource)``, then
``spark.read.format("bam").load(path)``. The path may hold ``*``; all executors must see it (a shared mount).

A file is read in byte ranges of ``split_bytes``, each a task. A range starts at the first compressed block in it; the
first record there is found by testing places until a chain of records fits, reading on as far as that takes, and the
records that start in the range's blocks are read, the last one beyond its end if needed. Memory per task is one block and
one batch of rows, and at a range's start a chain of records.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 128 << 20
SCHEMA = (
    "read_id string, flag int, chrom string, position int, mapq int, cigar string, mate_chrom string, mate_position int, insert_size int, "
    "seq string, qual string, nm int, meth_state string, barcode string"
)
_BASES = "=ACMGRSVTWYHKDBN"  # fixed code of the format
_OPS = "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_MAGIC = b"\x1f\x8b\x08\x04"
_CHAIN = 8


def _block_size(head: bytes) -> int | None:
    """Size of the compressed block that starts with ``head``, or None if none does."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    i = 0
    while i + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, i + 2)[0]
        if extra[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(extra):
            return struct.unpack_from("<H", extra, i + 4)[0] + 1
        i += 4 + n
    return None


def _blocks(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of the blocks from the first one at or behind ``start`` on."""
    at = start
    if start:  # ranges may start anywhere
        f.seek(start)
        window = f.read(1 << 17)
        i = window.find(_MAGIC)
        while i >= 0:
            size = _block_size(window[i : i + 64])
            if size and (window[i + size : i + size + 4] == _MAGIC or start + i + size == end):
                break
            i = window.find(_MAGIC, i + 1)
        if i < 0:
            return
        at = start + i
    while True:
        f.seek(at)
        head = f.read(18)
        if not head:
            return
        head += f.read(max(0, 12 + struct.unpack_from("<H", head, 10)[0] - 18)) if len(head) == 18 else b""
        size = _block_size(head)
        if size is None:
            raise ValueError(f"no compressed block at byte {at}")
        f.seek(at)
        yield at, zlib.decompress(f.read(size), 31)
        at += size


def _header(path: str) -> tuple[list[str], int]:
    """Names of the contigs, and the length of the header in uncompressed bytes."""
    data = b""
    with open(path, "rb") as f:
        blocks = _blocks(f, 0, os.path.getsize(path))

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                data += next(blocks)[1]

        need(12)
        if data[:4] != b"BAM\1":
            raise ValueError(f"{path} is no alignment file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        need(at + 4)
        n, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
        for _ in range(n):
            need(at + 4)
            size = struct.unpack_from("<i", data, at)[0]
            need(at + 8 + size)
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    return names, at


def _fits(data: bytes, at: int, n_ref: int) -> int | None:
    """Where the record at ``at`` ends if there may be one, else None."""
    size, ref, pos, name, _, _, ops, _, seq, mate, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (32 <= size < 1 << 24 and -1 <= ref < n_ref and -1 <= mate < n_ref and pos >= -1 and mpos >= -1 and name and seq >= 0):
        return None
    if 32 + name + 4 * ops + (seq + 1) // 2 + seq > size:
        return None
    last = at + 35 + name
    return None if last < len(data) and data[last] else at + 4 + size


def _first_record(data: bytes, n_ref: int, end: bool) -> int | None:
    """Where a chain of records starts: ``_CHAIN`` of them, or as many as there are up to the file's ``end``."""
    for start in range(len(data)):
        at, n = start, 0
        while at is not None and n < _CHAIN and at + 36 <= len(data):
            at, n = _fits(data, at, n_ref), n + 1
        if at is not None and n and (n == _CHAIN or end and at == len(data)):
            return start
    return None


def _record(data: bytes, at: int, names: list[str]) -> tuple:
    _, ref, pos, name, mapq, _, ops, flag, seq, mate, mpos, insert = struct.unpack_from("<iiiBBHHHiiii", data, at)
    end = at + 4 + struct.unpack_from("<i", data, at)[0]
    at += 36
    read_id = data[at : at + name - 1].decode()
    at += name
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", data, at)) or "*"
    at += 4 * ops
    packed = data[at : at + (seq + 1) // 2]
    bases = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:seq] or "*"
    at += (seq + 1) // 2
    quals = data[at : at + seq]
    qual = "*" if not seq or quals[0] == 255 else bytes(q + 33 for q in quals).decode()
    at += seq
    tags: dict[str, object] = {}
    while at + 3 <= end:
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            tags[tag], at = data[at:stop].decode(), stop + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            if kind in _INTS:
                tags[tag] = struct.unpack_from(_INTS[kind], data, at)[0]
            at += _SIZES[kind]
    where = lambda r: names[r] if r >= 0 else "*"
    mate_chrom = "=" if mate >= 0 and mate == ref else where(mate)
    return (read_id, flag, where(ref), pos + 1, mapq, cigar, mate_chrom, mpos + 1, insert, bases, qual, tags.get("NM"), tags.get("MD"), tags.get("BX"))


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(glob.glob(options["path"]))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        out = []
        for p in self.paths:
            size = os.path.getsize(p)
            out += [ByteRange(p, s, min(size, s + self.split)) for s in range(0, size, self.split)]
        return out

    def _walk(self, f, part: ByteRange, names: list[str], skip: int) -> Iterator[tuple]:
        data, base, at, starts = b"", 0, skip, []  # base: uncompressed bytes before data; starts: (first byte, place) of blocks
        for place, content in _blocks(f, 0, os.path.getsize(part.path)):
            starts.append((base + len(data), place))
            data += content
            while at + 4 <= base + len(data) and (end := at + 4 + struct.unpack_from("<i", data, at - base)[0]) <= base + len(data):
                while len(starts) > 1 and starts[1][0] <= at:
                    starts.pop(0)
                if part.start <= starts[0][1] < part.end:
                    yield _record(data, at - base, names)
                at = end
            n = min(at - base, len(data))
            data, base = data[n:], base + n
        if data:
            raise ValueError(f"no record found in bytes {part.start} to {part.end} of {part.path}")

    def read(self, part: ByteRange) -> Iterator[tuple]:
        names, skip = _header(part.path)
        with open(part.path, "rb") as f:
            data, synced, own = b"", part.start == 0, 0  # own: bytes of data from blocks that start in the range
            size = os.path.getsize(part.path)
            tried = 0
            for at, content in chain(_blocks(f, part.start, size), [(size, b"")]):
                inside = at < part.end
                if not inside and not own:
                    return
                data += content
                own = len(data) if inside else own
                if part.start == 0 and skip:  # the header is no record
                    n = min(skip, len(data))
                    data, own, skip = data[n:], max(0, own - n), skip - n
                if not synced:
                    if at < size and len(data) < max(1 << 17, 2 * tried):  # doubled, so that trying stays in proportion
                        continue
                    first, tried = _first_record(data, len(names), at == size), len(data)
                    if first is None:
                        if at == size:  # the range may lie in the last record: only a walk from the file's start can tell
                            yield from self._walk(f, part, names, skip)
                            return
                        continue
                    data, own, synced = data[first:], own - first, True
                here = 0
                while here < own and here + 4 <= len(data) and here + 4 + struct.unpack_from("<i", data, here)[0] <= len(data):
                    yield _record(data, here, names)
                    here += 4 + struct.unpack_from("<i", data, here)[0]
                data, own = data[here:], own - here
                if not inside and own <= 0:
                    return


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)
