"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard is one file:

    data block*      entries in key order, zstd-compressed, CRC-32 behind
    index block      for each data block its last key, place and length
    Bloom filter     over all keys
    properties       JSON: documents, ids, first and last key, id width
    footer           places and lengths of the three above, magic; fixed size

Within a block an entry shares a prefix with the key before it, except at
every RESTART-th entry, whose places stand at the block's end. A lookup reads
the footer, asks the Bloom filter, finds the block by bisecting the index and
the entry by bisecting the restarts.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib

import numpy as np
import zstandard

MAGIC = b"QSSTABL1"
FOOTER = struct.Struct("<6Q8s")
RESTART = 16
HASHES = 7


def key_of(ident: int | None) -> bytes:
    """Order-preserving: null first, then integers ascending."""
    return b"\x00" if ident is None else b"\x01" + struct.pack(">Q", (ident + (1 << 63)) & ((1 << 64) - 1))


def ident_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = raw[at]
        at += 1
        n |= (c & 0x7F) << shift
        if c < 0x80:
            return n, at
        shift += 7


def bloom_bits(key: bytes, size: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % size for i in range(HASHES)]


class Writer:
    """add() keys in ascending order (equal ones may repeat), then finish()."""

    def __init__(self, out, width: int, block_bytes: int = 256 << 10):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.clear()

    def clear(self) -> None:
        self.parts: list[bytes] = []
        self.filled = self.entries = 0
        self.restarts: list[int] = []
        self.last = b""

    def add(self, ident: int | None, value: bytes) -> None:
        key = key_of(ident)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.filled)
        entry = put(shared) + put(len(key) - shared) + put(len(value)) + key[shared:]
        self.parts += [entry, value]
        self.filled += len(entry) + len(value)
        self.entries += 1
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        if self.filled >= self.block_bytes:
            self.flush()

    def write(self, raw: bytes) -> tuple[int, int]:
        self.out.write(raw)
        self.at += len(raw)
        return self.at - len(raw), len(raw)

    def flush(self) -> None:
        if not self.entries:
            return
        raw = b"".join([*self.parts, np.asarray([*self.restarts, len(self.restarts)], "<u4").tobytes()])
        packed = self.squeeze.compress(raw)
        self.index.append((self.last, *self.write(packed + struct.pack("<I", zlib.crc32(packed)))))
        self.clear()

    def finish(self) -> None:
        self.flush()
        index = b"".join(put(len(k)) + k + put(a) + put(n) for k, a, n in self.index)
        size = max(64, 10 * len(self.keys))
        bits = np.zeros(size, bool)
        for k in self.keys:
            bits[bloom_bits(k, size)] = True
        props = json.dumps({"docs": self.docs, "ids": self.ids, "width": self.width, "bloom_bits": size, "first": self.keys[0].hex() if self.keys else None, "last": self.keys[-1].hex() if self.keys else None}).encode()
        places = [*self.write(index), *self.write(np.packbits(bits, bitorder="little").tobytes()), *self.write(props)]
        self.write(FOOTER.pack(*places, MAGIC))


class Reader:
    def __init__(self, source):
        """source: a random-access file (pyarrow's, or any with seek, read and size())."""
        self.source = source
        raw = self.slice(source.size() - FOOTER.size, FOOTER.size)
        *places, magic = FOOTER.unpack(raw)
        if magic != MAGIC:
            raise ValueError("not a shard: its footer has another magic")
        index, self.bloom, props = (self.slice(places[i], places[i + 1]) for i in (0, 2, 4))
        self.props = json.loads(props)
        self.lasts, self.places, at = [], [], 0
        while at < len(index):
            n, at = get(index, at)
            self.lasts.append(index[at : at + n])
            a, at = get(index, at + n)
            n, at = get(index, at)
            self.places.append((a, n))

    def slice(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> tuple[bytes, list[int]]:
        raw = self.slice(*self.places[i])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(raw[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        return raw[: -4 * (n + 1)], np.frombuffer(raw[-4 * (n + 1) : -4], "<u4").tolist()

    @staticmethod
    def entries(data: bytes, at: int = 0):
        key = b""
        while at < len(data):
            shared, at = get(data, at)
            rest, at = get(data, at)
            n, at = get(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def scan(self):
        """(identifier, value) in key order."""
        for i in range(len(self.places)):
            for key, value in self.entries(self.block(i)[0]):
                yield ident_of(key), value

    def lookup(self, ident: int | None) -> list[bytes]:
        """All values of a key, by Bloom filter and two binary searches."""
        key, size = key_of(ident), self.props["bloom_bits"]
        if not all(self.bloom[x >> 3] >> (x & 7) & 1 for x in bloom_bits(key, size)):
            return []
        found: list[bytes] = []
        for i in range(bisect.bisect_left(self.lasts, key), len(self.places)):
            data, restarts = self.block(i)
            first = [next(self.entries(data, r))[0] for r in restarts]
            start = restarts[max(0, bisect.bisect_left(first, key) - 1)]
            for k, value in self.entries(data, start):
                if k > key:
                    return found
                if k == key:
                    found.append(value)
        return found
