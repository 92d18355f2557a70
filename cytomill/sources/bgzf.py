"""Blocked gzip: blocks from anywhere in a file, and a stream that knows its virtual offsets.

A virtual offset is a block's place in the file, shifted by 16 bits, and a place in the block's bytes.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from typing import IO

from .files import open_binary, size

#: Fixed values of the format: how a block begins, and the most bytes that one has, compressed or not.
HEAD, MOST = b"\x1f\x8b\x08\x04", 1 << 16
PLAIN_HEAD = 12


def block_size(raw: bytes, at: int = 0) -> int | None:
    """The size of the block whose head stands at ``at``; None if there is no head, or not all of it."""
    if raw[at : at + 4] != HEAD or len(raw) < at + PLAIN_HEAD:
        return None
    (extra,) = struct.unpack_from("<H", raw, at + 10)
    end, at = at + PLAIN_HEAD + extra, at + PLAIN_HEAD
    if len(raw) < end:
        return None
    while at + 4 <= end:
        tag, length = raw[at : at + 2], struct.unpack_from("<H", raw, at + 2)[0]
        if tag == b"BC" and length == 2 and at + 6 <= end:
            return struct.unpack_from("<H", raw, at + 4)[0] + 1
        at += 4 + length
    return None


def read_block(f: IO[bytes]) -> bytes | None:
    """The next block's bytes, None at the end of the file."""
    head = f.read(PLAIN_HEAD)
    if len(head) < PLAIN_HEAD:
        return None
    if head[:4] != HEAD:
        raise ValueError("not a BGZF file")
    head += f.read(struct.unpack_from("<H", head, 10)[0])
    n = block_size(head)
    if n is None:
        raise ValueError("a BGZF block without its size")
    return gzip.decompress(head + f.read(n - len(head)))


def is_blocked(path: str) -> bool:
    with open_binary(path) as f:
        return block_size(f.read(1 << 10)) is not None


def find_block(path: str, start: int) -> int | None:
    """The first block at or behind ``start``. Bytes inside a block may look like one, or be a whole file of blocks; but a block
    has at most MOST bytes, so a true one is followed by others, each with its checksum, beyond that distance or to the file's end."""
    whole = size(path)
    with open_binary(path) as f:
        f.seek(start)
        raw = f.read(4 * MOST)
    at = raw.find(HEAD)
    while at >= 0:
        here = at
        while (n := block_size(raw, here)) is not None and here + n <= len(raw) and here <= at + MOST:
            try:
                gzip.decompress(raw[here : here + n])
            except (OSError, EOFError, zlib.error):
                break
            here += n
        if here > at and (here > at + MOST or start + here == whole):
            return start + at
        at = raw.find(HEAD, at + 1)
    return None


class Stream:
    """Bytes from a virtual offset on, aware of where they are."""

    def __init__(self, path: str, offset: int = 0) -> None:
        self.f = open_binary(path)
        self.f.seek(offset >> 16)
        self.block, self.at, self.data = offset >> 16, 0, b""
        self.load()
        self.at = offset & 0xFFFF

    def load(self) -> bool:
        while True:
            self.block = self.f.tell()
            data = read_block(self.f)
            if data is None:
                self.data, self.at = b"", 0
                return False
            if data:
                self.data, self.at = data, 0
                return True

    def tell(self) -> int:
        if self.at >= len(self.data):
            self.load()
        return (self.block << 16) | self.at

    def read(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        if len(out) == n:
            return out
        parts, have = [out], len(out)
        while have < n and self.load():
            part = self.data[: n - have]
            self.at = len(part)
            parts.append(part)
            have += len(part)
        return b"".join(parts)

    def close(self) -> None:
        self.f.close()


def offsets(gzi: str) -> list[tuple[int, int]]:
    """(place in the file, place in the bytes) of all blocks, from a ``.gzi`` index; the first block is not listed in it."""
    with open_binary(gzi) as f:
        data = f.read()
    (n,) = struct.unpack_from("<Q", data)
    flat = struct.unpack_from(f"<{2 * n}Q", data, 8)
    return [(0, 0), *zip(flat[::2], flat[1::2], strict=True)]
