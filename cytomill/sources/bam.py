"""BAM files as a data source in parallel tasks, with or without an index beside them.

With a ``.bai`` file, filters on ``rname`` and ``pos`` are pushed down to its bins: only the chunks of the wanted contigs and
positions are opened. Without one, tasks take equal stretches of the file and find the first record of theirs on their own
(``first_record``). Either way a record is read by one task, and ``file_ord`` is its virtual offset.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .bgzf import Stream, find_block
from .files import exists, open_binary, size

SCHEMA = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, tlen bigint, seq string, qual string, file_ord bigint"
#: Fixed values of the format: letters of packed bases, CIGAR operations, those of them that advance in the reference, the bytes of a record
#: before its name, the largest position, the bin that holds an index's own notes, the letters of the finest bins, as a shift.
BASES, OPS, IN_REFERENCE, FIXED, FAR, NOTES, FINEST = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", (0, 2, 3, 7, 8), 32, 1 << 29, 37450, 14
SPLIT = 64 << 20
#: A task looks for its first record from so many bytes before its stretch on, and believes a chain of records of this length.
BACK, CHAIN_BYTES, CHAIN_RECORDS, MOST_SEEN = 256 << 10, 128 << 10, 8, 1 << 28
FILTER_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Header:
    names: list[str]
    lengths: list[int]
    end: int  # virtual offset of the first record


def header(path: str) -> Header:
    s = Stream(path)
    if s.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    s.read(struct.unpack("<i", s.read(4))[0])
    out = Header([], [], 0)
    for _ in range(struct.unpack("<i", s.read(4))[0]):
        out.names.append(s.read(struct.unpack("<i", s.read(4))[0])[:-1].decode())
        out.lengths.append(struct.unpack("<i", s.read(4))[0])
    out.end = s.tell()
    s.close()
    return out


def record(raw: bytes, names: list[str], order: int) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = FIXED + l_name
    ops = struct.unpack_from(f"<{n_cigar}I", raw, at)
    at += 4 * n_cigar
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    at += (l_seq + 1) // 2
    q = raw[at : at + l_seq]
    qual = "*" if not q or q[0] == 0xFF else bytes(x + 33 for x in q).decode("latin-1")
    cigar = "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*"
    return raw[FIXED : FIXED + l_name - 1].decode(), flag, names[ref] if ref >= 0 else "*", pos, mapq, cigar, tlen, seq or "*", qual, order


def reach(raw: bytes) -> int:
    """The position behind a record's last aligned letter, that of its first and one more at least."""
    pos, l_name, n_cigar = *struct.unpack_from("<iB", raw, 4), struct.unpack_from("<H", raw, 12)[0]
    ops = struct.unpack_from(f"<{n_cigar}I", raw, FIXED + l_name)
    return pos + max(1, sum(o >> 4 for o in ops if o & 15 in IN_REFERENCE))


# -- with an index ---------------------------------------------------------------------------------


@dataclass
class Contig:
    """A contig in a ``.bai`` file: chunks (from and to a virtual offset) by bin, and the first record's offset by 2**14 letters."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    linear: tuple[int, ...] = ()


def index(path: str) -> list[Contig]:
    with open_binary(path) as f:
        data = f.read()
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAI file")
    out, at = [], 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        c = Contig()
        (bins,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(bins):
            number, n = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
            at += 8 + 16 * n
            if number != NOTES:
                c.bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
        (n,) = struct.unpack_from("<i", data, at)
        c.linear = struct.unpack_from(f"<{n}Q", data, at + 4)
        at += 4 + 8 * n
        out.append(c)
    return out


def bins(start: int, end: int) -> Iterator[range]:
    """The bins of all levels that letters from ``start`` to before ``end`` lie in: a level has eight times the bins of that above."""
    first, level = 0, 1
    for shift in range(FINEST + 15, FINEST - 1, -3):
        yield range(first + (start >> shift), first + (max(start, end - 1) >> shift) + 1)
        first, level = first + level, level * 8


def merged(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order; those that meet or lie in one block become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def region(c: Contig, start: int, end: int) -> list[tuple[int, int]]:
    """The chunks that hold all records overlapping the letters from ``start`` to before ``end``."""
    start, end = max(start, 0), min(end, FAR)
    if end <= start:
        return []
    least = c.linear[min(start >> FINEST, len(c.linear) - 1)] if c.linear else 0
    wanted = bins(start, end)
    if end - start > FAR // 8:  # more bins than a contig has
        ranges = list(wanted)
        chunks = [x for b, xs in c.bins.items() if any(b in r for r in ranges) for x in xs]
    else:
        chunks = [x for r in wanted for b in r for x in c.bins.get(b, ())]
    return merged([(max(a, least), b) for a, b in chunks if b > least])


def dealt(ranges: list[tuple[int, int]], cuts: list[int], split: int) -> list[list[tuple[int, int]]]:
    """Ranges in tasks of about ``split`` compressed bytes; a long one is divided where a record is known to begin."""
    out: list[list[tuple[int, int]]] = []
    size = split
    for a, b in ranges:
        inner = cuts[np.searchsorted(cuts, a, side="right") : np.searchsorted(cuts, b)] if cuts else []
        for c in [*inner, b]:
            if c != b and (c - a) >> 16 < split:
                continue
            if size >= split:
                out.append([])
                size = 0
            out[-1].append((a, c))
            size += (c - a) >> 16
            a = c
    return out


# -- without an index ------------------------------------------------------------------------------


def heads(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places at which the fixed part of a record may stand, with the size of it there; 0 elsewhere."""
    n = len(data) - FIXED - 4 + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def whole(at: int, width: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for i in range(width):
            out |= data[at + i : at + i + n].astype(np.int64) << (8 * i)
        return out - ((out >> (8 * width - 1)) << (8 * width)) if width == 4 else out

    size, l_name, n_cigar, l_seq = whole(0, 4), whole(12, 1), whole(16, 2), whole(20, 4)
    fine = (l_name > 0) & (l_seq >= 0) & (size >= FIXED + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq)
    longest = np.append(lengths, 0)  # for -1, no contig
    for ref_at, pos_at in ((4, 8), (24, 28)):
        ref, pos = whole(ref_at, 4), whole(pos_at, 4)
        known = (ref >= -1) & (ref < len(lengths))
        fine &= known & (pos >= -1) & (pos <= np.where(ref >= 0, longest[np.where(known, ref, -1)], FAR))
    end = np.arange(n) + 4 + FIXED + l_name - 1  # the name ends with its only zero
    fine &= (end >= len(data)) | (data[np.minimum(end, len(data) - 1)] == 0)
    return np.where(fine, size, 0)


def first_record(path: str, start: int, head: Header) -> int | None:
    """The virtual offset of the first record in a block at or behind the place ``start``, None behind the last.

    The search begins BACK bytes earlier. Of all places there, the first from which record follows record, each with a plausible
    fixed part, for CHAIN_BYTES and CHAIN_RECORDS or to the end of the file, is a record's; records are followed from it to ``start``.
    Bytes inside a record that look like records themselves are passed over if the chain of the record around them begins before.
    """
    if start <= head.end >> 16:
        s = Stream(path, head.end)
        s.close()
        return head.end if s.data else None
    back = find_block(path, max(0, start - BACK))
    if back is None:
        return None
    if back <= head.end >> 16:
        at = head.end
    else:
        at = _chain(path, back, np.array(head.lengths, np.int64))
        if at is None:
            return None
    s = Stream(path, at)
    while (order := s.tell()) >> 16 < start:
        n = s.read(4)
        if len(n) < 4:
            return None
        s.read(struct.unpack("<i", n)[0])
    found = None if not s.data else order
    s.close()
    return found


def _chain(path: str, block: int, lengths: np.ndarray) -> int | None:
    """The first place behind the start of a block from which record follows record."""
    s = Stream(path, block << 16)
    parts, starts, have, done = [], [], 0, False
    limit = 2 * CHAIN_BYTES
    while True:
        while have < limit and not done:
            if s.data:
                parts.append(s.data)
                starts.append((have, s.block))
                have += len(s.data)
            done = not s.data or not s.load()
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = heads(data, lengths)
        for o in np.flatnonzero(size).tolist():
            at = o
            n = 0
            while at < len(size) and size[at]:
                at += 4 + int(size[at])
                n += 1
            ended = at == len(data) if done else at >= len(size)
            if ended and (done or (n >= CHAIN_RECORDS and at - o >= CHAIN_BYTES)):
                s.close()
                k = int(np.searchsorted([a for a, _ in starts], o, side="right")) - 1
                return starts[k][1] << 16 | (o - starts[k][0])
            if ended:
                break  # it may be one, but too little is seen of what follows
        if done:
            s.close()
            return None
        limit *= 2
        if limit > MOST_SEEN:
            raise RuntimeError(f"{path}: no records to be told from others behind byte {block}; write an index, or read with split=0")


# -- the source ------------------------------------------------------------------------------------


class Part(InputPartition):
    """Ranges of virtual offsets at which records begin, or a stretch of the file whose records are still to be found."""

    def __init__(self, ranges: list[tuple[int, int | None]] | None = None, stretch: tuple[int, int | None] | None = None) -> None:
        self.ranges, self.stretch = ranges, stretch


class BamReader(DataSourceReader):
    """Options: ``split``, compressed bytes of a task (0: one task); ``region``, ``contig:start-end`` (0-based, the end not
    included), for the records that overlap it."""

    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.contigs: set[str] | None = None
        self.start, self.end = -1, FAR  # of records' first positions
        self.overlaps: tuple[str, int, int] | None = None
        if "region" in options:
            name, _, span = options["region"].rpartition(":")
            self.overlaps = name, *map(int, span.split("-"))

    def partitions(self) -> list[InputPartition]:
        head = header(self.path)
        known = index(f"{self.path}.bai") if exists(f"{self.path}.bai") else None
        if known is None:
            whole = size(self.path)
            if not self.split or whole <= self.split:
                return [Part([(head.end, None)])]
            cuts = [0, *range(self.split, whole, self.split)]
            return [Part(stretch=(a, b)) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        contigs = self.contigs
        if contigs is None and (self.start > -1 or self.end < FAR):
            contigs = {*head.names, *(["*"] if self.start <= -1 else [])}
        cuts = sorted({v for c in known for v in (*c.linear, *(a for xs in c.bins.values() for a, _ in xs))} - {0})
        if self.overlaps is None and contigs is None:
            ranges = [(head.end, max(size(self.path) << 16, head.end + 1))]
        else:
            ranges = []
            last = max([head.end, *(b for c in known for xs in c.bins.values() for _, b in xs)])
            for n, c in zip(head.names, known, strict=True):
                if self.overlaps is not None and n == self.overlaps[0]:
                    ranges += region(c, *self.overlaps[1:])
                elif self.overlaps is None and n in contigs:
                    ranges += region(c, max(self.start, 0), self.end)
            if self.overlaps is None and "*" in contigs:
                ranges.append((last, max(size(self.path) << 16, last + 1)))
            ranges = merged(ranges)
        tasks = dealt(ranges, cuts, self.split or FAR << 16)
        return [Part(t) for t in tasks] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        head = header(self.path)
        if partition.stretch is None:
            for start, end in partition.ranges:
                yield from self.records(head, start, end)
            return
        a, b = partition.stretch
        start = first_record(self.path, a, head)
        if start is None:
            return
        last = yield from self.records(head, start, None if b is None else b << 16)
        if b is not None and first_record(self.path, b, head) != last:
            raise RuntimeError(f"{self.path}: records beside byte {b} can't be told apart; write an index, or read with split=0")

    def records(self, head: Header, start: int, end: int | None) -> Iterator[tuple]:
        """The wanted records that begin from ``start`` to before ``end``; returns where the next one begins."""
        wanted = None if self.contigs is None else {i for i, n in enumerate(head.names) if n in self.contigs} | ({-1} if "*" in self.contigs else set())
        if self.overlaps is not None:
            wanted = {i for i, n in enumerate(head.names) if n == self.overlaps[0]}
        s = Stream(self.path, start)
        while True:
            order = s.tell()
            if end is not None and order >= end:
                s.close()
                return order if s.data else None
            n = s.read(4)
            if len(n) < 4:
                s.close()
                return None
            raw = s.read(struct.unpack("<i", n)[0])
            ref, pos = struct.unpack_from("<ii", raw)
            if wanted is not None and ref not in wanted or not self.start <= pos < self.end:
                continue
            if self.overlaps is not None and (pos >= self.overlaps[2] or reach(raw) <= self.overlaps[1]):
                continue
            yield record(raw, head.names, order)


class PushingBamReader(BamReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Contigs and bounds of positions; Spark looks at all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("rname",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = names if self.contigs is None else self.contigs & names
            elif getattr(f, "attribute", None) == ("pos",):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.start = max(self.start, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.end = min(self.end, f.value + (not isinstance(f, LessThan)))
            yield f


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cytomill_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return PushingBamReader(options) if options.get("pushdown") == "true" else BamReader(options)


def read(spark: SparkSession, path: str, **options: int | str) -> DataFrame:
    """Reads of a BAM file. Filters on ``rname`` and ``pos`` reach the file where the session lets them, which is asked for here."""
    spark.dataSource.register(BamSource)
    spark.conf.set(FILTER_PUSHDOWN, "true")
    return spark.read.format("cytomill_bam").options(pushdown="true", **{k: str(v) for k, v in options.items()}).load(path)


def read_region(spark: SparkSession, path: str, contig: str, start: int, end: int, **options: int | str) -> DataFrame:
    """Reads that overlap the letters from ``start`` to before ``end`` (0-based) of ``contig``."""
    return read(spark, path, region=f"{contig}:{start}-{end}", **options)
