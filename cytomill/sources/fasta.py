"""FASTA reader: genome rows in chunks with flanks (see ``operators.index``)."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bgzf
from .files import exists, is_gzip, open_binary, open_text

SCHEMA = "chrom string, chunk_start bigint, left int, core int, seq string"
CHUNK, FLANK, PER_TASK = 1 << 16, 64, 64


def contigs(path: str) -> list[str]:
    """Names of the contigs: the first token behind ``>``."""
    with open_text(path) as f:
        return [line[1:].split()[0] for line in f if line.startswith(">")]


def chunks(name: str, parts: Iterator[str], size: int, flank: int) -> Iterator[tuple]:
    """Chunks of a contig from its pieces of sequence; holds one chunk and its flanks."""
    held, start, left = "", 0, 0
    for part in parts:
        held += part
        while len(held) >= left + size + flank:
            yield name, start, left, size, held[: left + size + flank]
            keep = max(0, left + size - flank)
            left, start, held = left + size - keep, start + size, held[keep:]
    if len(held) > left:
        rest = len(held) - left
        for at in range(0, rest, size):
            n = min(size, rest - at)
            lo = max(0, left + at - flank)
            yield name, start + at, left + at - lo, n, held[lo : left + at + n + flank]


class Piece(InputPartition):
    def __init__(self, path: str, name: str | None = None, entry: tuple[int, int, int, int] | None = None, start: int = 0) -> None:
        self.path, self.name, self.entry, self.start = path, name, entry, start
        self.block: tuple[int, int] | None = None  # its place in the file and in the text, if the file is compressed


def indexed(path: str) -> list[tuple[str, tuple[int, int, int, int]]]:
    """Contigs of an ``.fai`` file: letters, place of the first in the text, letters and bytes of a line."""
    with open_text(path) as f:
        rows = [line.split("\t")[:5] for line in f if line.strip()]
    return [(name, tuple(map(int, numbers))) for name, *numbers in rows]


class FastaReader(DataSourceReader):
    """With an ``.fai`` index a task per ``per_task`` chunks of the wanted ``chroms``: of a plain file, or of a blocked gzip file that
    has a ``.gzi`` index too. Else one task streams the file; it passes over other contigs without making chunks of them."""

    def __init__(self, options: dict) -> None:
        self.path, self.size, self.flank = options["path"], int(options.get("chunk", CHUNK)), int(options.get("flank", FLANK))
        self.per_task = max(1, int(options.get("per_task", PER_TASK)))
        self.chroms = set(json.loads(options["chroms"])) if "chroms" in options else None
        self.gzi: list[tuple[int, int]] | None = None

    def partitions(self) -> list[InputPartition]:
        index = f"{self.path}.fai"
        zipped = is_gzip(self.path)
        if not exists(index) or zipped and not (exists(f"{self.path}.gzi") and bgzf.is_blocked(self.path)):
            return [Piece(self.path)]
        blocks = bgzf.offsets(f"{self.path}.gzi") if zipped else None
        out = []
        for name, (length, offset, bases, width) in indexed(index):
            if self.chroms is not None and name not in self.chroms:
                continue
            step = self.size * self.per_task
            for s in range(0, length, step):
                piece = Piece(self.path, name, (length, offset, bases, width), s)
                if blocks is not None:  # the block that holds the first letter of the task's chunks
                    at = self.place(piece.entry, max(0, s - self.flank))
                    piece.block = blocks[bisect.bisect_right(blocks, at, key=lambda b: b[1]) - 1]
                out.append(piece)
        return out or [Piece(self.path, "", (0, 0, 1, 1))]

    @staticmethod
    def place(entry: tuple[int, int, int, int], letter: int) -> int:
        _, offset, bases, width = entry
        return offset + letter // bases * width + letter % bases

    def read(self, partition: Piece) -> Iterator[tuple]:
        if partition.entry is None:
            yield from self.stream(partition.path)
            return
        length = partition.entry[0]
        end = min(length, partition.start + self.size * self.per_task)
        lo, hi = max(0, partition.start - self.flank), min(length, end + self.flank)
        begin = self.place(partition.entry, lo)
        if partition.block is None:
            source = open_binary(partition.path)
            source.seek(begin)
        else:
            source = bgzf.Stream(partition.path, partition.block[0] << 16)
            source.read(begin - partition.block[1])
        have = lo  # letters before it are read; those still needed are held
        held = ""
        for at in range(partition.start, end, self.size):
            core = min(self.size, length - at)
            first, last = max(0, at - self.flank), min(hi, at + core + self.flank)
            if last > have:
                raw = source.read(self.place(partition.entry, last) - self.place(partition.entry, have))
                held += raw.translate(None, b"\r\n").decode().upper()
                have = last
            held = held[first - (have - len(held)) :]
            yield partition.name, at, at - first, core, held[: last - first]
        source.close()

    def stream(self, path: str) -> Iterator[tuple]:
        with open_text(path) as f:
            name, lines = None, []

            def sequence(first: str) -> Iterator[str]:
                nonlocal name
                name = first
                for line in f:
                    if line.startswith(">"):
                        lines.append(line)
                        return
                    yield line.strip().upper()

            line = next((x for x in f if x.startswith(">")), None)
            while line:
                name = line[1:].split()[0]
                if self.chroms is None or name in self.chroms:
                    yield from chunks(name, sequence(line), self.size, self.flank)
                else:
                    for _ in sequence(line):
                        pass
                line = lines.pop() if lines else None


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cytomill_fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(dict(self.options))


def read(spark: SparkSession, path: str, chroms: list[str] | None = None, **options: int) -> DataFrame:
    """Genome rows, of the contigs ``chroms`` only if given: with an index the others are not opened. A wanted contig that is
    missing or empty is an error."""
    spark.dataSource.register(FastaSource)
    given = {k: str(v) for k, v in options.items()}
    if chroms is not None:
        known = {n for n, entry in indexed(f"{path}.fai") if entry[0]} if exists(f"{path}.fai") else set(contigs(path))
        if missing := set(chroms) - known:
            raise ValueError(f"{path} lacks {sorted(missing)}")
        given["chroms"] = json.dumps(sorted(chroms))
    return spark.read.format("cytomill_fasta").options(**given).load(path)
