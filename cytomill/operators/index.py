"""Genome to motif index.

A genome row is a chunk of a contig: ``chrom``, ``chunk_start`` (0-based start of its core), ``left``
(letters before the core), ``core`` (letters of the core) and ``seq``, upper case, with flanks on both sides
wherever the contig goes on. Chunks make partitions even, whatever the contigs' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Positions in a batch that a task gives back.
HITS = 1 << 16
#: Kinds of positions by number.
KINDS = (*C.MOTIFS, "CN", ".")


def whole_contigs(df: DataFrame, chrom: str = "chrom", seq: str = "seq") -> DataFrame:
    """Genome rows of whole contigs."""
    s = F.upper(F.col(seq))
    return df.select(F.col(chrom).cast("string").alias("chrom"), F.lit(0).cast("long").alias("chunk_start"), F.lit(0).alias("left"), F.length(s).alias("core"), s.alias("seq"))


def check_motifs(motifs: Sequence[str]) -> tuple[str, ...]:
    """CG, CHG, CHH and CWG may be asked for; CHG and CWG exclude each other. Nothing classifies as CWG,
    so an index of it alone is empty."""
    found = tuple(m.upper() for m in motifs)
    if not found:
        raise ValueError("at least one motif is needed")
    if unknown := set(found) - {"CG", "CHG", "CHH", "CWG"}:
        raise ValueError(f"unknown motifs: {sorted(unknown)}")
    if {"CHG", "CWG"} <= set(found):
        raise ValueError("CHG and CWG exclude each other")
    return found


def _complement() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[[ord(x) for x in "CGAT"]] = [ord(x) for x in "GCTA"]
    return table


def _around(codes: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Letters from ``before`` to ``after`` of each place, a row each; 0 beyond the ends."""
    places = at[:, None] + np.arange(-before, after + 1)
    return np.where((places >= 0) & (places < len(codes)), codes[np.clip(places, 0, len(codes) - 1)], 0)


def _reversed(letters: np.ndarray) -> np.ndarray:
    """Reverse complements of rows of letters."""
    other = np.where(letters < 256, _complement()[np.minimum(letters, 255)], letters)
    return other[:, ::-1]


def _text(letters: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(letters.astype("<u4")).view(f"<U{letters.shape[1]}").ravel()
    return pa.array(rows.tolist(), pa.string())


def _scan(motifs: Sequence[str], annotations: Sequence[str], n: int):
    wanted = np.array([k in motifs for k in KINDS])
    cg, chg, chh, cn, short = range(len(KINDS))

    def places(codes: np.ndarray, left: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of wanted positions in the core: place, kind, and whether it is a G."""
        part = codes[left : left + core]
        at = np.flatnonzero((part == ord("C")) | (part == ord("G"))) + left
        minus = codes[at] == ord("G")
        step = np.where(minus, -1, 1)
        near = np.zeros(len(codes) + 4, np.uint8)  # two places at either end stand for what is not there
        near[2:-2] = np.minimum(codes, 255)
        second, third = near[at + 2 + step], near[at + 2 + 2 * step]
        g = np.where(minus, ord("C"), ord("G"))
        kind = np.select([second == 0, second == g, second == ord("N"), third == 0, third == g], [short, cg, cn, short, chg], chh)
        kept = wanted[kind]
        return at[kept], kind[kept], minus[kept]

    def notes(codes: np.ndarray, at: np.ndarray, minus: np.ndarray) -> list[pa.Array]:
        out = []
        for a in annotations:
            if a == "triplet_seq":
                letters = np.where(minus[:, None], _reversed(_around(codes, at, 2, 0)), _around(codes, at, 0, 2))
                out.append(_text(np.where(letters == 0, ord("$"), letters)))
            else:
                letters = _around(codes, at, n, n)
                found = _text(np.where(minus[:, None], _reversed(letters), letters)).to_numpy(zero_copy_only=False)
                out.append(pa.array(np.where((at >= n) & (at + n < len(codes)), found, "."), pa.string()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.concat_arrays(c) for c in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["chrom", "start", "kind", "minus", *annotations])

        size = 0
        for batch in batches:
            for chrom, begin, left, core, seq in zip(*batch.columns, strict=True):
                codes = np.frombuffer(seq.as_py().encode("utf-32-le"), "<u4")
                left, begin = left.as_py(), begin.as_py()
                at, kind, minus = places(codes, left, core.as_py())
                for k in range(0, len(at), HITS):
                    i, one = at[k : k + HITS], minus[k : k + HITS]
                    held.append([pa.repeat(chrom, len(i)), pa.array(i + (begin - left), pa.int64()), pa.array(kind[k : k + HITS], pa.int8()), pa.array(one, pa.bool_()), *notes(codes, i, one)])
                    size += len(i)
                    if size >= HITS:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return run


def motif_index(genome: DataFrame, motifs: Sequence[str] = ("CG",), annotations: Sequence[str] = (), context_size: int = 2) -> DataFrame:
    """BED6 rows of all motif positions on both strands; ``annotations`` in the caller's order: of
    ``triplet_seq`` (padded with ``$``) and ``seq_context`` (``context_size`` letters on each side, ``.`` at contig ends).

    A chunk's letters are scanned at once as numbers; tasks give back places and kinds, and Spark makes the columns."""
    motifs, annotations = check_motifs(motifs), [a for a in annotations if a]
    if unknown := set(annotations) - {"triplet_seq", "seq_context"}:
        raise KeyError(f"unknown annotations {sorted(unknown)}")
    schema = ", ".join(["chrom string", "start long", "kind tinyint", "minus boolean", *[f"{a} string" for a in annotations]])
    g = genome.where("core > 0").select("chrom", "chunk_start", "left", "core", "seq").mapInArrow(_scan(motifs, annotations, context_size), schema)
    motif = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    strand = F.when(F.col("minus"), "-").otherwise("+")
    return g.select("chrom", "start", (F.col("start") + 1).alias("end"), motif.alias("motif"), F.lit(".").alias("score"), strand.alias("strand"), *annotations)
