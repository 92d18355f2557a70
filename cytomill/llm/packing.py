"""Packing of tokenised documents into sequences by vector best-fit.

Documents are tokenised where they are read; only narrow rows of pieces travel. Pieces are dealt by
hash to groups of about GROUP and each group is packed by one task: a piece is a vector of tokens,
documents and attention cost (its squared length), a sequence has a capacity in each. Pieces come in
decreasing length; each goes to the open sequence that it fits under every constraint and whose
weighted residual would have the smallest norm, or else opens a new one. Pieces of a length are alike
and a sequence that just took one fits the next best, so a length is placed in one vector step.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .words import pieces, spans

CAPACITY, END, GROUP = 1024, 2, 16_384
WEIGHTS = (1.0, 0.1, 0.1)
#: The split pattern of byte-level BPE, as the tokenizer file's ByteLevel pre-tokenizer has it built in.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable bytes are
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A tiktoken encoding with the ranks of a byte-level BPE tokenizer file; it gives the ids that the
    file's own library gives and is several times as fast. A file of another kind is refused."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["model"]["type"] != "BPE" or spec["model"].get("end_of_word_suffix"):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer file in its own library, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The library's ids of a whole text. Where the fast encoder gives up, as on a run of a million blanks, which its pattern
    backtracks through, the library itself encodes the text."""
    try:
        return np.asarray(encoder(path).encode_to_numpy(text or "", allowed_special="all"), dtype="<u4")
    except ValueError:
        return np.array(library(path).encode(text, add_special_tokens=False).ids, "<u4")


def _pieces(path: str, capacity: int, end: int | None, text: int, keep: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            row, piece, start, length, crc, flat = [], [], [], [], [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                ids = token_ids(t, path)
                if end is not None:
                    ids = np.append(ids, np.array([end], "<u4"))
                n = len(ids)
                at = 0
                for p in range(-(-n // capacity)):  # the first piece may be shorter
                    stop = n - capacity * (-(-n // capacity) - 1 - p)
                    part = ids[at:stop]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        flat.append(part)
                    at = stop
            cols = [batch.column(keep).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(spans(np.concatenate(flat) if flat else np.zeros(0, "<u4"), np.concatenate([[0], np.cumsum(length)])).cast(pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def best_fit(length: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """A sequence number and an offset for each piece. ``capacity``: tokens, documents, attention cost."""
    top = np.array(capacity, float)
    residual = np.zeros((0, 3))
    order = np.lexsort((np.arange(len(length)), -length))
    bins = np.empty(len(length), np.int64)
    sizes, first, count = np.unique(-length[order], return_index=True, return_counts=True)
    for size, i, m in zip((-sizes).tolist(), first.tolist(), count.tolist(), strict=True):
        need = np.array([size, 1, size * size], float)
        new = int((top // np.maximum(need, 1e-9)).min())
        if new < 1:
            raise ValueError(f"a piece of {size} tokens exceeds the capacity {capacity}")
        fits = np.flatnonzero((residual >= need).all(1))
        norm = (np.array(weights) * ((residual[fits] - need) / top) ** 2).sum(1)
        fits = fits[np.argsort(norm, kind="stable")]
        room = (residual[fits] // need).min(1).astype(np.int64)
        before = np.cumsum(room) - room
        take = np.clip(m - before, 0, room)
        rest = m - int(take.sum())
        fresh = np.full(-(-rest // new), new, np.int64)
        if len(fresh):
            fresh[-1] = rest - new * (len(fresh) - 1)
        where = np.concatenate([fits, len(residual) + np.arange(len(fresh))])
        take = np.concatenate([take, fresh])
        residual = np.concatenate([residual, np.tile(top, (len(fresh), 1))])
        residual[where] -= take[:, None] * need
        bins[order[i : i + m]] = np.repeat(where, take)
    # offsets in order of placement
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length))
    by = np.lexsort((rank, bins))
    ends = np.cumsum(length[by])
    begin = np.ones(len(by), bool)
    begin[1:] = bins[by][1:] != bins[by][:-1]
    base = np.maximum.accumulate(np.where(begin, ends - length[by], 0)) if len(by) else ends
    offset = np.empty(len(length), np.int64)
    offset[by] = ends - length[by] - base
    return bins, offset


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, max_docs: int | None = None, max_attention: int | None = None, end: int | None = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and
    with ``with_ids`` also ``ids`` (little-endian unsigned 32-bit integers).

    A document's ids are followed by ``end``; a null text is empty, so it is ``end`` alone, and without an
    ``end`` it has no piece. Only documents longer than ``capacity`` are cut. ``max_docs`` bounds the pieces of a
    sequence and ``max_attention`` the sum of their squared lengths; without them the tokens alone bind, as no
    sequence of ``capacity`` tokens has more than ``capacity`` pieces or a larger sum than its square. A
    capacity too small for a piece raises. Keys may be null and of any type and come back as they are. Repeated
    rows are packed as often as they come. Further columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    store.bound_batches(spark)
    limits = (capacity, max_docs or capacity, max_attention or capacity * capacity)
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shape = f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    cut = store.cut(slim.mapInArrow(_pieces(path, capacity, end, 1, 0, with_ids), shape), "pieces")
    groups = max(1, math.ceil(cut.count() / GROUP))
    # the written table is read in the same order again, so a piece keeps its group when a task is repeated
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        # in Arrow throughout: a null among whole numbers must not turn the others into floats
        by = [("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        t = table.sort_by([(c, o) for c, o in by if pa.types.is_primitive(table.schema.field(c).type) or pa.types.is_string(table.schema.field(c).type)])
        bins, offset = best_fit(t["length"].to_numpy().astype(np.int64), limits)
        sequence = (t["group"].to_numpy().astype(np.int64) << 32) + bins
        return t.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    out = dealt.groupBy("group").applyInArrow(place, shape + ", sequence_id long, offset long")
    return out.withColumnRenamed("key", key)
