"""BPE encoding and decoding over a table of distinct words.

Texts are normalised and split into words where they are read, plain ones by a pattern, others by the library's own steps. The distinct words of all blocks meet
by bucket, where each is encoded once; its ids go back to the blocks, and each text's ids are joined
from its words by position. Decoding joins the ids with the vocabulary's pieces, a table whose size the
tokenizer file fixes.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, store
from .words import bounds, hashes, pieces

#: The kind of tokenizer file that split() follows: these values have to be the file's own.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Texts of these letters alone are in normal form, take lower case letter by letter, and their classes are those of the library
#: (a test holds every one of them): Latin but for U+0130, Greek, Cyrillic, general punctuation, CJK, Hangul. Other texts are left to the library.
PLAIN = regex.compile(r"[\x00-\u012F\u0131-\u02FF\u0391-\u03A1\u03A3-\u03CE\u0400-\u0482\u048A-\u052F\u1EA0-\u1EF9\u2010-\u2027\u2030-\u205E\u3001-\u3029\u3041-\u3096\u30A1-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3]*+")


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, a copy that takes words as they are, the pieces by id and the pattern of the special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    split = pre["pretokenizers"][0] if pre["type"] == "Sequence" else {}
    if spec["normalizer"].get("normalizers") != NORMALIZERS or split.get("pattern") != {"Regex": PATTERN} or spec["decoder"] is not None or spec["post_processor"] is not None:
        raise ValueError(f"{path} is not a word BPE tokenizer of the kind that is followed here")
    t, of_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
    of_words.normalizer = None  # a second normal form of a lower-cased word can differ from the first
    of_words.no_padding()
    of_words.no_truncation()
    names = {i: w for w, i in t.get_vocab(with_added_tokens=True).items()}
    special = [a["content"] for a in spec["added_tokens"]]
    return t, of_words, [names.get(i, "") for i in range(max(names) + 1)], regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None


def split(text: str, tokenizer, special: regex.Pattern | None) -> list[str]:
    """The words of a text as the tokenizer's normalizer and pre-tokenizer make them; special tokens are words. Plain texts are
    split here, which is quicker, others by the library."""
    if special is not None and "<" in text and (found := list(special.finditer(text))):
        out, at = [], 0
        for m in found:
            out += split(text[at : m.start()], tokenizer, None)
            out.append(m.group())
            at = m.end()
        return out + split(text[at:], tokenizer, None)
    if text.isascii():
        return WORD.findall(text.lower())
    if PLAIN.fullmatch(text):
        return WORD.findall(text.replace("Σ", "σ").lower())  # letter by letter, without the final sigma
    text = tokenizer.normalizer.normalize_str(text)
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class Block:
    def __init__(self) -> None:
        self.table: dict[str, int] = defaultdict()
        self.table.default_factory = self.table.__len__
        self.keys: list = []
        self.codes: list[np.ndarray] = []
        self.size = self.part = 0


def _blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[Block]:
    tokenizer, _, _, special = load(path)
    block = Block()
    for batch in pieces(batches, "text"):
        keys = batch.column(0).to_pylist()
        block.part = batch.column(2)[0].as_py()
        for key, text in zip(keys, batch.column(1).to_pylist(), strict=True):
            words = split(text, tokenizer, special)
            block.keys.append(key)
            block.codes.append(np.fromiter(map(block.table.__getitem__, words), np.uint32, len(words)))
            block.size += len(text)
        if block.size >= blocks.BLOCK_BYTES:
            yield block
            block = Block()
    if block.keys:
        yield block


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = bounds(data, np.array([0, len(data)]))
    return hashes(data, start, end)


def _words(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(_blocks(batches, path)):
            words = list(block.table)
            h = _word_hashes(words)
            order, cut = blocks.order_by_bucket(h, buckets)
            rows = [(b, blocks.squeeze(" ".join(words[i] for i in order[cut[b] : cut[b + 1]]).encode())) for b in range(buckets) if cut[b] < cut[b + 1]]
            n = len(rows)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([blocks.block_id(block.part, k)] * n, pa.int64()), pa.array([blocks.checksum(h)] * n, pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block", "sum", "data"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of a bucket is encoded once; rows of a bucket come together."""
        _, tokenizer, _, _ = load(path)
        at, known = None, {}
        for bucket, block, total, data in blocks.rows_of(batches):
            if bucket.as_py() != at:
                at, known = bucket.as_py(), {}
            words = blocks.spread(data.as_py()).decode().split(" ")
            new = [w for w in words if w not in known]
            for i in range(0, len(new), 4096):
                for w, e in zip(new[i : i + 4096], tokenizer.encode_batch(new[i : i + 4096], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
            ids = [known[w] for w in words]
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) >> 2
            a, b = blocks.squeeze(sizes), blocks.squeeze(np.frombuffer(b"".join(ids), "<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([at], pa.int32()), pa.array([total.as_py()], pa.int64()), pa.array([len(a).to_bytes(4, "little") + a + b], pa.binary())], names=["block", "bucket", "sum", "data"])

    return run


def _bodies(path: str, buckets: int, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(_blocks(batches, path)):
            h = _word_hashes(list(block.table))
            order, _ = blocks.order_by_bucket(h, buckets)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            codes = place[np.concatenate(block.codes)] if len(h) else np.zeros(0, np.uint32)
            sizes = pa.array([[len(c) for c in block.codes]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([blocks.block_id(block.part, k)], pa.int64()), pa.array([blocks.checksum(h)], pa.int64()), pa.array([blocks.squeeze(codes)], pa.binary()), pa.array([block.keys], pa.list_(key_type)), sizes, pa.array([None], pa.binary())], names=["block", "sum", "data", "keys", "sizes", "more"])

    return run


def _join(path: str, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, names, _ = load(path)
        at, sizes, ids = None, [], []
        for block, bucket, total, data, keys, lengths, _more in blocks.rows_of(batches):
            if at is None or at[0] != block.as_py():
                at, sizes, ids = (block.as_py(), total.as_py()), [], []
            elif at[1] != total.as_py():
                raise RuntimeError("the documents came in another order; encode a table that is read alike each time")
            raw = data.as_py()
            if bucket.as_py() < 1 << 30:
                n = int.from_bytes(raw[:4], "little")
                sizes.append(blocks.spread(raw[4 : 4 + n]))
                ids.append(blocks.spread(raw[4 + n :]))
                continue
            size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
            first = np.cumsum(size) - size
            codes = blocks.spread(raw)
            owner, length = keys.values, np.array(lengths.as_py(), np.int64)
            ends = np.cumsum(length)
            i = 0
            while i < len(length):  # parts of about a million words
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 20))))
                c = codes[ends[i] - length[i] : ends[j - 1]]
                if len(c) and (not len(size) or c.max() >= len(size)):
                    raise RuntimeError("a block's words are missing; encode a table that is read alike each time")
                n = size[c] if len(c) else np.zeros(0, np.int64)
                stop = np.cumsum(n)
                got = flat[np.repeat(first[c] - (stop - n), n) + np.arange(int(stop[-1]))] if len(c) else np.zeros(0, "<u4")
                cut = np.concatenate([[0], stop])[ends[i:j] - (ends[i] - length[i])]
                begin = np.concatenate([[0], cut[:-1]])
                raw_ids = got.astype("<u4").tobytes()
                text = [" ".join(map(names.__getitem__, got[b:e].tolist())) for b, e in zip(begin.tolist(), cut.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([owner.slice(i, j - i), pa.array([raw_ids[4 * b : 4 * e] for b, e in zip(begin.tolist(), cut.tolist(), strict=True)], pa.binary()), pa.array(text, pa.string())], names=["key", "ids", "decoded"])
                i = j

    return run


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded`` (string) of every row.

    The ids are the tokenizer's for the whole text without added special tokens; special tokens within
    the text are recognised. A null or empty text has no ids and decodes to the empty string. Repeated
    rows and null keys are encoded like others; further columns are ignored.
    """
    spark = docs.sparkSession
    store.bound_batches(spark)
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind, arrow = slim.schema["key"].dataType, to_arrow_type(slim.schema["key"].dataType)
    buckets = blocks.buckets_of(docs)
    words = slim.mapInArrow(_words(path, buckets), "bucket int, block long, sum long, data binary")
    answers = blocks.by_bucket(words, buckets).mapInArrow(_encode(path), "block long, bucket int, sum long, data binary")
    bodies = slim.mapInArrow(_bodies(path, buckets, arrow), f"block long, sum long, data binary, keys array<{kind.simpleString()}>, sizes array<int>, more binary")
    out = blocks.meet(answers, bodies, buckets).mapInArrow(_join(path, arrow), f"key {kind.simpleString()}, ids binary, decoded string")
    return out.withColumnRenamed("key", key)
