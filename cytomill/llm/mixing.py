"""Language-model scores by online logistic context mixing.

A text is coded byte by byte, each byte as the binary decisions of a Huffman code for its context, the byte before.
Four predictors give each decision a probability from counts of all training texts under a hashed or exact context:

* the byte before, and the two bytes before, within the word: exact tables over all pairs and triples of bytes,
  which the number of byte values bounds and which are broadcast;
* the word so far with the text's alphabet: every prefix of every training word keeps the counts of the bytes after it;
* the two words before: the word that followed them most often predicts, bit by bit, for as long as the text agrees.

The last two tables grow with the corpus and are nowhere held whole: blocks of documents ask for the contexts they
need, all askers of a context meet in the task of its bucket, which sums the counts of all blocks and answers each.

The logits are mixed by weights that are selected by a gate (whether and how surely the words before predict) and
learned online from the first word of a text to its last; the mixed logit is refined by an adaptive correction for its
own level. Both learn after each word from all of its decisions, so all texts of a block advance together in numpy,
word by word. Before each byte and at the end, whether the text ends has a probability by the byte before. Contexts, the
alphabet among them, know only bytes that came before, so the probabilities of all texts add up to one.

A text is a sequence of stretches, each a word with the white space behind it. What depends on the stretch and the
alphabet alone is worked out once per distinct stretch of a block. The base score is that of smoothed word
frequencies; its word table is joined back by the same exchange.

``mixing.java`` has what is done with a block, asking and scoring, and with a bucket, summing and answering, as loops that run in
the executors' JVM; the steps in numpy here give the same scores and answers and are what tests hold both against.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, jvm, store
from .words import CHUNK, LOWER, SPACE, U, _powers, _tables, buffer_of, hashes, mix, pieces

#: Bytes of a block of texts: a bound of memory, without a part in the scores.
BLOCK = 4 << 20
RATE, REFINE, LEVELS, DELTA = 0.004, 0.01, 33, 0.4
#: Inputs of the mixer: one byte, two bytes, word so far, the words before, word so far once more by its own sureness.
INPUTS, GATES = 5, 4
START = np.array([[0.1, 0.3, 0.6, 0.0, 0.2], [0.1, 0.3, 0.5, 0.3, 0.2], [0.1, 0.2, 0.3, 0.8, 0.1], [0.1, 0.2, 0.3, 1.0, 0.1]], np.float32)
CLIP, SCALE, TOP = 7.9, 16.0, np.float32(11.9)
#: The token after the last word: no word hashes to it but by chance.
END = U(0x9E3779B97F4A7C15)
CONTEXT_BASE = 0xD1342543DE82EF95
#: Contexts are told apart by so many bits of their hashes more than it takes to number the training bytes, so the few
#: that are taken for others stay as rare whatever the corpus.
SPARE = 8
#: Bytes of a stretch that the words before predict.
AHEAD = 16
#: Where the counts of text ends, texts and empty texts stand behind those of byte triples.
TRIPLES = 1 << 24


@dataclass
class Code:
    """Huffman codes of the 256 bytes, one for each byte before. ``length`` and ``first`` by (byte before) * 256 + byte; the
    decisions of a byte are the entries of ``node`` (0 to 254 within its code) and ``bit`` from its ``first`` on."""

    length: np.ndarray
    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(count: np.ndarray) -> Code:
    """From (256, 256) counts of pairs, each weighed so that every byte has a code."""
    length, node, bit = np.empty(1 << 16, np.int32), [], []
    for one in range(256):
        heap = [(int(c) * 256 + 1, b, b) for b, c in enumerate(count[one])]
        heapq.heapify(heap)
        kids: list[tuple[int, int]] = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            kids.append((a[2], b[2]))
            heapq.heappush(heap, (a[0] + b[0], 255 + len(kids), 255 + len(kids)))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(511)]
        for at in range(510, 255, -1):
            for x in (0, 1):
                paths[kids[at - 256][x]] = [*paths[at], (at - 256, x)]
        for b in range(256):
            length[one * 256 + b] = len(paths[b])
            node += [n for n, _ in paths[b]]
            bit += [x for _, x in paths[b]]
    return Code(length, (np.cumsum(length) - length).astype(np.int32), np.array(node, np.uint8), np.array(bit, np.uint8))


def logits(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of a decision's counts, in steps of 1 / SCALE; few counts give small ones."""
    return np.rint(np.clip(np.log((one + DELTA) / (zero + DELTA)), -CLIP, CLIP) * SCALE).astype(np.int8)


class Stretches:
    """The stretches of a batch of texts, the distinct ones among them, and their words' hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        n = len(data)
        head = np.zeros(n, bool)
        head[1:] = SPACE[data[:-1]]
        head[offs[:-1][offs[:-1] < offs[1:]]] = True
        self.data, self.offs = data, offs
        self.begin = np.flatnonzero(head)
        self.run = np.diff(np.append(self.begin, n))
        h = np.empty(len(self.begin), U)
        table = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
        i = 0
        while i < len(h):  # pieces that stay in the cache
            j = max(i + 1, int(np.searchsorted(self.begin, self.begin[i] + CHUNK)))
            lo, hi = int(self.begin[i]), int(self.begin[j - 1] + self.run[j - 1])
            size = max(CHUNK, 1 << (hi - lo).bit_length()) + 1
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(table[data[lo:hi]] * _powers(CONTEXT_BASE, size)[: hi - lo], out=sums[1:])
            b = self.begin[i:j] - lo
            h[i:j] = (sums[b + self.run[i:j]] - sums[b]) * _powers(pow(CONTEXT_BASE, -1, 1 << 64), size)[b] + self.run[i:j].astype(U)
            i = j
        alphabet = alphabets(data, offs, self.begin)
        h = mix(h) ^ mix(alphabet)
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        one = order[new]
        self.inverse = np.empty(len(h), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.alphabet = alphabet[one]
        run = self.run[one]
        self.first = np.cumsum(run) - run
        at = np.repeat(self.begin[one] - self.first, run)
        at += np.arange(len(at))
        self.bytes, self.byte_run = data.take(at), run
        self.worded = ~SPACE[self.bytes[self.first]]
        low = np.frombuffer(self.bytes.tobytes().translate(LOWER), np.uint8)
        last = self.first + run - 1
        self.word = np.zeros(len(run), U)
        self.word[self.worded] = hashes(low, self.first[self.worded], (last + ~SPACE[self.bytes[last]])[self.worded])

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, the end among them, the texts' tokens as places among these, and their numbers by text."""
        distinct, place = np.unique(np.append(self.word[self.worded], END), return_inverse=True)
        code = np.zeros(len(self.word), np.uint32)
        code[self.worded] = place[:-1]
        some = self.worded[self.inverse]
        text = np.searchsorted(self.offs, self.begin[some], side="right") - 1
        n = np.bincount(text, minlength=len(self.offs) - 1) + 1
        out = np.full(int(n.sum()), place[-1], np.uint32)
        out[np.arange(len(text)) + text] = code[self.inverse[some]]
        return distinct, out, n

    def contexts(self) -> None:
        """The one and two bytes before each byte of the distinct stretches, and the keys of the word so far."""
        data, n = self.bytes, len(self.bytes)

        def before(x: np.ndarray) -> np.ndarray:
            out = np.zeros(n, np.int32)
            out[1:] = x[:-1]
            out[self.first] = 0
            return out

        self.one = before(data)
        self.two = before(self.one)
        table = np.random.default_rng(22).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
        size = 1 << max(20, n.bit_length())
        sums = np.zeros(n + 1, U)
        np.cumsum(table[data] * _powers(CONTEXT_BASE, size)[:n], out=sums[1:])
        prefix = sums[:n] - np.repeat(sums[self.first], self.byte_run)
        prefix *= np.repeat(_powers(pow(CONTEXT_BASE, -1, 1 << 64), size)[self.first], self.byte_run)
        prefix ^= np.repeat(mix(self.alphabet + U(9)), self.byte_run)
        self.prefix = mix(prefix + self.one.astype(U))

    def ahead(self) -> np.ndarray:
        """The first AHEAD bytes of the distinct stretches, with zeros behind."""
        out = np.zeros((len(self.first), AHEAD), np.uint8)
        at = np.minimum(self.first[:, None] + np.arange(AHEAD), max(len(self.bytes) - 1, 0))
        inside = np.arange(AHEAD) < self.byte_run[:, None]
        out[inside] = self.bytes[at[inside]]
        return out

    def before(self) -> np.ndarray:
        """The keys of the two words before each stretch; at a text's start there are none."""
        n = len(self.begin)
        word = self.word[self.inverse]
        one, two = np.zeros(n, U), np.zeros(n, U)
        one[1:] = word[:-1]
        head = np.searchsorted(self.begin, self.offs[:-1][self.offs[:-1] < self.offs[1:]])
        one[head] = 1
        two[1:] = one[:-1]
        two[head] = 2
        return mix(mix(one + U(5)) * U(3) + two)


def alphabets(data: np.ndarray, offs: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """What stands for the language at each stretch: of the bytes above ASCII that the text has had before it, the most
    frequent one (of these the one that came to it last) and one, or 0 if it is rare; leading bytes say less and do not count."""
    at = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    row = np.searchsorted(offs, begin, side="right") - 1
    out = np.zeros(len(begin), U)
    if not len(at):
        return out
    text = np.searchsorted(offs, at, side="right") - 1
    key = text * 64 + data[at] - 0x80
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(key[order]) > 0))
    nth = np.empty(len(at), np.int64)  # which of its text's equal bytes each is
    nth[order] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) + 1
    base = text * (len(data) + 1)
    most = np.maximum.accumulate(base + nth) - base
    leader = np.maximum.accumulate(np.where(nth == most, np.arange(len(at)), 0))
    before = np.searchsorted(at, begin) - 1
    some = np.flatnonzero((before >= 0) & (text[before] == row))
    k = before[some]
    frequent = most[k] * 500 > begin[some] - offs[row[some]]
    out[some] = np.where(frequent, data[at[leader[k]]].astype(np.int64) - 0x7F, 0)
    return out


def joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(d) for d, _ in held)])
    return np.concatenate([d for d, _ in held]), np.concatenate([np.zeros(1, np.int64), *(o[1:] + s for (_, o), s in zip(held, starts, strict=False))])


def offsets(size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return out


def spread_over(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of runs of ``size``, one run after the other."""
    at = np.repeat(first - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte triples within stretches, of bytes that end a text, of texts and of empty ones."""
    total: dict[int, int] = {}
    ends = np.zeros(258, np.int64)
    for batch in pieces(batches, "text"):
        data, offs = buffer_of(batch.column(0))
        full = offs[:-1] < offs[1:]
        ends[:256] += np.bincount(data[offs[1:][full] - 1], minlength=256)
        ends[256:] += (len(full), (~full).sum())
        if not len(data):
            continue
        head = np.zeros(len(data), bool)  # as in Stretches
        head[1:] = SPACE[data[:-1]]
        head[offs[:-1][full]] = True
        key = data.astype(np.uint32)
        one = np.zeros(len(data), np.uint32)
        one[1:] = key[:-1]
        one[head] = 0
        two = np.zeros(len(data), np.uint32)
        two[1:] = one[:-1]
        two[head] = 0
        key |= one << np.uint32(8) | two << np.uint32(16)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for k, c in zip(key[first].tolist(), np.diff(np.append(first, len(key))).tolist(), strict=True):
            total[k] = total.get(k, 0) + c
    total |= {TRIPLES + i: int(n) for i, n in enumerate(ends) if n}
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])


@dataclass
class Model:
    """The exact tables: ``one`` has a logit for each byte before and node, ``two`` for each pair of bytes in ``pair`` (of
    65536, -1 if it was not seen) and node; ``stop`` the probability of the text's end behind each byte and, as its last
    entry, at the start; ``bits`` says how many of a context's hash count."""

    code: Code
    one: np.ndarray
    two: np.ndarray
    pair: np.ndarray
    stop: np.ndarray = field(default_factory=lambda: np.full(257, 0.5))
    bits: int = 48

    def ends(self, s: Stretches) -> np.ndarray:
        """log10 probability of each text's end where it is and of none before."""
        full = s.offs[:-1] < s.offs[1:]
        on = np.log10(1 - self.stop)
        out = np.full(len(full), np.log10(self.stop[-1]))
        last = s.data[s.offs[1:][full] - 1]
        value = on.take(s.data)  # whole texts are summed, the last byte's share is taken back
        out[full] = on[-1] + np.add.reduceat(value, s.offs[:-1][full]) - on[last] + np.log10(self.stop[last]) if full.any() else 0
        return out


def model_of(keys: np.ndarray, n: np.ndarray) -> Model:
    """From counts by key, as ``_count`` has them."""
    triple = keys < TRIPLES
    k, c = keys[triple], n[triple]
    two, byte = k >> 8, k & 255
    pairs = np.bincount(k & 0xFFFF, c, 1 << 16).astype(np.int64)
    code = huffman(pairs.reshape(256, 256))

    def table(context: np.ndarray, one: np.ndarray, byte: np.ndarray, count: np.ndarray, contexts: int) -> np.ndarray:
        at = one * 256 + byte
        place = spread_over(code.first[at], code.length[at])
        key = (np.repeat(context, code.length[at]) * 255 + code.node[place]) * 2 + code.bit[place]
        both = np.bincount(key, np.repeat(count, code.length[at]), contexts * 510).reshape(-1, 2)
        return logits(both[:, 0], both[:, 1])

    seen = np.flatnonzero(pairs)
    one = table(seen >> 8, seen >> 8, seen & 255, pairs[seen], 256)
    known = np.unique(two)
    pair = np.full(1 << 16, -1, np.int32)
    pair[known] = np.arange(len(known))
    second = table(pair[two].astype(np.int64), two & 255, byte, c, len(known)) if len(known) else np.zeros(255, np.int8)
    ends = np.zeros(258, np.int64)
    ends[keys[~triple] - TRIPLES] = n[~triple]
    bytes_ = np.bincount(k & 255, c, 256)
    stop = (np.append(ends[:256], ends[257]) + 0.5) / (np.append(bytes_, ends[256]) + 1)  # smoothed: never 0 or 1
    return Model(code, one, second, pair, stop, min(56, int(c.sum()).bit_length() + SPARE))


def train(texts: DataFrame) -> Model:
    """Count the byte triples of all ``texts`` (one column). The driver receives a count for each triple that occurs,
    TRIPLES at most whatever the corpus."""
    store.bound_batches(texts.sparkSession)
    t = texts.select(F.coalesce(F.col(texts.columns[0]), F.lit("")).alias("text"))
    got = t.mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return model_of(got["key"].to_numpy(), got["n"].to_numpy())


# what a block asks for, and the answers


def packed_up(*arrays: np.ndarray) -> bytes:
    """Arrays as one value. Each plane of an array's bytes is compressed by itself behind its size, as the low bytes of
    hashes do not compress and would spoil the code of the others; a plane that does not gain stays as it is."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(a.itemsize.to_bytes(1, "little") + len(a).to_bytes(4, "little"))
        for plane in a.view(np.uint8).reshape(len(a), a.itemsize).T:
            raw = plane.tobytes()
            less = zstandard.compress(raw, 3)
            if len(less) >= len(raw):
                less = raw
            parts.append(len(less).to_bytes(4, "little") + less)
    return b"".join(parts)


def unpacked(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        size, n = raw[at], int.from_bytes(raw[at + 1 : at + 5], "little")
        at += 5
        a = np.empty((n, size), np.uint8)
        for j in range(size):
            k = int.from_bytes(raw[at : at + 4], "little")
            plane = raw[at + 4 : at + 4 + k]
            a[:, j] = np.frombuffer(plane if k == n else zstandard.decompress(plane), np.uint8)
            at += 4 + k
        out.append(a.reshape(-1).view(f"<u{size}"))
    return out


def shortened(ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes of stretches, two numbers each, as their lengths without the zeros at the end and the bytes, one
    stretch behind the other: so the compression finds words that come again."""
    b = np.ascontiguousarray(ahead).view(np.uint8).reshape(-1, AHEAD)
    some = b != 0
    length = np.where(some.any(1), AHEAD - some[:, ::-1].argmax(1), 0).astype(np.uint8)
    return length, b[np.arange(AHEAD) < length[:, None]]


def lengthened(length: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(length), AHEAD), np.uint8)
    out[np.arange(AHEAD) < length[:, None]] = data
    return out.view(np.uint64).reshape(-1, 2)


def narrow(a: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold the values."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and each value's place among them."""
    order = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return x[order[new]], inverse


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of ``n``."""
    value, inverse = distinct(key)
    return value, np.bincount(inverse, n, len(value)).astype(np.int64)


class Asked:
    """A block's contexts: the three kinds of keys by bucket and key, and after ``count`` the training counts that it adds.

    ``token`` has the distinct tokens; ``node`` the prefixes, with edges to the bytes after them; ``pair`` the words before,
    with edges to the stretches after them."""

    def __init__(self, s: Stretches, buckets: int, bits: int) -> None:
        self.buckets = buckets
        key = U((1 << bits) - 1)
        s.contexts()
        words, self.codes, self.sizes = s.tokens()
        self.token, place, self.token_cut = self.ordered(words)
        self.codes = place[self.codes]
        node, at = distinct(s.prefix & key)
        self.node, place, self.node_cut = self.ordered(node)
        self.node_at = place[at]
        pair, at = distinct(s.before() & key)
        self.pair, place, self.pair_cut = self.ordered(pair)
        self.pair_at = place[at]

    def count(self, s: Stretches, learn: np.ndarray) -> None:
        """Add what the texts with ``learn`` count."""
        self.token_count = np.bincount(self.codes[np.repeat(learn, self.sizes)], minlength=len(self.token))
        heavy = np.repeat(np.bincount(s.inverse[self.known(s, learn)], minlength=len(s.first)), s.byte_run)
        some = np.flatnonzero(heavy)
        self.edge, self.edge_count = summed(self.node_at[some] << 8 | s.bytes[some], heavy[some])
        self.count_pairs(s, learn)

    def known(self, s: Stretches, learn: np.ndarray) -> np.ndarray:
        return learn[np.searchsorted(s.offs, s.begin, side="right") - 1] if len(s.begin) else np.zeros(0, bool)

    def count_pairs(self, s: Stretches, learn: np.ndarray) -> None:
        """What follows the words before; of each of these, the most frequent stretch first, of equals that first by its bytes."""
        known, d = self.known(s, learn), max(1, len(s.first))
        at, self.next_count = summed(self.pair_at[known] * d + s.inverse[known], np.ones(int(known.sum())))
        ahead = s.ahead() if len(at) else np.zeros((0, AHEAD), np.uint8)
        self.next, self.next_ahead = at // d, ahead[at % d].view(np.uint64)
        self.nexts = np.bincount(self.next, minlength=len(self.pair))
        many = np.flatnonzero(self.nexts[self.next] > 1)
        k = self.next_ahead[many]
        order = many[np.lexsort((k[:, 1], k[:, 0], -self.next_count[many], self.next[many]))]
        self.next_count[many], self.next_ahead[many] = self.next_count[order], self.next_ahead[order]

    def ordered(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys by bucket and value, their places there, and the buckets' offsets."""
        order, cut = blocks.order_by_bucket(key, self.buckets)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return key[order], place, cut

    def row(self, b: int) -> bytes:
        def keys(all_: np.ndarray, cut: np.ndarray) -> np.ndarray:
            return narrow(np.diff(all_[cut[b] : cut[b + 1]] // U(self.buckets), prepend=U(0)))

        def fan(at: np.ndarray, cut: np.ndarray, shift: int) -> tuple[np.ndarray, slice]:
            lo, hi = np.searchsorted(at >> shift, (cut[b], cut[b + 1]))
            return narrow(np.bincount((at[lo:hi] >> shift) - cut[b], minlength=cut[b + 1] - cut[b])), slice(lo, hi)

        edges, e = fan(self.edge, self.node_cut, 8)
        nexts, x = fan(self.next, self.pair_cut, 0)
        return packed_up(
            keys(self.token, self.token_cut), narrow(self.token_count[self.token_cut[b] : self.token_cut[b + 1]]),
            keys(self.node, self.node_cut), edges, (self.edge[e] & 255).astype(np.uint8), narrow(self.edge_count[e]),
            keys(self.pair, self.pair_cut), nexts, *shortened(self.next_ahead[x]), narrow(self.next_count[x]),
        )

    def sum(self) -> int:
        return blocks.checksum(np.concatenate([self.token, self.node, self.pair]))


ASKED = "bucket int, block long, sum long, data binary"


def _ask(buckets: int, block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (held, learn) in enumerate(_blocks(batches, block)):
            s = Stretches(*joined([buffer_of(b.column(1)) for b in held]))
            asked = Asked(s, buckets, bits)
            asked.count(s, learn)
            id_, total = blocks.block_id(held[0].column(3)[0].as_py(), k), asked.sum()
            for b in range(buckets):
                if any(cut[b] < cut[b + 1] for cut in (asked.token_cut, asked.node_cut, asked.pair_cut)):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([id_], pa.int64()), pa.array([total], pa.int64()), pa.array([asked.row(b)], pa.binary())], names=["bucket", "block", "sum", "data"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Blocks of rows (key, text, learn, part): their batches and flags of training."""
    held: list[pa.RecordBatch] = []
    size = 0

    def close() -> tuple[list[pa.RecordBatch], np.ndarray]:
        return held, np.concatenate([b.column(2).to_numpy(zero_copy_only=False).astype(bool) for b in held])

    for batch in pieces(batches, "text"):
        held.append(batch)
        size += len(buffer_of(batch.column(1))[0])
        if size >= block:
            yield close()
            held, size = [], 0
    if held:
        yield close()


class Counts:
    """Sums of a bucket over all blocks."""

    def __init__(self, rows: list[bytes], bucket: int, buckets: int) -> None:
        self.bucket, self.buckets = U(bucket), U(buckets)
        none = ((np.zeros(0, U), np.zeros(0, np.int64)), (np.zeros(0, U), np.zeros(0, np.int64)), (np.zeros(0, U), np.zeros((0, 2), U), np.zeros(0, np.int64)))
        kinds: list[list[tuple[np.ndarray, ...]]] = [[n] for n in none]
        for raw in rows:
            token, count, node, edges, byte, edge_count, pair, nexts, length, ahead, next_count = unpacked(raw)
            kinds[0].append((self.keys(token), count))
            kinds[1].append((np.repeat(self.keys(node), edges) << U(8) | byte, edge_count))
            kinds[2].append((np.repeat(self.keys(pair), nexts), lengthened(length, ahead), next_count))
            for i, k in enumerate(kinds):  # sums are made when as much has come as was summed already
                if sum(len(x[0]) for x in k[1:]) > max(1 << 20, len(k[0][0])):
                    kinds[i] = [self.reduced(i, k)]
        self.token, self.edge, self.next = (self.reduced(i, k) for i, k in enumerate(kinds))
        # of what followed two words: the most frequent stretch, of equals the one first by its bytes, and all of them
        key, ahead, count = self.next
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        first = np.flatnonzero(new)
        many = np.flatnonzero(np.repeat(np.diff(np.append(first, len(key))) > 1, np.diff(np.append(first, len(key)))))
        m = order[many]
        order[many] = m[np.lexsort((ahead[m, 1], ahead[m, 0], -count[m], key[m]))]
        self.pair, self.best = key[order[first]], order[first]
        self.pair_total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)

    def keys(self, steps: np.ndarray) -> np.ndarray:
        return np.cumsum(steps, dtype=U) * self.buckets + self.bucket

    @staticmethod
    def reduced(kind: int, parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        count = cols[-1].astype(np.int64)
        if kind < 2:
            return summed(cols[0], count)
        both = mix(cols[0] ^ mix(cols[1][:, 0] + U(7)) ^ mix(cols[1][:, 1] + U(11)) * U(3))
        order = np.argsort(both)
        first = np.flatnonzero(np.append(True, both[order[1:]] != both[order[:-1]])) if len(order) else order
        return cols[0][order[first]], cols[1][order[first]], np.add.reduceat(count[order], first) if len(first) else count

    def answer(self, raw: bytes) -> bytes:
        """For the row of a block: the tokens' counts, the edges of the prefixes, and what follows the words before most
        often. That needs no bytes where the block's own most frequent stretch, the first in its row, is the one."""
        token, _, node, _, _, _, pair, nexts, length, ahead, _ = unpacked(raw)
        words, counts = self.token
        count = counts[np.searchsorted(words, self.keys(token))]
        key = self.keys(node)
        lo, hi = np.searchsorted(self.edge[0], key << U(8)), np.searchsorted(self.edge[0], (key + U(1)) << U(8))
        at = spread_over(lo, hi - lo)
        key = self.keys(pair)
        some, i = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        if len(self.pair):
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            some = self.pair[i] == key
        best = self.next[1][self.best[i[some]]] if some.any() else np.zeros((0, 2), U)
        own = np.zeros((len(key), 2), U)
        own[nexts > 0] = lengthened(length, ahead)[offsets(nexts)[:-1][nexts > 0]]
        other = ((own[some] != best).any(1)) | (nexts[some] == 0)
        state = np.zeros(len(key), np.uint8)
        state[some] = 1 + other
        return packed_up(
            narrow(count), narrow(hi - lo), (self.edge[0][at] & U(255)).astype(np.uint8), narrow(self.edge[1][at]),
            state, *shortened(best[other]), narrow(self.next[2][self.best[i[some]]] if some.any() else i[some]), narrow(self.pair_total[i[some]] if some.any() else i[some]),
        )


ANSWERED = "block long, bucket int, sum long, data binary"


def _tally(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tallied(batches, buckets)

    return run


def _tallied(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sum each bucket over all blocks, then answer every block. The compressed rows of one bucket are held, not
    those of others; buckets follow one another. A row of block -1 has the bucket's training tokens and distinct ones."""

    def row(block: int, bucket: int, total: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["block", "bucket", "sum", "data"])

    def answers(bucket: int, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        c = Counts([r[2] for r in rows], bucket, buckets)
        yield row(-1, bucket, 0, packed_up(np.array([c.token[1].sum(), (c.token[1] > 0).sum()], np.int64)))
        for block, total, raw in rows:
            yield row(block, bucket, total, c.answer(raw))

    at, rows = None, []
    for bucket, block, total, data in blocks.rows_of(batches):
        if bucket.as_py() != at:
            if rows:
                yield from answers(at, rows)
            at, rows = bucket.as_py(), []
        rows.append((block.as_py(), total.as_py(), data.as_py()))
    if rows:
        yield from answers(at, rows)


# scores of a block


class Answers:
    """All answers to a block, in the order of its keys."""

    def __init__(self, rows: list[bytes], asked: Asked) -> None:
        cols = list(zip(*(unpacked(r) for r in rows), strict=True)) or [[np.zeros(0, np.uint8)]] * 9
        self.count, self.edges, self.byte, self.edge_count, state, length, ahead, best, total = (np.concatenate(c) for c in cols)
        self.ahead = np.zeros((len(state), 2), U)
        own = state == 1
        self.ahead[own] = asked.next_ahead[offsets(asked.nexts)[:-1][own]]
        self.ahead[state == 2] = lengthened(length, ahead)
        self.best, self.total = np.zeros(len(state)), np.zeros(len(state))
        self.best[state > 0], self.total[state > 0] = best, total


def decisions(model: Model, s: Stretches, asked: Asked, got: Answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct stretches: offsets of their decisions; logits of the three predictors within the stretch and 1 or -1
    for the bit, together in 32 bits; and offsets of the bytes' decisions. A byte after a prefix is worked out once."""
    code = model.code
    step, which = distinct(asked.node_at << 8 | s.bytes)
    one, two = np.zeros(len(step), np.int32), np.zeros(len(step), np.int32)
    one[which], two[which] = s.one, s.two
    at = one << 8 | (step & 255)
    size = code.length[at]
    place = spread_over(code.first[at], size)
    node, bit = code.node[place].astype(np.int32), code.bit[place]
    x = np.zeros((len(node), 4), np.int8)
    x[:, 0] = model.one.take(np.repeat(one * 255, size) + node)
    pair = np.repeat(model.pair[two << 8 | one], size)
    x[:, 1] = np.where(pair >= 0, model.two.take(np.maximum(pair, 0).astype(np.int64) * 255 + node), 0)
    x[:, 2] = so_far(model, one, step >> 8, asked, got, size, node)
    x[:, 3] = bit * np.int8(2) - np.int8(1)
    byte_size = size[which]
    rows = x.view(np.int32).ravel().take(spread_over(offsets(size)[which], byte_size))
    byte_cut = offsets(byte_size)
    return byte_cut[np.append(s.first, len(s.bytes))], rows, byte_cut


def so_far(model: Model, one: np.ndarray, of: np.ndarray, asked: Asked, got: Answers, size: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Logits of the word so far for decisions ``node``, ``size`` of them for each byte after the prefix ``of``, ascending. The
    bytes that the corpus has after each prefix are added up along their codes, some prefixes at a time."""
    code = model.code
    out = np.zeros(len(node), np.int8)
    before = np.zeros(len(asked.node), np.int32)
    before[of] = one
    edge, own = offsets(got.edges), np.append(np.searchsorted(of, np.arange(len(asked.node))), len(of))
    cut = offsets(size)
    i, n = 0, len(asked.node)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(edge, edge[i] + (1 << 18), side="right")) - 1))
        e = slice(int(edge[i]), int(edge[j]))
        owner = np.repeat(np.arange(j - i, dtype=np.int32), got.edges[i:j])
        at = before[i:j][owner] << 8 | got.byte[e]
        length = code.length[at]
        path = spread_over(code.first[at], length)
        key = np.repeat(owner << 8, length) | code.node[path]
        order = np.argsort(key)
        key, count, bit = key[order], np.repeat(got.edge_count[e].astype(np.float64), length)[order], code.bit[path][order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        lo, hi = int(own[i]), int(own[j])
        wanted = np.repeat((of[lo:hi] - i).astype(np.int32) << 8, size[lo:hi]) | node[cut[lo] : cut[hi]]
        if len(first):
            ones = np.add.reduceat(count * bit, first)
            value = logits(np.add.reduceat(count, first) - ones, ones)
            key = key[first]
            k = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            out[cut[lo] : cut[hi]] = np.where(key[k] == wanted, value[k], 0)
        i = j
    return out


def agreed(model: Model, s: Stretches, asked: Asked, got: Answers, byte_cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each stretch: how many of its first decisions the words before predict as they are, whether they predict the next
    one wrongly, the logit's size, and the gate."""
    which = s.inverse
    guess = np.ascontiguousarray(got.ahead[asked.pair_at]).view(np.uint8).reshape(-1, AHEAD)
    own = s.ahead()[which]
    some = got.total[asked.pair_at] > 0
    length = np.minimum(s.byte_run[which], AHEAD)
    differ = (guess != own) & (np.arange(AHEAD) < length[:, None])
    same = np.where(differ.any(1), differ.argmax(1), length)
    here = s.first[which] + same
    inside = some & (same < length)
    last = np.minimum(here, len(s.bytes) - 1)
    n = byte_cut[here] - byte_cut[s.first[which]]
    # along the byte that differs: the bits its code shares with the one that was predicted; a zero ends the prediction
    wrong = np.zeros(len(which), bool)
    k = np.flatnonzero(inside)
    b = guess[k, np.minimum(same[k], AHEAD - 1)]
    k, b = k[b > 0], b[b > 0]
    if len(k):
        a, c = s.one[last[k]] << 8 | s.bytes[last[k]], s.one[last[k]] << 8 | b
        steps = np.arange(int(np.minimum(model.code.length[a], model.code.length[c]).max()))
        top = len(model.code.bit) - 1
        unlike = model.code.bit[np.minimum(model.code.first[a][:, None] + steps, top)] != model.code.bit[np.minimum(model.code.first[c][:, None] + steps, top)]
        n[k] += unlike.argmax(1)
        wrong[k] = True
    best, total = got.best[asked.pair_at], got.total[asked.pair_at]
    size = np.rint(np.clip(np.log((best + DELTA) / (total - best + DELTA)), 0, CLIP) * SCALE)
    gate = np.where(some, np.where(2 * best <= total, 1, np.where(best < 2, 2, 3)), 0)
    return np.where(some, n, 0), wrong & some, np.where(some, size, 0).astype(np.int8), gate


def scores(model: Model, s: Stretches, asked: Asked, got: Answers) -> np.ndarray:
    """log10 probability of each text's bytes; that of its end comes from ``Model.ends``."""
    texts = len(s.offs) - 1
    out = np.zeros(texts)
    if not len(s.begin):
        return out
    cut, rows, byte_cut = decisions(model, s, asked, got)
    same, wrong, strength, gate = agreed(model, s, asked, got, byte_cut)
    text = np.searchsorted(s.offs, s.begin, side="right") - 1
    count = np.bincount(text, minlength=texts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    rank = np.empty(texts, np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(texts)
    lane = rank[text]
    order = np.argsort(nth * texts + lane)  # word by word, in each the texts with most words first
    which = s.inverse[order]
    size = np.diff(cut)[which]
    active = np.bincount(nth)
    weights = np.tile(START.reshape(1, -1), (texts, 1)).reshape(texts * GATES, INPUTS)
    level = np.zeros(texts * LEVELS, np.float32)
    total = np.zeros(texts)
    chosen = (lane * GATES + gate)[order]
    own_level = lane[order] * LEVELS + LEVELS // 2
    same, wrong, strength = same[order].astype(np.int32), wrong[order].astype(np.int8), strength[order]
    at = offsets(size)
    steps = offsets(active)
    i = 0
    while i < len(active):  # steps of about half a million decisions are laid out together
        j = max(i + 1, int(np.searchsorted(at[steps], at[steps[i]] + (1 << 19))) - 1)
        w = slice(int(steps[i]), int(steps[j]))
        n = size[w]
        v = rows.take(spread_over(cut[which[w]], n)).view(np.int8).reshape(-1, 4)
        left = np.repeat(same[w], n)  # how many decisions are predicted as they are, from each on
        left -= spread_over(np.zeros(len(n), np.int32), n.astype(np.int32))
        guess = (left > 0).view(np.int8) - ((left == 0) & np.repeat(wrong[w], n).view(bool)).view(np.int8)
        sign = v[:, 3].astype(np.float32)
        x = np.empty((len(v), INPUTS), np.float32)
        np.multiply(v[:, :3], np.float32(1 / SCALE), out=x[:, :3], casting="unsafe")
        np.multiply(guess * v[:, 3], np.repeat(strength[w] * np.float32(1 / SCALE), n), out=x[:, 3])
        np.multiply(x[:, 2], np.abs(x[:, 2]), out=x[:, 4])
        x[:, 4] *= np.float32(1 / CLIP)
        base = int(at[steps[i]])
        of = np.repeat(np.arange(len(n)), n)
        spot = np.repeat(own_level[w], n)
        miss = np.empty(len(v), np.float32)
        for t in range(i, j):
            a, b = int(steps[t]), int(steps[t + 1])
            k = slice(int(at[a]) - base, int(at[b]) - base)
            _step(x[k], sign[k], of[k] - (a - w.start), at[a:b] - at[a], chosen[a:b], spot[k], weights, level, miss[k])
        np.negative(miss, out=miss)
        np.add.at(total, lane[order[w]], np.add.reduceat(np.log1p(miss), at[w] - base, dtype=np.float64))
        i = j
    out[:] = total[rank] / np.log(10)
    return out


_HALF = np.float32((LEVELS - 1) / 24)


def _step(x: np.ndarray, sign: np.ndarray, of: np.ndarray, first: np.ndarray, chosen: np.ndarray, spot: np.ndarray, weights: np.ndarray, level: np.ndarray, miss: np.ndarray) -> None:
    """One word of each text: ``x`` has its decisions' inputs, ``of`` their word; then weights and levels learn from
    what each probability lacks, which goes to ``miss``."""
    w = weights.take(chosen, axis=0)
    z = np.einsum("ij,ij->i", x, w.take(of, axis=0))
    np.minimum(z, TOP, out=z)
    np.maximum(z, -TOP, out=z)
    spot += np.rint(z * _HALF).astype(np.int64)
    z += level.take(spot)
    z *= sign
    np.exp(z, out=z)
    z += np.float32(1)
    np.reciprocal(z, out=miss)
    np.multiply(miss, sign, out=z)
    np.add.at(level, spot, z * np.float32(REFINE))
    x *= z[:, None]
    d = np.add.reduceat(x, first, axis=0)
    d *= np.float32(RATE)
    w += d
    weights[chosen] = w


def _bodies(key_type: pa.DataType, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (held, learn) in enumerate(_blocks(batches, block)):
            data, offs = joined([buffer_of(b.column(1)) for b in held])
            keys = [x for b in held for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([blocks.block_id(held[0].column(3)[0].as_py(), k)], pa.int64()), pa.array([0], pa.int64()), pa.array([blocks.squeeze(data.tobytes())], pa.binary()), pa.array([keys], pa.list_(key_type)), pa.array([np.diff(offs).tolist()], pa.list_(pa.int32())), pa.array([learn.tobytes()], pa.binary())], names=["block", "sum", "data", "keys", "sizes", "more"])

    return run


SCORED = "held_out boolean, n_tokens long, n_known long, logs double, score double"


def _join(buckets: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        at, rows = None, []
        for block, bucket, total, data, keys, sizes, more in blocks.rows_of(batches):
            if at is None or at[0] != block.as_py():
                at, rows = (block.as_py(), total.as_py()), []
            if bucket.as_py() < 1 << 30:
                rows.append(data.as_py())
                continue
            learn = np.frombuffer(more.as_py(), bool)
            s = Stretches(np.frombuffer(blocks.spread(data.as_py()), np.uint8), offsets(np.array(sizes.as_py(), np.int64)))
            asked = Asked(s, buckets, m.bits)
            if asked.sum() != at[1]:
                raise RuntimeError("the documents came in another order; score a table that is read alike each time")
            asked.count_pairs(s, learn)
            got = Answers(rows, asked)
            score = scores(m, s, asked, got) + m.ends(s)
            first = np.cumsum(asked.sizes) - asked.sizes
            count = got.count.astype(np.int64)
            logs = np.add.reduceat(np.log10(count + 0.5)[asked.codes], first)
            known = np.add.reduceat((count > 0)[asked.codes].astype(np.int64), first)
            cols = [keys.values, pa.array(~learn), pa.array(asked.sizes.astype(np.int64)), pa.array(known), pa.array(logs), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "held_out", "n_tokens", "n_known", "logs", "score"])

    return run


def _prepared(model: Model, buckets: int):
    """Gives the Java loops what the numpy steps have as constants, code and tables."""
    table, word_base, _ = _tables(0)
    drawn = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1) for seed in (21, 22)]
    base = np.array([CONTEXT_BASE, word_base, int(END)], U)
    c = model.code

    def prepare(made) -> None:
        t = made.tables()
        t.sizes(buckets, model.bits, AHEAD, LEVELS)
        t.rates(DELTA, float(CLIP), float(SCALE), RATE, REFINE, float(TOP))
        t.words(SPACE.tobytes(), LOWER, *(a.tobytes() for a in (*drawn, table, base)))
        t.code(*(a.tobytes() for a in (c.length.astype(np.int32), c.first.astype(np.int32), c.node, c.bit)))
        t.model(*(a.tobytes() for a in (model.one, model.two, model.pair, model.stop.astype(np.float64), START)))

    return prepare


def _asked(bodies: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Rows as ``_ask`` gives them."""
    ask = jvm.function(bodies.sparkSession, "mixing.java", "cytomill.Mixing$Ask", "array<struct<sum:bigint,data:binary>>", _prepared(model, buckets))
    rows = bodies.select("block", ask("data", "sizes", "more").alias("rows")).select("block", F.posexplode("rows").alias("bucket", "row"))
    return rows.where("row.data IS NOT NULL").select("bucket", "block", "row.sum", "row.data")


def _answered(asked: DataFrame, buckets: int) -> DataFrame:
    """Rows as ``_tally`` gives them, by its steps in the executors' JVM."""
    return jvm.over_partitions(blocks.by_bucket(asked, buckets), "mixing.java", "cytomill.Mixing$Tally", ANSWERED, lambda made: made.tables().sizes(buckets, 0, AHEAD, LEVELS))


def _scored(answers: DataFrame, bodies: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Rows as ``_join`` gives them, without those of the buckets' tokens."""
    kinds = "held_out array<boolean>, n_tokens array<bigint>, n_known array<bigint>, logs array<double>, score array<double>"
    score = jvm.function(bodies.sparkSession, "mixing.java", "cytomill.Mixing$Score", f"struct<{kinds.replace(' a', ':a')}>", _prepared(model, buckets))
    of_body = ("data", "keys", "sizes", "more")
    a = answers.where("block >= 0").select("block", F.struct("bucket", "sum", "data").alias("answer"), *(F.lit(None).cast(bodies.schema[c].dataType).alias(c) for c in of_body))
    b = bodies.select("block", F.lit(None).cast(a.schema["answer"].dataType).alias("answer"), *of_body)
    met = a.union(b).repartition(buckets, "block").groupBy("block").agg(F.collect_list("answer").alias("answers"), *(F.first(c, True).alias(c) for c in of_body))
    done = met.select("keys", score("data", "sizes", "more", "answers").alias("s"))
    names = [k.split()[0] for k in kinds.split(", ")]
    return done.select(F.inline(F.arrays_zip("keys", *(f"s.{n}" for n in names))).alias("key", *names))


def score(docs: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", block: int = BLOCK, compiled: bool = True) -> DataFrame:
    """``key``, ``held_out`` (not ``learn``), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` of every row, learning from the rows with ``learn``.

    Both scores charge the text's end. A null or empty text has one token, its end. Repeated rows count as often as they
    come. Null keys are scored like others; further columns are ignored. Without training rows all
    predictors give even odds. An empty table gives no rows. ``block`` bounds the bytes that are worked on together
    and has no part in the results; a longer text is a block of its own. With ``compiled`` the loops over a block's bytes and
    decisions and over a bucket's keys are those of ``mixing.java``, else the steps in numpy of this module, which take several times as long.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    store.bound_batches(spark)
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), F.spark_partition_id().alias("part"))
    model = spark.sparkContext.broadcast(train(slim.where("learn").select("text")))
    kind, arrow = slim.schema["key"].dataType, to_arrow_type(slim.schema["key"].dataType)
    buckets = blocks.buckets_of(docs)
    bodies = slim.mapInArrow(_bodies(arrow, block), f"block long, sum long, data binary, keys array<{kind.simpleString()}>, sizes array<int>, more binary")
    asked = _asked(bodies, model.value, buckets) if compiled else slim.mapInArrow(_ask(buckets, block, model.value.bits), ASKED)
    tables = store.Tables(spark)
    with store.shuffles_end_with_jobs(spark):  # what was asked goes before the answers are shuffled
        met = _answered(asked, buckets) if compiled else blocks.by_bucket(asked, buckets).mapInArrow(_tally(buckets), ANSWERED)
        answers = tables.cut(met, "answers")
    n, v = np.sum([(0, 0), *(unpacked(r[0])[0].tolist() for r in answers.where("block < 0").select("data").collect())], axis=0).tolist()  # a row for each bucket
    with store.shuffles_end_with_jobs(spark):
        if compiled:
            found = _scored(answers, bodies, model.value, buckets)
        else:
            found = blocks.meet(answers.where("block >= 0"), bodies, buckets).mapInArrow(_join(buckets, model), f"key {kind.simpleString()}, {SCORED}")
        done = store.cut(found, "scored")
    tables.drop_all_but()
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))
    return done.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
