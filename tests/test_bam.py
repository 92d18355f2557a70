"""BAM in parallel: regions by the index's bins, stretches without an index, and blocked FASTA, against one task that reads all."""

import gzip
import random
import struct

import pytest

from cytomill.operators import index
from cytomill.sources import bam, bgzf, fasta, sam

from .test_genome import bgzf as blocked

NAMES, LENGTH = ["c1", "c2", "c3"], 400_000


def packed_record(name, ref, pos, seq_len, aux=b"", cigar=None, rng=None):
    ops = cigar or [(seq_len, 0)]
    r = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), 99, seq_len, -1, -1, 300) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
    r += bytes(rng.choice((0x11, 0x24, 0x48, 0x81)) for _ in range((seq_len + 1) // 2)) + bytes(rng.randrange(10, 40) for _ in range(seq_len)) + aux
    return struct.pack("<i", len(r)) + r


def bam_file(path, reads=1500, block=3000, aux=None, seed=1, indexed=True):
    """A coordinate-sorted file; ``aux`` gives bytes behind a record. Returns (name, contig, pos) in order."""
    rng = random.Random(seed)
    places = sorted((rng.randrange(3), rng.randrange(LENGTH - 3000)) for _ in range(reads)) + [(-1, -1)] * 5
    raw = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 3) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", LENGTH) for n in NAMES)
    at, starts, spans = len(raw), [], []
    parts = [raw]
    for i, (ref, pos) in enumerate(places):
        n = rng.choice((50, 100, 101))
        cigar = [(20, 0), (rng.choice((1, 2000)), 3), (n - 20, 0)] if i % 7 == 0 else [(n, 0)]
        r = packed_record(f"r{i}", ref, pos, n, aux(i) if aux else b"", cigar if ref >= 0 else [(n, 4)], rng)
        starts.append(at)
        spans.append(sum(k for k, o in cigar if o in (0, 3)))
        parts.append(r)
        at += len(r)
    data = b"".join(parts)
    path.write_bytes(blocked(data, block))
    if indexed:
        places_of = [0]  # of the blocks in the file
        with open(path, "rb") as f:
            whole = f.read()
        while (n := bgzf.block_size(whole, places_of[-1])) is not None:
            places_of.append(places_of[-1] + n)

        def virtual(o):
            return places_of[o // block] << 16 | o % block

        write_index(path, places, spans, [virtual(o) for o in (*starts, len(data))])
    return [(f"r{i}", NAMES[ref] if ref >= 0 else "*", pos) for i, (ref, pos) in enumerate(places)], spans


def smallest_bin(start, end):
    """The finest bin that holds the letters from start to before end."""
    found = None
    for r in bam.bins(start, end):
        if len(r) == 1:
            found = r[0]
    return found


def write_index(path, places, spans, offset):
    out = b"BAI\x01" + struct.pack("<i", 3)
    for ref in range(3):
        by, linear = {}, {}
        for i, ((r, pos), n) in enumerate(zip(places, spans, strict=True)):
            if r == ref:
                chunks = by.setdefault(smallest_bin(pos, pos + n), [])
                if chunks and chunks[-1][1] == offset[i]:
                    chunks[-1][1] = offset[i + 1]
                else:
                    chunks.append([offset[i], offset[i + 1]])
                for w in range(pos >> 14, ((pos + n - 1) >> 14) + 1):
                    linear.setdefault(w, offset[i])
        by[bam.NOTES] = [[0, 0], [1, 2]]
        out += struct.pack("<i", len(by))
        for b, chunks in by.items():
            out += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        top = max(linear, default=-1) + 1
        filled, last = [], 0
        for w in range(top):
            last = linear.get(w, last)
            filled.append(last)
        out += struct.pack("<i", top) + b"".join(struct.pack("<Q", v) for v in filled)
    path.with_name(path.name + ".bai").write_bytes(out)


def read_all(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


class Counted:
    """Bytes that readers take from a file."""

    def __init__(self, monkeypatch):
        self.total = 0
        monkeypatch.setattr(bgzf, "open_binary", lambda path: counting_file(self, path))


def test_region_opens_its_chunks_only(tmp_path, monkeypatch):
    path = tmp_path / "x.bam"
    rows, spans = bam_file(path)
    seen = Counted(monkeypatch)
    every = read_all(bam.BamReader({"path": str(path)}))
    assert [(r[0], r[2], r[3]) for r in every] == rows
    whole, seen.total = seen.total, 0
    for split, tasks in (("4000", 8), ("1000000", 1)):
        seen.total = 0
        reader = bam.PushingBamReader({"path": str(path), "split": split})
        left = list(reader.pushFilters([bam.EqualTo(("rname",), "c2")]))
        assert len(left) == 1 and read_all(reader) == [r for r in every if r[2] == "c2"] and len(reader.partitions()) >= tasks
    assert seen.total < whole * 0.4
    seen.total = 0
    reader = bam.PushingBamReader({"path": str(path)})
    list(reader.pushFilters([bam.In(("rname",), ("c1", "c3")), bam.GreaterThanOrEqual(("pos",), 100_000), bam.LessThan(("pos",), 130_000)]))
    assert read_all(reader) == [r for r in every if r[2] in ("c1", "c3") and 100_000 <= r[3] < 130_000]
    assert seen.total < whole * 0.2
    for name, start, end in (("c1", 0, 400_000), ("c2", 123_456, 123_457), ("c3", 16_384, 32_768), ("c3", 399_999, 400_000), ("c2", 5, 5)):
        got = read_all(bam.BamReader({"path": str(path), "region": f"{name}:{start}-{end}"}))
        assert got == [r for r, n in zip(every, spans, strict=True) if r[2] == name and r[3] < end and r[3] + n > start and end > start]


def test_region_through_spark(spark, tmp_path):
    path = tmp_path / "x.bam"
    rows, _ = bam_file(path, reads=600)
    df = sam.read(spark, str(path), ["c2"])
    assert [(r["qname"], r["rname"], r["pos"]) for r in df.orderBy("file_ord").collect()] == [r for r in rows if r[1] == "c2"]
    assert "rname" in df._jdf.queryExecution().optimizedPlan().toString()
    few = bam.read(spark, str(path)).where("rname = 'c3' AND pos BETWEEN 1000 AND 90000 AND mapq > 3")
    assert few.count() == sum(n == "c3" and 1000 <= p <= 90_000 for _, n, p in rows)
    assert bam.read(spark, str(path)).where("rname = 'none'").count() == 0 and bam.read(spark, str(path)).where("rname = '*'").count() == 5
    assert bam.read_region(spark, str(path), "c1", 50_000, 60_000, split=2000).count() == bam.read(spark, str(path)).where("rname = 'c1' AND pos < 60000 AND pos + coalesce(aggregate(transform(regexp_extract_all(cigar, '(\\\\d+)[MN]', 1), x -> int(x)), 0, (a, x) -> a + x), 0) > 50000").count()


def disguised(seed):
    """Bytes inside records that look like records, and like whole blocks of a file."""
    rng = random.Random(seed)

    def aux(i):
        if i % 5:
            return bytes(rng.randrange(256) for _ in range(rng.randrange(80)))
        many = b"".join(packed_record(f"f{k}", k % 3, 1000 + k, 60, rng=rng) for k in range(12))
        return many + (blocked(many, 500) if i % 2 else b"") + many[:37]

    return aux


@pytest.mark.parametrize("block, split", [(3000, 1500), (700, 5000), (60_000, 30_000)])
def test_stretches_without_an_index(tmp_path, monkeypatch, block, split):
    monkeypatch.setattr(bam, "BACK", 8 << 10)
    monkeypatch.setattr(bam, "CHAIN_BYTES", 8 << 10)
    path = tmp_path / "x.bam"
    rows, _ = bam_file(path, reads=700, block=block, aux=disguised(block), indexed=False)
    one = read_all(bam.BamReader({"path": str(path), "split": "0"}))
    assert [(r[0], r[2], r[3]) for r in one] == rows
    reader = bam.BamReader({"path": str(path), "split": str(split)})
    assert len(reader.partitions()) >= 10
    assert read_all(reader) == one


def test_stretches_through_spark(spark, tmp_path):
    path = tmp_path / "x.bam"
    rows, _ = bam_file(path, reads=900, indexed=False)
    df = bam.read(spark, str(path), split=20_000)
    assert df.rdd.getNumPartitions() > 3
    assert [(r["qname"], r["rname"], r["pos"]) for r in df.orderBy("file_ord").collect()] == rows


def test_stored_blocks_that_hold_blocks(tmp_path):
    """A block whose bytes are stored as they are and are a file of blocks themselves."""
    inner = blocked(b"x" * 5000, 900)[:-28]  # without the empty block at its end

    def stored(part):
        import zlib

        c = b"\x01" + struct.pack("<HH", len(part), 0xFFFF ^ len(part)) + part
        return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(c) + 25) + c + struct.pack("<II", zlib.crc32(part), len(part))

    sizes = [len(stored(inner + bytes([i]) * 40)) for i in range(60)]
    (tmp_path / "s").write_bytes(b"".join(stored(inner + bytes([i]) * 40) for i in range(60)))
    true = [sum(sizes[:i]) for i in range(61)]
    for at in range(0, sum(sizes) - sizes[-1], 97):
        assert bgzf.find_block(str(tmp_path / "s"), at) == min(t for t in true if t >= at)


def test_no_records(spark, tmp_path):
    path = tmp_path / "x.bam"
    path.write_bytes(blocked(b"BAM\x01" + struct.pack("<iii", 0, 1, 2) + b"c\0" + struct.pack("<i", 9), 100))
    assert sam.read(spark, str(path)).count() == 0 and bam.read(spark, str(path), split=10).count() == 0
    path.write_bytes(gzip.compress(b"not one"))
    with pytest.raises(ValueError):
        bam.header(str(path))


def genome(path, widths=(60, 61, 70), lengths=(5000, 1, 12_345)):
    rng = random.Random(2)
    text, fai = "", ""
    for i, (n, w) in enumerate(zip(lengths, widths, strict=True)):
        seq = "".join(rng.choice("acgtNACGT") for _ in range(n))
        text += f">c{i} x\n"
        fai += f"c{i}\t{n}\t{len(text)}\t{w}\t{w + 1}\n"
        text += "\n".join(seq[k : k + w] for k in range(0, n, w)) + "\n"
    path.write_text(text)
    return text, fai


def test_blocked_fasta_is_read_by_chunks(spark, tmp_path, monkeypatch):
    text, fai = genome(tmp_path / "g.fa")
    whole = sorted(map(tuple, fasta.read(spark, str(tmp_path / "g.fa"), chunk=500, flank=7).collect()))
    size = 1000
    (tmp_path / "z.fa.gz").write_bytes(blocked(text.encode(), size))
    (tmp_path / "z.fa.gz.fai").write_text(fai)
    (tmp_path / "g.fa.fai").write_text(fai)
    places, raw = [0], (tmp_path / "z.fa.gz").read_bytes()
    while (n := bgzf.block_size(raw, places[-1])) is not None:
        places.append(places[-1] + n)
    known = [(p, i * size) for i, p in enumerate(places[:-2])][1:]
    (tmp_path / "z.fa.gz.gzi").write_bytes(struct.pack("<Q", len(known)) + b"".join(struct.pack("<QQ", *k) for k in known))
    for name in ("g.fa", "z.fa.gz"):
        for per_task in (1, 4, 100):
            df = fasta.read(spark, str(tmp_path / name), chunk=500, flank=7, per_task=per_task)
            assert sorted(map(tuple, df.collect())) == whole
            assert df.rdd.getNumPartitions() == {1: 36, 4: 11, 100: 3}[per_task]
    one = fasta.read(spark, str(tmp_path / "z.fa.gz"), ["c2"], chunk=500, flank=7)
    assert sorted(map(tuple, one.collect())) == [r for r in whole if r[0] == "c2"]
    seen = Counted(monkeypatch)
    reader = fasta.FastaReader({"path": str(tmp_path / "z.fa.gz"), "chunk": "500", "flank": "7", "chroms": '["c0"]'})
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(got) == [r for r in whole if r[0] == "c0"] and seen.total < len(raw) / 2
    with pytest.raises(ValueError):
        fasta.read(spark, str(tmp_path / "z.fa.gz"), ["c0", "c9"])
    assert index.motif_index(fasta.read(spark, str(tmp_path / "z.fa.gz"), chunk=500), ("CG",)).count() == index.motif_index(fasta.read(spark, str(tmp_path / "g.fa")), ("CG",)).count()


def counting_file(seen, path):
    f = open(path, "rb")

    class File:
        def read(self, n=-1):
            data = f.read(n)
            seen.total += len(data) if not str(path).endswith(("fai", "gzi")) else 0
            return data

        def __enter__(self):
            return self

        def __exit__(self, *_):
            f.close()

        def __getattr__(self, key):
            return getattr(f, key)

    return File()
