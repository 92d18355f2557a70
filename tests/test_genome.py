"""Genome, index and file readers."""

import gzip
import random
import struct
import zlib

import pytest

from cytomill.operators import index
from cytomill.sources import bam, bed, fasta, files, sam, writers

CONTIG = "GCNNNACGTAAGCCAGCGNTCCGAATACNCG"
GOLDEN = [
    (6, "CG", "+", "CGT"), (7, "CG", "-", "CGT"), (11, "CHH", "-", "CTT"), (12, "CHH", "+", "CCA"), (13, "CHG", "+", "CAG"), (15, "CHG", "-", "CTG"), (16, "CG", "+", "CGN"),
    (17, "CG", "-", "CGC"), (20, "CHG", "+", "CCG"), (21, "CG", "+", "CGA"), (22, "CG", "-", "CGG"), (29, "CG", "+", "CG$"), (30, "CG", "-", "CGN"),
]


@pytest.fixture()
def genome_file(tmp_path):
    path = tmp_path / "genome.fa"
    path.write_text(f">chr1 first\n{CONTIG[:10].lower()}\n{CONTIG[10:]}\n\n>chrMt\n{CONTIG}\n")
    return path


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_golden_index(spark, genome_file):
    df = index.motif_index(fasta.read(spark, str(genome_file)), ("CG", "CHG", "CHH"), ("triplet_seq", "seq_context"))
    assert df.columns == ["chrom", "start", "end", "motif", "score", "strand", "triplet_seq", "seq_context"]
    for chrom in ("chr1", "chrMt"):
        assert [(r[1], r[3], r[5], r[6]) for r in rows(df.where(f"chrom = '{chrom}'"))] == GOLDEN
    first = {r[1]: r[7] for r in rows(df.where("chrom = 'chr1'"))}
    assert (first[6], first[7], first[11], first[30]) == ("NACGT", "TACGT", "GGCTT", ".")


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_chunks_do_not_change_the_index(spark, genome_file, chunk):
    whole = rows(index.motif_index(fasta.read(spark, str(genome_file)), ("CG", "CHH"), ("seq_context",)))
    assert rows(index.motif_index(fasta.read(spark, str(genome_file), chunk=chunk, flank=4), ("CG", "CHH"), ("seq_context",))) == whole
    (genome_file.parent / "g.fa").write_text(f">a\n{CONTIG[:10]}\n{CONTIG[10:20]}\n{CONTIG[20:30]}\n{CONTIG[30:]}\n")
    (genome_file.parent / "g.fa.fai").write_text("a\t31\t3\t10\t11\n")
    got = rows(index.motif_index(fasta.read(spark, str(genome_file.parent / "g.fa"), chunk=chunk, flank=4), ("CG", "CHH"), ("seq_context",)))
    assert [r[1:] for r in got] == [r[1:] for r in whole if r[0] == "chr1"]


def plain_index(chrom, seq, motifs, n):
    """Letter by letter."""
    pair = {"C": "G", "G": "C", "A": "T", "T": "A"}
    back = lambda x: "".join(pair.get(c, c) for c in reversed(x))
    for i, c in enumerate(seq):
        if c not in "CG":
            continue
        triplet = seq[i : i + 3] if c == "C" else back(seq[max(0, i - 2) : i + 1])
        if len(triplet) < 2:
            motif = "."
        elif triplet[1] in "GN":
            motif = "C" + triplet[1]
        elif len(triplet) < 3:
            motif = "."
        else:
            motif = "CHG" if triplet[2] == "G" else "CHH"
        if motif in motifs:
            context = seq[i - n : i + n + 1] if n <= i < len(seq) - n else "."
            yield chrom, i, i + 1, motif, ".", "+" if c == "C" else "-", triplet.ljust(3, "$"), context if c == "C" or context == "." else back(context)


@pytest.mark.parametrize("hits", [3, 1 << 16])
def test_index_equals_a_plain_version(spark, monkeypatch, hits):
    """Contigs of any length, letters outside ASCII, empty and null ones; batches that end within a contig."""
    monkeypatch.setattr(index, "HITS", hits)
    rng = random.Random(4)
    contigs = {f"k{i}": "".join(rng.choices("ACGTNRÉ\U00010400", k=i)) for i in [*range(8), 40, 300]}
    genome = index.whole_contigs(spark.createDataFrame([*contigs.items(), ("none", None)], "chrom string, seq string"))
    for motifs, n in ((("CG",), 1), (("CG", "CHG", "CHH"), 3)):
        want = sorted(r for k, seq in contigs.items() for r in plain_index(k, seq.upper(), motifs, n))
        assert rows(index.motif_index(genome, motifs, ("triplet_seq", "seq_context"), n)) == want
    assert index.motif_index(genome.limit(0)).count() == 0
    with pytest.raises(KeyError):
        index.motif_index(genome, ("CG",), ("other",))


def test_fasta_errors(spark, genome_file, tmp_path):
    zipped = tmp_path / "g.fa.gz"
    zipped.write_bytes(gzip.compress(genome_file.read_bytes()))
    assert fasta.contigs(str(zipped)) == ["chr1", "chrMt"] and files.is_gzip(str(zipped))
    assert fasta.read(spark, str(zipped), ["chrMt"]).count() == 1
    with pytest.raises(ValueError):
        fasta.read(spark, str(zipped), ["chr7"])
    with pytest.raises(FileNotFoundError):
        fasta.contigs(str(tmp_path / "none"))
    (tmp_path / "empty").touch()
    with pytest.raises(ValueError):
        fasta.contigs(str(tmp_path / "empty"))


def test_motif_choice():
    assert index.check_motifs(["cg", "CWG"]) == ("CG", "CWG")
    for bad in ([], ["CHG", "CWG"], ["XX"]):
        with pytest.raises(ValueError):
            index.check_motifs(bad)


def test_index_round_trip(spark, genome_file, tmp_path):
    df = index.motif_index(fasta.read(spark, str(genome_file)), ("CG", "CHG"), ("triplet_seq",))
    writers.write(writers.index_lines(df), str(tmp_path / "out"), df.columns, single_file=True)
    assert sorted(p.name for p in (tmp_path / "out").glob("*.gz")) == ["CG_chr1.txt.gz", "CG_chrMt.txt.gz", "CHG_chr1.txt.gz", "CHG_chrMt.txt.gz"]
    back = bed.read_index(spark, str(tmp_path / "out" / "CG_chr1.txt.gz"))
    assert [(r["start"], r["strand"], r["triplet_seq"], r["watson_base"]) for r in back.collect()] == [(s, d, t, "C" if d == "+" else "G") for s, m, d, t in GOLDEN if m == "CG"]
    (tmp_path / "no").write_text("chrom\tstart\n1\t2\n")
    with pytest.raises(ValueError):
        bed.read(spark, str(tmp_path / "no"))


READS = [
    ("a", 99, "chr1", 4, 60, "5M", 8, "ACGTA", "IIIII"), ("a", 147, "chr1", 7, 60, "2S3M1I2M1D2M", -8, "TTACGTACGT", "ABCDEFGHIJ"), ("b", 83, "chr1", 9, 13, "3H2S4M", 20, "GGACGT", "!!IIII"),
    ("c", 4, "*", -1, 0, "*", 0, "*", "*"), ("d", 163, "chrMt", 0, 30, "3M2N3M", 9, "CCGTTN", "*"),
]


def bam_bytes(reads, names):
    body = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(names))
    for n in names:
        body += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    import re

    for q, flag, ref, pos, mapq, cigar, tlen, seq, qual in reads:
        ops = [(int(n), bam.OPS.index(o)) for n, o in re.findall(r"(\d+)(.)", cigar)] if cigar != "*" else []
        s = "" if seq == "*" else seq
        codes = [bam.BASES.index(c) for c in s] + [0] * (len(s) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        quals = bytes([0xFF] * len(s)) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        r = struct.pack("<iiBBHHHiiii", names.index(ref) if ref in names else -1, pos, len(q) + 1, mapq, 0, len(ops), flag, len(s), -1, -1, tlen) + q.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + quals
        body += struct.pack("<i", len(r)) + r
    return body


def bgzf(data, size):
    out = b""
    for i in [*range(0, len(data), size), len(data)]:
        part = data[i : i + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        c = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(c) + 25) + c + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("size", [7, 64, 60_000])
def test_sam_and_bam_agree(spark, tmp_path, size):
    text = "@HD\tVN:1\n" + "".join("\t".join(map(str, (q, f, r, p + 1, m, c, "*", 0, t, s, u))) + "\n" for q, f, r, p, m, c, t, s, u in READS)
    (tmp_path / "x.sam").write_text(text)
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes(READS, ["chr1", "chrMt"]), size))
    got = [[tuple(r)[:9] for r in sam.read(spark, str(tmp_path / f"x.{kind}")).orderBy("file_ord").collect()] for kind in ("sam", "bam")]
    assert got[0] == READS and got[1] == READS
