"""Column expressions for bisulfite reads. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bisulfite strands in the order of their ordinals.
STRANDS = ("c_bc", "c_bc_rv", "w_bc", "w_bc_rv")
STRATA = (*STRANDS, "mate1", "mate2")
#: The flag bits of each strand, tested in this order.
STRAND_FLAGS = (("c_bc", 80), ("c_bc_rv", 160), ("w_bc", 96), ("w_bc_rv", 144))
#: Methylation status of an observed base.
NA, METH, UNMETH, SNP, REF = 16, 8, 4, 2, 1
#: A read has to be paired and mapped in a proper pair (3) and to have none of the bits of 3852.
REQUIRED_FLAGS, FORBIDDEN_FLAGS = 3, 3852
MOTIFS = ("CG", "CHG", "CHH")


def bs_strand(flag: Column) -> Column:
    """The bisulfite strand of a read from its SAM flag, null if none applies."""
    out = F.lit(None).cast("string")
    for name, bits in reversed(STRAND_FLAGS):
        out = F.when(flag.bitwiseAND(bits) == bits, name).otherwise(out)
    return out


def strand_rank(strand: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STRANDS)), strand) - 1


def flags_ok(flag: Column) -> Column:
    return (flag.bitwiseAND(REQUIRED_FLAGS) == REQUIRED_FLAGS) & (flag.bitwiseAND(FORBIDDEN_FLAGS) == 0)


def info_ok(seq: Column, qual: Column, cigar: Column) -> Column:
    """Sequence, qualities and CIGAR are there; ``*`` stands for a missing one."""
    there = [F.coalesce((c != "*") & (F.length(c) > 0), F.lit(False)) for c in (seq, qual, cigar)]
    return there[0] & there[1] & there[2]


def strand_letters(strand: Column) -> tuple[Column, Column, Column]:
    """What a strand's reads show of the base that tells of methylation: kept, converted, and the other base of the pair."""
    watson = F.coalesce(strand.isin("w_bc", "w_bc_rv"), F.lit(False))
    kept, lost, other = (F.when(watson, F.lit(a)).otherwise(b) for a, b in (("C", "G"), ("T", "A"), ("G", "C")))
    return kept, lost, other


def meth_status(base: Column, watson_base: Column, strand: Column, letters: tuple[Column, Column, Column] | None = None) -> Column:
    """Status of an observed base: on Watson strands a C is read as C or, converted, T; on Crick strands the
    G opposite is read as G or A. On the other base of the pair only identity can be seen. ``letters`` are those of the strand, if already there."""
    kept, lost, other = letters or strand_letters(strand)
    informative = watson_base == kept
    status = F.when(informative, F.when(base == kept, METH).when(base == lost, UNMETH).otherwise(SNP)).when(~informative & (base == other), REF).otherwise(SNP)
    return F.when(strand.isNull() | base.isNull() | (base == "N"), NA).otherwise(status)


def pos_in_read(strand: Column, qpos: Column, qlen: Column, clip_start: Column, clip_end: Column) -> Column:
    """0-based distance from the read's sequenced start, without soft clips."""
    return F.when(strand.isin("c_bc", "w_bc_rv"), qlen - (qpos + 1) - clip_end).otherwise(qpos - clip_start)


def within_fragment(pos: Column, tlen: Column) -> Column:
    return pos + 1 <= F.abs(tlen)


def outside_clips(qpos: Column, qlen: Column, clip_start: Column, clip_end: Column) -> Column:
    return (clip_start < qpos + 1) & (qpos + 1 < qlen - clip_end + 1)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "CGAT", "GCTA"))


def classify_motif(triplet: Column) -> Column:
    """CG, CN (second base unknown), CHG, CHH (also when the third base is unknown), or ``.`` if too short."""
    second, third = F.substring(triplet, 2, 1), F.substring(triplet, 3, 1)
    return (
        F.when(F.length(triplet) < 2, ".").when(second == "G", "CG").when(second == "N", "CN")
        .when(F.length(triplet) < 3, ".").when(third == "G", "CHG").otherwise("CHH")
    )


def context_ok(context: Column, size: int) -> Column:
    """Whether a sequence context has ``size`` letters of ACGT around a C."""
    if size % 2 == 0:
        raise ValueError("the context size has to be odd")
    half = size // 2
    return F.coalesce(context.rlike(f"^[ACGT]{{{half}}}C[ACGT]{{{half}}}$"), F.lit(False))


def pooled(context: Column) -> Column:
    """A sequence context with A and T pooled as W."""
    return F.translate(context, "AT", "WW")


def context_bin(context: Column, size: int) -> Column:
    """A sequence context with A and T pooled as W; null unless it is one (``context_ok``)."""
    return F.when(context_ok(context, size), pooled(context))


def motif_of_context(context: Column, size: int, classical: bool = True) -> Column:
    """The motif of a binned context: CG, CHG or CHH (size 3: CG or CH); not classical: C and two letters of C, G, W.

    A table of the letters after the C, rather than cases: filters by motif are pushed to the reads, and each case would make the
    context anew there."""
    tail = F.substring(context, size // 2 + 2, 2)
    if not classical:
        return F.concat(F.lit("C"), F.translate(tail, "AT", "WW"))
    pool = {"A": "H", "C": "H", "G": "G", "T": "H", "W": "H"}
    known = {a + b: "CG" if a == "G" else f"C{x}{y}" for a, x in pool.items() for b, y in [("", ""), *pool.items()]}
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in known.items() for v in pair]), tail)


def flen_bin(tlen: Column, max_single: int, width: int, top: int) -> Column:
    """Right-labelled fragment length bin: single lengths, then bins of ``width``, all longer ones at ``top``."""
    t = F.abs(tlen)
    binned = F.least(max_single + F.ceil((t - max_single) / F.lit(width)) * width, F.lit(top))
    return F.when(t <= max_single, t).when(t > top, F.lit(top)).otherwise(binned).cast("long")


def phred_bin(phred: Column, width: int, top: int) -> Column:
    """Right-labelled quality bin, all better ones at ``top``."""
    return F.when(phred > top, F.lit(top)).otherwise(F.least(F.floor(phred / F.lit(width)) * width + width - 1, F.lit(top))).cast("long")


def mate_label(strand: Column) -> Column:
    return F.when(strand.endswith("_rv"), "Mate 2").otherwise("Mate 1")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where nothing was counted."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def fixed8(x: Column) -> Column:
    """Eight decimals, exact ties to even, null as ``nan``."""
    return F.coalesce(F.bround(x.cast("decimal(30,24)"), 8).cast("decimal(22,8)").cast("string"), F.lit("nan"))


#: Symbols of methylated cytosines by motif; unmethylated ones are lower case.
SYMBOLS = {"CG": "Z", "CHG": "X", "CHH": "H"}


def call_symbol(motif: Column, status: Column) -> Column:
    out = F.lit(None).cast("string")
    for m, s in SYMBOLS.items():
        out = F.when(motif == m, F.when(status == METH, s).otherwise(s.lower())).otherwise(out)
    return out
