"""Cutting sites from bias curves: a plateau is fitted to the long fragments' curve, and each stratum keeps
the positions whose counts agree with it.

A position admits an interval of heights. For each slope these become intervals of intercepts, and a sweep over
their sorted ends finds the intercept that most positions admit: tables of positions times slopes, not of models. Strata are
tested in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import sites as S

#: Fixed values of the method.
END_P, PLATEAU_P, RUN, REJECTED, HOPELESS = 1e-6, 0.1, 6, -8.0, -4.0


@dataclass(frozen=True)
class PlateauConfig:
    allow_slope: bool = True
    min_plateau_length: int = 30
    max_slope: float = 0.0006
    plateau_flen: int = 210
    plateau_strands: tuple[str, ...] = ("c_bc", "w_bc")
    always_accept: float = 0.02
    steps: int = 1000


_lgamma = np.vectorize(lgamma, otypes=[float])
#: From this smaller parameter on the beta function is integrated numerically, below it its fraction is summed.
LARGE, FAR = 3000.0, 20.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, elementwise for a, b > 0, whatever their size."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.empty(a.shape)
    large = np.minimum(a, b) > LARGE
    for part, f in ((large, _by_quadrature), (~large, _by_fraction)):
        if part.any():
            out[part] = f(a[part], b[part], x[part])
    return out


def _by_quadrature(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gauss-Legendre quadrature of the density over panels of one deviation around its top, where it is as good as all.
    The density is taken relative to its top and the integral relative to the whole, so no large terms cancel."""
    top = (a - 1) / (a + b - 2)
    width = np.sqrt(top * (1 - top) / (a + b - 2))

    def panel(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        d = width[:, None] * ((hi - lo)[:, None] / 2 * _NODES + (hi + lo)[:, None] / 2)
        inside = (d > -top[:, None]) & (d < 1 - top[:, None])
        d = np.where(inside, d, 0)
        log = (a - 1)[:, None] * np.log1p(d / top[:, None]) + (b - 1)[:, None] * np.log1p(-d / (1 - top)[:, None])
        return (np.where(inside, np.exp(log), 0) @ _WEIGHTS) * (hi - lo) / 2

    z = np.clip((x - top) / width, -FAR, FAR)
    # the tail on the nearer side and all of the density, tails of their own precision
    near = np.where(z > 0, 1.0, -1.0)
    tail, whole = np.zeros(len(z)), np.zeros(len(z))
    for k in np.arange(-FAR, FAR, 4):
        whole += panel(np.full(len(z), k), np.full(len(z), k + 4))
    for k in np.arange(0, FAR, 2):  # outwards from z
        at = np.abs(z) + k
        lo, hi = np.minimum(at, FAR), np.minimum(at + 2, FAR)
        tail += panel(np.where(near > 0, lo, -hi), np.where(near > 0, hi, -lo))
    return np.where(near > 0, 1 - tail / whole, tail / whole)


def _by_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction, summed until it stands."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300

    def safe(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < tiny, tiny, v)

    c, d = np.ones_like(y), 1 / safe(1 - (p + q) * y / (p + 1))
    h = d.copy()
    most = 1000 + 20 * int(np.sqrt(max(a.max(), b.max())))  # it takes terms in proportion to that root
    for m in range(1, most):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / safe(1 + even * d), safe(1 + even / c)
        h *= d * c
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / safe(1 + odd * d), safe(1 + odd / c)
        step = d * c
        h *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    else:
        raise ArithmeticError(f"the fraction did not converge in {most} terms")
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k); NaN for p outside [0, 1]; 1 where k >= n."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    out = np.ones(k.shape)
    inner = k < n
    if inner.any():
        out[inner] = incomplete_beta(n[inner] - k[inner], k[inner] + 1, np.clip(1 - p[inner], 0, 1))
    return np.where((p < 0) | (p > 1) | np.isnan(p), np.nan, out)


def p_values(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Doubled smaller tail as P(X <= k) gives it; 0 where nothing was counted."""
    c = binomial_cdf(k, n, p)
    return 2 * np.where(c > 0.5, 1 - c, c)


def _log10(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(p)


HEIGHTS = 1000


def numbered(line: DataFrame) -> DataFrame:
    """The curve with ``x``, the position's number from 0, and ``beta``, null where nothing was counted. A row per position in a
    read, so they are numbered in one task."""
    x = F.row_number().over(Window.orderBy("pos")) - 1
    return line.withColumns({"x": x.cast("long"), "beta": F.when(F.col("n_total") > 0, F.col("n_meth") / F.col("n_total"))})


def height_sums(line: DataFrame) -> DataFrame:
    """For each of HEIGHTS heights from 0 to 1 (``h``): ``total``, the sum of the positions' log p-values without hopeless ones, and
    ``bad``, the positions that reject it. Heights are tried where the positions are, in Arrow batches, and summed per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heights = np.linspace(0, 1, HEIGHTS)
        for batch in batches:
            k, n = (batch.column(c).to_numpy().astype(float) for c in ("n_meth", "n_total"))
            total, bad = np.zeros(HEIGHTS), np.zeros(HEIGHTS, np.int64)
            for i in range(0, len(k), 256):
                logs = np.log10(p_values(k[None, i : i + 256], n[None, i : i + 256], heights[:, None]) + 1e-30)
                total += np.where(logs < REJECTED, 0, logs).sum(1)
                bad += (logs < HOPELESS).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(HEIGHTS)), pa.array(total), pa.array(bad)], names=["h", "total", "bad"])

    sums = line.select("n_meth", "n_total").mapInArrow(run, "h long, total double, bad long")
    return sums.groupBy("h").agg(F.sum("total").alias("total"), F.sum("bad").alias("bad"))


def flat_plateau(line: DataFrame) -> float:
    """Height of a plateau without slope: that with the best sum of log p-values, the first of equals. Heights that
    half of the positions reject are out, single hopeless positions do not count against one."""
    best = height_sums(line).crossJoin(line.agg(F.count("*").alias("n"))).where(F.col("bad") < F.col("n") / 2).orderBy(F.desc("total"), "h").first()
    if best is None:
        raise ValueError("no plateau found; allowing a slope may help")
    return best["h"] / 1000


def accepted_range(meth: np.ndarray, seen: np.ndarray, strip: float) -> tuple[np.ndarray, np.ndarray]:
    """Per position the interval of model proportions that are not rejected or within ``strip`` of beta. The
    p-value rises and falls once along the proportion, so each end is found by bisection."""
    with np.errstate(invalid="ignore", divide="ignore"):
        beta = np.where(seen > 0, meth / np.maximum(seen, 1), np.nan)

    def ok(p: np.ndarray) -> np.ndarray:
        return _log10(p_values(meth, seen, p)) > REJECTED

    peak = np.clip(np.nan_to_num((meth + 0.5) / (seen + 1)), 1e-9, 1 - 1e-9)
    some = ok(peak)
    ends = []
    for edge in (0.0, 1.0):
        good, bad = peak.copy(), np.full(len(meth), edge)
        whole = ok(bad)
        for _ in range(60):
            mid = (good + bad) / 2
            g = ok(mid)
            good, bad = np.where(g, mid, good), np.where(g, bad, mid)
        ends.append(np.where(whole, edge, good))
    lo, hi = np.where(some, ends[0], np.inf), np.where(some, ends[1], -np.inf)
    return np.where(np.isnan(beta), lo, np.minimum(lo, beta - strip)), np.where(np.isnan(beta), hi, np.maximum(hi, beta + strip))


def admitted(line: DataFrame, strip: float) -> DataFrame:
    """The numbered curve with ``low`` and ``high``, the proportions that a position does not reject (``accepted_range``); positions that
    reject all are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = (batch.column(c).to_numpy().astype(float) for c in ("n_meth", "n_total"))
            if len(k):
                low, high = accepted_range(k, n, strip)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], names=[*batch.schema.names, "low", "high"])

    t = numbered(line)
    return t.mapInArrow(run, StructType([*t.schema.fields, StructField("low", DoubleType()), StructField("high", DoubleType())])).where("low <= high")


def stabbed(t: DataFrame, middle: float, cfg: PlateauConfig) -> DataFrame:
    """For each slope, the intercepts at which the number of agreeing positions changes, and that number: ``slope``, ``intercept`` (numbers on
    their grids of ``cfg.steps``) and ``n``. A model's value is cut to 0 to 1, so a range that reaches an end has none there."""
    last = max(cfg.steps - 1, 1)
    step, base, rise = 0.2 / last, middle - 0.1, cfg.max_slope / last
    each = t.where("low <= 1 AND high >= 0").withColumn("slope", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cfg.steps - 1).cast("long"))))
    shift = F.col("slope") * F.lit(rise) * F.col("x") + F.lit(base)
    first = F.when(F.col("low") <= 0, 0).otherwise(F.ceil((F.col("low") - shift) / F.lit(step)))
    after = F.when(F.col("high") >= 1, cfg.steps).otherwise(F.floor((F.col("high") - shift) / F.lit(step)) + 1)
    each = each.select("slope", F.greatest(first, F.lit(0)).alias("a"), F.least(after, F.lit(cfg.steps)).alias("b")).where("a < b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("intercept"), F.lit(1).alias("d")), F.struct(F.col("b").alias("intercept"), F.lit(-1).alias("d")))).alias("e")
    moves = each.select("slope", ends).groupBy("slope", "e.intercept").agg(F.sum("e.d").alias("d"))
    n = F.sum("d").over(Window.partitionBy("slope").orderBy("intercept").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return moves.select("slope", "intercept", n.alias("n"))


def best_line(line: DataFrame, cfg: PlateauConfig) -> tuple[float, int, int, int, int]:
    """The middle of the intercepts' grid, the numbers of intercept and slope that most positions agree with, the first of equals, how
    many do, and all positions."""
    t = numbered(line)
    middle, size = t.agg(F.median("beta"), F.count("*")).first()
    if middle is None:
        raise ValueError("no plateau found")
    best = stabbed(admitted(line, cfg.always_accept), middle, cfg).orderBy(F.desc("n"), "intercept", "slope").first()
    return (middle, best["intercept"], best["slope"], best["n"], size) if best else (middle, 0, 0, 0, size)


def sloped_plateau(line: DataFrame, cfg: PlateauConfig) -> tuple[float, float]:
    """Intercept and slope that most positions agree with; at least half have to. The
    intercept is then the median of the betas within the accepted strip."""
    middle, i, j, n, size = best_line(line, cfg)
    if n < size / 2:
        raise ValueError("no plateau found")
    last = max(cfg.steps - 1, 1)
    a, b = middle - 0.1 + i * (0.2 / last), j * (cfg.max_slope / last)
    near = numbered(line).where(F.abs(F.col("beta") - (F.lit(a) + F.lit(b) * F.col("x"))) < cfg.always_accept).agg(F.median("beta")).first()[0]
    return (a if near is None else near), b


def integrated(beta: np.ndarray, low: np.ndarray, high: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The larger of the p-values against both bounds (the upper where the lower is unknown), 1 within them."""
    p = np.where(low > high, low, high)
    return np.where((beta >= bounds[0]) & (beta <= bounds[1]), 1.0, p)


def breakpoints(p: np.ndarray, flen: int) -> tuple[int, int]:
    """The kept range of one stratum. An end that deviates is walked inwards to the first run of RUN
    agreeing positions; without such a run nothing is kept."""
    n = len(p)
    last = flen - 1 if 0 < flen < n else n - 1
    good = np.nan_to_num(p, nan=0.0) > PLATEAU_P
    runs = np.flatnonzero(np.convolve(good, np.ones(RUN, int), "valid") == RUN) if n >= RUN else np.zeros(0, int)
    start, end = 0, n
    if p[0] < END_P:
        if not len(runs):
            return 0, 0
        start = int(runs[0])
    if p[last] < END_P:
        inner = runs[runs + RUN <= last + 1]
        if not len(inner):
            return 0, 0
        end = int(inner[-1]) + RUN
    return start, end


def cg_counts(classic: DataFrame) -> DataFrame:
    """``bs_strand``, ``flen``, ``pos``, ``n_meth``, ``n_total`` of the CG rows; masked rows count 0."""
    rows = classic.where(F.col("motif") == "CG") if "motif" in classic.columns else classic
    return rows.select("bs_strand", F.col("flen").cast("long").alias("flen"), F.col("pos").cast("long").alias("pos"), F.coalesce("n_meth", F.lit(0)).cast("long").alias("n_meth"), F.coalesce(F.col("n_meth") + F.col("n_unmeth"), F.lit(0)).cast("long").alias("n_total"))


def curve(counts: DataFrame, cfg: PlateauConfig) -> DataFrame:
    """The curve that the plateau is fitted to: sums by position over the long fragments of the chosen strands."""
    chosen = counts.where(F.col("bs_strand").isin(*cfg.plateau_strands) & (F.col("flen") >= cfg.plateau_flen))
    return chosen.groupBy("pos").agg(F.sum("n_meth").alias("n_meth"), F.sum("n_total").alias("n_total"))


def stratum_p_values(counts: DataFrame, intercept: float, slope: float, first: int, always_accept: float) -> DataFrame:
    """``counts`` with ``p``: how well a position agrees with the plateau of that ``intercept`` at position ``first`` and
    ``slope``, within ``always_accept``. Row by row, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, k, n = (batch.column(c).to_numpy().astype(float) for c in ("pos", "n_meth", "n_total"))
            model = intercept + slope * (pos - first)
            lo, hi = model - always_accept, model + always_accept
            beta = np.where(n > 0, k / np.maximum(n, 1), 0.0)
            p = integrated(beta, p_values(k, n, lo), p_values(k, n, hi), (lo, hi))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p"])

    return counts.mapInArrow(run, StructType([*counts.schema.fields, StructField("p", DoubleType())]))


def cut_ends(p: DataFrame, first: int, last: int) -> DataFrame:
    """Cutting sites of all strata from rows (bs_strand, flen, pos, p), as ``breakpoints`` has them for one: the
    positions from ``first`` to ``last`` in a row's arrays. A position without a row disagrees."""
    n = last - first + 1
    rows = p.groupBy("bs_strand", "flen").agg(F.map_from_entries(F.collect_list(F.struct("pos", "p"))).alias("at"))
    all_ = F.transform(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")), lambda i: F.coalesce(F.nanvl(F.try_element_at("at", i), F.lit(0.0)), F.lit(0.0)))
    rows = rows.select("bs_strand", "flen", all_.alias("p"))
    end = F.when((F.col("flen") > 0) & (F.col("flen") < n), F.col("flen") - 1).otherwise(n - 1).cast("int")
    starts = F.sequence(F.lit(0), F.lit(n - RUN)) if n >= RUN else F.array().cast("array<int>")
    runs = F.filter(starts, lambda i: F.forall(F.slice("p", i + 1, F.lit(RUN)), lambda x: x > PLATEAU_P))
    rows = rows.select("bs_strand", "flen", "p", end.alias("e"), runs.alias("runs"))
    inner = F.filter("runs", lambda i: i + RUN <= F.col("e") + 1)
    low, high = F.get("p", F.lit(0)) < END_P, F.get("p", F.col("e")) < END_P
    none = (low & (F.size("runs") == 0)) | (high & (F.size(inner) == 0))
    start = F.when(low, F.get("runs", F.lit(0))).otherwise(0)
    stop = F.when(high, F.get(inner, F.size(inner) - 1) + RUN).otherwise(n)
    return rows.select("bs_strand", "flen", F.when(none, 0).otherwise(start).cast("long").alias("start"), F.when(none, 0).otherwise(stop).cast("long").alias("end"))


def detect(classic: DataFrame, cfg: PlateauConfig = PlateauConfig()) -> DataFrame:
    """Cutting sites from CG rows of the classic table: ``bs_strand``, ``flen``, ``pos``, ``n_meth``, ``n_unmeth``."""
    spark = classic.sparkSession
    rows = cg_counts(classic)
    line = curve(rows, cfg)
    held = line.toPandas()  # a row per position in a read: made once from the counts, then small
    if not len(held):
        raise ValueError("no fragments are long enough to estimate the plateau")
    line = spark.createDataFrame(held, line.schema)
    intercept, slope = sloped_plateau(line, cfg) if cfg.allow_slope else (flat_plateau(line), 0.0)
    if slope > cfg.max_slope:
        raise ValueError("the plateau is too steep")
    first, last = rows.agg(F.min("pos"), F.max("pos")).first()
    found = cut_ends(stratum_p_values(rows, intercept, slope, first, cfg.always_accept), first, last)
    # strands times lengths rows: written out once so that the windows do not test the strata again
    table = spark.createDataFrame(found.toPandas(), found.schema)
    return S.least_length(S.smoothed(table), cfg.min_plateau_length)


def normal_plateau(group: pd.DataFrame, min_share: float = 0.5, max_std: float = 0.02, min_flen: int = 50) -> tuple[int, int]:
    """An alternative for one curve: the longest stretch of positions whose betas deviate less than ``max_std``
    and whose four positions at either end lie within two deviations of the mean; of equally long
    stretches that with the least deviation. The whole curve itself is not a candidate."""
    beta = group.sort_values("pos")["beta_value"].to_numpy(float)
    n = len(beta)
    if n < min_flen or np.isnan(beta).all():
        return 0, 0
    for length in range(n - 1, max(1, int(n * min_share)) - 1, -1):
        part = np.lib.stride_tricks.sliding_window_view(beta, length)[: n - length]
        known = (~np.isnan(part)).sum(1)
        mean = np.nansum(part, 1) / np.maximum(known, 1)
        std = np.sqrt(np.nansum((part - mean[:, None]) ** 2, 1) / np.maximum(known - 1, 1))
        ends = np.concatenate([part[:, :4], part[:, -4:]], 1)
        with np.errstate(invalid="ignore"):
            fine = (std < max_std) & ~(np.abs(ends - mean[:, None]) > 2 * std[:, None]).any(1)
        if fine.any():
            start = int(np.argmin(np.where(fine, std, np.inf)))
            return start, start + length
    return 0, 0


def normal_plateaus(classic: DataFrame, **kw) -> DataFrame:
    """``normal_plateau`` of every strand and fragment length."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        start, end = normal_plateau(pdf, **kw)
        return pd.DataFrame({"bs_strand": [pdf["bs_strand"].iloc[0]], "flen": [int(pdf["flen"].iloc[0])], "start": [start], "end": [end]})

    return classic.select("bs_strand", F.col("flen").cast("long").alias("flen"), "pos", "beta_value").groupBy("bs_strand", "flen").applyInPandas(one, "bs_strand string, flen long, start long, end long")
