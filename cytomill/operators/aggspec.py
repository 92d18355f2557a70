"""Declarative aggregations for bias plots: specifications are expanded, deduplicated and computed from one
scan per dataset, whatever their number."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import merged
from . import mbias

VALUES = ("n_meth", "n_unmeth", "beta_value")


@dataclass(frozen=True)
class Mapping2D:
    """Which variable goes where in a chart; ``x`` and ``y`` are needed."""

    x: str
    y: str
    color: str | None = None
    detail: str | tuple[str, ...] | None = None
    column: str | None = None
    row: str | None = None

    def variables(self) -> frozenset[str]:
        """Variables to group by: all but the dataset and the statistic."""
        out: set[str] = set()
        for v in (self.x, self.column, self.row, self.color, self.detail):
            out |= set(v) if isinstance(v, (tuple, list)) else {v} if v else set()
        return frozenset(out - {"dataset", "statistic"})

    def encoding(self) -> dict[str, str]:
        return {k: v for k in ("x", "y", "color", "detail", "column", "row") if (v := getattr(self, k)) and isinstance(v, str)}


@dataclass(frozen=True)
class Task:
    """One aggregate of one dataset; equal tasks are computed once."""

    dataset: str
    variables: frozenset[str]
    filters: tuple[tuple[str, tuple], ...] = ()

    def digest(self) -> str:
        """A stable name for the materialised result."""
        return hashlib.sha256(json.dumps([self.dataset, sorted(self.variables), sorted((k, list(map(str, v))) for k, v in self.filters)]).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class PlotConfig:
    group: str
    datasets: tuple[str, ...]
    mapping: Mapping2D
    pre: tuple[tuple[str, tuple], ...] = ()
    post: tuple[tuple[str, tuple], ...] = ()
    params: tuple[tuple[str, object], ...] = field(default=(), compare=False)

    def tasks(self) -> list[Task]:
        return [Task(d, self.mapping.variables(), self.pre) for d in self.datasets]


def _filters(found: Mapping[str, Sequence] | None) -> tuple[tuple[str, tuple], ...]:
    for k, v in (found or {}).items():
        if not isinstance(v, (list, tuple)):
            raise TypeError(f"the values of filter {k} have to be a list")
    return tuple(sorted((k, tuple(v)) for k, v in (found or {}).items()))


def plot_configs(spec: Mapping[str, dict], known: Iterable[str] | None = None) -> list[PlotConfig]:
    """Expand a compact specification: group entries override ``defaults``, and each group is the product of its
    ``datasets`` and ``aes_mappings``."""
    spec = dict(spec)
    defaults = spec.pop("defaults", {})
    out = []
    for name, group in spec.items():
        group = merged(defaults, group, allow_new_keys=True)
        try:
            for datasets, aes in itertools.product(group["datasets"], group["aes_mappings"]):
                names = (datasets,) if isinstance(datasets, str) else tuple(datasets)
                if known is not None and (missing := set(names) - set(known)):
                    raise KeyError(f"unknown datasets {sorted(missing)}")
                detail = aes.get("detail")
                mapping = Mapping2D(**{**aes, "detail": tuple(detail) if isinstance(detail, list) else detail})
                out.append(PlotConfig(name, names, mapping, _filters(group.get("pre_agg_filters")), _filters(group.get("post_agg_filters")), tuple(group["plot_params"].items())))
        except (KeyError, TypeError) as e:
            raise ValueError(f"incomplete specification of {name}: {e}") from e
    return out


def check_levels(names: Iterable[str], levels: Iterable[str]) -> None:
    if unknown := set(names) - set(levels):
        raise ValueError(f"unknown variables {sorted(unknown)}")


def selection(**levels: object) -> Column:
    """A predicate from named levels: a scalar equals, a list contains, a slice is an inclusive range, a column holds."""

    def one(name: str, v: object) -> Column:
        if isinstance(v, slice):
            parts = [F.col(name) >= v.start] * (v.start is not None) + [F.col(name) <= v.stop] * (v.stop is not None)
            return reduce(Column.__and__, parts, F.lit(True))
        if isinstance(v, Column):
            return v
        return F.col(name).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(name) == v

    return reduce(Column.__and__, [one(k, v) for k, v in levels.items()], F.lit(True))


def aggregate_table(df: DataFrame, variables: Iterable[str], filters: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Filter, sum by ``variables`` in the table's own order, beta anew."""
    variables = set(variables)
    levels = [c for c in df.columns if c not in VALUES]
    check_levels(variables, levels)
    for k, v in _filters(filters):
        check_levels([k], levels)
        df = df.where(F.col(k).isin(list(v)))
    return mbias.roll_up(df, [c for c in levels if c in variables])


def rolled(df: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """The aggregates of all ``tasks`` in one table: ``task`` (its place among them), the variables of all (null in rows of tasks without
    them), and sums. One scan: the table is rolled up to the variables that any task groups or filters by, and each task's rows come from
    these few."""
    levels = [c for c in df.columns if c not in VALUES]
    for t in tasks:
        check_levels({*t.variables, *dict(t.filters)}, levels)
    wanted = [c for c in levels if any(c in t.variables or c in dict(t.filters) for t in tasks)]
    kept = [c for c in wanted if any(c in t.variables for t in tasks)]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_meth", "n_unmeth")]
    base = df.groupBy(*wanted).agg(*sums)

    def entry(i: int, t: Task) -> Column:
        one = F.struct(F.lit(i).alias("task"), *[(F.col(c) if c in t.variables else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in kept])
        return F.when(selection(**{k: list(v) for k, v in t.filters}), one) if t.filters else one

    each = F.explode(F.array_compact(F.array(*[entry(i, t) for i, t in enumerate(tasks)]))).alias("e")
    return mbias.roll_up(base.select(each, "n_meth", "n_unmeth").select("e.*", "n_meth", "n_unmeth"), ["task", *kept])


def of_task(done: DataFrame, tasks: Sequence[Task], task: Task, levels: Sequence[str]) -> DataFrame:
    """One task's table from what ``rolled`` gave, as ``aggregate_table`` gives it."""
    return done.where(F.col("task") == list(tasks).index(task)).select(*[c for c in levels if c in task.variables], *VALUES)


def aggregates(configs: Iterable[PlotConfig], tables: Mapping[str, DataFrame]) -> dict[Task, DataFrame]:
    """Each distinct task once. Several of one dataset are parts of one table, which frames read in one job compute once; to read
    them in jobs of their own, write the table first (``workflows.mbias_plots``)."""
    tasks = list(dict.fromkeys(t for c in configs for t in c.tasks()))
    out = {}
    for name, table in tables.items():
        mine = [t for t in tasks if t.dataset == name]
        if len(mine) == 1:
            out[mine[0]] = aggregate_table(table, mine[0].variables, dict(mine[0].filters))
        elif mine:
            every = rolled(table, mine)
            out |= {t: of_task(every, mine, t, table.columns) for t in mine}
    return {t: out[t] for t in tasks}


def post_filter(df: DataFrame, filters: Mapping[str, Sequence]) -> DataFrame:
    """Keep some elements of levels that the table has; an element that it lacks is an error when the rows are
    read. What is there comes as one row from an aggregate over the same table, in the same job and from the same exchange: it reads
    the same counts, and the filter is asked for only where nothing is lacking, so neither is pushed below."""
    known = [(k, list(v)) for k, v in _filters(filters) if k in df.columns]
    if not known:
        return df
    kept = reduce(Column.__and__, [F.col(k).isin(v) for k, v in known])
    lacks = [F.array_except(F.lit(v).cast(f"array<{df.schema[k].dataType.simpleString()}>"), F.col(f"_{i}")) for i, (k, v) in enumerate(known)]
    total = F.sum(reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0)) for c in ("n_meth", "n_unmeth") if c in df.columns], F.lit(0))).alias("_total")
    there = df.agg(*[F.collect_set(F.when(F.col(k).isin(v), F.col(k))).alias(f"_{i}") for i, (k, v) in enumerate(known)], total)
    says = [F.when(F.size(m) > 0, F.raise_error(F.concat(F.lit(f"{k} has no "), F.array_join(m.cast("array<string>"), ", ")))) for m, (k, _) in zip(lacks, known, strict=True)]
    guard = there.select(F.coalesce(*[s.cast("boolean") for s in says], F.col("_total") >= 0, F.lit(True)).alias("_there"))
    return df.join(F.broadcast(guard)).where(F.when(F.col("_there"), kept)).drop("_there")


def plot_data(config: PlotConfig, done: Mapping[Task, DataFrame]) -> DataFrame:
    """The rows of one chart: all datasets one below the other, and for y = value in long form without nulls."""
    parts = [done[t].withColumn("dataset", F.lit(t.dataset)) for t in config.tasks()]
    df = reduce(DataFrame.unionByName, [post_filter(p, dict(config.post)) for p in parts])
    if config.mapping.y == "value":
        keys = [c for c in df.columns if c not in VALUES]
        df = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in VALUES]).unpivot(keys, list(VALUES), "statistic", "value")
    return df.where(F.col(config.mapping.y).isNotNull())


#: The chart grammar's version.
SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"


@dataclass(frozen=True)
class Axis:
    """``breaks``: their number or the values; ``limits``: None or (low, high)."""

    share: bool = True
    breaks: int | tuple[float, ...] = 5
    limits: tuple[float, float] | None = None
    rotate_labels: bool = True

    def encoding(self) -> dict:
        ticks = {"tickCount": self.breaks} if isinstance(self.breaks, int) else {"values": list(self.breaks)}
        axis = {"axis": {**ticks, **({"labelAngle": -90} if self.rotate_labels else {})}}
        return {**axis, **({"scale": {"domain": list(self.limits)}} if self.limits else {})}


@dataclass(frozen=True)
class PlotParams:
    """Presentation of a chart; panels are measured in centimetres."""

    y_axis: Axis = Axis()
    x_axis: Axis = Axis(rotate_labels=False)
    panel_height_cm: float = 6
    panel_width_cm: float = 6
    theme: str = "paper"
    plot: tuple[str, ...] = ("line",)

    @staticmethod
    def of(params: Mapping[str, object]) -> tuple[PlotParams, dict]:
        """From a specification's ``plot_params``; what is not known here goes to the chart's own configuration."""
        known = {k: v for k, v in params.items() if k in PlotParams.__dataclass_fields__}
        for k in ("x_axis", "y_axis"):
            if k in known:
                known[k] = Axis(**{n: tuple(v) if isinstance(v, list) else v for n, v in dict(known[k]).items()})
        if "plot" in known:
            known["plot"] = tuple(known["plot"])
        return PlotParams(**known), {k: v for k, v in params.items() if k not in known}


#: Font sizes of the themes.
THEMES = {"paper": 10, "notebook": 12, "talk": 16, "poster": 22}


def line_chart(df: DataFrame, fields: Mapping[str, str], title: str, params: Mapping[str, object] | None = None, max_rows: int = 100_000) -> dict:
    """A chart as a Vega-Lite dictionary with its rows, lines and, if ``plot`` has them, points. ``fields`` maps channels
    (x, y, color, detail, column, row) to columns. Charts of more than ``max_rows`` rows are refused."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a chart of more than {max_rows} rows; group by fewer variables")
    kinds = dict(df.dtypes)
    p, rest = PlotParams.of(params or {})
    encoding = {k: {"field": v, "type": "nominal" if kinds.get(v) == "string" else "quantitative"} for k, v in fields.items()}
    for k, axis in (("x", p.x_axis), ("y", p.y_axis)):
        encoding[k] |= axis.encoding()
    size = {"width": round(p.panel_width_cm * 96 / 2.54), "height": round(p.panel_height_cm * 96 / 2.54)}
    resolve = {"scale": {k: "shared" if a.share else "independent" for k, a in (("x", p.x_axis), ("y", p.y_axis))}}
    font = THEMES.get(p.theme, THEMES["paper"])
    look = {"axis": {"labelFontSize": font, "titleFontSize": font}, **rest}
    return {"$schema": SCHEMA, "title": title, "mark": {"type": "line", "point": "point" in p.plot}, **size, "data": {"values": [r.asDict() for r in rows]}, "encoding": encoding, "resolve": resolve, "config": look}


def chart(config: PlotConfig, df: DataFrame, max_rows: int = 100_000) -> dict:
    """The chart of one entry of a specification."""
    return line_chart(df, config.mapping.encoding(), config.group, dict(config.params), max_rows)


def plot_frame(df: DataFrame, mapping: Mapping2D, flens: Sequence[int] = ()) -> DataFrame:
    """The rows of one chart straight from a table: sums by the variables of the mapping, of fragment lengths (if they
    are among these) only ``flens``, without rows that have no y."""
    variables = mapping.variables()
    chosen = {"flen": list(flens)} if "flen" in variables and flens else None
    return aggregate_table(df, variables, chosen).where(F.col(mapping.y).isNotNull())


def report(groups: Mapping[str, Sequence[str]], title: str = "M-bias") -> str:
    """An HTML page that links the charts' files by group."""
    parts = "".join(f"<h2>{g}</h2><ul>{''.join(f'<li><a href={json.dumps(p)}>{p}</a></li>' for p in ps)}</ul>" for g, ps in groups.items())
    return f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1>{parts}"
