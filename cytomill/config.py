"""Run configuration: TOML defaults, strict user overrides, expanded paths."""

from __future__ import annotations

import copy
import itertools
import json
import tomllib
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

#: Default parameters; fixed values.
DEFAULTS: dict[str, Any] = {
    "paths": {
        "mbias_counts": "{output_dir}/qc_stats/{name}_mbias-counts", "mbias_stats": "{output_dir}/qc_stats/{name}_mbias-stats",
        "cutting_sites": "{output_dir}/qc_stats/{name}_cutting-sites", "coverage": "{output_dir}/qc_stats/{name}_coverage",
        "calls": "{output_dir}/meth_calls/{name}",
    },
    "stats": {"seq_context_size": 5, "max_flen_with_single_flen_resolution": 150, "flen_bin_size": 20, "max_flen": 500, "phred_bin_size": 5, "max_phred": 40},
    "basic_quality_filtering": {"min_mapq": 25, "min_phred_score": 25},
    "trimming": {
        "min_plateau_perc": 0.5, "max_flen_considered_for_trimming": 500, "min_flen_considered_for_trimming": 50, "max_std_within_plateau": 0.02,
        "relative_to_fragment_ends_dict": {"w_bc": [0, 9], "c_bc": [0, 9], "w_bc_rv": [9, 0], "c_bc_rv": [9, 0]},
    },
    "coverage_analysis": {"max_per_motif_cov": 80},
}


def merged(base: Mapping, custom: Mapping, allow_new_keys: bool = False) -> dict:
    """A copy of ``base`` with the values of ``custom``, section by section. New keys are allowed at the top
    level only and on request (KeyError); a value may not change its type (TypeError)."""
    out = copy.deepcopy(dict(base))
    for k, v in custom.items():
        if k not in out:
            if not allow_new_keys:
                raise KeyError(f"unknown key {k}")
            out[k] = copy.deepcopy(v)
        elif isinstance(out[k], Mapping):
            if not isinstance(v, Mapping):
                raise TypeError(f"{k} has to be a section")
            out[k] = merged(out[k], v)
        elif isinstance(v, type(out[k])) and isinstance(out[k], bool) == isinstance(v, bool):
            out[k] = copy.deepcopy(v)
        else:
            raise TypeError(f"{k} has to be {type(out[k]).__name__}, not {type(v).__name__}")
    return out


def selected(template: str, **values: Any) -> str | list[str]:
    """A template filled with every combination of the given values: one value or a list for each field, the last
    field varying fastest. Other fields stay; a single combination gives a string."""
    lists = [[v] if isinstance(v, (str, int)) else list(v) for v in values.values()]
    out = [expand(template, dict(zip(values, found, strict=True))) for found in itertools.product(*lists)]
    return out[0] if len(out) == 1 else out


def expand(value: Any, fields: Mapping[str, Any]) -> Any:
    """Fill {fields} in all strings of a nested value; unknown fields stay."""
    if isinstance(value, str):
        for k, v in fields.items():
            value = value.replace("{" + k + "}", str(v))
        return value
    if isinstance(value, Mapping):
        return {k: expand(v, fields) for k, v in value.items()}
    return [expand(v, fields) for v in value] if isinstance(value, list) else value


def assemble(sample: Mapping[str, Any], run: Mapping[str, Any] | None = None, user: str | Mapping | None = None, defaults: Mapping = DEFAULTS) -> dict:
    """Defaults, overridden by a user's TOML file or dictionary, with the sample's and the run's fields
    filled into all paths; relative paths are under the output folder."""
    if isinstance(user, str):
        user = tomllib.loads(Path(user).read_text())
    out = merged(defaults, user or {})
    fields = {**sample, **(run or {})}
    out["paths"] = {k: p if p.startswith("/") or "://" in p else f"{fields.get('output_dir', '.')}/{p}" for k, p in expand(out["paths"], fields).items()}
    return {**out, "sample": dict(sample), "run": dict(run or {})}


def sample_info(name: str, **meta: Any) -> dict[str, Any]:
    return {"name": name, **meta}


def subset(keys: str | Sequence[str], of: Mapping) -> dict:
    """Some entries of a mapping; an unknown key raises."""
    return {k: of[k] for k in ([keys] if isinstance(keys, str) else keys)}


def named_paths(text: str) -> dict[str, str]:
    """``a=path,b=path`` as a dictionary."""
    return dict(part.split("=", 1) for part in text.split(",") if part)


def trimming(text: str, cfg: Mapping = DEFAULTS) -> tuple[str, Any]:
    """``frag_end::{json}``, ``frag_end`` alone for the configuration's own, or ``cutting_sites::path``; trimming by
    read ends is not supported."""
    kind, _, rest = text.partition("::")
    if kind == "frag_end":
        rest = rest or json.dumps(cfg["trimming"]["relative_to_fragment_ends_dict"])
        return kind, {k: (int(v[0]), int(v[1])) for k, v in json.loads(rest).items()}
    if kind == "cutting_sites":
        return kind, rest
    if kind == "read_end":
        raise NotImplementedError("trimming by read ends")
    raise ValueError(f"unknown trimming {kind}")
