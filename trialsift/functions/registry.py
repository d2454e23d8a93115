"""Facts about known scores and the plan-time checks of arguments (no Spark job runs here)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

# ---- fixed values -------------------------------------------------------------------------
BOOLEAN_METRICS = frozenset({"ar-pec", "ar-lec", "argument_reweighting"})
HIGH_METRICS = frozenset(
    {
        "logical_gap",
        "linearize_logicalgap",
        "forced_gap_ml",
        "reweighted_linearized_gap",
        "wills_reproduce",
    }
)
LOW_METRICS = frozenset({"cluster_llr"})
GAP_METRICS = frozenset({"logical_gap", "linearize_logicalgap", "forced_gap_ml"})
FORCED_METRICS = frozenset({"forced_gap_ml", "linearize_logicalgap"})
SPLIT_KEYS = ("random_split", "randon_split", "n_splits")
CASE_LABELS = {
    -1: "normal success",
    0: "all fail",
    1: "rescued",
    2: "missed",
    3: "overridden",
}
SCORE_LABELS = {
    "exact_gap": "exact gap",
    "forced_gap": "forced gap",
    "anchored_gap": "anchored gap",
    "forced_gap_override_penalty": "forced gap + override penalty",
    "hybrid_min_forced_anchor": "min(forced gap, anchored gap)",
}
SET_LABELS = {
    "both_rejected": "Both rejected",
    "overconfident": "Overconfident",
    "underconfident": "Underconfident",
}
NON_STAT_COLUMNS = frozenset(
    {
        "shot_id", "batch", "experiment", "decoder", "metric", "code", "noisemodel", "d",
        "rounds", "p", "b", "alpha", "cluster_llr_alpha", "n_splits", "split_seed",
        "num_decoding_rounds", "use_both", "xyz", "ibm_reproduce", "random_split",
        "randon_split", "get_detail_stat",
    }
)
# Options of the metrics: their types and default values.
_NUMBER = (int, float)
_SPLIT_OPTIONS = {
    "alpha": ((int, float, str), None),
    "cluster_llr_alpha": ((int, float, str), 2.0),
    "random_split": (bool, False),
    "n_splits": (int, 3),
    "split_seed": (int, 0),
    "split_balanced": (bool, False),
    "get_detail_stat": (bool, False),
    "forced_unconverged_confidence_value": (str, None),
}
_AGREEMENT_OPTIONS = {
    "b": (_NUMBER, None),
    "test_type": (str, None),
    "num_decoding_rounds": (int, None),
}
METRIC_OPTIONS: dict[str, dict[str, tuple]] = {
    "forced_gap_ml": {**_SPLIT_OPTIONS, "get_all_failure_rate": (bool, False)},
    "linearize_logicalgap": _SPLIT_OPTIONS,
    "reweighted_linearized_gap": {
        "b": (_NUMBER, None),
        "forced_unconverged_confidence_value": (str, None),
    },
    "ar-pec": _AGREEMENT_OPTIONS,
    "ar-lec": _AGREEMENT_OPTIONS,
}
# -------------------------------------------------------------------------------------------

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def direction_of(metric: str, given: str | None = None) -> str:
    """``high``: keep large values; ``low``: keep small ones; ``boolean``: an accept flag."""
    if given is not None:
        return check_direction(given, allow_boolean=True)
    if metric in BOOLEAN_METRICS:
        return "boolean"
    if metric in LOW_METRICS:
        return "low"
    if metric in HIGH_METRICS:
        return "high"
    raise ValueError(f"no known direction for metric {metric!r}; pass direction explicitly")


def check_direction(direction: str, allow_boolean: bool = False) -> str:
    allowed = {"high", "low"} | ({"boolean"} if allow_boolean else set())
    if direction not in allowed:
        raise ValueError(f"direction must be one of {sorted(allowed)}, got {direction!r}")
    return direction


def check_gap_metric(metric: str, option: str) -> None:
    if metric not in GAP_METRICS:
        raise ValueError(f"{option} needs a gap metric ({', '.join(sorted(GAP_METRICS))})")


def metric_names(names: str | Sequence[str]) -> list[str]:
    """One or several metric names as a list without repeats."""
    found = [names] if isinstance(names, str) else list(dict.fromkeys(names))
    if not found or any(not isinstance(n, str) or not n for n in found):
        raise ValueError("at least one non-empty metric name is needed")
    return found


def whole_number(value: Any, name: str, minimum: int | None = None) -> int | None:
    """None, or an integer (also given as an integral float) not below ``minimum``."""
    if value is None:
        return None
    integral = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
    if isinstance(value, bool) or not integral:
        raise ValueError(f"{name} must be an integer or None")
    if minimum is not None and value < minimum:
        raise ValueError(f"{name} must be at least {minimum}")
    return int(value)


def bin_count(bins: Any) -> int | None:
    """Number of bins; None means one group per distinct value."""
    if bins is None or isinstance(bins, bool):
        return None
    number = whole_number(bins, "bins")
    return number if number and number > 0 else None


def check_rates(rates: Sequence[float]) -> list[float]:
    values = [float(r) for r in rates]
    if not values:
        raise ValueError("abort_rates must not be empty")
    if any(not 0.0 <= r < 1.0 for r in values):
        raise ValueError("abort_rates must satisfy 0 <= r < 1")
    return values


def partition_keys(by: Sequence[str], error: str | None = None, separate_error: bool = False):
    """Grouping columns, with the label appended when results are split by it."""
    keys = list(dict.fromkeys(by))
    if separate_error and error and error not in keys:
        keys.append(error)
    return keys


def check_options(given: Mapping[str, Any], allowed: Mapping[str, tuple]) -> dict[str, Any]:
    """Options with types checked and unknown keys rejected.

    ``allowed`` maps an option to ``(type or tuple of types, default)``.
    """
    unknown = sorted(set(given) - set(allowed))
    if unknown:
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    out: dict[str, Any] = {}
    for name, (types, default) in allowed.items():
        value = given.get(name, default)
        kinds = types if isinstance(types, tuple) else (types,)
        wrong_bool = isinstance(value, bool) and bool not in kinds
        if value is not None and (wrong_bool or not isinstance(value, kinds)):
            raise ValueError(f"option {name} has the wrong type: {value!r}")
        out[name] = value
    return out


# Accepted options per metric: name -> (types, default).


def metric_options(metric: str, given: Mapping[str, Any]) -> dict[str, Any]:
    """Checked options of one metric; unknown names and contradictions are errors."""
    if metric not in METRIC_OPTIONS:
        raise ValueError(f"unknown metric {metric!r}")
    out = check_options(given, METRIC_OPTIONS[metric])
    unconverged = out.get("forced_unconverged_confidence_value")
    if unconverged is not None:
        out["forced_unconverged_confidence_value"] = unconverged = unconverged.strip().lower()
        if unconverged not in ("positive", "negative"):
            raise ValueError("forced_unconverged_confidence_value: 'positive' or 'negative'")
    if "cluster_llr_alpha" in out:
        order = out.pop("alpha")
        out["cluster_llr_alpha"] = float(out["cluster_llr_alpha"] if order is None else order)
        return out
    needed = [name for name, value in out.items()
              if value is None and name != "forced_unconverged_confidence_value"]
    if needed:
        raise ValueError(f"{metric} requires {', '.join(needed)}")
    kind = out.get("test_type", "Ratio")
    if kind != "Ratio":
        kind = out["test_type"] = kind.strip().title()
    if kind not in ("Ratio", "Gap"):
        raise ValueError("test_type must be 'Ratio' or 'Gap'")
    if out["b"] <= (1.0 if kind == "Ratio" else 0.0):
        raise ValueError("b must be above 1 for Ratio and above 0 for Gap reweighting")
    if out.get("num_decoding_rounds", 2) < 2:
        raise ValueError("num_decoding_rounds must be at least 2")
    return out


def stat_columns(schema, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither identifiers nor parameters."""
    skip = NON_STAT_COLUMNS | set(exclude)
    return [
        f.name
        for f in schema.fields
        if f.name not in skip and f.dataType.simpleString() in NUMERIC_TYPES
    ]


def stage_pairs(names: Sequence[str]) -> list[str]:
    """Baseline/forced column pairs besides the weights, baseline first."""
    present = set(names)
    out: list[str] = []
    for name in names:
        stem = name.removeprefix("baseline_")
        if name.startswith("baseline_") and stem != "weight" and f"forced_{stem}" in present:
            out += [name, f"forced_{stem}"]
    return out


def stage_values(names: Sequence[str]) -> list[str]:
    """Weights first, then the other baseline/forced pairs."""
    weights = [n for n in ("baseline_weight", "forced_weight") if n in set(names)]
    return weights + stage_pairs(names)


def stage_metric(names: Sequence[str], stage: str) -> str:
    """The one column of a stage that is not its weight."""
    found = [n for n in names if n.startswith(f"{stage}_") and n != f"{stage}_weight"]
    if len(found) != 1:
        raise ValueError(f"expected exactly one {stage} column, found {found}")
    return found[0]
