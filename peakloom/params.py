"""Parameters, their allowed ranges and fallbacks, read from a two-column CSV."""

from __future__ import annotations

import dataclasses
import json
import warnings
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Params:
    rt_lower: float = 0.0
    rt_upper: float = 1000.0
    mz_lower: float = 0.0
    mz_upper: float = 100000.0
    scan_levels: tuple[int, ...] = (1, 2)
    centroid_mz_tol: float | None = 0.002
    ms1_abs_int_tol: float = 1000.0
    ms2_abs_int_tol: float = 500.0
    ms2_rel_int_tol: float = 0.01
    precursor_mz_offset: float = 2.0
    mz_tol_ms1: float = 0.01
    mz_tol_ms2: float = 0.015
    feature_gap_tol: int = 10
    scan_scan_cor_tol: float = 0.9
    mz_tol_feature_grouping: float = 0.01
    rt_tol_feature_grouping: float = 0.05
    isotope_rel_int_limit: float = 1.5
    mz_tol_alignment: float = 0.01
    rt_tol_alignment: float = 0.2
    noise_tol: float = 2.0
    gaussian_similarity_tol: float = 0.7
    rt_tol_rt_correction: float = 0.5
    correct_rt: bool = True
    scan_number_cutoff: int = 5
    detection_rate_cutoff: float = 0.1
    merge_features: bool = True
    mz_tol_merge_features: float = 0.005
    rt_tol_merge_features: float = 0.03
    fill_gaps: bool = True
    gap_filling_rt_window: float = 0.05
    rt_tol_annotation: float = 0.2
    ms2_sim_tol: float = 0.7
    consider_rt: bool = False
    fuzzy_search: bool = False
    ms2_library_path: str | None = None
    mzrt_list_path: str | None = None
    signal_normalization: bool = False
    sample_normalization: bool = False
    quant_method: str = "peak_height"
    run_statistics: bool = False
    by_group_name: str | None = None
    ion_mode: str = "positive"
    ms_type: str | None = None

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=1)


#: What a value outside its range becomes: (least, most, fallback). The fallbacks aren't always the defaults above.
RANGES: dict[str, tuple[float, float, float]] = {
    "centroid_mz_tol": (0, 0.1, 0.005), "ms1_abs_int_tol": (0, 1e10, 1000), "ms2_abs_int_tol": (0, 1e10, 500), "ms2_rel_int_tol": (0, 1, 0.01), "precursor_mz_offset": (0, 1e5, 2.0),
    "mz_tol_ms1": (0, 5, 0.01), "mz_tol_ms2": (0, 5, 0.015), "feature_gap_tol": (0, 100, 30), "scan_scan_cor_tol": (0, 1, 0.7), "mz_tol_alignment": (0, 0.02, 0.01), "rt_tol_alignment": (0, 2, 0.2),
    "scan_number_cutoff": (0, 100, 5), "detection_rate_cutoff": (0, 1, 0.1), "mz_tol_merge_features": (0, 0.02, 0.01), "rt_tol_merge_features": (0, 0.5, 0.05), "ms2_sim_tol": (0, 1, 0.7),
}
#: Least intensities of orbitraps: MS1, MS2.
ORBITRAP = (30000.0, 10000.0)


def typed(text: str | None) -> object:
    """A cell as number, truth value, None (``none``) or text."""
    value = (text or "").strip()
    low = value.lower()
    if low in ("", "none", "nan"):
        return None
    if low in ("true", "yes", "false", "no"):
        return low in ("true", "yes")
    try:
        number = float(value)
    except ValueError:
        return value
    return int(number) if number.is_integer() and "." not in value and "e" not in low else number


def checked(values: dict[str, object]) -> Params:
    """Known values in range; others fall back with a warning, unknown names are reported and left out."""
    known = {f.name: f for f in dataclasses.fields(Params)}
    out = {}
    for name, value in values.items():
        if name not in known:
            warnings.warn(f"unknown parameter {name!r}", stacklevel=2)
            continue
        if value is None and name != "centroid_mz_tol" and known[name].default is not None:
            continue
        if name in RANGES and value is not None:
            least, most, fallback = RANGES[name]
            if not isinstance(value, (int, float)) or isinstance(value, bool) or not least <= value <= most:
                warnings.warn(f"{name} = {value!r} is not within {least} and {most}; {fallback} is taken", stacklevel=2)
                value = fallback
        default = known[name].default
        if isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        elif isinstance(default, int) and not isinstance(default, bool) and isinstance(value, float):
            value = int(value)
        out[name] = value
    return Params(**out)


def read_params(spark: SparkSession, path: str) -> Params:
    """Of a CSV with a header: column 0 the name, column 1 the value. A few dozen rows."""
    rows = spark.read.csv(path, header=True).collect()
    return checked({r[0].strip(): typed(r[1]) for r in rows if r[0]})
