"""Golden values by hand, and the split into islands against the whole."""

import numpy as np
import pytest

from peakloom.functions import chem
from peakloom.kernels import align, peaks
from peakloom.operators import statistics


def test_scores():
    assert peaks.noise_score(np.array([1, 2, 3, 2, 1])) == 0
    assert peaks.noise_score(np.array([1, 3, 1, 3, 1])) == pytest.approx(2 / 3)
    assert peaks.noise_score(np.array([1, 2, 2, 1])) == 0
    assert peaks.asymmetry(np.array([0, 5, 10, 5, 0])) == 1
    assert peaks.asymmetry(np.array([1, 2, 2, 1])) is None
    assert peaks.asymmetry(np.array([10, 5, 5, 5, 0])) == 99
    assert peaks.gaussian_similarity(np.arange(4), np.arange(4)) == 0
    assert peaks.area(np.array([0, 1, 2]), np.array([0, 100, 0])) == 6000
    assert peaks.top_average(np.array([1, 5, 3, 4])) == 4
    assert peaks.trim(np.array([0, 0, 3, 0, 1, 0])) == (2, 5) and peaks.trim(np.zeros(3)) == (0, 0)


def test_nearest_is_none_between_two():
    values = np.array([1.0, 2.0])
    assert peaks.nearest_within(values, 1.5, 1) is None
    assert peaks.nearest_within(values, 1.4, 1) == 0
    assert peaks.nearest_within(values, 3.0, 1) is None


def test_two_peaks_are_split():
    x = np.arange(40)
    y = 1000 * np.exp(-0.5 * ((x - 10) / 2.5) ** 2) + 800 * np.exp(-0.5 * ((x - 28) / 2.5) ** 2)
    assert list(peaks.chromatographic_peaks(y)) == [10, 28]
    parts = peaks.split(peaks.Trace(list(range(40)), [100.0] * 40, y.tolist()))
    assert len(parts) == 2 and parts[0].scans[-1] == parts[1].scans[0]


def whole_link(scans, n, tol, gap):
    return sorted((t.scans[0], tuple(np.round(t.mz, 9)), tuple(t.intensity)) for t in map(peaks.trimmed, peaks.link(scans, n, tol, gap)) if t)


@pytest.mark.parametrize("seed", range(8))
def test_islands_give_the_same_traces(seed):
    rng = np.random.default_rng(seed)
    n, tol = 25, 0.01
    scans = {i: np.sort(np.round(rng.choice(100, 12) + rng.normal(0, 0.006, 12), 6)) for i in range(n)}
    high = {i: rng.integers(1, 10**6, 12).astype(float) for i in scans}
    every = np.sort(np.concatenate(list(scans.values())))
    cuts = (every[1:] + every[:-1])[np.diff(every) >= tol] / 2
    split = []
    for a, b in zip([-np.inf, *cuts], [*cuts, np.inf], strict=True):
        own = {i: (m[(m > a) & (m < b)], high[i][(m > a) & (m < b)]) for i, m in scans.items() if ((m > a) & (m < b)).any()}
        split += whole_link(own, n, tol, 3)
    assert sorted(split) == whole_link({i: (scans[i], high[i]) for i in scans}, n, tol, 3)


@pytest.mark.parametrize("seed", range(6))
def test_islands_give_the_same_alignment(seed):
    rng = np.random.default_rng(seed)
    files = []
    for s in range(4):
        n = 40
        files.append((s, {"fid": np.arange(n) + 1000 * s, "mz": rng.choice(60, n) + rng.normal(0, 0.006, n), "rt": rng.uniform(0, 1, n), "height": rng.permutation(10**5)[:n].astype(float) + s / 10, "gaussian": rng.uniform(0.5, 1, n), "noise": rng.uniform(0, 3, n), "has_ms2": rng.random(n) < 0.2}))
    every = np.sort(np.concatenate([f["mz"] for _, f in files]))
    cuts = (every[1:] + every[:-1])[np.diff(every) >= 0.01] / 2
    key = lambda found: sorted(tuple(sorted(m[1] for m in f["members"])) for f in found)
    split = []
    for a, b in zip([-np.inf, *cuts], [*cuts, np.inf], strict=True):
        own = [(s, {k: v[(f["mz"] > a) & (f["mz"] < b)] for k, v in f.items()}) for s, f in files]
        split += align.align(own)
    assert key(split) == key(align.align(files))


def test_knots():
    own = np.array([5.0, 2.0, 5.05, 6.0, 7.0, 8.0])
    assert [k[0] for k in align.rt_knots(own + 0.1, own)] == [0.0, 5.0, 6.0, 7.0, 8.0]
    assert align.rt_knots(own[:4], own[:4]) == []
    assert align.warp(np.array([4.0]), [(0.0, 0.0), (5.0, 6.0)])[0] == pytest.approx(4.8)


def test_lowess_of_a_line_is_the_line():
    x = np.arange(20.0)
    assert align.lowess(x, 3 * x + 1, 0.5) == pytest.approx(3 * x + 1)
    values = 1000 + 50 * x
    assert np.ptp(align.drift_corrected(values, np.arange(20) % 3 == 0)[:19]) < 1
    assert (align.drift_corrected(values, np.arange(20) < 2) == values).all()


def test_group():
    rows = {"fid": np.arange(4), "mz": np.array([181.0707, 182.07405, 203.0526, 300.0]), "rt": np.array([1.0, 1.0, 1.01, 1.0]), "height": np.array([1e6, 1e5, 2e5, 5e5])}
    ions = lambda k: [("M+1", rows["mz"][k] + 1), ("[M+Na]+", rows["mz"][k] + 21.98194)]
    found = align.group_ions(rows, ions, lambda a, b: 1.0)
    assert [f["group_id"] for f in found] == [1, 1, 1, 2]
    assert found[1]["is_isotope"] and found[2]["adduct"] == "[M+Na]+"


def test_chemistry():
    assert chem.parse("C2(CH2)3") == {"C": 5, "H": 6}
    assert chem.formula_to_mz("C6H12O6", "[M+H]+") == pytest.approx(181.070665, abs=1e-6)
    assert sum(p for _, p in chem.isotope_distribution("C6H12O6", "[M+H]+")) > 0.999
    assert len([a for a in chem.ADDUCTS if a[1] == "positive"]) == 23 and len([a for a in chem.ADDUCTS if a[1] == "negative"]) == 13


def test_incomplete_beta():
    assert statistics.incomplete_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)
    assert statistics.incomplete_beta(0.5, 0.5, np.array([0.0, 1.0])) == pytest.approx([0, 1])
    t, df = 2.0, 10.0
    assert statistics.incomplete_beta(df / 2, 0.5, df / (df + t * t)) == pytest.approx(0.07338803)


@pytest.mark.parametrize("block, together", [(1024, 512), (2, 3)])
def test_components_and_neighbours_count_missing_cells(spark, monkeypatch, block, together):
    from peakloom.operators import learning, statistics

    monkeypatch.setattr(learning, "BLOCK", block)
    monkeypatch.setattr(learning, "TOGETHER", together)
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((40, 6)) < 0.3, 0.0, rng.lognormal(5, 1, (40, 6)))
    dense[0] = 7.0  # constant
    rows = [(i, j, float(dense[i, j])) for i in range(40) for j in range(6) if dense[i, j] > 0]
    scaled = statistics.impute_scale(spark.createDataFrame(rows, "feature_id long, sample_id long, intensity double"), 6, relative=True)
    full = np.log10(np.where(dense > 0, dense, 0.2 * np.where(dense > 0, dense, np.inf).min(axis=1, keepdims=True)))
    z = (full - full.mean(axis=1, keepdims=True)) / np.where(full.std(axis=1, keepdims=True) < 1e-9, 1, full.std(axis=1, keepdims=True))
    _, s, vt = np.linalg.svd(z - z.mean(axis=1, keepdims=True), full_matrices=False)
    found = learning.sample_components(scaled).orderBy("sample_id").collect()
    assert np.allclose(np.abs([r.pc1 for r in found]), np.abs(vt[0] * s[0]), atol=1e-6) and np.allclose(np.abs([r.pc2 for r in found]), np.abs(vt[1] * s[1]), atol=1e-6)
    for r in learning.neighbours(scaled, 5).collect():
        assert np.isclose(r.distance, np.linalg.norm(z[:, r.sample_id] - z[:, r.other_id]))


def test_drift_correction_decides_as_its_twin():
    import duckdb

    from peakloom.plans import registry

    # all but exact fits: the last bits of residuals decide which point counts
    rng, samples = np.random.default_rng(5), (0, 5, 10, 15, 3)
    heights = [[102, 624, 924, 234, 60], [1440, 5040, 8940, 2760, 60], *(rng.integers(1, 16000, (300, 5)) / 100).tolist()]
    con = duckdb.connect()
    con.sql("create table lineitem (l_partkey bigint, l_suppkey bigint, l_quantity double)")
    con.executemany("insert into lineitem values (?, ?, ?)", [(p, s, v) for p, row in enumerate(heights) for s, v in zip(samples, row, strict=True)])
    twin = sorted(con.sql(f"select feature_id, sample_id, intensity from ({registry.ORACLE_SQL['lowess']})").fetchall())
    own = []
    for p, row in enumerate(heights):
        values = np.zeros(20)
        values[list(samples)] = row
        own += [(p, s, int(v)) for s, v in enumerate(np.trunc(np.round(align.drift_corrected(values, np.arange(20) % 5 == 0), 6))) if int(v)]
    assert own == twin
