"""Sequential operators without a SQL twin, against plain restatements over all rows at once: no islands, no bins."""

import itertools
import math

import duckdb
import numpy as np
import pytest

from peakloom.functions import chem
from peakloom.kernels import peaks as peak_kernel
from peakloom.operators import detection, islands
from peakloom.plans import registry
from peakloom.plans import views as V


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in ("events", "lineitem", "part", "embeddings"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def linked(con, tol, gap_tol):
    """(sample, scan ids, m/z, intensities) of all traces: every scan's peaks offered to every open trace."""
    rows = con.sql(f"with {V.PEAKS} select sample_id, scan_id, mz, intensity, rt from peaks order by all").fetchall()
    out, times = [], {}
    for sample, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        scans = sorted({r[1] for r in own})
        for r in own:
            times[sample, r[1]] = min(times.get((sample, r[1]), math.inf), r[4])
        at = {s: sorted((r[2], r[3]) for r in own if r[1] == s) for s in scans}
        alive, done = [], []
        for s in scans:
            free = dict(enumerate(at[s]))
            for t in alive:
                target = t["mz"][-1]
                below = [(k, m) for k, (m, _) in enumerate(at[s]) if m < target]
                above = [(k, m) for k, (m, _) in enumerate(at[s]) if m >= target]
                left = target - below[-1][1] if below else math.inf
                right = above[0][1] - target if above else math.inf
                k = None if left == right or min(left, right) >= tol else (below[-1][0] if left < right else above[0][0])
                hit = k is not None and k in free
                t["scans"].append(s)
                t["mz"].append(at[s][k][0] if hit else t["mz"][-1])
                t["y"].append(at[s][k][1] if hit else 0.0)
                t["gap"] = 0 if hit else t["gap"] + 1
                if hit:
                    del free[k]
            done += [t for t in alive if t["gap"] > gap_tol]
            alive = [t for t in alive if t["gap"] <= gap_tol] + [{"scans": [s], "mz": [m], "y": [i], "gap": 0} for m, i in free.values()]
            alive.sort(key=lambda t: -t["y"][-1])
        for t in done + alive:
            last = max(k for k, v in enumerate(t["y"]) if v > 0) + 1
            out.append((sample, t["scans"][:last], t["mz"][:last], t["y"][:last]))
    return out, times


def test_roi_link(spark, sf, con):
    expected = sorted((s, scans[0], scans[-1], mz[0], len(y), max(y)) for s, scans, mz, y in linked(con, 0.05, 10)[0])
    found = sorted((r.sample_id, r.first_scan, r.last_scan, r.first_mz, r.n_scans, r.highest) for r in registry.QUERIES["roi_link"](spark, sf).collect())
    assert found == expected and any(r[4] > 2 for r in found)


def test_segment(spark, sf, con):
    expected = []
    traces, times = linked(con, 0.05, 10)
    for sample, scans, mz, y in traces:
        parts = [peak_kernel.Trace(list(scans), list(mz), list(y))]
        for _ in range(2):
            parts = [p for t in parts for p in peak_kernel.split(t)]
        for p in parts:
            k, x = int(np.argmax(p.intensity)), np.array([times[sample, s] for s in p.scans])
            expected.append((sample, p.scans[k], p.mz[k], x[k], x[0], x[-1], sum(v > 0 for v in p.intensity), int(max(p.intensity)), peak_kernel.area(x, p.intensity), peak_kernel.top_average(np.array(p.intensity)), peak_kernel.noise_score(p.intensity), peak_kernel.gaussian_similarity(x, p.intensity)))
    rows = registry.QUERIES["segment"](spark, sf).collect()
    found = [(r.sample_id, r.scan_id, r.mz, r.rt, r.rt_start, r.rt_end, r.total_scans, r.peak_height, r.peak_area, r.top_average, r.noise_score, r.gaussian_similarity) for r in rows]
    assert len(found) == len(expected)
    for a, b in zip(sorted(found), sorted(expected), strict=True):
        assert a[:8] == b[:8] and abs(a[8] - b[8]) < 1.001 and abs(a[9] - b[9]) < 1.001 and a[10:] == pytest.approx(b[10:], abs=1e-9)
    assert len({(r.sample_id, r.feature_id) for r in rows}) == len(rows)


@pytest.mark.parametrize("island, call", [(20_000, 5000), (3, 2)])
def test_align(spark, sf, con, monkeypatch, island, call):
    monkeypatch.setattr(detection, "ISLAND_ROWS", island)
    monkeypatch.setattr(detection, "CALL_ROWS", call)
    monkeypatch.setattr(detection, "FEW_ROWS", island)
    rows = con.sql(f"with {V.FEATURES} select sample_id, fid, mz, rt, peak_height, 1 - noise_score, noise_score, part % 10 = 0 from features").fetchall()
    features = []
    for sample in range(20):
        own = sorted((r for r in rows if r[0] == sample), key=lambda r: (-r[4], r[1]))
        mz, rt, free = np.array([r[2] for r in own]), np.array([r[3] for r in own]), np.ones(len(own), bool)
        for f in features:
            near = np.flatnonzero(free & (np.abs(mz - f["mz"]) < 0.01) & (np.abs(rt - f["rt"]) < 0.5)) if own else []
            if len(near):
                k = min(near, key=lambda k: (abs(rt[k] - f["rt"]), abs(mz[k] - f["mz"]), k))
                free[k] = False
                f["members"].append(own[k])
                f["mz"] = float(np.median([m[2] for m in f["members"]]))
                f["ms2"] |= own[k][7]
                if own[k][4] > f["highest"]:
                    f |= {"highest": own[k][4], "rt": own[k][3], "reference": sample, "good": own[k][5] > 0.7 and own[k][6] < 2.0}
        features += [{"members": [r], "mz": r[2], "rt": r[3], "highest": r[4], "reference": sample, "ms2": r[7], "good": r[5] > 0.7 and r[6] < 2.0} for r, unused in zip(own, free, strict=True) if unused]
        features = [f for f in features if f["ms2"] or f["good"] or len(f["members"]) > 1 or f["highest"] >= 10_000]
        features.sort(key=lambda f: -f["highest"])
    expected = sorted((tuple(sorted(m[1] for m in f["members"])), round(f["mz"], 9), f["rt"], f["reference"], f["highest"]) for f in features if f["ms2"] or f["good"])
    by_id = {}
    for r in registry.QUERIES["align"](spark, sf).collect():
        by_id.setdefault(r.feature_id, []).append(r)
    found = sorted((tuple(sorted(r.fid for r in own)), round(own[0].consensus_mz, 9), own[0].consensus_rt, own[0].reference, own[0].highest) for own in by_id.values())
    assert found == expected and any(len(f[0]) > 1 for f in found)


def test_boxes(spark):
    """A field without a gap on either axis falls into boxes that keep their distance, as many as joining by hand gives."""
    rng = np.random.default_rng(4)
    points = [(float(x), float(y)) for x, y in zip(rng.uniform(0, 10, 400), rng.uniform(0, 10, 400), strict=True)]
    df = spark.createDataFrame(points, "x double, y double").selectExpr("0 as k", "*")
    own = {}
    for r in islands.boxes(df, "x", 0.05, "y", 0.2, ["k"]).collect():
        own.setdefault(r.box, []).append((r.x, r.y))
    assert sorted(p for ps in own.values() for p in ps) == sorted(points)
    bounds = [(min(x for x, _ in ps), max(x for x, _ in ps), min(y for _, y in ps), max(y for _, y in ps)) for ps in own.values()]
    for a, b in itertools.combinations(bounds, 2):
        assert a[0] >= b[1] + 0.05 or b[0] >= a[1] + 0.05 or a[2] >= b[3] + 0.2 or b[2] >= a[3] + 0.2
    assert len(own) > 150 and len(islands.boxes(df, "x", 5.0, "y", 5.0, ["k"]).select("box").distinct().collect()) == 1


def test_group(spark, sf, con):
    rows = con.sql(f"with {V.FEATURES} select sample_id, fid, mz, rt, peak_height from features").fetchall()
    hydrogen, listed = 1.00782503227, [a for a in chem.POSITIVE if a[4] and a[0] != "[M+H]+"]
    expected = []
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[4], r[1])), key=lambda r: r[0]):
        own = list(own)
        mz, rt, height = (np.array([r[c] for r in own]) for c in (2, 3, 4))
        group, state = np.zeros(len(own), int), {}
        fids = np.array([r[1] for r in own])
        for seed in range(len(own)):
            if group[seed]:
                continue
            number = group.max() + 1
            frozen = (group == 0) & (np.abs(rt - rt[seed]) < 0.05)
            frozen[seed] = False
            group[seed], state[seed] = number, ("[M+H]+", False, 0, None)
            ions = [(f"M+{i}", mz[seed] + 1 + (i - 1) * 1.003355) for i in (1, 2, 3)]
            ions += [(name, ((mz[seed] - hydrogen) * times + shift) / charge) for name, shift, charge, times, _, _ in listed]
            for key, at in ions:
                hits = np.flatnonzero(frozen & (np.abs(mz - at) < 0.01))
                if key.startswith("M+"):
                    for k in hits:
                        group[k], state[k] = number, ("[M+H]+", True, int(key[2:]), state.get(k, (0, 0, 0, None))[3])
                elif len(hits):
                    k = min(hits, key=lambda k: (abs(rt[k] - rt[seed]), fids[k]))
                    old = state.get(k, (None, False, 0, None))
                    group[k], state[k] = number, (key, old[1], old[2], 1.0)
                    for i in (1, 2, 3):
                        for j in np.flatnonzero((group == 0) & (np.abs(rt - rt[seed]) < 0.05) & (np.abs(mz - (mz[k] + 1 + (i - 1) * 1.003355)) < 0.01) & (height < 1.5 * height[k])):
                            group[j], state[j] = number, (key, True, i, None)
        for k, r in enumerate(own):
            expected.append((r[0], r[1], min(x for x, g in zip(fids, group, strict=True) if g == group[k]), *state[k]))
    found, least = registry.QUERIES["group"](spark, sf).collect(), {}
    for r in found:
        least[r.sample_id, r.group_id] = min(least.get((r.sample_id, r.group_id), r.fid), r.fid)
    own = sorted((r.sample_id, r.fid, least[r.sample_id, r.group_id], r.adduct, r.is_isotope, r.isotope_state, r.scan_scan_cor) for r in found)
    assert [x[:6] for x in own] == sorted(x[:6] for x in expected) and sum(x[1] != x[2] for x in own) > 0


def test_isotope_distribution(spark, sf):
    """Shares of all combinations of heavy atoms, binomial by binomial, without any pruning of rare ones."""
    found = {}
    for r in registry.QUERIES["isotope_distribution"](spark, sf).collect():
        found.setdefault(r.formula, []).append((r.mz, r.share))
    heavy = {"C": [(0.0107, 1.0033548378)], "H": [(0.000115, 1.00627674573)], "N": [(0.00364, 0.9970348934)], "O": [(0.00038, 1.00421708), (0.00205, 2.00424638)]}
    for formula, peaks in found.items():
        counts = chem.parse(formula)
        counts["H"] += 1
        base = sum(chem.ISOTOPES[e][0][0] * n for e, n in counts.items()) - 0.00054857990946
        combos = [(0.0, 1.0)]
        for e, n in counts.items():
            own = []
            for picks in itertools.product(*[range(min(n, 7) + 1) for _ in heavy[e]]):
                light = n - sum(picks)
                if light >= 0:
                    ways, share = math.factorial(n) // math.factorial(light) // math.prod(map(math.factorial, picks)), (1 - sum(p for p, _ in heavy[e])) ** light
                    own.append((sum(k * d for k, (_, d) in zip(picks, heavy[e], strict=True)), ways * share * math.prod(p**k for k, (p, _) in zip(picks, heavy[e], strict=True))))
            combos = [(a + b, p * q) for a, p in combos for b, q in own if p * q > 1e-9]
        nominal = {}
        for d, p in combos:
            nominal[round(d)] = nominal.get(round(d), 0) + p
        own = {}
        for mz, share in peaks:
            own[round(mz - base)] = own.get(round(mz - base), 0) + share
        assert abs(min(mz for mz, _ in peaks) - base) < 2e-4 and sum(own.values()) > 0.9998
        assert all(abs(own[k] - nominal[k]) < 2e-4 for k in own)


def test_rf_cv(spark, sf, con):
    rows = registry.QUERIES["rf_cv"](spark, sf).collect()
    n, labels = con.sql("select count(*), count(distinct label) from embeddings").fetchall()[0]
    assert [r.fold for r in rows] == [0, 1, 2, 3, 4] and sum(r.n for r in rows) == n
    assert sum(r.n * r.accuracy for r in rows) / n > 1.1 / labels
