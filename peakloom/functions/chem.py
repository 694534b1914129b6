"""Formulas, masses and adducts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Electron mass, step between isotopes, monoisotopic masses.
ELECTRON = 0.00054857990946
ISOTOPE_STEP = 1.003355
MASSES = {
    "H": 1.00782503207,
    "D": 2.01410177812,
    "C": 12.0,
    "N": 14.0030740052,
    "O": 15.9949146221,
    "F": 18.998403163,
    "Na": 22.989769282,
    "Mg": 23.985041697,
    "P": 30.973761998,
    "S": 31.97207069,
    "Cl": 34.968852682,
    "K": 38.96370649,
    "Ca": 39.96259098,
    "Fe": 55.93493633,
    "Cu": 62.92959772,
    "Zn": 63.92914201,
    "Br": 78.9183376,
    "I": 126.904473,
    # of adducts and of elements that formulas may name beyond those
    "Li": 7.016003443,
    "Ag": 106.905092,
    "B": 11.0093054,
    "Si": 27.9769265325,
    "Se": 79.9165213,
}
#: Isotopes: (mass, share).
ISOTOPES = {
    "H": ((1.00782503207, 0.999885), (2.0141017778, 0.000115)), "C": ((12.0, 0.9893), (13.0033548378, 0.0107)), "N": ((14.0030740048, 0.99636), (15.0001088982, 0.00364)),
    "O": ((15.99491461956, 0.99757), (16.9991317, 0.00038), (17.999161, 0.00205)), "P": ((30.97376163, 1.0),), "S": ((31.972071, 0.9499), (32.97145876, 0.0075), (33.9678669, 0.0425), (35.96708076, 0.0001)),
    "F": ((18.99840322, 1.0),), "Cl": ((34.96885268, 0.7576), (36.96590259, 0.2424)), "Br": ((78.9183371, 0.5069), (80.9162906, 0.4931)), "I": ((126.904473, 1.0),),
    "Na": ((22.9897692809, 1.0),), "K": ((38.96370668, 0.932581), (39.96399848, 0.000117), (40.96182576, 0.067302)), "Si": ((27.9769265325, 0.92223), (28.9764947, 0.04685), (29.97377017, 0.03092)),
    "Li": ((6.015122795, 0.0759), (7.01600455, 0.9241)),
}
_TOKEN = re.compile(r"([A-Z][a-z]*)(\d*)")
_GROUP = re.compile(r"\(([^()]*)\)(\d*)")


def parse(formula: str) -> dict[str, int]:
    """Element counts; groups in parentheses may be nested and repeated."""
    while m := _GROUP.search(formula):
        inner, times = Counter(), int(m[2] or 1)
        for e, n in _TOKEN.findall(m[1]):
            inner[e] += int(n or 1) * times
        formula = formula[: m.start()] + "".join(f"{e}{n}" for e, n in inner.items()) + formula[m.end() :]
    out: Counter = Counter()
    for e, n in _TOKEN.findall(formula):
        out[e] += int(n or 1)
    return dict(out)


# Name, mass shift, charge, molecules, considered when ions are enumerated, change of the formula.
POSITIVE = (
    ("[M+H]+", 1.00782503227, 1, 1, True, {"H": 1}),
    ("[M+NH4]+", 18.03437413328, 1, 1, True, {"N": 1, "H": 4}),
    ("[M]+", 0.0, 1, 1, False, {}),
    ("[M+H+CH3OH]+", 33.03403978155, 1, 1, False, {"C": 1, "H": 5, "O": 1}),
    ("[M+Na]+", 22.989769282, 1, 1, True, {"Na": 1}),
    ("[M+K]+", 38.963706493, 1, 1, True, {"K": 1}),
    ("[M+H+CH3CN]+", 42.033826, 1, 1, False, {"C": 2, "H": 4, "N": 1}),
    ("[M-H+2Na]+", 44.971165, 1, 1, False, {"Na": 2, "H": -1}),
    ("[M+H-H2O]+", -17.00273965247, 1, 1, True, {"H": -1, "O": -1}),
    ("[M+H+CH3COOH]+", 61.02895440175, 1, 1, True, {"C": 2, "H": 5, "O": 2}),
    ("[M+H+HCOOH]+", 47.01330433721, 1, 1, True, {"C": 1, "H": 3, "O": 2}),
    ("[2M+H]+", 1.00782503227, 1, 2, True, {"H": 1}),
    ("[2M+NH4]+", 18.03437413328, 1, 2, False, {"N": 1, "H": 4}),
    ("[2M+Na]+", 22.989769282, 1, 2, False, {"Na": 1}),
    ("[2M+H-H2O]+", -17.00273965247, 1, 2, False, {"H": -1, "O": -1}),
    ("[3M+H]+", 1.00782503227, 1, 3, True, {"H": 1}),
    ("[3M+H-H2O]+", -17.00273965247, 1, 3, False, {"H": -1, "O": -1}),
    ("[M+2H]2+", 2.01565006454, 2, 1, True, {"H": 2}),
    ("[M+3H]3+", 3.02347509681, 3, 1, True, {"H": 3}),
    ("[M+Li]+", 7.016003443, 1, 1, False, {"Li": 1}),
    ("[M+Ag]+", 106.905092, 1, 1, False, {"Ag": 1}),
    ("[M+Ca]2+", 39.96259092, 2, 1, False, {"Ca": 1}),
    ("[M+Fe]2+", 55.9349363, 2, 1, False, {"Fe": 1}),
)
NEGATIVE = (
    ("[M-H]-", -1.00782503227, -1, 1, True, {"H": -1}),
    ("[M+Cl]-", 34.96885273, -1, 1, True, {"Cl": 1}),
    ("[M+HCOO]-", 44.99765427267, -1, 1, True, {"C": 1, "H": 1, "O": 2}),
    ("[M+CH3COO]-", 59.01330433721, -1, 1, True, {"C": 2, "H": 3, "O": 2}),
    ("[M-H-H2O]-", -19.01838971701, -1, 1, True, {"H": -3, "O": -1}),
    ("[2M-H]-", -1.00782503227, -1, 2, True, {"H": -1}),
    ("[3M-H]-", -1.00782503227, -1, 3, True, {"H": -1}),
    ("[M-2H]2-", -2.01565006454, -2, 1, True, {"H": -2}),
    ("[M-3H]3-", -3.02347509681, -3, 1, True, {"H": -3}),
    ("[2M+Cl]-", 34.96885273, -1, 2, False, {"Cl": 1}),
    ("[2M+HCOO]-", 44.99765427267, -1, 2, False, {"C": 1, "H": 1, "O": 2}),
    ("[2M+CH3COO]-", 59.01330433721, -1, 2, False, {"C": 2, "H": 3, "O": 2}),
    ("[2M-H-H2O]-", -19.01838971701, -1, 2, False, {"H": -3, "O": -1}),
)
#: (name, polarity, mass shift, charge, molecules, considered, change)
ADDUCTS = [(name, polarity, *rest) for polarity, table in (("positive", POSITIVE), ("negative", NEGATIVE)) for name, *rest in table]
BY_NAME = {a[0]: a for a in ADDUCTS}


def adducts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADDUCTS, "adduct string, polarity string, mass_shift double, charge int, mult int, considered boolean, modification map<string,int>")


def mass(formula: str) -> float:
    return sum(MASSES[e] * n for e, n in parse(formula).items())


def change_mass(adduct: str) -> float:
    """Mass of the atoms that an adduct adds."""
    return float(sum(MASSES[e] * n for e, n in BY_NAME[adduct][6].items()))


def with_adduct(formula: str, adduct: str) -> dict[str, int]:
    _, _, _, _, times, _, change = BY_NAME[adduct]
    out = Counter({e: n * times for e, n in parse(formula).items()})
    for e, n in change.items():
        out[e] += n
    return {e: n for e, n in out.items() if n}


def formula_to_mz(formula: str, adduct: str) -> float:
    """(mass - charge * electron mass) / |charge| of the lightest-isotope ion."""
    charge = BY_NAME[adduct][3]
    return (sum(MASSES[e] * n for e, n in with_adduct(formula, adduct).items()) - charge * ELECTRON) / abs(charge)


def isotope_distribution(formula: str, adduct: str, prob: float = 0.9999, tol: float = 0.005) -> list[tuple[float, float]]:
    """(m/z, share) of the ion's isotopologues that together reach ``prob``, those closer than ``tol`` joined."""
    charge = BY_NAME[adduct][3]
    masses, shares = np.zeros(1), np.ones(1)
    for e, n in with_adduct(formula, adduct).items():
        own = ISOTOPES.get(e, ((MASSES[e], 1.0),))
        for _ in range(n):
            m = np.add.outer(masses, [a for a, _ in own]).ravel()
            p = np.multiply.outer(shares, [b for _, b in own]).ravel()
            key, inverse = np.unique(np.round(m, 4), return_inverse=True)
            shares = np.bincount(inverse, p)
            masses = np.bincount(inverse, p * m) / shares
            keep = shares > 1e-9
            masses, shares = masses[keep], shares[keep]
    order = np.argsort(-shares)
    masses, shares = masses[order], shares[order]
    n = int(np.searchsorted(np.cumsum(shares), prob * shares.sum())) + 1
    mz, shares = (masses[:n] - charge * ELECTRON) / abs(charge), shares[:n]
    order = np.argsort(mz)
    mz, shares = mz[order], shares[order]
    group = np.cumsum(np.concatenate([[0], np.diff(mz) >= tol]))
    total = np.bincount(group, shares)
    return list(zip((np.bincount(group, mz * shares) / total).tolist(), total.tolist(), strict=True))


def parse_column(formula: Column) -> Column:
    """Element counts of formulas without parentheses, as a map."""
    tokens = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]*)(\d*)"), F.lit(0))
    element = lambda t: F.regexp_extract(t, r"([A-Z][a-z]*)", 1)
    count = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    names = F.array_distinct(F.transform(tokens, element))
    return F.map_from_entries(F.transform(names, lambda e: F.struct(e, F.aggregate(tokens, F.lit(0), lambda a, t: a + F.when(element(t) == e, count(t)).otherwise(0)))))


def mass_column(counts: Column) -> Column:
    """Monoisotopic mass of a map of counts; null where an element is unknown."""
    known = F.create_map(*[F.lit(x) for e, m in MASSES.items() for x in (e, m)])
    entries = F.array_sort(F.map_entries(counts))
    return F.aggregate(entries, F.lit(0.0), lambda a, e: a + F.try_element_at(known, e["key"]) * e["value"])


def bin_isotopes(rows: DataFrame, keys: list[str], mass: str, abundance: str, width: float) -> DataFrame:
    """Per key and bin (floor of mass over ``width``) the abundance-weighted mass and the abundance."""
    m, a = F.col(mass), F.col(abundance)
    binned = rows.groupBy(*keys, F.floor(m / width).cast("long").alias("bin"))
    return binned.agg((F.sum(m * a) / F.sum(a)).alias("mass"), F.sum(a).alias("abundance"))
