"""Entropy similarity of blocks of spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Matched peaks that are held at once; few, so that they stay in the cache.
CHUNK = 100_000


class Spectra:
    """Spectra with the columns ``ids``, ``sizes`` (peaks of each) and, one after the other, ``mz`` and ``i``."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, mz: np.ndarray, i: np.ndarray):
        self.ids, self.mz, self.i = ids, mz, i
        self.owner = np.repeat(np.arange(len(ids)), sizes)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.where(x > 0, x, 1.0))


def meetings(at: np.ndarray, ordered: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``at``, in the sorted ``ordered``) of all pairs closer than ``tol``."""
    wide = tol * (1 + 1e-6)  # a difference is rounded otherwise than the bound of a search
    low, high = np.searchsorted(ordered, at - wide), np.searchsorted(ordered, at + wide, side="right")
    n = high - low
    a = np.repeat(np.arange(len(at)), n)
    b = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
    keep = np.abs(at[a] - ordered[b]) < tol
    return (a, b) if keep.all() else (a[keep], b[keep])


def similar(left: Spectra, right: Spectra, tol: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some spectra of ``left`` after the other: the number of the first, and tables (spectrum, all of ``right``) of
    the similarity and the number of matched peaks."""
    order = np.argsort(right.mz, kind="stable")
    mz, i, owner = right.mz[order], right.i[order], right.owner[order]
    own, other = entropy(left.i), entropy(i)
    wide, n = tol * (1 + 1e-6), len(right.ids)
    met = np.searchsorted(mz, left.mz + wide, side="right") - np.searchsorted(mz, left.mz - wide)
    load = np.concatenate([[0], np.cumsum(met)])[left.starts]
    begin = 0
    while begin < len(left.ids):
        end = max(begin + 1, min(int(np.searchsorted(load, load[begin] + CHUNK, side="right")) - 1, begin + max(1, CHUNK // max(n, 1))))
        span = slice(left.starts[begin], left.starts[end])
        a, b = meetings(left.mz[span], mz, tol)
        x = left.i[span][a] + i[b]
        cell = (left.owner[span][a] - begin) * n + owner[b]
        value = np.bincount(cell, weights=x * np.log2(np.where(x > 0, x, 1.0)) - own[span][a] - other[b], minlength=(end - begin) * n)
        yield begin, value.reshape(-1, n), np.bincount(cell, minlength=(end - begin) * n).reshape(-1, n)
        begin = end
