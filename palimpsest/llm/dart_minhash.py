"""DartMinHash: weighted minwise signatures from hashed darts (Christiani 2020), in numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ADD = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S11 = (np.uint64(s) for s in (30, 27, 31, 11))
#: Darts of a cell of area 1 are Poisson with mean 1: the cumulative chances of 0, 1, 2 ... darts.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 16)))))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = x + _ADD
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _S11).astype("float64") * 2.0**-53


def _darts(elements: np.ndarray, weights: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(rank, dart) of the darts in the regions [0, weight) x [low, high) of the elements.

    The plane of an element is cut into cells of area 1: weights [0, 1), [1, 2), [2, 4), [4, 8) ... by ranks as high as makes that area.
    What a cell holds depends on the element and the cell alone, so two sets agree where their regions do.
    """
    ranks, ids, v = [], [], 0
    while len(elements):
        base, width = (0.0, 1.0) if v == 0 else (2.0 ** (v - 1), 2.0 ** (v - 1))
        reach = weights > base
        elements, weights = elements[reach], weights[reach]
        if not len(elements):
            break
        height = 1.0 / width
        first, last = int(low / height), int(np.ceil(high / height))
        cells = np.arange(first, last, dtype="uint64")
        # Element by element, a block of cells at a time, so that memory stays bounded.
        step = max(1, (1 << 20) // max(1, len(elements)))
        for at in range(0, len(cells), step):
            some = cells[at : at + step]
            with np.errstate(over="ignore"):
                h = mix(mix(elements[:, None] + np.uint64(v) * _M2) ^ some[None, :]).ravel()
            n = np.searchsorted(_POISSON, _unit(h), side="right")
            has = np.flatnonzero(n)
            cell = np.repeat(has, n[has])
            k = np.arange(len(cell)) - np.repeat(np.cumsum(n[has]) - n[has], n[has])
            with np.errstate(over="ignore"):
                dart = mix(h[cell] + (k.astype("uint64") + np.uint64(1)) * _M1)
            w = base + width * _unit(mix(dart ^ _M1))
            r = (some[cell % len(some)].astype("float64") + _unit(mix(dart ^ _M2))) * height
            inside = (w < weights[cell // len(some)]) & (r < high) & (r >= low)
            ranks.append(r[inside])
            ids.append(dart[inside])
        v += 1
    return (np.concatenate(ranks), np.concatenate(ids)) if ranks else (np.empty(0), np.empty(0, "uint64"))


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k darts: of each coordinate, the one of least rank in the set's regions; two sets agree there with the chance of their weighted Jaccard similarity.

    Ranks are searched up to a bound that is expected to fill all coordinates, then beyond it while one is empty.
    ``elements``: distinct uint64; ``weights``: positive.
    """
    total = float(weights.sum())
    low, high = 0.0, (k * np.log(k) + 2 * k) / total
    out, best = np.zeros(k, "uint64"), np.full(k, np.inf)
    while True:
        r, d = _darts(elements, weights, low, high)
        j = (mix(d) % np.uint64(k)).astype("int64")
        order = np.argsort(-r, kind="stable")  # the least rank is written last
        new_best, new = np.full(k, np.inf), np.zeros(k, "uint64")
        new_best[j[order]], new[j[order]] = r[order], d[order]
        better = new_best < best
        best[better], out[better] = new_best[better], new[better]
        if np.isfinite(best).all():
            return out
        low, high = high, 2 * high
