"""Weights of places inside circles on a sphere: the sums of one tile's circles and places.

Places are put in strips of latitude and sorted by longitude there. In a strip, a circle holds one
interval of longitude for sure and touches no place beyond a wider one. The sure interval is a
difference of running sums, so it costs the same however many places it has; only places between the
two intervals are compared one by one, by chord length. Strips are thinner where places are denser.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

# executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EARTH_RADIUS_M = 6_371_000.0
#: Angle up to which intervals are told apart; wider circles compare every place.
WIDEST = 1.0
#: Relative slack of both intervals, and absolute slack in radians, far above rounding errors.
SLACK, LEAST_SLACK = 1e-6, 1e-9
#: Places compared one by one at a time.
CHUNK = 1 << 20


def _half_width(south: np.ndarray, lat: np.ndarray, angle: float) -> np.ndarray:
    """Half the longitudes of the circles around ``lat`` at another latitude; -1 where they do not reach it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        h = (math.sin(angle / 2) ** 2 - np.sin((south - lat) / 2) ** 2) / (np.cos(lat) * np.cos(south))
    return np.where(h >= 0, 2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))), -1.0)


def _intervals(lat: np.ndarray, south: np.ndarray, high: float, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Per circle half the longitudes that are inside all over the strip (-1: none), and inside anywhere in it."""
    if angle > WIDEST:
        return np.full(len(lat), -1.0), np.full(len(lat), np.pi)
    north = np.minimum(south + high + LEAST_SLACK * high, np.pi / 2)
    south = np.maximum(south - LEAST_SLACK * high, -np.pi / 2)
    # the width rises up to one latitude and falls after it
    inner = np.minimum(*[_half_width(x, lat, angle * (1 - SLACK)) for x in (south, north)]) * (1 - SLACK) - LEAST_SLACK
    wide = angle * (1 + SLACK) + LEAST_SLACK
    touch = np.arcsin(np.clip(np.sin(lat) / math.cos(wide), -1, 1))
    outer = np.max([_half_width(x, lat, wide) for x in (south, north, np.clip(touch, south, north))], 0)
    outer = np.where(outer < 0, -1.0, outer * (1 + SLACK) + LEAST_SLACK)
    whole = (outer >= np.pi) | (np.cos(lat) < 1e-12)
    outer = np.where(whole, np.pi, outer)
    # a ring that is closed outside but not inside is compared whole
    return np.where((inner < 0) | (whole & (inner < np.pi - 2 * SLACK * np.pi)), -1.0, np.where(whole, np.pi, inner)), outer


def _unit_vectors(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)


def counts(lat: np.ndarray, lon: np.ndarray, plat: np.ndarray, plon: np.ndarray, category: np.ndarray, weight: np.ndarray,
           radius_m: float, n_categories: int) -> np.ndarray:
    """(circle, category): sums of the weights of places within the radius; positions are in degrees."""
    found = np.zeros((len(lat), n_categories))
    if not len(lat) or not len(plat):
        return found.astype(np.int64)
    angle = radius_m / EARTH_RADIUS_M
    lat, plat = np.radians(lat), np.radians(plat)
    lon, plon = np.radians(np.mod(lon + 180.0, 360.0)), np.radians(np.mod(plon + 180.0, 360.0))
    here, there = _unit_vectors(lat, lon), _unit_vectors(plat, plon)
    bound = (2 * math.sin(radius_m / (2 * EARTH_RADIUS_M))) ** 2
    base, top = plat.min(), plat.max()
    spread = max(float(top - base), angle / 8) * max(float(np.ptp(plon)) * math.cos(min(abs(base), abs(top))), angle / 8)
    high = angle / min(64, max(2, round(0.36 * angle * math.sqrt(len(plat) / spread))))
    strip = np.floor((plat - base) / high).astype(np.int64)
    order = np.lexsort((plon, strip))
    # longitudes are below 8, so one sorted array serves all strips
    keys = strip[order] * 8.0 + plon[order]
    category, weight, there = category[order], weight[order], [x[order] for x in there]
    used = np.unique(category)
    sums = np.zeros((len(keys) + 1, len(used)), np.int64)
    for i, c in enumerate(used):
        np.cumsum(np.where(category == c, weight, 0), out=sums[1:, i])

    def compared(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Adds the places from begin to end that are near enough."""
        kept = end > begin
        row, begin, size = row[kept], begin[kept], (end - begin)[kept]
        while len(row):
            upto = np.cumsum(size)
            n = max(1, int(np.searchsorted(upto, CHUNK, "right")))
            r, b, s = row[:n], begin[:n], np.minimum(size[:n], CHUNK)
            of = np.repeat(np.arange(n), s)
            place = np.arange(len(of)) + np.repeat(b - (np.cumsum(s) - s), s)
            chord = sum((here[k][r][of] - there[k][place]) ** 2 for k in range(3))
            near = chord <= bound
            slots, at = np.unique(r, return_inverse=True)
            hits = np.bincount(at[of[near]] * n_categories + category[place[near]], weight[place[near]], len(slots) * n_categories)
            found[slots] += hits.reshape(-1, n_categories)
            if s[-1] < size[n - 1]:  # one circle with more places than a chunk goes on with the rest
                row, begin, size = row[n - 1:], np.concatenate([b[-1:] + s[-1], begin[n:]]), np.concatenate([size[n - 1:n] - s[-1], size[n:]])
            else:
                row, begin, size = row[n:], begin[n:], size[n:]

    reach = angle * (1 + SLACK) + LEAST_SLACK
    first = np.maximum(np.floor((lat - reach - base) / high), 0).astype(np.int64)
    last = np.minimum(np.floor((lat + reach - base) / high), strip.max()).astype(np.int64)
    for step in range(int((last - first).max()) + 1):
        rows = np.flatnonzero(first + step <= last)
        at = (first[rows] + step).astype(float)
        inner, outer = _intervals(lat[rows], base + at * high, high, angle)
        for turn in (0.0, 2 * np.pi, -2 * np.pi):
            middle = lon[rows] + turn
            touches = (outer >= np.pi) if turn == 0 else np.zeros(len(rows), bool)
            ring = outer >= np.pi
            touches |= ~ring & (outer >= 0) & (middle - outer < 2 * np.pi) & (middle + outer >= 0)
            if not touches.any():
                continue
            t, m, w, v, all_round = rows[touches], middle[touches], outer[touches], inner[touches], ring[touches]
            floor_ = at[touches] * 8.0

            def place_of(x: np.ndarray, side: str) -> np.ndarray:
                return np.searchsorted(keys, floor_ + np.clip(x, 0.0, 7.0), side)

            begin = place_of(np.where(all_round, 0.0, m - w), "left")
            end = place_of(np.where(all_round, 7.0, m + w), "right")
            sure = v >= 0
            low = np.where(sure, place_of(np.where(all_round, 0.0, m - v), "left"), begin)
            up = np.maximum(np.where(sure, place_of(np.where(all_round, 7.0, m + v), "right"), begin), low)
            found[np.ix_(t, used)] += sums[up] - sums[low]
            compared(np.concatenate([t, t]), np.concatenate([begin, up]), np.concatenate([low, end]))
    return found.astype(np.int64)


def counts_at(lat: np.ndarray, lon: np.ndarray, number: np.ndarray, plat: np.ndarray, plon: np.ndarray, category: np.ndarray, weight: np.ndarray,
              since: np.ndarray, until: np.ndarray, radius_m: float, n_categories: int) -> np.ndarray:
    """``counts`` of the places alive at each circle's snapshot: those begun before its number and not gone before it.

    Snapshots between which no place begins or ends have the same places and are counted at once.
    """
    found = np.zeros((len(lat), n_categories), np.int64)
    snapshots, of = np.unique(number, return_inverse=True)
    changes = np.unique(np.concatenate([since, until]))
    _, same, alike = np.unique(np.searchsorted(changes, snapshots, "left"), return_index=True, return_inverse=True)
    for i, n in enumerate(snapshots[same]):
        here, alive = alike[of] == i, (since < n) & (n <= until)
        found[here] = counts(lat[here], lon[here], plat[alive], plon[alive], category[alive], weight[alive], radius_m, n_categories)
    return found
