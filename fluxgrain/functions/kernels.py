"""Numpy kernels for recursive and sequential steps, used by grouped-map operators. Written from the formulas, no SciPy."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from fluxgrain.functions.columns import MAD_FACTOR, butter2


def fill_gaps(x: np.ndarray) -> np.ndarray:
    """Non-finite samples by linear interpolation over the index, ends held."""
    x = np.asarray(x, float)
    good = np.isfinite(x)
    if good.all() or not good.any():
        return np.where(good, x, 0.0)
    return np.interp(np.arange(len(x)), np.flatnonzero(good), x[good])


def percentile_filter(x: np.ndarray, size: int, p: float, mode: str = "nearest") -> np.ndarray:
    """Rank filter: the element of rank int(size * p / 100) of each centred window. mode: how ends are padded (nearest, reflect)."""
    half = size // 2
    padded = np.pad(x, (half, size - 1 - half), "edge" if mode == "nearest" else "symmetric")
    rank = min(size - 1, int(size * p / 100))
    out = np.empty(len(x))
    step = max(1, (1 << 22) // size)
    view = np.lib.stride_tricks.sliding_window_view(padded, size)
    for i in range(0, len(x), step):
        out[i : i + step] = np.partition(view[i : i + step], rank, axis=1)[:, rank]
    return out


def dff_rolling(f: np.ndarray, fps: float, window_s: float = 45.0, p: float = 10.0) -> np.ndarray:
    """(F - F0) over one scalar: the 1st percentile of the rolling baseline F0."""
    f = fill_gaps(f)
    n = len(f)
    size = max(3, int(window_s * fps) | 1)
    size = min(size, n if n % 2 else n - 1)
    f0 = percentile_filter(f, size, p) if size >= 3 else np.full(n, np.percentile(f, p))
    return (f - f0) / max(np.percentile(f0, 1), 1e-9)


def dff_first(f: np.ndarray, fps: float, minutes: float = 1.0, p: float = 10.0) -> np.ndarray:
    f = fill_gaps(f)
    f0 = max(np.percentile(f[: max(1, round(minutes * 60 * fps))], p), 1e-9)
    return (f - f0) / f0


def lowpass(x: np.ndarray, cutoff: float, fs: float, init: str = "first") -> np.ndarray:
    """Causal second-order low-pass. init: first (state = first sample), pad64 (zero state, 64 repeats of it in front), zero."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return x.copy()
    b0, b1, b2, a1, a2 = butter2(cutoff, fs)
    pad = 64 if init == "pad64" else 0
    z0 = z1 = x[0] if init == "first" else 0.0
    out = []
    for v in np.concatenate([np.full(pad, x[0]), x]).tolist():
        y = b0 * v + z0
        z0, z1 = b1 * v - a1 * y + z1, b2 * v - a2 * y
        out.append(y)
    return np.array(out[pad:])


def savgol_derivative(x: np.ndarray, fps: float, window_ms: float = 333.0, poly: int = 3) -> np.ndarray:
    """First derivative of local polynomial fits; the ends use the fit of the first and last window."""
    x = np.asarray(x, float)
    n = len(x)
    size = max(3, int(window_ms / 1000 * fps) | 1)
    if size >= n:  # the largest odd window that fits
        size = n if n % 2 else n - 1
    if size < 3 or size <= poly:
        g = np.zeros(n)
        g[1:] = np.diff(x) * fps
        return g
    half = size // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, poly + 1, increasing=True))
    out = np.empty(n)
    out[half : n - half] = np.convolve(x, fit[1][::-1], "valid")
    powers = np.arange(1, poly + 1)
    for first, at in ((0, range(half)), (n - size, range(half + 1, size))):
        c = fit @ x[first : first + size]
        for i in at:
            out[first + i] = (powers * c[1:] * float(t[i]) ** (powers - 1)).sum()
    return out * fps


def gaussian_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of radius int(4 * sigma + 0.5) with the ends repeated."""
    if sigma <= 0:
        return np.asarray(x, float).copy()
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(x, float), r, "edge"), w / w.sum(), "valid")


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles of plateaus that are higher than both neighbours."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    edge = np.flatnonzero(np.diff(x) != 0)
    left, right = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(x) - 1]])
    inner = np.arange(1, len(left) - 1)
    top = (x[left[inner]] > x[left[inner] - 1]) & (x[right[inner]] > x[right[inner] + 1])
    return ((left[inner] + right[inner]) // 2)[top]


def prominence(x: np.ndarray, peak: int) -> tuple[float, int, int]:
    """Height over the higher of the two lowest points between the peak and higher ground, and these points."""
    i = low_left = peak
    while i >= 0 and x[i] <= x[peak]:
        if x[i] < x[low_left]:
            low_left = i
        i -= 1
    i = low_right = peak
    while i < len(x) and x[i] <= x[peak]:
        if x[i] < x[low_right]:
            low_right = i
        i += 1
    return float(x[peak] - max(x[low_left], x[low_right])), low_left, low_right


def width(x: np.ndarray, peak: int, prom: float, left: int, right: int, share: float = 0.5) -> tuple[float, float, float]:
    """Width at a share of the prominence, with its interpolated ends."""
    level = x[peak] - prom * share
    i = peak
    while left < i and x[i] > level:
        i -= 1
    a = float(i) + ((level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else 0.0)
    i = peak
    while i < right and x[i] > level:
        i += 1
    b = float(i) - ((level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else 0.0)
    return b - a, a, b


def find_peaks(x: np.ndarray, min_prominence: float = 0.0, min_width: float = 0.0, distance: int = 1, height: float | None = None) -> np.ndarray:
    """Plateau maxima, then the gates in this order: height, distance (tallest first), prominence, width at half prominence."""
    x = np.asarray(x, float)
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(peaks - peaks[i]) < distance
                near[i] = False
                keep[near] = False
        peaks = peaks[keep]
    out = []
    for p in peaks:
        prom, a, b = prominence(x, p)
        if prom >= min_prominence and width(x, p, prom, a, b)[0] >= min_width:
            out.append(p)
    return np.array(out, int)


def quiet_noise(density: np.ndarray, baseline: np.ndarray, quiet: float = 40.0) -> float:
    """MAD-based noise of the residuals up to their quiet-th percentile (of all, if those are fewer than 32)."""
    r = density - baseline
    calm = r[r <= np.percentile(r, quiet)]
    calm = calm if len(calm) >= 32 else r
    return MAD_FACTOR * (float(np.median(np.abs(calm - np.median(calm)))) + 1e-12)


@dataclass(frozen=True)
class EventParams:
    """Parameters of population-event detection; times in seconds, widths in bins."""

    bin_s: float = 0.05
    sigma_bins: float = 2.0
    per_roi: bool = True
    min_prominence: float = 0.007
    min_width_bins: float = 2.0
    min_distance_bins: float = 3.0
    baseline: str = "rolling"
    baseline_percentile: float = 5.0
    baseline_window_s: float = 30.0
    quiet_percentile: float = 40.0
    end_k: float = 2.0
    max_duration_s: float = 10.0
    merge_gap_s: float = 0.0
    gaussian: bool = True
    z: float = 2.3263478740408408  # the 0.99 quantile of the normal distribution
    fit_pad_s: float = 0.5
    min_sigma_s: float = 0.05


@dataclass
class Event:
    peak: int
    start: int
    end: int
    mu: float = field(default=float("nan"))
    sigma: float = field(default=float("nan"))


def baseline_of(density: np.ndarray, dt: float, p: EventParams) -> np.ndarray:
    n = len(density)
    size = max(3, round(p.baseline_window_s / dt) | 1)
    size = min(size, n if n % 2 else n - 1)
    if p.baseline == "global" or size < 3:
        return np.full(n, np.percentile(density, p.baseline_percentile))
    return percentile_filter(density, size, p.baseline_percentile, "reflect")


def walk(density: np.ndarray, peak: int, level: np.ndarray, direction: int, most: int) -> int:
    """The last index over the level from the peak in a direction, at most `most` steps away."""
    i = peak
    for _ in range(most):
        j = i + direction
        if not 0 <= j < len(density) or density[j] <= level[j]:
            break
        i = j
    return i


def bounded_events(time_s: np.ndarray, density: np.ndarray, peaks: Sequence[int], p: EventParams) -> list[dict]:
    """Events around peaks: walked boundaries, touching ones merged (the taller peak stays), refined by Gaussian moments."""
    dt = float(np.median(np.diff(time_s))) if len(time_s) > 1 else 1.0
    base = baseline_of(density, dt, p)
    level = base + p.end_k * quiet_noise(density, base, p.quiet_percentile)
    most, gap, pad = max(1, round(p.max_duration_s / dt)), max(0, round(p.merge_gap_s / dt)), max(0, round(p.fit_pad_s / dt))
    events: list[Event] = []
    for peak in sorted(map(int, peaks)):
        e = Event(peak, walk(density, peak, level, -1, most), walk(density, peak, level, 1, most))
        if events and e.start - events[-1].end <= gap:
            last = events[-1]
            last.start, last.end = min(last.start, e.start), max(last.end, e.end)
            if density[e.peak] > density[last.peak]:
                last.peak = e.peak
        else:
            events.append(e)
    out = []
    for e in events:
        t0, t1, tp = float(time_s[e.start]), float(time_s[e.end]), float(time_s[e.peak])
        start, end, left, right = t0, t1, "baseline", "baseline"
        if p.gaussian:
            lo, hi = max(0, e.start - pad), min(len(density) - 1, e.end + pad)
            t, w = time_s[lo : hi + 1], np.maximum(density[lo : hi + 1] - base[lo : hi + 1], 0)
            if hi > lo and w.sum() > 0:
                e.mu = float((t * w).sum() / w.sum())
                e.sigma = max(float(np.sqrt(((t - e.mu) ** 2 * w).sum() / w.sum())), p.min_sigma_s)
            else:
                e.mu, e.sigma = tp, p.min_sigma_s
            a, b = e.mu - p.z * e.sigma, e.mu + p.z * e.sigma
            left, right = ("gaussian" if a >= t0 else "baseline"), ("gaussian" if b <= t1 else "baseline")
            start, end = min(max(a, t0), tp), max(min(b, t1), tp)
        out.append(
            {"start_s": start, "peak_s": tp, "end_s": end, "peak_height": float(density[e.peak]), "prominence": float(density[e.peak] - level[e.peak]), "duration_s": end - start, "mu_s": e.mu, "sigma_s": e.sigma, "src_left": left, "src_right": right}
        )
    return out


def bin_edges(duration_s: float, bin_s: float) -> np.ndarray:
    edges = np.arange(0.0, duration_s + bin_s, bin_s)
    return np.append(edges, duration_s) if edges[-1] < duration_s else edges


def density(counts: np.ndarray, duration_s: float, n_rois: int, p: EventParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin centres, onsets a bin (per ROI if wanted), and their smoothed form, from the counts of the first bins."""
    edges = bin_edges(duration_s, p.bin_s)
    full = np.zeros(len(edges) - 1)
    full[: len(counts)] = counts[: len(full)]
    full /= n_rois if p.per_roi and n_rois else 1
    return (edges[:-1] + edges[1:]) / 2, full, gaussian_smooth(full, p.sigma_bins)


def population_events(counts: np.ndarray, duration_s: float, n_rois: int, p: EventParams) -> list[dict]:
    t, _, smooth = density(counts, duration_s, n_rois, p)
    return bounded_events(t, smooth, find_peaks(smooth, p.min_prominence, p.min_width_bins, max(1, round(p.min_distance_bins))), p)


def linkage(distance: np.ndarray, method: str = "average") -> np.ndarray:
    """Agglomerative merges (a, b, distance, size) of a square distance matrix; average or ward (on Euclidean distances)."""
    n = len(distance)
    d = {i: {j: float(distance[i, j]) for j in range(n) if j != i} for i in range(n)}
    size = dict.fromkeys(range(n), 1)
    heap = [(float(distance[i, j]), i, j) for i in range(n) for j in range(i + 1, n)]
    heapq.heapify(heap)
    merges = []
    while len(d) > 1:
        dist, a, b = heapq.heappop(heap)
        if a not in d or b not in d:
            continue
        new, total = n + len(merges), size[a] + size[b]
        row = {}
        for k in d:
            if k in (a, b):
                continue
            if method == "ward":
                s = total + size[k]
                row[k] = float(np.sqrt(max(0.0, ((size[a] + size[k]) * d[a][k] ** 2 + (size[b] + size[k]) * d[b][k] ** 2 - size[k] * dist**2) / s)))
            else:
                row[k] = (size[a] * d[a][k] + size[b] * d[b][k]) / total
        for gone in (a, b):
            for k in d.pop(gone):
                if k in d:
                    d[k].pop(gone, None)
        for k, v in row.items():
            d[k][new] = v
            heapq.heappush(heap, (v, k, new))
        d[new], size[new] = row, total
        merges.append((a, b, dist, total))
    return np.array(merges, float).reshape(-1, 4)


def vector_linkage(x: np.ndarray, method: str = "average", block: int = 64) -> np.ndarray:
    """The same merges from vectors, without their distances: average linkage of 1 - x_i . x_j, or ward linkage of |x_i - x_j|.

    Both are functions of the clusters' means and sizes, and neither lets a merge bring clusters nearer to a third. So all pairs
    that are each other's nearest can be merged at once, which is done in rounds by matrix products; once rounds merge little for
    what they compute, chains of nearest neighbours do the rest in at most three searches a cluster. Memory grows with n."""
    n, ward = len(x), method == "ward"
    means, sizes, ids = np.array(x, float), np.ones(n), np.arange(n)
    heights, merges = np.zeros(2 * n), []

    def between(i: np.ndarray | int, near: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Of clusters i to all: the distance, for ward squared."""
        dot = near[i] @ near.T
        if not ward:
            return np.subtract(1.0, dot, out=dot)
        dot *= -2
        dot += norms
        dot += norms[i][..., None]
        w = sizes[i][..., None]
        dot *= 2 * w * sizes / (w + sizes)
        return dot

    def merged(i: int, j: int) -> tuple[np.ndarray, float, int]:
        a, b = sizes[i], sizes[j]
        gap = float(np.sqrt(2 * a * b / (a + b)) * np.linalg.norm(means[i] - means[j])) if ward else float(1 - means[i] @ means[j])
        new = n + len(merges)
        heights[new] = max(gap, heights[ids[i]], heights[ids[j]]) if max(ids[i], ids[j]) >= n else gap  # but for rounding it is the gap
        merges.append((ids[i], ids[j], heights[new], int(a + b)))
        return (a * means[i] + b * means[j]) / (a + b), a + b, new

    nearest, stale = np.zeros(n, int), np.ones(n, bool)
    while len(ids) > 1:
        norms, todo = (means * means).sum(1), np.flatnonzero(stale)
        for k in range(0, len(todo), block):
            at = todo[k : k + block]
            d = between(at, means, norms)
            d[np.arange(len(at)), at] = np.inf
            nearest[at] = d.argmin(1)
        first = np.flatnonzero((nearest[nearest] == np.arange(len(ids))) & (np.arange(len(ids)) < nearest))
        second = nearest[first]
        made = [merged(i, j) for i, j in zip(first, second, strict=True)]
        for i, (mean, size, new) in zip(first, made, strict=True):
            means[i], sizes[i], ids[i] = mean, size, new
        stale = np.zeros(len(ids), bool)
        stale[first] = stale[second] = True  # and whose nearest is one of them
        stale = stale | stale[nearest]
        stay = np.ones(len(ids), bool)
        stay[second] = False
        place = np.cumsum(stay) - 1
        nearest, stale = place[nearest[stay]], stale[stay]
        means, sizes, ids = means[stay], sizes[stay], ids[stay]
        if 24 * len(first) < stale.sum():
            break
    alive, left, chain = np.ones(len(ids), bool), len(ids), []
    norms = (means * means).sum(1)
    while left > 1:
        if 2 * left < len(ids) and not chain:
            means, sizes, ids, norms, alive = means[alive], sizes[alive], ids[alive], norms[alive], np.ones(left, bool)
        if not chain:
            chain = [int(alive.argmax())]
        i = chain[-1]
        d = between(i, means, norms)
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1:
            before = chain[-2]
            slack = 1e-12 * (1 if not ward else float(2 * sizes[i] * sizes[j] / (sizes[i] + sizes[j]) * (norms[i] + norms[j])))
            if d[before] <= d[j] + slack or j in chain:  # equal but for rounding
                means[i], sizes[i], ids[i] = merged(i, before)
                norms[i] = means[i] @ means[i]
                alive[before], left, chain = False, left - 1, chain[:-2]
                continue
        chain.append(j)
    if not merges:
        return np.zeros((0, 4))
    out = np.array(merges, float)
    order = np.argsort(out[:, 2], kind="stable")  # a merge is never lower than its parts, and was made after them
    name = np.concatenate([np.arange(n), np.empty(len(out))])
    name[n + order] = n + np.arange(len(out))
    out = out[order]
    out[:, :2] = np.sort(name[out[:, :2].astype(int)], axis=1)
    return out


def tops(merges: np.ndarray, n: int, joined: np.ndarray) -> np.ndarray:
    """Of each leaf: the highest merge reached by climbing while merges are joined, or the leaf itself."""
    up = np.arange(n + len(merges))
    for child in (0, 1):
        up[merges[joined, child].astype(int)] = n + np.flatnonzero(joined)
    while not np.array_equal(further := up[up], up):
        up = further
    return up[:n]


def members(merges: np.ndarray, n: int, cut: float) -> list[list[int]]:
    """Flat clusters: leaves joined by merges of distance up to cut, in leaf order."""
    top = tops(merges, n, merges[:, 2] <= cut)
    groups: dict[int, list[int]] = {}
    for leaf in leaf_order(merges, n):
        groups.setdefault(int(top[leaf]), []).append(int(leaf))
    return list(groups.values())


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right, a merge's first part before its second."""
    if not len(merges):
        return list(range(n))
    out, stack = [], [n + len(merges) - 1]
    while stack:
        i = stack.pop()
        if i < n:
            out.append(i)
        else:
            a, b = merges[i - n, :2].astype(int)
            stack += [b, a]
    return out


def colour_groups(merges: np.ndarray, n: int, cut: float, palette: int = 9) -> list[int]:
    """Of each leaf in leaf order: 0 if it hangs above the cut, else 1 + the running number of its subtree, modulo the palette."""
    top, numbers, out = tops(merges, n, merges[:, 2] < cut), {}, []
    for leaf in leaf_order(merges, n):
        root = int(top[leaf])
        out.append(0 if root < n else 1 + numbers.setdefault(root, len(numbers)) % palette)
    return out


def auto_cut(merges: np.ndarray, n: int, wanted: Sequence[int] = (4, 5), fallback: float = 0.9, palette: int = 9) -> float:
    """The first fraction .90, .89, ... .05 of the highest merge whose number of leaf colours is wanted."""
    if not len(merges):
        return 0.0
    highest = float(merges[:, 2].max())
    for percent in range(90, 4, -1):
        top = np.unique(tops(merges, n, merges[:, 2] < percent / 100 * highest))
        if min(palette, int((top >= n).sum())) + bool((top < n).any()) in wanted:
            return percent / 100 * highest
    return fallback * highest


def lagged_correlation(za: np.ndarray, zb: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best lag, its value and the value at lag 0 of the biased correlation sum za[t + k] * zb[t] / T for all pairs of columns."""
    n = len(za)
    best = np.full((za.shape[1], zb.shape[1]), -np.inf)
    lag = np.zeros(best.shape, int)
    zero = None
    for k in range(-most, most + 1):
        r = (za[k:].T @ zb[: n - k] if k >= 0 else za[: n + k].T @ zb[-k:]) / n
        if k == 0:
            zero = r
        better = r > best
        best[better], lag[better] = r[better], k
    return lag, best, zero
