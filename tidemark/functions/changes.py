"""Change-point detectors of one segment without missing values: (types, degrees)."""

from __future__ import annotations

from math import comb

import numpy as np


def _blank(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, "normal", dtype=object), np.zeros(n)


def bocpd(t, v, hazard: float = 1 / 150):
    """The published recursion's change mass, which always equals the hazard: it is the hazard's share of a sum
    that the growth terms share in the same ratio. It never labels a change; ``bocpd_run_length`` does."""
    types, degrees = _blank(len(v))
    return types, degrees if len(v) < 2 else np.full(len(v), hazard)


def bocpd_run_length(t, v, hazard: float = 1 / 150, recent: int = 10, most: int = 500):
    """Probability that the run is younger than ``recent`` rows, with a Normal-Normal model; runs beyond ``most`` rows are merged into the oldest."""
    n = len(v)
    types, degrees = _blank(n)
    if n < 2:
        return types, degrees
    noise = np.median(np.abs(np.diff(v))) / 0.6745 or 1.0
    centre, spread = np.median(v), np.std(v) or 1.0
    logp, mean, prec = np.zeros(1), np.full(1, centre), np.full(1, spread**-2)
    for i, x in enumerate(v):
        var = 1 / prec + noise**2
        like = logp - 0.5 * (x - mean) ** 2 / var - 0.5 * np.log(2 * np.pi * var)
        fresh = np.log(hazard) - 0.5 * (x - centre) ** 2 / (spread**2 + noise**2) - 0.5 * np.log(2 * np.pi * (spread**2 + noise**2))
        logp = np.r_[fresh, like + np.log1p(-hazard)]
        after = np.r_[spread**-2, prec] + noise**-2
        mean = (np.r_[centre * spread**-2, prec * mean] + x * noise**-2) / after
        prec = after
        logp -= np.logaddexp.reduce(logp)
        if len(logp) > most:
            logp[most - 1] = np.logaddexp.reduce(logp[most - 1 :])
            logp, mean, prec = logp[:most], mean[:most], prec[:most]
        if i >= recent:
            degrees[i] = min(1.0, np.exp(np.logaddexp.reduce(logp[:recent])))
    types[(degrees > 0.25) & (degrees <= 0.55)] = "transition"
    types[degrees > 0.55] = "shift"
    return types, degrees


def median_squared_distance(v: np.ndarray) -> float:
    """Median of the squared differences of all pairs, exactly, in memory linear in the rows (0 without pairs).

    The k-th least difference is found by bisection over the bit patterns of
    non-negative doubles, which are in the order of the doubles.
    """
    x = np.sort(np.asarray(v, float))
    n, pairs = len(x), len(v) * (len(v) - 1) // 2
    if not pairs:
        return 0.0
    rows = np.arange(n)

    def within(limit):
        # searchsorted rounds x + limit; the neighbours are set right by the differences themselves.
        stop = np.searchsorted(x, x + limit, side="right")
        while (more := (stop < n) & (x[np.minimum(stop, n - 1)] - x <= limit)).any():
            stop = np.where(more, np.searchsorted(x, x[np.minimum(stop, n - 1)], side="right"), stop)
        while (less := x[stop - 1] - x > limit).any():
            stop = np.where(less, np.searchsorted(x, x[stop - 1], side="left"), stop)
        return int((stop - rows - 1).sum())

    def kth(k):
        lo, hi = 0, int(np.float64(x[-1] - x[0]).view(np.int64))
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if within(np.int64(mid).view(np.float64)) >= k else (mid + 1, hi)
        return float(np.int64(lo).view(np.float64))

    low = kth((pairs + 1) // 2)
    high = low if within(low) >= pairs // 2 + 1 else kth(pairs // 2 + 1)
    return (low**2 + high**2) / 2


#: Rows since the oldest open start from which starts are held in groups, and value cells beyond which they are not.
NEAR, CELLS = 2048, 120
#: Rows whose sums are made at once, and up to which the kernel is taken pair by pair.
ROWS, FEW = 32, 12
#: Costs may break the inequality behind the pruning by a little, as the kernel is cut at its top.
SLACK = 0.05


class _KernelSums:
    """Sums of the kernel over rows ``lo`` to ``hi`` at any values, without the pairs and exact but for rounding.

    The Gauss kernel is interpolated in cells one scale wide, at 20 nodes each. Where the kernel is cut, up to a tenth
    of a scale, the difference is a polynomial of the distance and comes from moments of the sorted values.
    """

    TOP, POWER = 0.1, 8

    def __init__(self, v, scale):
        self.v, self.scale = v, scale
        self.x = (v - v.min()) / np.sqrt(scale)
        self.cell = np.minimum(self.x, 1e4).astype(np.int64)
        self.cells = np.unique(self.cell)
        self.fits = len(self.cells) <= CELLS and self.x.max() < 1e4
        if not self.fits:
            return
        self.nodes = 0.5 + 0.5 * np.cos(np.pi * (np.arange(20) + 0.5) / 20)
        self.weight = np.sin(np.pi * (np.arange(20) + 0.5) / 20) * (-1.0) ** np.arange(20)
        places = (self.cells[:, None] + self.nodes).ravel()
        self.gauss = np.exp(-np.subtract.outer(places, places) ** 2)
        cut = np.polynomial.Chebyshev.interpolate(lambda u: np.exp(-u), self.POWER // 2, [0, self.TOP**2]).convert(kind=np.polynomial.Polynomial).coef
        cut[0] -= np.exp(-(self.TOP**2))
        # (x - y)^2k, by powers of y and of x.
        self.terms = np.zeros((self.POWER + 1, self.POWER + 1))
        for k, c in enumerate(cut):
            for p in range(2 * k + 1):
                self.terms[p, 2 * k - p] += c * comb(2 * k, p) * (-1) ** p
        self.pieces = {}

    def spread(self, rows):
        """Interpolation weights of rows at all nodes."""
        d = (self.x[rows] - self.cell[rows])[:, None] - self.nodes
        hit = d == 0
        d[hit] = 1.0
        w = self.weight / d
        w[hit.any(axis=1)] = 0
        w[hit] = 1.0
        w /= w.sum(axis=1, keepdims=True)
        out = np.zeros((len(w), len(self.cells), 20))
        out[np.arange(len(w)), np.searchsorted(self.cells, self.cell[rows])] = w
        return out.reshape(len(w), -1)

    def piece(self, lo, hi):
        if (lo, hi) not in self.pieces:
            y = np.sort(self.x[lo:hi])
            moments = np.zeros((hi - lo + 1, self.POWER + 1))
            np.cumsum((y - np.floor(y) - 0.5)[:, None] ** np.arange(self.POWER + 1), axis=0, out=moments[1:])
            mass = sum(self.spread(slice(a, min(a + 4096, hi))).sum(axis=0) for a in range(lo, hi, 4096))
            self.pieces[lo, hi] = y, moments, self.gauss @ mass
        return self.pieces[lo, hi]

    def at(self, bounds, rows):
        """Sums over the rows between each two of ``bounds`` at the values of other rows: one line a pair of bounds."""
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        out = np.empty((len(spans), rows.stop - rows.start))
        long = [i for i, (lo, hi) in enumerate(spans) if hi - lo > FEW]
        for i in set(range(len(spans))).difference(long):
            out[i] = kernel(self.v[slice(*spans[i]), None], self.v[rows], self.scale).sum(axis=0)
        if not long:
            return out
        pieces = [self.piece(*spans[i]) for i in long]
        out[long] = np.stack([p[2] for p in pieces]) @ self.spread(rows).T
        x = self.x[rows]
        order = np.argsort(x)
        x = x[order]
        left, right = x - self.TOP, x + self.TOP
        first, last = np.floor(left), np.floor(right)
        two = np.flatnonzero(first != last)
        by_first, by_last = (self._powers(x - c - 0.5) for c in (first, last))
        by_last = by_last[two]
        for i, (y, moments, _) in zip(long, pieces, strict=True):
            lo, hi = np.searchsorted(y, left, "right"), np.searchsorted(y, right, "left")
            mid, end = hi.copy(), moments[hi]
            mid[two] = np.searchsorted(y, last[two], "left")
            top = np.einsum("ij,ij->i", moments[mid] - moments[lo], by_first)
            top[two] += np.einsum("ij,ij->i", end[two] - moments[mid[two]], by_last)
            out[i, order] -= top
        return out

    def _powers(self, x):
        return x[:, None] ** np.arange(self.POWER + 1) @ self.terms.T

    def forget(self, bounds):
        kept = set(zip(bounds[:-1], bounds[1:], strict=True))
        self.pieces = {k: p for k, p in self.pieces.items() if k in kept}


class _FarStarts:
    """Open starts before the row ``near``: single ones, and groups that stand for all their starts by a bound.

    The cost of rows s to e is at least that of s to q plus that of q to e, the inequality behind the pruning. So a
    group settled at q costs at least the ``low`` of its starts at q plus the cost of q to e. Where that is not above
    the best cost, the group is opened: its starts are computed in full and settled again.
    """

    def __init__(self, sums: _KernelSums, v, scale, best, block, penalty, least):
        self.kernel, self.v, self.scale, self.best, self.block, self.penalty, self.least = sums, v, scale, best, block, penalty, least
        self.start, self.low, self.sums, self.cost = np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0)
        self.groups: list = []
        self.near = None

    def add(self, end, total):
        """Takes the row before ``end``; ``total``: what it adds to the sums of the near rows."""
        if end > self.stop:
            self.look()
        self.sums += 2 * self.ahead[end - 1 - self.first] + total
        size = end - self.start
        self.cost = self.low + size - self.sums / size + self.penalty

    def look(self):
        """Sums from each start to ``near`` at the next rows: as many as were taken since the last settling, then twice as many."""
        self.first, self.stop = self.stop, min(self.stop + self.step, len(self.v))
        self.step = min(2 * self.step, NEAR)
        ahead = np.zeros((self.stop - self.first, len(self.bounds)))
        if len(self.bounds) > 1:
            ahead[:, :-1] = np.cumsum(self.kernel.at(self.bounds.tolist(), slice(self.first, self.stop))[::-1], axis=0)[::-1].T
        self.ahead = ahead[:, np.searchsorted(self.bounds, self.start)]

    def lone(self):
        """(cost, start) of the best single start."""
        if not len(self.singles):
            return np.inf, 0
        j = self.singles[self.cost[self.singles].argmin()]
        return self.cost[j], self.start[j]

    def doubtful(self, floor):
        """Whether a group may hold a start that costs no more than ``floor``."""
        return (self.cost[self.held] <= floor + SLACK).any()

    def open(self, which, end):
        """(starts, block sums, costs) of a group's starts at ``end``."""
        starts, sums = self.groups[which]
        at, lo = int(self.start[which]), int(starts.min())
        bounds = [*[int(q) for q in np.unique(self.start) if q >= at and q < self.near], self.near]
        rows = slice(lo, at)
        seen = self.kernel.at(bounds, rows).sum(axis=0) if len(bounds) > 1 else np.zeros(at - lo)
        for row in range(self.near, end):
            seen += kernel(self.v[lo:at], self.v[row], self.scale)
        cross = np.cumsum(seen[::-1])[::-1]
        sums = sums + self.sums[which] + 2 * cross[starts - lo]
        size = end - starts
        return starts, sums, self.best[starts] + size - sums / size + self.penalty

    def settle(self, end, starts, floor):
        """Groups the near ``starts`` and opened groups at ``end``; returns the best (cost, start) among them and single starts."""
        size = end - starts
        parts = [(starts, self.block[starts], self.best[starts] + size - self.block[starts] / size + self.penalty)]
        stay = [j for j in range(len(self.groups)) if self.groups[j] is None or self.cost[j] > floor + self.penalty / 8]
        parts += [self.open(j, end) for j in range(len(self.groups)) if j not in set(stay)]
        starts, sums, cost = (np.concatenate(c) for c in zip(*parts, strict=True))
        old = [j for j in stay if self.groups[j] is None]
        ready = end - starts >= self.least
        single = [(self.cost[j], int(self.start[j])) for j in old] + list(zip(cost[ready].tolist(), starts[ready].tolist(), strict=True))
        lowest = min(single)
        stay = [j for j in stay if self.cost[j] - self.penalty <= lowest[0]]
        open_ = ~ready | (cost - self.penalty <= lowest[0])
        starts, sums, cost, ready = starts[open_], sums[open_], cost[open_], ready[open_]
        alone = ready & (cost < lowest[0] + self.penalty / 4)
        # Single starts that have fallen behind go into the new group.
        back = [j for j in stay if self.groups[j] is None and self.cost[j] >= lowest[0] + self.penalty / 2]
        starts, sums, cost = (np.r_[x, y[back]] for x, y in ((starts, self.start), (sums, self.sums), (cost, self.cost)))
        alone = np.r_[alone, np.zeros(len(back), bool)]
        keep = [(int(self.start[j]), self.low[j], self.sums[j], self.groups[j]) for j in stay if j not in set(back)]
        keep += [(int(s), self.best[s], b, None) for s, b in zip(starts[alone], sums[alone], strict=True)]
        if not alone.all():
            keep.append((end, (cost[~alone] - self.penalty).min(), 0.0, (starts[~alone], sums[~alone])))
        keep.sort(key=lambda k: k[0])
        self.start, self.low, self.sums = np.array([k[0] for k in keep]), np.array([k[1] for k in keep]), np.array([k[2] for k in keep])
        self.groups, self.step, self.near = [k[3] for k in keep], min(max(end - (self.near or 0), 128), NEAR), end
        held = np.array([g is not None for g in self.groups])
        self.held, self.singles = np.flatnonzero(held), np.flatnonzero(~held)
        self.bounds = np.unique(np.r_[self.start, end])
        self.kernel.forget(self.bounds.tolist())
        self.first = self.stop = end
        return lowest


def kernel(x, y, scale):
    """The kernel of values ``x`` and others, in an array of its own."""
    k = x - y
    k *= k
    k /= scale
    np.maximum(k, 1e-2, out=k)
    np.minimum(k, 1e2, out=k)
    return np.exp(np.negative(k, out=k), out=k)


def kernel_breaks(v: np.ndarray, penalty: float = 4.0, least: int = 3) -> list[int]:
    """Starts of new segments under the penalised Gaussian-kernel cost, exactly, with pruning.

    The kernel's scale is the median squared distance. Block sums are carried from
    row to row, so memory is linear in the rows, and from the oldest start that is
    still open: time is the rows times the reach of the open starts. Few are, so
    each call of NumPy counts: the sums of ``ROWS`` rows are made at once. Where the
    reach is long, as without a change no start is ever closed, those more than
    ``NEAR`` rows back are held in groups.
    """
    v, n = np.asarray(v, float), len(v)
    scale = median_squared_distance(v) or 1.0
    best, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    block, starts, place = np.zeros(n), np.zeros(1, int), np.zeros(n + 1, int)
    seen, far, reach, end = np.tri(ROWS), None, NEAR if np.isfinite(v).all() else n + 1, 0
    while end < n:
        began, stop = end, min(end + ROWS, n)
        oldest = far.near if far else int(starts[0])
        sums, past = kernel(v[oldest:stop], v[began:stop, None], scale), began - oldest
        rows = stop - began
        sums[:, past:] *= seen[:rows, :rows]
        sums[np.arange(rows), past + np.arange(rows)] = 1.0
        sums = np.add.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
        sums *= 2
        sums -= 1.0
        sums[:, past:] *= seen[:rows, :rows]
        totals = sums[:, 0].copy()
        sums[0] += block[oldest:stop]
        np.add.accumulate(sums, axis=0, out=sums)
        for line, total in zip(sums, totals, strict=True):
            end += 1
            if far:
                far.add(end, total)
            if end < least:
                continue
            # The starts ascend, and the last came with the row before: all are ``least`` rows old.
            size = end - starts
            cost = best[starts] + size - line[starts - oldest] / size + penalty
            if len(starts):
                k = cost.argmin()
                best[end], cut[end] = cost[k], starts[k]
            if far and (lone := far.lone())[0] <= best[end]:
                best[end], cut[end] = lone
            if end - oldest >= reach or (far and far.doubtful(best[end])):
                if far is None:
                    ready = _KernelSums(v, scale)
                    far = _FarStarts(ready, v, scale, best, block, penalty, least) if ready.fits else None
                    reach = reach if far else n + 1
                if far:
                    block[oldest:end] = line[: end - oldest]
                    best[end], cut[end] = far.settle(end, np.r_[starts, max(end - least + 1, oldest) : end], best[end])
                    starts = place[:0]
                    break
            keep = starts[cost - penalty <= best[end]]
            place[: len(keep)], place[len(keep)] = keep, end - least + 1
            starts = place[: len(keep) + (not far or end - least + 1 >= oldest)]
        else:
            block[oldest:end] = line
    out, at = [], n
    while cut[at] > 0:
        at = int(cut[at])
        out.append(at)
    return out[::-1]


def kcp(t, v, least: int = 3, width: int = 10):
    """Kernel change points, scored by the mean shift over the noise of first differences."""
    n = len(v)
    types, degrees = _blank(n)
    if n < 2 * least:
        return types, degrees
    d = np.diff(v)
    noise = max(1.4826 * np.median(np.abs(d - np.median(d))), 1e-6)
    for at in kernel_breaks(v, least=least):
        ratio = abs(v[at : at + width].mean() - v[max(0, at - width) : at].mean()) / noise
        degrees[at] = min(ratio / 3, 1.0)
        types[at] = "shift" if ratio >= 0.8 else "transition" if ratio >= 0.3 else "normal"
    return types, degrees


#: Level, slope and their covariance before a first reading.
KALMAN_START = (0.0, 10.0, 0.0, 10.0)


def kalman_step(state, dt: float, y: float, noise: float = 10.0, drift: float = 0.1) -> tuple[tuple, float]:
    """(state, normalised innovation) of a level-and-slope filter after a reading ``dt`` minutes on; state None: at a first one."""
    if state is None:
        level, (slope, a, b, c) = y, KALMAN_START
    else:
        level, slope, a, b, c = state
        level += slope * dt
        a, b, c = a + 2 * dt * b + dt * dt * c + drift * dt**4 / 4, b + dt * c + drift * dt**3 / 2, c + drift * dt**2
    miss, s = y - level, a + noise
    return (level + a / s * miss, slope + b / s * miss, a - a * a / s, b - a * b / s, c - b * b / s), miss * miss / s


def kalman(t, v, noise: float = 10.0, drift: float = 0.1, limit: float = 60.0, medium: float = 8.0):
    """Normalised innovations of a level-and-slope filter; times in minutes."""
    state, scores = None, np.empty(len(v))
    for i, (dt, y) in enumerate(zip(np.diff(t, prepend=t[:1]).tolist(), np.asarray(v, float).tolist(), strict=True)):
        state, scores[i] = kalman_step(state, dt, y, noise, drift)
    types = np.where(scores > limit, "adverse", np.where(scores > medium, "medium", "normal")).astype(object)
    return types, np.minimum(scores / limit, 1.0)


#: Rows from which a chain is computed by stretches.
LONG = 1000


def _forward_backward(like, move, start):
    n = len(like)
    if n >= LONG:
        return _by_stretches(like, move, start)
    alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    p = start
    for i in range(n):
        p = p * like[i]
        scale[i] = p.sum() or 1e-300
        alpha[i] = p / scale[i]
        p = alpha[i] @ move
    for i in range(n - 2, -1, -1):
        beta[i] = move @ (like[i + 1] * beta[i + 1]) / scale[i + 1]
    return alpha, beta, scale


def _by_stretches(like, move, start):
    """The same by stretches, all at once: each stretch's product of two by two matrices gives what enters it from
    either side, then one pass each way fills them. What enters is found in plain numbers, so there can be many stretches.
    A state's column is contiguous here and in what is returned."""
    n = len(like)
    size = int(np.sqrt(n)) // 4
    parts = -(-n // size)
    rows = np.ones((2, parts * size))
    rows[:, :n] = like.T
    rows = np.ascontiguousarray(rows.reshape(2, parts, size).transpose(2, 0, 1))
    (ma, mb), (mc, md) = move.tolist()
    a, b, c, d = np.ones(parts), np.zeros(parts), np.zeros(parts), np.ones(parts)
    for u, w in rows:
        a, b, c, d = a * u, b * w, c * u, d * w
        a, b, c, d = a * ma + b * mc, a * mb + b * md, c * ma + d * mc, c * mb + d * md
        total = a + b + c + d
        a /= total
        b /= total
        c /= total
        d /= total
    products = np.stack([a, b, c, d], axis=1).tolist()
    before, after = np.empty((parts, 2)), np.ones((parts, 2))
    p, q = start.tolist()
    for i, (a, b, c, d) in enumerate(products):
        before[i] = p, q
        p, q = p * a + q * c, p * b + q * d
        p, q = p / (p + q), q / (p + q)
    p = q = 1.0
    for i in range(parts - 1, 0, -1):
        a, b, c, d = products[i]
        p, q = a * p + b * q, c * p + d * q
        p, q = after[i - 1] = p / (p + q), q / (p + q)
    alpha, beta, scale = np.empty(rows.shape), np.empty(rows.shape), np.empty((size, parts))
    p, q = before.T.copy()
    for i, (u, w) in enumerate(rows):
        p, q = p * u, q * w
        np.maximum(p + q, 1e-300, out=scale[i])
        p, q = np.divide(p, scale[i], out=alpha[i, 0]), np.divide(q, scale[i], out=alpha[i, 1])
        p, q = p * ma + q * mc, p * mb + q * md
    p, q = after.T.copy()
    for i in range(size - 1, -1, -1):
        p, q = p * ma + q * mb, p * mc + q * md
        # Scaled as in the recursion: with alpha it sums to 1.
        total = alpha[i, 0] * p
        total += alpha[i, 1] * q
        p, q = np.divide(p, total, out=beta[i, 0]), np.divide(q, total, out=beta[i, 1])
        p, q = p * rows[i, 0], q * rows[i, 1]
        total = p + q
        p /= total
        q /= total
    back = lambda x: x.transpose(1, 2, 0).reshape(2, -1)[:, :n].T
    return back(alpha), back(beta), scale.T.ravel()[:n]


def _likeliest(like, move, start) -> np.ndarray:
    """Viterbi path of two states from log likelihoods; plain numbers, as small arrays would cost ten times as much."""
    (aa, ab), (ba, bb) = np.log(move + 1e-300).tolist()
    (x, y), n = (np.log(start + 1e-300) + like[0]).tolist(), len(like)
    from_a, from_b = bytearray(n), bytearray(n)
    for i, (u, w) in enumerate(zip(like[1:, 0].tolist(), like[1:, 1].tolist(), strict=True), 1):
        from_a[i], from_b[i] = y + ba > x + aa, y + bb > x + ab
        x, y = max(x + aa, y + ba) + u, max(x + ab, y + bb) + w
    path = np.empty(n, int)
    at = path[-1] = int(y > x)
    for i in range(n - 1, 0, -1):
        at = path[i - 1] = from_b[i] if at else from_a[i]
    return path


def hmm(t, v, rounds: int = 100, tol: float = 1e-2):
    """Two Gaussian states by EM from the outer quartiles (deterministic); degree: posterior of the rarer state."""
    n = len(v)
    types, degrees = _blank(n)
    if n < 3:
        return types, degrees
    x = (v - v.mean()) / (v.std() or 1.0)
    mean, var = np.quantile(x, [0.25, 0.75]), np.ones(2)
    if mean[0] == mean[1]:
        mean = mean + np.array([-0.5, 0.5])
    move, start, last = np.array([[0.9, 0.1], [0.1, 0.9]]), np.full(2, 0.5), -np.inf
    # One line a state, which is contiguous in long segments.
    for _ in range(rounds):
        like = x - mean[:, None]
        like *= like
        like *= -0.5 / var[:, None]
        np.exp(like, out=like)
        like /= np.sqrt(2 * np.pi * var)[:, None]
        like += 1e-300
        alpha, beta, scale = _forward_backward(like.T, move, start)
        alpha, beta = alpha.T, beta.T
        post = alpha * beta
        post /= post[0] + post[1]
        like *= beta
        like /= scale
        pairs = alpha[:, :-1] @ like[:, 1:].T * move
        start = post[:, 0]
        move = (pairs * 1.0 + 1e-12) / (pairs.sum(axis=1, keepdims=True) + 2e-12)
        mass = post.sum(axis=1) + 1e-12
        mean = post @ x / mass
        far = x - mean[:, None]
        far *= far
        far *= post
        var = np.maximum(far.sum(axis=1) / mass, 1e-3)
        total = np.log(scale).sum()
        if total - last < tol:
            break
        last = total
    like = -0.5 * (x[:, None] - mean) ** 2 / var - 0.5 * np.log(2 * np.pi * var)
    path = _likeliest(like, move, start)
    degrees = post[int(np.bincount(path, minlength=2).argmin())]
    turns = np.flatnonzero(np.diff(path)) + 1
    near = np.unique(np.clip(np.r_[turns - 1, turns + 1], 0, n - 1))
    types[near] = "transition"
    types[turns] = "shift"
    return types, degrees
