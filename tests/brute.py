"""Interval operators by the definition, for small tracks of (chr, start, end, value)."""

from __future__ import annotations

import math
import random

FOLDS = {"sum": sum, "avg": lambda v: sum(v) / len(v), "max": max, "min": min, "product": math.prod}
PAIRS = {
    "sum": lambda a, b: a + b, "avg": lambda a, b: (a + b) / 2, "diff": lambda a, b: a - b,
    "product": lambda a, b: a * b, "quotient": lambda a, b: a / b if b else None,
    "max": max, "min": min, "left": lambda a, b: a, "right": lambda a, b: b,
}
LOCATION = {
    "overlaps": lambda a, b: a[1] <= b[2] and a[2] >= b[1],
    "contains": lambda a, b: a[1] <= b[1] and a[2] >= b[2],
    "within": lambda a, b: b[1] <= a[1] and b[2] >= a[2],
    "coincides": lambda a, b: a[1:3] == b[1:3],
    "adjacent": lambda a, b: a[2] + 1 == b[1] or a[1] - 1 == b[2],
    "precedes": lambda a, b: a[2] < b[1],
    "follows": lambda a, b: a[1] > b[2],
    "prefix": lambda a, b: a[1] == b[1] and a[2] <= b[2],
    "suffix": lambda a, b: a[2] == b[2] and a[1] >= b[1],
}


def random_track(seed, n, span, longest, chromosomes):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.randint(1, span)
        size = rng.choice([0, 0, 1, 2, 3, rng.randint(0, longest)])
        rows.append((rng.choice(chromosomes), start, start + size, float(rng.randint(-5, 9))))
    return rows + rows[:3]  # some copies


def length(x):
    return x[2] - x[1] + 1


def shared(x, y):
    return min(x[2], y[2]) - max(x[1], y[1]) + 1


def overlap(x, y):
    return x[0] == y[0] and LOCATION["overlaps"](x, y)


def distance(x, y):
    return max(0, y[1] - x[2], x[1] - y[2])


def part(x, n, vm):
    return x[3] * n / length(x) if vm == "total" else x[3]


def intersect(a, b, vd, vm):
    return [(x[0], max(x[1], y[1]), min(x[2], y[2]),
             PAIRS[vd](part(x, shared(x, y), vm), part(y, shared(x, y), vm)))
            for x in a for y in b if overlap(x, y)]


def covering(track, chromosome, position):
    return [x for x in track if x[0] == chromosome and x[1] <= position <= x[2]]


def coalesce(track, slack=0):
    out = []
    for chromosome in sorted({x[0] for x in track}):
        run = None
        for x in sorted(y for y in track if y[0] == chromosome):
            if run is not None and x[1] <= run[2] + slack:
                run[2] = max(run[2], x[2])
                run[3].append(x[3])
            else:
                run = [chromosome, x[1], x[2], [x[3]]]
                out.append(run)
    return [tuple(r) for r in out]


def discretize(track, vd, vm):
    out = []
    for chromosome in sorted({x[0] for x in track}):
        cuts = sorted({p for x in track if x[0] == chromosome for p in (x[1] - 1, x[2])})
        for low, high in zip(cuts, cuts[1:]):
            over = covering(track, chromosome, low + 1)
            if over:
                out.append((chromosome, low + 1, high, FOLDS[vd]([part(x, high - low, vm) for x in over])))
    return out


def exclusive(a, b, vm="each"):
    out = []
    for x in a:
        free = [p for p in range(x[1], x[2] + 1) if not covering(b, x[0], p)]
        while free:
            n = 1
            while n < len(free) and free[n] == free[n - 1] + 1:
                n += 1
            out.append((x[0], free[0], free[n - 1], part(x, n, vm)))
            free = free[n:]
    return out


def project(a, targets, vd, vm):
    out = []
    for t in {y[:3] for y in targets}:
        over = [x for x in a if overlap(x, t)]
        if not over:
            value = 0.0
        elif (vd, vm) == ("avg", "each"):
            value = sum(x[3] * shared(x, t) for x in over) / length(t)
        else:
            value = FOLDS[vd]([part(x, shared(x, t), vm) for x in over])
        out.append((*t, value))
    return out


def bins(a, sizes, width, leading):
    out = []
    for chromosome, size in sizes.items():
        own = [x for x in a if x[0] == chromosome]
        if not leading and not own:
            continue
        first = 0 if leading else min((x[1] - 1) // width for x in own)
        for k in range(first, (size - 1) // width + 1):
            t = (chromosome, k * width + 1, min((k + 1) * width, size))
            out.append((*t, sum(x[3] * shared(x, t) for x in own if overlap(x, t)) / length(t)))
    return out


def pair_closest(a, b):
    out = []
    for x in a:
        near = [(distance(x, y), y) for y in b if y[0] == x[0]]
        least = min((d for d, _ in near), default=None)
        out += [(*x, *y[1:], d) for d, y in near if d == least]
    return out
