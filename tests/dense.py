"""Dense NumPy counterparts, for tests only."""

import numpy as np


def square(pairs, ids):
    at = {k: i for i, k in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in pairs:
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["d"]
    return out


def gower(d):
    a = -0.5 * d**2
    j = np.eye(len(d)) - 1 / len(d)
    return j @ a @ j


def hat(x):
    q, _ = np.linalg.qr(x)
    return q @ q.T
