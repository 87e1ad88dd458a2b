"""Gaussian hidden Markov models with diagonal covariance, for volatility regimes; NumPy only.

Many windows are fitted at once: every recursion step is one vectorised operation over all of them.
"""

from __future__ import annotations

import numpy as np

FLOOR = 1e-8  # least variance


def _log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """x: windows x time x features; mean, var: windows x states x features; windows x time x states."""
    d = x[:, :, None, :] - mean[:, None]
    return -0.5 * ((d * d / var[:, None]) + np.log(2 * np.pi * var[:, None])).sum(-1)


def forward(dens: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state probabilities (windows x time x states) and log-likelihood of every window."""
    top = dens.max(2, keepdims=True)
    p = np.exp(dens - top)
    out = np.empty_like(p)
    like = top.sum((1, 2))
    a = start * p[:, 0]
    for t in range(p.shape[1]):
        if t:
            a = (a[:, None] @ move)[:, 0] * p[:, t]
        c = np.maximum(a.sum(1, keepdims=True), 1e-300)
        a = a / c
        like += np.log(c[:, 0])
        out[:, t] = a
    return out, like


def fit(x: np.ndarray, states: int, rounds: int = 25) -> dict[str, np.ndarray]:
    """Baum-Welch on every window of x, states ordered by the variance of the first feature.

    The start splits each window by the size of its first feature into equal parts: no random numbers."""
    n, t, f = x.shape
    order = np.argsort(np.abs(x[:, :, 0]), axis=1, kind="stable").argsort(1)
    part = order * states // t
    g = np.eye(states)[part]
    start = np.full((n, states), 1 / states)
    move = np.full((n, states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((n, 1, 1))
    if states > 1:
        move[:, np.arange(states), np.arange(states)] = 0.9
    floor = np.maximum(x.var(1, keepdims=True) * 1e-4, FLOOR)

    def moments(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = g.sum(1)[:, :, None] + 1e-12
        mean = np.einsum("nts,ntf->nsf", g, x) / w
        var = np.einsum("nts,ntf->nsf", g, x * x) / w - mean**2
        return mean, np.maximum(var, floor)

    mean, var = moments(g)
    like = np.full(n, -np.inf)
    for _ in range(rounds):
        dens = _log_density(x, mean, var)
        a, new = forward(dens, start, move)
        p = np.exp(dens - dens.max(2, keepdims=True))
        b = np.ones((n, states))
        post = np.empty_like(a)
        trans = np.zeros_like(move)
        post[:, -1] = a[:, -1]
        for k in range(t - 2, -1, -1):
            w = p[:, k + 1] * b
            xi = a[:, k, :, None] * move * w[:, None]
            xi /= np.maximum(xi.sum((1, 2), keepdims=True), 1e-300)
            trans += xi
            post[:, k] = xi.sum(2)
            b = (move @ w[:, :, None])[:, :, 0]
            b /= np.maximum(b.max(1, keepdims=True), 1e-300)
        start = post[:, 0]
        move = (trans + 1e-6) / (trans + 1e-6).sum(2, keepdims=True)
        mean, var = moments(post)
        if (new - like < 1e-4).all():
            like = new
            break
        like = new
    o = np.argsort(var[:, :, 0], axis=1)
    take = lambda z: np.take_along_axis(z, o.reshape(n, states, *[1] * (z.ndim - 2)), 1)
    return {"start": take(start), "move": np.take_along_axis(take(move), o[:, None, :], 2), "mean": take(mean), "var": take(var), "like": like}


def bic(like: np.ndarray, states: int, features: int, n: int) -> np.ndarray:
    free = states * states - 1 + 2 * states * features
    return -2 * like + free * np.log(n)


def likelihood(x: np.ndarray, states: int, rounds: int = 8) -> float:
    """Log-likelihood that `fit` reaches on one long series (time x features), in about sqrt(time) NumPy steps a pass.

    The series is cut into as many chunks as one has rows. Every chunk's transfer matrix gives the state before and
    after it, and all chunks then run side by side: the same sums as row by row, in another order."""
    t, f = x.shape
    size = max(1, int(np.ceil(np.sqrt(t))))
    n = -(-t // size)
    pad = lambda z, v: np.concatenate([z, np.full((n * size - t, *z.shape[1:]), v)]).reshape(n, size, *z.shape[1:])
    order = np.argsort(np.abs(x[:, 0]), kind="stable").argsort()
    post = np.eye(states)[order * states // t]
    start = np.full(states, 1 / states)
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.9)
    floor = np.maximum(x.var(0) * 1e-4, FLOOR)
    like = -np.inf
    for _ in range(rounds):
        w = post.sum(0)[:, None] + 1e-12
        mean = post.T @ x / w
        var = np.maximum(post.T @ (x * x) / w - mean**2, floor)
        dens = _log_density(x[None], mean[None], var[None])[0]
        top = dens.max(1, keepdims=True)
        p = pad(np.exp(dens - top), 1.0)
        m, scale = np.repeat(np.eye(states)[None], n, 0), np.zeros((n, states))
        for k in range(size):
            m = (m.reshape(-1, states) @ move).reshape(n, states, states) * p[:, k, None] if k else np.concatenate([np.eye(states)[None], np.repeat(move[None], n - 1, 0)]) * p[:, 0, None]
            c = np.maximum(m.sum(2), 1e-300)
            m /= c[:, :, None]
            scale += np.log(c)
        a, b = np.empty((n, states)), np.ones((n, states))
        a[0] = start
        for i in range(1, n):
            g = np.log(np.maximum(a[i - 1], 1e-300)) + scale[i - 1]
            z = np.exp(g - g.max()) @ m[i - 1]
            a[i] = z / z.sum()
        for i in range(n - 1, 0, -1):
            g = np.log(np.maximum(m[i] @ b[i], 1e-300)) + scale[i]
            b[i - 1] = np.exp(g - g.max())
        seen, norm = np.empty_like(p), np.empty((n, size))
        for k in range(size):
            a = (np.concatenate([a[:1], a[1:] @ move]) if k == 0 else a @ move) * p[:, k]
            c = np.maximum(a.sum(1, keepdims=True), 1e-300)
            a = a / c
            seen[:, k], norm[:, k] = a, c[:, 0]
        new = float(top.sum() + np.log(norm.reshape(-1)[:t]).sum())
        ahead = np.empty_like(p)  # the density of a row and of all after it, by the row's state
        for k in range(size - 1, -1, -1):
            ahead[:, k] = p[:, k] * b
            b = ahead[:, k] @ move.T
            b /= np.maximum(b.max(1, keepdims=True), 1e-300)
        seen, ahead = seen.reshape(-1, states)[:t], ahead.reshape(-1, states)[:t]
        after = ahead[1:] @ move.T
        total = np.maximum((seen[:-1] * after).sum(1, keepdims=True), 1e-300)
        trans = move * ((seen[:-1] / total).T @ ahead[1:])
        post = np.concatenate([seen[:-1] * after / total, seen[-1:]])
        start = post[0]
        move = (trans + 1e-6) / (trans + 1e-6).sum(1, keepdims=True)
        if new - like < 1e-4:
            return new
        like = new
    return like


def best_states(x: np.ndarray, low: int = 2, high: int = 8) -> int:
    """The state count of least BIC for one series (time x features)."""
    scores = {k: float(bic(likelihood(x, k, 8), k, x.shape[1], len(x))) for k in range(low, high + 1) if len(x) >= 10 * k}
    return min(scores, key=scores.get) if scores else low


def walk_forward(x: np.ndarray, window: int, every: int, states: int) -> np.ndarray:
    """Probability of the most volatile state at every row, by models fitted on the `window` rows before each batch.

    Only the forward pass is used, so that no row sees what follows it; NaN before the first model."""
    out = np.full(len(x), np.nan)
    starts = np.arange(window, len(x), every)
    if not len(starts):
        return out
    m = fit(np.stack([x[s - window : s] for s in starts]), states)
    for i, s in enumerate(starts):
        end = min(s + every, len(x))
        seen = x[None, s - window : end]
        a, _ = forward(_log_density(seen, m["mean"][i : i + 1], m["var"][i : i + 1]), m["start"][i : i + 1], m["move"][i : i + 1])
        out[s:end] = a[0, window:, -1]
    return out
