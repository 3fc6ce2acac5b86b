"""A small causal self-attention model over symbol classes, in numpy: forward, gradients, Adam.

A window is two blocks of ``BLOCK`` inputs: the symbols of the second block ask, those of both blocks up to themselves
answer, so that every symbol is predicted from 16 to 31 before it and each block is scored once. What an answer weighs
depends on both symbols and on their distance. The counted transitions of the whole corpus are a fixed part of the
logits; attention learns what they don't say.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16
CONTEXT = 2 * BLOCK
WIDTH = 16
#: Classes come in groups; a class has its group's probability times its own within the group.
GROUP, GROUPS = 16, 16
CLASSES = GROUP * GROUPS
#: The input in front of a text's first symbols.
PAD = CLASSES
#: Pseudo-counts that draw a class's transitions to the shares of all classes.
SMOOTHING = 20.0


def shapes(width: int = WIDTH) -> dict[str, tuple[int, ...]]:
    return {"embed": (CLASSES + 1, width), "near": (CONTEXT,), "query": (width, width), "key": (width, width), "value": (width, width), "out": (width, width), "groups": (width, GROUPS), "head": (GROUPS, width, GROUP)}


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the heads are 0, so to begin with the transitions alone count."""
    r = np.random.default_rng(seed)
    scale = {"embed": 0.3, "near": 0.1, "groups": 0.0, "head": 0.0}
    return {n: (r.standard_normal(s) * scale.get(n, 1 / np.sqrt(s[0]))).astype(np.float32) for n, s in shapes().items()}


def transitions(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs: of each group behind each input (CLASSES + 1, GROUPS), of each class within its group behind each
    input (CLASSES + 1, GROUPS, GROUP). ``pairs``: counts (CLASSES + 1, CLASSES)."""
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
    p = (pairs + SMOOTHING * share) / (pairs.sum(1, keepdims=True) + SMOOTHING)
    p = p.reshape(CLASSES + 1, GROUPS, GROUP)
    of_groups = p.sum(2)
    return np.log(of_groups).astype(np.float32), np.log(p / of_groups[..., None]).astype(np.float32)


#: Distance from each asking position back to each answering one; ahead is never seen.
_DISTANCE = BLOCK + np.arange(BLOCK)[:, None] - np.arange(CONTEXT)[None, :]
_SEEN = (_DISTANCE >= 0).astype(np.float32)
_DISTANCE = np.maximum(_DISTANCE, 0)


class Tables:
    """What depends on one symbol only, worked out once: scoring looks it up."""

    def __init__(self, p: dict[str, np.ndarray], logs: tuple[np.ndarray, np.ndarray]):
        n = p["embed"].shape[1]
        self.groups, self.head = p["groups"], p["head"]
        self.query = (p["embed"] @ p["query"]) / np.float32(np.sqrt(n))
        self.key = p["embed"] @ p["key"]
        self.value = p["embed"] @ p["value"] @ p["out"]
        self.near = np.exp(p["near"])[_DISTANCE] * _SEEN
        # what each symbol's answer weighs for each asking one, but for the distance; only shares of it count
        weighs = self.query @ self.key.T
        weighs -= np.maximum(weighs.max(1, keepdims=True) - 60, 0)
        self.weighs = np.exp(weighs).ravel()
        # the asking symbol's own part of the logits: its transitions and its embedding
        self.of_groups = logs[0] + p["embed"] @ p["groups"]
        self.within = (logs[1] + np.einsum("xw,gwc->xgc", p["embed"], p["head"])).reshape(-1, GROUP)

    def contexts(self, x: np.ndarray) -> np.ndarray:
        """What attention adds behind each position of the blocks ``x`` (n + 1 x BLOCK classes), but for the first
        block, in rows. Each block sees itself and the one before it."""
        x = np.ascontiguousarray(x, np.int64)
        a = self.weighs.take((x[1:] * (CLASSES + 1))[:, :, None] + _pairs(x)[:, None, :])
        a *= self.near
        total = a.reshape(-1, CONTEXT) @ np.ones(CONTEXT, a.dtype)
        total += 1e-30
        c = (a @ _pairs(self.value.take(x, 0))).reshape(-1, self.value.shape[1])
        c /= total[:, None]
        return c

    def log_probabilities(self, context: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target class behind its context and the input before it."""
        order = np.argsort(target.astype(np.uint8), kind="stable")
        context, before, target = context.take(order, 0), before[order], target[order]
        group = target >> 4
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        z = self.within.take(before * GROUPS + group, 0)
        for g in range(GROUPS):
            if ends[g] < ends[g + 1]:
                z[ends[g] : ends[g + 1]] += context[ends[g] : ends[g + 1]] @ self.head[g]
        of_groups = self.of_groups.take(before, 0)
        of_groups += context @ self.groups
        got = _log_softmax_at(z, target & (GROUP - 1)) + _log_softmax_at(of_groups, group)
        out = np.empty_like(got)
        out[order] = got
        return out


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row of ``z`` at one place; ``z`` is used up."""
    picked = z.ravel().take(np.arange(0, z.size, z.shape[1]) + at)
    if z.max(initial=0) > 60:
        top = z.max(1)
        picked -= top
        z -= top[:, None]
    np.exp(z, out=z)
    return picked - np.log(z @ np.ones(z.shape[1], z.dtype) + 1e-30)


def gradients(p: dict[str, np.ndarray], logs: tuple[np.ndarray, np.ndarray], x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the weighted positions and its gradient. ``x``: windows x CONTEXT, ``target``, ``weight``: x BLOCK."""
    at = (np.arange(len(x))[:, None] * CONTEXT + np.arange(BLOCK)).ravel()
    return block_gradients(p, logs, x.reshape(-1, BLOCK), at, target.ravel(), weight.ravel() / max(float(weight.sum()), 1.0))


def block_gradients(p: dict[str, np.ndarray], logs: tuple[np.ndarray, np.ndarray], x: np.ndarray, at: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted loss and its gradient. Each of the blocks ``x`` (n + 1 x BLOCK classes) but the first sees itself and
    the one before it; ``at``: the places in those n blocks that have a ``target`` of a ``weight``."""
    n, width, embed = len(x) - 1, p["embed"].shape[1], p["embed"]
    x = np.ascontiguousarray(x, np.int64)
    one, query_in, value_out = embed.dtype.type(1), p["query"] * embed.dtype.type(1 / np.sqrt(width)), p["value"] @ p["out"]
    # what depends on one symbol only is worked out once a class
    own = embed.take(x, 0)
    q, key, value = (embed @ query_in).take(x[1:], 0), (embed @ p["key"]).take(x, 0), (embed @ value_out).take(x, 0)
    k, v = _pairs(key), _pairs(value)
    a = q @ k.transpose(0, 2, 1)
    if a.max(initial=0) > 60:
        a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a *= np.exp(p["near"])[_DISTANCE] * _SEEN.astype(embed.dtype)
    # the weights stay as they are, what they give is divided by their sum
    share = one / (a.reshape(-1, CONTEXT) @ np.ones(CONTEXT, a.dtype) + embed.dtype.type(1e-30))[:, None]
    c = (a @ v).reshape(-1, width)
    c *= share
    order = np.argsort(target.astype(np.uint8), kind="stable")
    at, target, weight = at[order], target[order], weight[order].astype(embed.dtype)
    before, group = x[1:].ravel()[at], target // GROUP
    ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    state, g = embed.take(before, 0), {"head": np.zeros_like(p["head"])}
    state += c.take(at, 0)
    z = logs[0].take(before, 0)
    z += state @ p["groups"]
    loss, dz = _loss(z, group, weight)
    g["groups"], done = state.T @ dz, dz @ p["groups"].T
    z = logs[1].reshape(-1, GROUP).take(before * GROUPS + group, 0)
    of_groups = [(i, slice(low, high)) for i, (low, high) in enumerate(zip(ends, ends[1:])) if low < high]
    for i, those in of_groups:
        z[those] += state[those] @ p["head"][i]
    more, dz = _loss(z, target % GROUP, weight)
    for i, those in of_groups:
        np.matmul(state[those].T, dz[those], out=g["head"][i])
        done[those] += dz[those] @ p["head"][i].T
    asked = np.zeros_like(c)
    asked[at] = done
    dc = asked * share
    lost, dc = (dc * c) @ np.ones(width, c.dtype), dc.reshape(n, BLOCK, width)
    da = dc @ v.transpose(0, 2, 1)
    da -= lost.reshape(n, BLOCK, 1)
    da *= a
    g["near"] = np.bincount(_DISTANCE.ravel(), np.ones(n, da.dtype) @ da.reshape(n, -1), CONTEXT).astype(embed.dtype)
    dq, dk, dv = (da @ k).reshape(-1, width), _both(da.transpose(0, 2, 1) @ q), _both(a.transpose(0, 2, 1) @ dc)
    own = own.reshape(-1, width)
    g["query"], g["key"], of_values = own[BLOCK:].T @ dq, own.T @ dk, own.T @ dv
    g["query"] *= embed.dtype.type(1 / np.sqrt(width))
    g["value"], g["out"] = of_values @ p["out"].T, p["value"].T @ of_values
    rows = dk @ p["key"].T
    rows += dv @ value_out.T
    rows[BLOCK:] += dq @ query_in.T
    rows[BLOCK:] += asked
    g["embed"] = _by_class(x.ravel(), rows)
    return loss + more, g


def _pairs(m: np.ndarray) -> np.ndarray:
    """Each block of ``m`` (n + 1 x BLOCK x ...) but the first with the one before it, as a view."""
    return np.lib.stride_tricks.as_strided(m, (len(m) - 1, CONTEXT, *m.shape[2:]), m.strides, writeable=False)


def _both(d: np.ndarray) -> np.ndarray:
    """What each symbol gets from both windows it answers in, in rows. ``d``: n x CONTEXT x width."""
    out = np.empty((len(d) + 1, BLOCK, d.shape[2]), d.dtype)
    out[0], out[-1] = d[0, :BLOCK], d[-1, BLOCK:]
    np.add(d[:-1, BLOCK:], d[1:, :BLOCK], out=out[1:-1])
    return out.reshape(-1, d.shape[2])


def _loss(z: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted negative log-softmax of the rows of ``z`` at one place each, and its gradient; ``z`` is used up."""
    own = np.arange(0, z.size, z.shape[1]) + at
    if z.max(initial=0) > 60:
        z -= z.max(1, keepdims=True)
    picked = z.ravel().take(own)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype) + z.dtype.type(1e-30)
    z *= (weight / total)[:, None]
    z.reshape(-1)[own] -= weight
    return float(((np.log(total) - picked) * weight).sum()), z


def _by_class(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` by class."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    own = at[order].astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    out = np.zeros((CLASSES + 1, rows.shape[1]), rows.dtype)
    out[own[first]] = np.add.reduceat(rows.take(order, 0), first, axis=0)
    return out


class Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.step, self.m, self.v = rate, 0, np.float32(0), np.float32(0)

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.step += 1
        d = np.concatenate([g[n].ravel() for n in p])
        self.m = 0.9 * self.m + 0.1 * d
        self.v = 0.99 * self.v + 0.01 * d * d
        d = (self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)
        at = 0
        for w in p.values():
            w -= d[at : at + w.size].reshape(w.shape)
            at += w.size


def windows(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For sequences of ``lengths`` symbols to score each: where the symbols' inputs go in one padded array - every
    sequence is a block of padding, then its inputs, filled up to whole blocks - and the number of its places. A window
    is a block and the one before it."""
    blocks = 1 + -(-lengths // BLOCK)
    begin = (np.cumsum(blocks) - blocks) * BLOCK
    first = np.cumsum(lengths) - lengths
    return np.repeat(begin + BLOCK - first, lengths) + np.arange(int(lengths.sum())), int(blocks.sum()) * BLOCK
