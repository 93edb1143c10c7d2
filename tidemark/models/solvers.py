"""Numeric solvers on numpy arrays; nothing of Spark."""

from __future__ import annotations

import numpy as np


def elastic_net(gram: np.ndarray, target: np.ndarray, n: float, alpha: float, l1_ratio: float, positive: bool = True, max_iter: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Weights w [B, N] of B problems at once: min 1/(2n) |y - X w|^2 + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|^2.

    gram [B, N, N] = X'X, target [B, N] = X'y. Coordinates with a zero diagonal keep weight 0.
    """
    b, size = target.shape
    out = np.zeros((b, size))
    if not b:
        return out
    # problems stand last, so that a step reads neighbouring numbers; those that are done leave
    alive, gram, target = np.arange(b), np.ascontiguousarray(gram.transpose(2, 1, 0)), np.ascontiguousarray(target.T)
    w, fitted = np.zeros((size, b)), np.zeros((size, b))  # fitted: gram @ w
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
    diagonal = np.einsum("iib->ib", gram)
    for _ in range(max_iter):
        moved = np.zeros(len(alive))
        for i in range(size):
            d = diagonal[i]
            rest = target[i] - fitted[i] + d * w[i]
            fresh = np.maximum(rest - l1, 0) if positive else np.sign(rest) * np.maximum(np.abs(rest) - l1, 0)
            fresh = np.where(d > 0, fresh / np.maximum(d + l2, 1e-300), 0.0)
            step = fresh - w[i]
            if step.any():
                fitted += gram[i] * step
                w[i] = fresh
                moved = np.maximum(moved, np.abs(step))
        left = moved > tol * np.maximum(np.abs(w).max(axis=0, initial=0), 1e-12)
        if not left.any():
            break
        if left.sum() < 0.8 * len(alive):
            out[alive[~left]] = w[:, ~left].T
            alive, gram, target, w, fitted = alive[left], gram[:, :, left], target[:, left], w[:, left], fitted[:, left]
            diagonal = np.einsum("iib->ib", gram)
    out[alive] = w.T
    return out


def elastic_net_sgd(gram: np.ndarray, target: np.ndarray, n: float, alpha: float, l1_ratio: float, positive: bool = True, max_iter: int = 100, eta0: float = 0.001, tol: float = 1e-4) -> np.ndarray:
    """The same objective by proximal gradient steps with inverse-scaled rates, scaled to the problem's curvature."""
    b, size = target.shape
    w = np.zeros((b, size))
    curve = np.abs(gram).sum(axis=2).max(axis=1, initial=1e-12) / n + alpha * (1 - l1_ratio)
    for t in range(1, max_iter * 10 + 1):
        grad = (np.einsum("bij,bj->bi", gram, w) - target) / n + alpha * (1 - l1_ratio) * w
        rate = (1 / curve)[:, None] * max(eta0, t**-0.1)
        fresh = w - rate * grad
        cut = rate * alpha * l1_ratio
        fresh = np.maximum(fresh - cut, 0) if positive else np.sign(fresh) * np.maximum(np.abs(fresh) - cut, 0)
        done = np.abs(fresh - w).max(initial=0) < tol * 1e-2
        w = fresh
        if done:
            break
    return w


def elastic_net_columns(columns: list[tuple[np.ndarray, np.ndarray]], target: tuple[np.ndarray, np.ndarray], n: float, alpha: float, l1_ratio: float, positive: bool = True, max_iter: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Weights of one problem, the same objective as elastic_net, on sparse columns (rows, values) instead of products.

    Sweeps go over all columns until nothing new becomes active, and in between over the active ones alone.
    """
    w = np.zeros(len(columns))
    rest = np.zeros(1 + max([int(c[0].max(initial=-1)) for c in columns] + [int(target[0].max(initial=-1))]))
    rest[target[0]] = target[1]
    diagonal = np.array([v @ v for _, v in columns])
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
    every, active = np.flatnonzero(diagonal > 0), None
    for _ in range(max_iter):
        moved = 0.0
        for i in (every if active is None else active).tolist():
            rows, value = columns[i]
            z = value @ rest[rows] + diagonal[i] * w[i]
            fresh = max(z - l1, 0.0) if positive else np.sign(z) * max(abs(z) - l1, 0.0)
            fresh /= diagonal[i] + l2
            if fresh != w[i]:
                rest[rows] -= (fresh - w[i]) * value
                moved = max(moved, abs(fresh - w[i]))
                w[i] = fresh
        if moved <= tol * max(np.abs(w).max(initial=0), 1e-12):
            if active is None:
                break
            active = None
        else:
            active = np.flatnonzero(w)
    return w


class Factors:
    """Embeddings and biases of features, trained by pairwise ranking with sampled negatives and Adagrad."""

    def __init__(self, n_user: int, n_item: int, dim: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        scale = 1.0 / dim
        self.user = ((rng.random((n_user, dim)) - 0.5) * scale).astype(np.float32)
        self.item = ((rng.random((n_item, dim)) - 0.5) * scale).astype(np.float32)
        self.user_bias, self.item_bias = np.zeros(n_user, np.float32), np.zeros(n_item, np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.user, self.item, self.user_bias, self.item_bias]


class Steps:
    """Parameters with what the step sizes are made of: sums of squares (adagrad), or running means (adadelta)."""

    def __init__(self, p: list[np.ndarray], schedule: str = "adagrad", rate: float = 0.05, rho: float = 0.95, epsilon: float = 1e-6):
        self.p, self.schedule, self.rate, self.rho, self.epsilon = p, schedule, rate, rho, epsilon
        self.squares = [np.zeros_like(a) for a in p]
        self.moves = [np.zeros_like(a) for a in p] if schedule == "adadelta" else None
        self.used = [np.zeros(len(a), np.int64) for a in p]

    def all(self) -> list[list[np.ndarray]]:
        return [self.p, self.squares, *([self.moves] if self.moves is not None else [])]

    def copy(self) -> Steps:
        out = Steps([a.copy() for a in self.p], self.schedule, self.rate, self.rho, self.epsilon)
        out.squares = [a.copy() for a in self.squares]
        out.moves = None if self.moves is None else [a.copy() for a in self.moves]
        return out

    def take(self, which: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """One step against the gradient, summed by row, for one kind of parameters."""
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        rows, many = rows[order][first], np.diff(np.append(first, len(rows)))
        grad = np.add.reduceat(grad[order], first, axis=0).astype(np.float32)
        self.used[which][rows] += many
        h = self.squares[which]
        if self.moves is None:
            h[rows] += grad * grad
            self.p[which][rows] -= self.rate * grad / np.sqrt(h[rows] + 1e-6)
            return
        d = self.moves[which]
        h[rows] = self.rho * h[rows] + (1 - self.rho) * grad * grad
        move = np.sqrt(d[rows] + self.epsilon) / np.sqrt(h[rows] + self.epsilon) * grad
        d[rows] = self.rho * d[rows] + (1 - self.rho) * move * move
        self.p[which][rows] -= move


class Entities:
    """The features of some entities, and the sums of their parameters."""

    def __init__(self, steps: Steps, which: int, side: tuple[np.ndarray, np.ndarray, int], chosen: np.ndarray):
        start, features, _ = side
        length = start[chosen + 1] - start[chosen]
        before = np.cumsum(length) - length
        self.owner = np.repeat(np.arange(len(chosen)), length)
        self.rows = features[np.repeat(start[chosen] - before, length) + np.arange(length.sum())]
        self.vec = np.add.reduceat(steps.p[which][self.rows], before, axis=0)
        self.bias = np.add.reduceat(steps.p[2 + which][self.rows], before)


def train_pairs(
    steps: Steps, sides: list[tuple[np.ndarray, np.ndarray, int]], user: np.ndarray, item: np.ndarray, weight: np.ndarray, loss: str = "warp",
    max_sampled: int = 10, user_l2: float = 1e-7, item_l2: float = 1e-7, seed: int = 0, block: int = 32,
) -> None:
    """One epoch over pairs, in place, `block` pairs a step. sides: (starts, features, entities) of users and items,
    each entity with one feature at least; the pairs are sorted.

    warp: of max_sampled negatives the first that outranks the positive counts; the step grows with the rank that this
    implies. bpr: one negative, logistic step. logistic: signs of the weights as labels.
    """
    rng = np.random.default_rng(seed)
    n_items = sides[1][2]
    seen = user.astype(np.int64) * n_items + item
    order = rng.permutation(len(user))
    if loss != "logistic":
        order = order[weight[order] > 0]
    draws = max_sampled if loss == "warp" else 1
    for at in range(0, len(order), block):
        chosen = order[at : at + block]
        u, i, w = user[chosen], item[chosen], weight[chosen]
        users, items = Entities(steps, 0, sides[0], u), Entities(steps, 1, sides[1], i)
        score = np.einsum("bd,bd->b", users.vec, items.vec) + users.bias + items.bias
        if loss == "logistic":
            push = (1 / (1 + np.exp(-score)) - (w > 0)) * np.abs(w)
            _step(steps, 0, users, push, items.vec, user_l2)
            _step(steps, 1, items, push, users.vec, item_l2)
            continue
        j = rng.integers(n_items, size=(len(u), draws))
        key = u[:, None].astype(np.int64) * n_items + j
        usable = seen[np.minimum(seen.searchsorted(key), len(seen) - 1)] != key
        drawn = Entities(steps, 1, sides[1], j.ravel())
        other = np.einsum("bd,bsd->bs", users.vec, drawn.vec.reshape(len(u), draws, -1)) + users.bias[:, None] + drawn.bias.reshape(len(u), draws)
        if loss == "warp":
            usable &= other > score[:, None] - 1
        first = usable.argmax(axis=1)
        push = np.minimum(w * np.log(np.maximum(1.0, (n_items - 1) // (first + 1))), 10.0) if loss == "warp" else w * (1 - 1 / (1 + np.exp(-(score - other[:, 0]))))
        push = np.where(usable.any(axis=1), push, 0.0)
        taken = push > 0
        if not taken.any():
            continue
        u, i, j, push = u[taken], i[taken], j[taken, first[taken]], push[taken]
        users, pair = Entities(steps, 0, sides[0], u), Entities(steps, 1, sides[1], np.concatenate([i, j]))
        _step(steps, 0, users, push, pair.vec[len(i) :] - pair.vec[: len(i)], user_l2, bias=False)
        _step(steps, 1, pair, np.concatenate([-push, push]), np.vstack([users.vec, users.vec]), item_l2)


def _step(steps: Steps, which: int, entities: Entities, push: np.ndarray, toward: np.ndarray, l2: float, bias: bool = True) -> None:
    grad = (push[:, None] * toward)[entities.owner] + l2 * steps.p[which][entities.rows]
    steps.take(which, entities.rows, grad)
    if bias:
        steps.take(2 + which, entities.rows, push[entities.owner])
