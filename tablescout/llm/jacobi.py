"""Leading eigenpairs of a symmetric matrix that is known only by its products: Jacobi-Davidson.

A small basis is kept and multiplied once. Each round takes the Ritz pairs of the basis (Rayleigh-
Ritz), locks the leading ones whose residual is as small as rounding allows, and widens the basis by
the corrections of the others. A correction solves ``(I - QQ')(A - theta I)(I - QQ') t = -r``, with
``Q`` the locked and the current vectors, by a few steps of MINRES; the equations of one round are
stepped together, so that each step is one product with a narrow block.

All arrays here have as many rows as the matrix has dimensions; what a product costs is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]

#: A residual counts as zero below this part of the largest eigenvalue.
TOLERANCE = 2e-14
#: MINRES steps for a correction, and the part of the right-hand side at which a solution is good enough.
STEPS, ENOUGH = 10, 1e-2
#: The basis is cut back to the leading Ritz vectors when it is wider than this many of them.
WIDEST, KEPT = 16, 4
#: Rounds without a better residual after which the one reached is the best that rounding allows.
PATIENCE = 4


def _orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``columns`` add to the orthonormal ``against``; dependent ones drop out."""
    kept = np.zeros((len(columns), 0))
    for column in columns.T:
        size = np.linalg.norm(column)
        if size == 0.0 or not np.isfinite(size):
            continue
        column = column / size
        for _ in range(2):
            column = column - against @ (against.T @ column)
            column = column - kept @ (kept.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-8:
                break
            column = column / left
        else:
            kept = np.column_stack([kept, column])
    return kept


def minres(apply: Product, right: np.ndarray, steps: int = STEPS, enough: float = ENOUGH) -> np.ndarray:
    """Approximate solutions of ``apply(x) = right``, column by column, stepped together."""
    norm = np.linalg.norm(right, axis=0)
    beta = norm.copy()
    v = right / np.where(beta > 0, beta, 1.0)
    v_old, w_old, w, x = (np.zeros_like(right) for _ in range(4))
    eta = beta.copy()
    cos_old, cos, sin_old, sin = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    open_ = beta > 0
    for _ in range(steps):
        if not open_.any():
            break
        av = apply(v)
        delta = (v * av).sum(axis=0)
        v_new = av - delta * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        first = cos * delta - cos_old * sin * beta
        length = np.sqrt(first * first + beta_new * beta_new)
        open_ &= length > 0
        safe = np.where(length > 0, length, 1.0)
        w_new = (v - sin_old * beta * w_old - (sin * delta + cos_old * cos * beta) * w) / safe
        cos_old, cos, sin_old, sin = cos, first / safe, sin, beta_new / safe
        x = x + np.where(open_, cos * eta, 0.0) * w_new
        eta = -sin * eta
        open_ = open_ & (np.abs(eta) > enough * norm) & (beta_new > 1e-14 * norm)
        v_old, v, beta = v, v_new / np.where(beta_new > 0, beta_new, 1.0), beta_new
        w_old, w = w, w_new
    return x


def leading(product: Product, dims: int, count: int, seed: int = 7, tolerance: float = TOLERANCE,
            rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (falling) and their unit vectors, as columns."""
    count = min(count, dims)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dims, min(dims, 2 * count))), np.zeros((dims, 0)))
    image = product(basis)
    locked = locked_image = np.zeros((dims, 0))
    largest, best, waited = 0.0, np.inf, 0
    for _ in range(rounds):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        largest = max(largest, float(np.abs(values).max(initial=0.0)))
        wanted = min(count - locked.shape[1], basis.shape[1])
        residual = image[:, :wanted] - basis[:, :wanted] * values[:wanted]
        sizes = np.linalg.norm(residual, axis=0)
        whole = basis.shape[1] + locked.shape[1] == dims  # nothing is left to widen the basis by
        improved = sizes[0] < 0.5 * best
        best, waited = (sizes[0], 0) if improved else (best, waited + 1)
        done = 0
        while done < wanted and (sizes[done] <= tolerance * largest or whole or (
                done == 0 and waited >= PATIENCE and sizes[0] <= 100 * tolerance * largest)):
            done += 1
        if done:
            locked, locked_image = np.column_stack([locked, basis[:, :done]]), np.column_stack([locked_image, image[:, :done]])
            basis, image, values, residual = basis[:, done:], image[:, done:], values[done:], residual[:, done:]
            best, waited = np.inf, 0
            if locked.shape[1] == count:
                break
        wanted = min(count - locked.shape[1], basis.shape[1])
        if basis.shape[1] > WIDEST * count:
            basis, image = basis[:, : KEPT * count], image[:, : KEPT * count]
        theta = values[:wanted]
        known = np.column_stack([locked, basis[:, :wanted]])

        def projected(block: np.ndarray) -> np.ndarray:
            return block - known @ (known.T @ block)

        def correction(block: np.ndarray) -> np.ndarray:
            block = projected(block)
            return projected(product(block) - block * theta)

        wider = _orthonormal(np.column_stack([minres(correction, -projected(residual)), residual]), np.column_stack([locked, basis]))
        if not wider.shape[1]:  # a closed subspace: go on with a direction outside it
            fresh = np.random.default_rng(seed + locked.shape[1] + basis.shape[1]).standard_normal((dims, 1))
            wider = _orthonormal(fresh, np.column_stack([locked, basis]))
        basis, image = np.column_stack([basis, wider]), np.column_stack([image, product(wider)])
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    small = locked.T @ locked_image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], locked @ turn[:, ::-1]
