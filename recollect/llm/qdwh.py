"""Eigenvectors of a symmetric matrix by spectral divide and conquer on polar decompositions.

The polar factor U of A - s I has the eigenvalues 1 and -1, for those of A above and below s; (U + I) / 2 projects on the
first subspace. An orthogonal basis of it and of its complement turns A into two blocks, which are split again
until a block is diagonal to working precision. U comes from the QR form of the dynamically weighted Halley
iteration, which needs no inverse and at most six or seven steps.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo("f8").eps)
STEPS = 40
TRIES = 8


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix that isn't zero."""
    d = len(a)
    x = a / np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max())
    low = max(EPS, 0.9 / (np.sqrt(d) * np.abs(np.linalg.inv(x)).sum(0).max())) if np.linalg.cond(x, 1) < 1 / EPS else EPS
    one = np.eye(d)
    for _ in range(STEPS):
        square = min(low, 1.0) ** 2
        root = np.cbrt(4 * (1 - square) / square**2)
        first = np.sqrt(1 + root)
        wa = first + 0.5 * np.sqrt(max(8 - 4 * root + 8 * (2 - square) / (square * first), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
        after = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        after = (after + after.T) / 2
        step = np.linalg.norm(after - x)
        x, low = after, min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if step <= (4 * EPS) ** (1 / 3) and 1 - low <= 10 * EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthogonal basis, its first ``rank`` columns of the projector's range: columns pivoted by what is left of them."""
    left, chosen = projector.copy(), []
    for _ in range(rank):
        norms = (left * left).sum(0)
        norms[chosen] = -1
        chosen.append(int(norms.argmax()))
        v = left[:, chosen[-1]] / np.linalg.norm(left[:, chosen[-1]])
        left -= np.outer(v, v @ left)
    q, _ = np.linalg.qr(projector[:, chosen], mode="complete")
    # A second pass of the projector makes the range exact to rounding.
    q, _ = np.linalg.qr(np.hstack([projector @ q[:, :rank], q[:, rank:]]))
    return q


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """A basis of two invariant subspaces, the upper one first, and its size; None if no shift parts the block."""
    diagonal = np.sort(np.diag(a))
    centre = float(np.median(diagonal))
    spread = max(float(np.linalg.norm(a - centre * np.eye(len(a)))), EPS * scale)
    best = None
    for k in range(TRIES):
        shift = centre + spread * (0, 0.003, -0.003, 0.05, -0.05, 0.3, -0.3, 0.6)[k]
        moved = a - shift * np.eye(len(a))
        if not np.abs(moved).max():
            continue
        projector = (polar(moved) + np.eye(len(a))) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < len(a):
            continue
        basis = _basis(projector, rank)
        error = float(np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank]))
        if best is None or error < best[0]:
            best = (error, basis, rank)
        if error <= 10 * EPS * scale * len(a):
            break
    return None if best is None else best[1:]


def _rotation(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a block of two, the upper one first."""
    angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, -s], [s, c]])


def components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of symmetric ``a``, falling, and unit eigenvectors as columns.

    The upper of two blocks is split first, and no block below the last wanted eigenvalue at all.
    Equal eigenvalues give some orthogonal basis of their space.
    """
    a = (a + a.T) / 2
    scale = float(np.linalg.norm(a))
    wanted = min(wanted, len(a))
    blocks, found = [np.eye(len(a))], []
    while blocks and len(found) < wanted:
        basis = blocks.pop()
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        apart = inner - np.diag(np.diag(inner))
        if np.linalg.norm(apart) <= EPS * scale:
            order = np.argsort(-np.diag(inner), kind="stable")
            found.extend(basis[:, i] for i in order)
        elif len(inner) == 2:
            found.extend((basis @ _rotation(inner)).T)
        elif (parted := _split(inner, scale)) is None:
            raise ArithmeticError(f"no shift parts a block of {len(inner)}")
        else:
            q, rank = parted
            blocks += [basis @ q[:, rank:], basis @ q[:, :rank]]
    vectors = np.array(found[:wanted]).reshape(-1, len(a)).T
    vectors, r = np.linalg.qr(vectors)
    vectors = vectors * np.sign(np.diag(r))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]
