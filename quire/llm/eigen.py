"""Eigenvectors of symmetric matrices in mixed precision."""

from __future__ import annotations

import numpy as np

#: The higher precision: numpy's widest float, 64 bits of fraction on most machines.
WIDE = np.longdouble
UNIT = float(np.finfo(WIDE).eps)


def eigenpairs(matrix: np.ndarray, rounds: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit eigenvectors (as columns) of a symmetric matrix, in ``WIDE``.

    The eigenvectors that a single-precision solver finds are corrected by the iteration of Ogita and
    Aishima, which is matrix products in the higher precision. With R = I - X'X and S = X'AX, an
    eigenvalue is s_ii / (1 - r_ii), and X becomes X + XE, where E has (s_ij + l_j r_ij) / (l_j - l_i) for
    eigenvalues that are apart by more than the residuals allow, else r_ij / 2. Each round about
    doubles the digits. Eigenvalues that are not apart are clusters: of the matrix shifted by a
    cluster's centre and projected on its vectors, the same is done anew, in which they are apart; its
    eigenvectors turn those of the cluster.
    """
    matrix = np.asarray(matrix, WIDE)
    matrix = (matrix + matrix.T) / 2
    size = len(matrix)
    middle = np.trace(matrix) / max(size, 1)
    own = matrix - middle * np.eye(size, dtype=WIDE)
    scale = np.max(np.abs(own), initial=WIDE(0))
    if size < 2 or not scale:
        return np.diag(matrix).copy(), np.eye(size, dtype=WIDE)
    own = own / scale
    vectors = np.linalg.eigh(own.astype(np.float32))[1].astype(WIDE)
    solved: set[tuple[int, int]] = set()
    last, near = np.inf, -1
    for done in range(rounds):
        values, vectors, apart, step, close = _corrected(own, vectors)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        turned = False
        if done:  # the first round makes the vectors of a cluster its own
            for first, end in _clusters(values, apart):
                if (first, end) not in solved and end - first < size:
                    solved.add((first, end))
                    part = vectors[:, first:end]
                    centre = values[first:end].mean()
                    turn = eigenpairs(part.T @ (own @ part - centre * part), rounds)[1]
                    vectors[:, first:end] = part @ turn
                    turned = True
        # What is left is rounding once a round with the same clusters brings no more digits.
        if not turned and close == near and (step <= 8 * UNIT or step >= last / 2):
            break
        last, near = step, -1 if turned else close
    values, vectors, *_ = _corrected(own, vectors)
    vectors = vectors + vectors @ (np.eye(size, dtype=WIDE) - vectors.T @ vectors) / 2
    order = np.argsort(-values, kind="stable")
    return values[order] * scale + middle, vectors[:, order]


def _corrected(own: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, WIDE, float, int]:
    """Eigenvalues, corrected vectors, by how much eigenvalues must be apart, the largest correction, and
    how many pairs are not apart."""
    image = own @ vectors
    rest = np.eye(len(own), dtype=WIDE) - vectors.T @ vectors
    inner = vectors.T @ image
    inner = (inner + inner.T) / 2
    values = np.diag(inner) / (1 - np.diag(rest))
    off = inner - np.diag(np.diag(inner))
    # Frobenius norms, which bound the spectral ones; no less than what rounding does.
    size = np.sqrt((own * own).sum())
    apart = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((rest * rest).sum())) + 4 * UNIT * size
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > apart
    change = np.where(far, (inner + values[None, :] * rest) / np.where(far, gap, WIDE(1)), rest / 2)
    np.fill_diagonal(change, np.diag(rest) / 2)
    return values, vectors + vectors @ change, apart, float(np.max(np.abs(change))), int((~far).sum())


def _clusters(values: np.ndarray, apart: WIDE) -> list[tuple[int, int]]:
    """Stretches of at least two of the falling eigenvalues whose neighbours are not apart."""
    cuts = np.concatenate([[0], np.flatnonzero(-np.diff(values) > apart) + 1, [len(values)]])
    return [(int(a), int(b)) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
