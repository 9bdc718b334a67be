"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The signs of the pivots of LDL' of a shifted matrix count the eigenvalues above the shift (Sylvester's
law of inertia). Bisection on these counts isolates each leading eigenvalue, Rayleigh quotient iteration
converges to its vector, and two more counts certify its number. The matrix has the size of one
vector's covariance, so this runs where the matrix is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = float(np.finfo(np.float64).eps)
PIVOT = (1 + 17 ** 0.5) / 8


@dataclass
class Factors:
    """P A P' = L D L' with pivots of one or two rows (complete pivoting)."""

    lower: np.ndarray
    blocks: list[tuple[int, np.ndarray]]
    order: np.ndarray
    positive: int

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = np.asarray(b, dtype=np.float64)[self.order].copy()
        n = x.size
        for k in range(n):
            x[k + 1:] -= self.lower[k + 1:, k] * x[k]
        for k, block in self.blocks:
            w = block.shape[0]
            x[k:k + w] = np.linalg.solve(block, x[k:k + w])
        for k in range(n - 1, -1, -1):
            x[k] -= self.lower[k + 1:, k] @ x[k + 1:]
        out = np.empty(n)
        out[self.order] = x
        return out


def factor(matrix: np.ndarray, shift: float) -> Factors:
    """LDL' of matrix - shift * I; `positive` is the number of eigenvalues above the shift."""
    a = np.array(matrix, dtype=np.float64)
    n = a.shape[0]
    a[np.diag_indices(n)] -= shift
    tiny = EPS * EPS * (float(np.abs(a).max(initial=0.0)) + abs(shift)) or np.finfo(np.float64).tiny
    lower, order, blocks, positive, k = np.eye(n), np.arange(n), [], 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], k:] = a[[j, i], k:]
            a[k:, [i, j]] = a[k:, [j, i]]
            lower[[i, j], :k] = lower[[j, i], :k]
            order[[i, j]] = order[[j, i]]

    while k < n:
        rest = np.abs(a[k:, k:])
        diagonal = np.diagonal(rest)
        r = int(diagonal.argmax())
        off = np.tril(rest, -1)
        i, j = divmod(int(off.argmax()), n - k)
        if diagonal[r] >= PIVOT * off[i, j] or k == n - 1:
            swap(k, k + r)
            d = a[k, k] if abs(a[k, k]) > tiny else tiny  # an exact hit counts as above the shift
            positive += d > 0
            column = a[k + 1:, k] / d
            lower[k + 1:, k] = column
            a[k + 1:, k + 1:] -= np.outer(column, a[k, k + 1:])
            blocks.append((k, np.array([[d]])))
            k += 1
        else:
            low, high = k + min(i, j), k + max(i, j)
            swap(k, low)
            swap(k + 1, high)
            block = a[k:k + 2, k:k + 2].copy()
            positive += int((np.linalg.eigvalsh(block) > 0).sum())
            columns = np.linalg.solve(block, a[k:k + 2, k + 2:]).T
            lower[k + 2:, k:k + 2] = columns
            a[k + 2:, k + 2:] -= columns @ a[k:k + 2, k + 2:]
            blocks.append((k, block))
            k += 2
    return Factors(lower, blocks, order, int(positive))


def quotient(matrix: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """Rayleigh quotient of a unit vector and the norm of its residual, in extended precision."""
    wide = v.astype(np.longdouble)
    image = matrix.astype(np.longdouble) @ wide
    rho = (wide @ image) / (wide @ wide)
    return float(rho), float(np.linalg.norm((image - rho * wide).astype(np.float64)))


@dataclass
class Spectrum:
    values: np.ndarray
    #: One column for each value.
    vectors: np.ndarray
    #: (eigenvalues above value + width, eigenvalues above value - width, width) of each value.
    certificates: list[tuple[int, int, float]]


def leading(matrix: np.ndarray, k: int, seed: int = 1) -> Spectrum:
    """The k largest positive eigenvalues, falling, with orthonormal vectors.

    Eigenvalues that rounding cannot tell from zero are left out, so that a matrix of rank r gives at
    most r. Equal eigenvalues get any orthonormal vectors of their space.
    """
    matrix = (np.asarray(matrix, dtype=np.float64) + np.asarray(matrix, dtype=np.float64).T) / 2
    n = matrix.shape[0]
    none = Spectrum(np.zeros(0), np.zeros((n, 0)), [])
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if bound == 0.0:
        return none
    width = 4 * n * EPS * bound
    seen: list[tuple[float, int]] = [(2 * bound, 0), (width, factor(matrix, width).positive)]
    random = np.random.default_rng(seed)
    values, vectors, certificates = [], np.zeros((n, 0)), []

    def above(shift: float) -> int:
        count = factor(matrix, shift).positive
        seen.append((shift, count))
        return count

    def away(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - vectors @ (vectors.T @ v)
        size = np.linalg.norm(v)
        return v / size if size > 0 else away(random.standard_normal(n))

    for number in range(1, min(k, seen[1][1]) + 1):
        while True:
            low = max(s for s, c in seen if c >= number)
            high = min(s for s, c in seen if c < number and s > low)
            alone = next(c for s, c in seen if s == low) == number and next(c for s, c in seen if s == high) == number - 1
            tight = high - low <= width
            if not (alone or tight):
                above((low + high) / 2)
                continue
            v = away(random.standard_normal(n))
            rho = (low + high) / 2
            v = away(factor(matrix, rho).solve(v))
            best = (np.inf, rho, v)
            for _ in range(30):
                rho, residual = quotient(matrix, v)
                if residual < best[0]:
                    best = (residual, rho, v)
                elif best[0] <= width:
                    break
                if not low - width <= rho <= high + width:  # pulled to a neighbour: solve at the middle again
                    rho = (low + high) / 2
                v = away(factor(matrix, rho).solve(v))
            residual, rho, v = best
            slack = max(residual, width)
            if low - width <= rho <= high + width and residual <= 64 * width:
                over, under = factor(matrix, rho + slack).positive, factor(matrix, rho - slack).positive
                if over < number <= under:
                    break
            if tight:
                raise ArithmeticError(f"eigenvalue {number} does not settle between {low} and {high}")
            above((low + high) / 2)
        values.append(rho)
        vectors = np.column_stack([vectors, v])
        certificates.append((over, under, slack))
    return Spectrum(np.array(values), vectors, certificates)
