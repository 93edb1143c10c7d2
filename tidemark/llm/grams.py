"""A character model of fixed size: counts of all grams of 1 to 3 characters, by fold, in a count-min sketch.

Single characters have a cell each; pairs and triples have two cells each, chosen by two hashes, of which the lower
counts. Every gram of every record is counted, however rare; what is bounded is the number of cells, at most
1,114,112 + 4 CELLS of FOLDS counts. A gram is never counted too low, and too high only where both of its cells are
shared; a gram counts no more than the shorter grams within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .chains import Flat

#: Cells of each hash of pairs and triples.
CELLS = 1 << 20
#: Parts of the records; each is judged by the counts of the others.
FOLDS = 8
#: Weight of the shorter context, and of a character never seen.
WEIGHT, NEW = 2.0, 0.05
_BITS = 21
_LOW = (1 << _BITS) - 1
_HASHES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Characters scored at once.
PIECE = 1 << 20


def _seen_as() -> np.ndarray:
    """How the model sees characters of the first plane: kinds of blanks as blanks, digits as 0."""
    out = np.arange(65537, dtype=np.uint32)
    for c in range(65536):
        if chr(c).isdecimal():
            out[c] = 0x30
    out[[9, 10, 11, 12, 13]] = 32
    return out


_SEEN_AS = _seen_as()
_UPPER = np.array([chr(c).isupper() for c in range(65537)])
_LOWER = np.array([chr(c).islower() or chr(c).istitle() and not chr(c).isupper() for c in range(65537)])
_TO_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(65537)], np.uint32)


def _plane(points: np.ndarray) -> np.ndarray:
    return np.minimum(points, 65536)


def seen(points: np.ndarray) -> np.ndarray:
    return np.where(points < 65536, _SEEN_AS[_plane(points)], points)


def _keys(n: int, code: np.ndarray) -> list[np.ndarray]:
    """The cells of grams of n characters, numbered through: one for each hash."""
    if n == 1:
        return [code.astype(np.int64)]
    shift = np.uint64(64 - (CELLS.bit_length() - 1))
    return [((2 * n - 3 + h) << _BITS) | ((code.astype(np.uint64) * m) >> shift).astype(np.int64) for h, m in enumerate(_HASHES)]


def count_grams(texts: list[str], folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, counts [cell, fold]) of all grams of the texts; runs of blanks count as one, ends as blanks."""
    cells, amounts, of = [], [], []
    for k in sorted(set(folds)):
        joined = "".join(f" {t} \x00\x00" for t, f in zip(texts, folds) if f == k)
        c = seen(np.frombuffer(joined.encode("utf_32_le", "surrogatepass"), np.uint32)).astype(np.int64)
        blank = c == 32
        c = c[~(blank & np.append(False, blank[:-1]))]
        code = (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:]
        found = pa.array(code[c[:-2] != 0]).value_counts()
        code, many = found.field("values").to_numpy(), found.field("counts").to_numpy()
        # triples with a NUL only end a text: the shorter grams within them are whole
        for n in (1, 2, 3):
            part = code >> (3 - n) * _BITS
            whole = (part & _LOW) != 0 if n == 1 else ((part & _LOW) != 0) & (((part >> _BITS) & _LOW) != 0)
            part, index = np.unique(part[whole], return_inverse=True)
            sums = np.bincount(index, many[whole], len(part))
            for key in _keys(n, part):
                cells.append(key)
                amounts.append(sums)
                of.append(np.full(len(key), k))
    if not cells:
        return np.zeros(0, np.int64), np.zeros((0, FOLDS))
    cell, index = np.unique(np.concatenate(cells), return_inverse=True)
    counts = np.bincount(index * FOLDS + np.concatenate(of), np.concatenate(amounts), len(cell) * FOLDS)
    return cell, counts.reshape(len(cell), FOLDS)


class Model:
    """Interpolated log probabilities of characters given the two before, in FOLDS + 1 columns: by the counts of the
    other folds, and last by all counts."""

    def __init__(self, cell: np.ndarray, counts: np.ndarray):
        whole = counts.sum(axis=1, keepdims=True)
        self.left = np.vstack([np.hstack([whole - counts, whole]), np.zeros((1, FOLDS + 1))]).astype(np.float32)
        table, place = cell >> _BITS, cell & _LOW
        self.rows = [np.full(size, len(cell), np.int32) for size in (0x110000, *[CELLS] * 4)]
        for t, rows in enumerate(self.rows):
            rows[place[table == t]] = np.flatnonzero(table == t)
        self.total = self.left[self.rows[0]].sum(axis=0, dtype=np.float64).astype(np.float32)
        self._known: dict[int, float] = {}

    def count(self, n: int, code: np.ndarray) -> np.ndarray:
        parts = [self.left[self.rows[0][k] if n == 1 else self.rows[2 * n - 3 + h][k & _LOW]] for h, k in enumerate(_keys(n, code))]
        return parts[0] if n == 1 else np.minimum(*parts)

    def log_p(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability, whether the last character is new) of triples, by column."""
        b, c = (code >> _BITS) & _LOW, code & _LOW
        n_b, n_c, n_ab, n_bc, n_abc = self.count(1, b), self.count(1, c), self.count(2, code >> _BITS), self.count(2, code & ((1 << 2 * _BITS) - 1)), self.count(3, code)
        n_bc = np.minimum(n_bc, np.minimum(n_b, n_c))
        n_abc = np.minimum(n_abc, np.minimum(n_ab, n_bc))
        p = (n_c + NEW) / (self.total + NEW * 65536)
        p = (n_bc + WEIGHT * p) / (n_b + WEIGHT)
        return np.log((n_abc + WEIGHT * p) / (n_ab + WEIGHT)), n_c == 0

    def score(self, flat: Flat, as_small: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood, number of new characters) of each text, by column; words in capitals as in small letters if as_small."""
        n, columns = len(flat.lengths), FOLDS + 1
        out = np.zeros((n, columns), np.float32), np.zeros((n, columns), np.float32)
        done = 0
        ends = np.cumsum(flat.lengths)
        while done < n:
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PIECE, "right")))
            part = Flat(flat.points[flat.starts[done] : ends[upto - 1]], flat.lengths[done:upto])
            for o, x in zip(out, self._score(part, as_small)):
                o[done:upto] = x
            done = upto
        return out

    def _score(self, flat: Flat, as_small: bool) -> tuple[np.ndarray, np.ndarray]:
        plane = _plane(flat.points)
        capitals = (flat.lengths > 5) & (flat.sums(_UPPER[plane]) > 0) & (flat.sums(_LOWER[plane]) == 0)
        points = flat.points
        if as_small and capitals.any():
            points = np.where(np.repeat(capitals, flat.lengths), np.where(points < 65536, _TO_LOWER[plane], points), points)
        c = seen(points).astype(np.int64)
        code = np.full(len(c), -1, np.int64)
        code[:-2] = (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:]
        ends = flat.starts + flat.lengths
        code[ends - 1] = code[ends - 2] = -1
        coded = pa.array(code).dictionary_encode()
        kinds, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        known = kinds >= 0
        both = np.zeros((len(kinds), 2 * (FOLDS + 1)), np.float32)
        p, new = self.log_p(kinds[known])
        both[known] = np.hstack([p, new])
        sums = np.add.reduceat(both[index], flat.starts, axis=0)
        return sums[:, : FOLDS + 1], sums[:, FOLDS + 1 :]

    def log_p_of(self, codes: list[int]) -> list[float]:
        """Log probabilities of single triples by all counts."""
        lacking = [c for c in codes if c not in self._known]
        if lacking:
            if len(self._known) > 2_000_000:
                self._known.clear()
                lacking = list(dict.fromkeys(codes))
            self._known.update(zip(lacking, self.log_p(np.array(lacking, np.int64))[0][:, -1].tolist()))
        return [self._known[c] for c in codes]
