"""Correlation of all pairs of many columns from one scan, by masked Gram matrices.

With X the cells (0 where missing) and M the mask of filled cells, M'M holds the complete rows of every pair, X'M the
sums and (X^2)'M the squares of a column over the rows that the other one fills, and X'X the products. A task adds these
up over its batches; blocks of them are merged over salted tasks first and then over all. Cells are taken relative to a
value of their column, and merged matrices are brought to one such value, so that large numbers that differ little keep
their digits and a constant column stays exactly constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a block, and groups in which tasks are merged first.
BLOCK_COLUMNS = 64
MERGE_GROUPS = 64
# A variance below this part of the squares it is left of counts as none: rounding leaves that much.
_NOTHING = 1e-13

_PARTIAL = "a int, b int, salt int, shift_a binary, shift_b binary, sums binary"


def _products(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """n, sums, squares and products of all pairs as one array (4, columns, columns), relative to shift."""
    filled = ~np.isnan(x)
    mask = filled.astype(np.float64)
    x = np.where(filled, x - shift, 0.0)
    return np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])


def _moved(sums: np.ndarray, by_a: np.ndarray, by_b: np.ndarray) -> np.ndarray:
    """The same figures relative to other values: by_* is the old value less the new one. Squares and sums of the second
    column are those of the transposed block, so a block holds both: n, sum a, square a, product, sum b, square b."""
    n, sa, qa, p, sb, qb = sums
    da, db = by_a[:, None], by_b[None, :]
    return np.stack([
        n, sa + n * da, qa + 2 * da * sa + n * da * da, p + da * sb + db * sa + n * da * db, sb + n * db, qb + 2 * db * sb + n * db * db,
    ])


def _middle(shifts: np.ndarray) -> np.ndarray:
    """For each column the value in the middle of those that parts are relative to, ignoring columns without cells."""
    out = np.zeros(shifts.shape[1])
    for i, column in enumerate(shifts.T):
        some = np.sort(column[~np.isnan(column)])
        out[i] = some[len(some) // 2] if len(some) else np.nan
    return out


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shifts = [np.stack([np.frombuffer(v) for v in rows[c].to_pylist()]) for c in ("shift_a", "shift_b")]
    to = [_middle(s) for s in shifts]
    total = 0.0
    for k, data in enumerate(rows["sums"].to_pylist()):
        sums = np.frombuffer(data).reshape(6, len(to[0]), len(to[1]))
        total = total + _moved(sums, *[np.nan_to_num(s[k] - t) for s, t in zip(shifts, to)])
    return to[0], to[1], total


def gram_correlations(numbers: DataFrame, columns: list[str]) -> DataFrame:
    """``(pair_ord, column_a, column_b, r, n)`` for columns of doubles; NULL where a side is constant."""
    p = len(columns)
    blocks = [(i, min(i + BLOCK_COLUMNS, p)) for i in range(0, p, BLOCK_COLUMNS)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, total = np.full(p, np.nan), np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            for i in np.flatnonzero(np.isnan(shift)):
                some = np.sort(x[:, i][~np.isnan(x[:, i])])
                if len(some):
                    shift[i] = some[len(some) // 2]  # a value of the column; no cell of it was added before
            total += _products(x, np.nan_to_num(shift))
        salt = TaskContext.get().partitionId() % MERGE_GROUPS
        for a, (i, j) in enumerate(blocks):
            for b, (k, m) in enumerate(blocks[a:], a):
                n, s, q, x = total[:, i:j, k:m]
                sums = np.stack([n, s, q, x, total[1, k:m, i:j].T, total[2, k:m, i:j].T])
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "salt": pa.array([salt], pa.int32()),
                    "shift_a": [shift[i:j].tobytes()], "shift_b": [shift[k:m].tobytes()], "sums": [sums.tobytes()],
                })

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        shift_a, shift_b, sums = _merged(rows)
        return pa.table({
            "a": pa.array([key[0].as_py()], pa.int32()), "b": pa.array([key[1].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()),
            "shift_a": [shift_a.tobytes()], "shift_b": [shift_b.tobytes()], "sums": [sums.tobytes()],
        })

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        (i, _), (k, _) = blocks[key[0].as_py()], blocks[key[1].as_py()]
        n, sa, qa, x, sb, qb = _merged(rows)[2]
        with np.errstate(all="ignore"):
            var_a, var_b, cov = qa - sa * sa / n, qb - sb * sb / n, x - sa * sb / n
            none = (n < 2) | (var_a <= _NOTHING * qa) | (var_b <= _NOTHING * qb)
            r = np.clip(cov / np.sqrt(var_a * var_b), -1.0, 1.0)
        at_a, at_b = np.nonzero((np.arange(n.shape[0])[:, None] + i) < (np.arange(n.shape[1])[None, :] + k))
        a, b = at_a + i, at_b + k
        return pa.table({
            "pair_ord": pa.array(a * p - a * (a + 1) // 2 + b - a - 1, pa.int64()),
            "column_a": pa.array([columns[v] for v in a], pa.string()), "column_b": pa.array([columns[v] for v in b], pa.string()),
            "r": pa.array(r[at_a, at_b], pa.float64(), mask=none[at_a, at_b]), "n": pa.array(np.rint(n[at_a, at_b]).astype(np.int64)),
        })

    parts = numbers.mapInArrow(add_up, _PARTIAL)
    parts = parts.groupBy("a", "b", "salt").applyInArrow(merge, _PARTIAL)
    return parts.groupBy("a", "b").applyInArrow(finish, "pair_ord long, column_a string, column_b string, r double, n long").select(
        F.col("pair_ord").cast("int").alias("pair_ord"), "column_a", "column_b", "r", "n",
    )
