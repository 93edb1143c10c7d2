"""Frequency of every distinct term: a range-partitioned external sort, then run-length scanning.

Equal pairs of (term, record identifier) are counted within each batch as it is read, so that one pair that makes up
a large share of all rows shrinks to one row a batch. The pairs are then range partitioned on the whole pair and
sorted, spilling as they must. A frequent term is thereby divided over many partitions, and equal pairs never are.
Each partition is read once in order: a run of one pair is a record that holds the term, and the counts in it the
occurrences there. The counts of a partition's terms are plain sums, so those of a term that was divided add up.

Defined results: nulls in a record's columns are equal to each other, as are NaNs and the two zeros; a null term is
counted under the null term, which callers may drop; a term that occurs twice in a record counts two occurrences and
one record; empty tables give no terms; texts of any length may be terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bits(c: pa.Array) -> pa.Array:
    """Doubles as whole numbers that are equal where the doubles are the same value."""
    if not pa.types.is_floating(c.type):
        return c
    x = c.cast(pa.float64())
    values = x.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    values[np.isnan(values)] = np.nan
    return pa.array(values.view(np.int64), mask=x.is_null().to_numpy(zero_copy_only=False) if x.null_count else None)


def _differs(columns: Sequence[pa.Array], before: Sequence[pa.Array] | None) -> np.ndarray:
    """True where a row differs from the one before it; `before` is the last row of the batch before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[0] = before is None or not all(c.slice(0, 1).equals(b) for c, b in zip(columns, before))
    for c in columns if n > 1 else ():
        a, b = c.slice(1), c.slice(0, n - 1)
        d = pa.compute.fill_null(pa.compute.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            d = d | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        out[1:] |= d
    return out


def _counted(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.Table.from_batches([b]).group_by(names, use_threads=False).aggregate([([], "count_all")])
            yield from found.select([*names, "count_all"]).combine_chunks().to_batches()

    return run


def _run_lengths(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [_bits(b.column(f"c{i}")) for i in range(width)]
            term, pair = _differs(columns[:1], last[:1] if last else None), _differs(columns, last)
            start = np.flatnonzero(term)
            if not len(start) or start[0]:
                start = np.append(0, start)
            rows = np.add.reduceat(b.column("n").to_numpy(), start)
            records = np.add.reduceat(pair.astype(np.int64), start)
            yield pa.RecordBatch.from_arrays([b.column("c0").take(pa.array(start)), pa.array(rows.astype(np.int64)), pa.array(records)], names=["term", "occurrences", "records"])
            last = [c.slice(b.num_rows - 1, 1) for c in columns]

    return run


def term_frequencies(df: DataFrame, term: str, record: Sequence[str]) -> DataFrame:
    """(term, occurrences, records): one row per distinct term; record names the columns that identify a record."""
    by = [f"c{i}" for i in range(1 + len(record))]
    pairs = df.select(*(F.col(c).alias(n) for c, n in zip((term, *record), by)))
    counted = pairs.mapInArrow(_counted(by), ", ".join(f"{n} {k}" for n, k in (*pairs.dtypes, ("n", "long"))))
    ordered = counted.repartitionByRange(*by).sortWithinPartitions(*by)
    runs = ordered.mapInArrow(_run_lengths(len(by)), f"term {dict(pairs.dtypes)['c0']}, occurrences long, records long")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark(records: Column, rare_below: int, common_above: Column) -> Column:
    """'rare', 'common' or null."""
    return F.when(records < rare_below, "rare").when(records > common_above, "common")
