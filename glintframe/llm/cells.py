"""Cells: the leaves of a bisecting tree for every index, and the units of work made of them.

The tree of an index is fitted on a bounded sample (``SAMPLE_ROWS`` rows, at
most ``SAMPLE_BYTES``); every row is then assigned to its nearest leaf.
The leaves are numbered from the tightest to the loosest, and packed in that
order into units of about ``UNIT_ROWS`` rows, so that vectors far from every
centre, which probe many loose leaves, go to few units.  A leaf of more rows
is cut into several units by a hash of the id.  What probes a unit is
estimated on a share of the rows (:func:`unit_loads`); a unit that very many
rows probe is held by several tasks, each answering a part of them
(:func:`lay_out`).  So no task gets much more than a unit and its part
of the probing rows, however the rows lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bisect import fit_leaves
from .bisect import unit_rows as to_unit
from .vectors import only_usable, usable_rows

SAMPLE_ROWS = 65_536
SAMPLE_BYTES = 48 << 20
ROWS_PER_CELL = 256
MAX_CELLS = 8_192
UNIT_ROWS = 16_384
UNIT_BYTES = 24 << 20
#: Bytes that small tasks are packed up to into partitions, and what a routed row takes besides its vector.
TASK_BYTES = 10 << 20
ROW_BYTES = 48
#: One of so many probing rows is routed to estimate the loads of units.
LOAD_SHARE = 16
#: Indexes that a call may have, and bytes of the centres of all of them, which travel to every executor.
MAX_INDEXES = 256
CENTRE_BYTES = 64 << 20


@dataclass
class Cells:
    """One index: its leaves from the tightest on, the rows expected in each with their mean cosine to the centre, and their units."""

    number: int
    dims: int
    centres: np.ndarray
    rows: np.ndarray
    tight: np.ndarray
    extra: bytes
    first_unit: np.ndarray | None = None
    splits: np.ndarray | None = None


def _pack_units(cells: Cells, base: int, unit_rows_: int) -> int:
    """Sets the units, numbered from ``base``; returns the next free number."""
    first, splits = np.zeros(len(cells.rows), np.int64), np.ones(len(cells.rows), np.int64)
    unit, held = base, 0.0
    for k, r in enumerate(cells.rows):
        if r > unit_rows_:
            unit += held > 0
            splits[k] = int(-(-r // unit_rows_))
            first[k] = unit
            unit, held = unit + int(splits[k]), 0.0
            continue
        if held and held + r > unit_rows_:
            unit, held = unit + 1, 0.0
        first[k] = unit
        held += r
    cells.first_unit, cells.splits = first, splits
    return unit + (held > 0)


def fit_cells(
    vectors: DataFrame,
    min_cosine: float = 1.0,
    rows_per_cell: int = ROWS_PER_CELL,
    max_cells: int = MAX_CELLS,
    extra: Callable[[np.ndarray, np.ndarray], bytes] | None = None,
    unit_rows: int = UNIT_ROWS,
    cells_of: Callable[[int], int] | None = None,
    sample_rows: Callable[[int], int] | None = None,
) -> dict[str, Cells]:
    """The cells of every index of ``vectors`` (index_name, dims, vec_id, embedding) that has a usable row.

    Each index is fitted in a task of its own.  ``min_cosine`` is the
    compactness at which a node is split no further; ``extra`` may fit more on
    the sample and its centres.  ``cells_of`` and ``sample_rows`` give the
    wanted cells and sampled rows of an index of so many rows, in place of one
    cell for ``rows_per_cell`` rows and of ``SAMPLE_ROWS``.  The centres of
    all indexes together have at most ``CENTRE_BYTES``.
    """
    counts = {r[0]: r[1] for r in vectors.groupBy("index_name").count().limit(MAX_INDEXES + 1).collect()}
    if len(counts) > MAX_INDEXES:
        raise ValueError(f"more than {MAX_INDEXES} indexes in one call")
    if not counts:
        return {}
    by_name = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("index_name"))
    rows = by_name({k: min(SAMPLE_ROWS, sample_rows(n)) for k, n in counts.items()}) if sample_rows else F.lit(SAMPLE_ROWS)
    most = F.least(rows, F.floor(F.lit(SAMPLE_BYTES) / (4 * F.col("dims"))).cast("int"))
    sample = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < most / by_name(counts) * (1 << 30))

    def fit(key: tuple[pa.Scalar, ...], batches: pa.Table) -> pa.Table:
        parts = [m for b in batches.combine_chunks().to_batches() for _, _, m in usable_rows(b)]
        name = key[0].as_py()
        if not parts:
            return pa.table({"index_name": pa.array([], pa.string()), "dims": pa.array([], pa.int32()), "centres": pa.array([], pa.binary()), "share": pa.array([], pa.binary()), "tight": pa.array([], pa.binary()), "extra": pa.array([], pa.binary())})
        x = to_unit(np.vstack(parts))
        bound = CENTRE_BYTES // (4 * x.shape[1] * len(counts))
        wanted = max(1, min(max_cells, bound, cells_of(counts[name]) if cells_of else counts[name] // rows_per_cell, len(x)))
        centres = fit_leaves(x, wanted, 4, min_cosine)
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres)).astype(np.float64)
        tight = np.bincount(own, np.einsum("ij,ij->i", x, centres[own]), len(centres)) / np.maximum(count, 1)
        more = extra(x, centres[own]) if extra else b""
        return pa.table({"index_name": [name], "dims": pa.array([x.shape[1]], pa.int32()), "centres": [centres.tobytes()], "share": [(count / len(x)).tobytes()], "tight": [tight.tobytes()], "extra": [more]})

    shape = "index_name string, dims int, centres binary, share binary, tight binary, extra binary"
    fitted = sample.groupBy("index_name").applyInArrow(fit, shape).collect()
    lost = sorted(set(counts) - {r["index_name"] for r in fitted})
    if lost:
        # the sample of these held no usable row; the rates of a second one count usable rows alone
        usable = only_usable(vectors.filter(F.col("index_name").isin(lost)))
        again = {r[0]: r[1] for r in usable.groupBy("index_name").count().collect()}
        if again:
            counts |= again
            sample = usable.filter(F.col("index_name").isin(list(again))).filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < most / by_name(again) * (1 << 30))
            fitted += sample.groupBy("index_name").applyInArrow(fit, shape).collect()
    out, base = {}, 0
    for k, r in enumerate(sorted(fitted, key=lambda r: r["index_name"])):
        tight = np.frombuffer(r["tight"], np.float64)
        turn = np.argsort(-tight, kind="stable")
        centres = np.frombuffer(r["centres"], np.float32).reshape(-1, r["dims"])[turn]
        c = Cells(k, r["dims"], centres, np.frombuffer(r["share"], np.float64)[turn] * counts[r["index_name"]], tight[turn], bytes(r["extra"]))
        base = _pack_units(c, base, max(1, min(unit_rows, UNIT_BYTES // (4 * c.dims))))
        out[r["index_name"]] = c
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, (8 << 20) // max(1, len(centres)))
    return np.concatenate([(x[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def probes(x: np.ndarray, cells: Cells, min_similarity: float, z: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first row, nearest cell of each row, pairs: row, cell) of the cells that may hold a neighbour.

    If y with cosine >= min_similarity to x lies in cell b and x in cell a,
    then x.b >= x.a - (y - x).(a - b).  The last product is at most
    |y - x| |a - b|; its spread over directions is that divided by the root
    of the width.  All cells within ``z`` such spreads are probed.
    """
    reach = z * np.sqrt(max(0.0, 2 - 2 * min_similarity)) / np.sqrt(cells.dims)
    c = cells.centres
    step = max(1, (4 << 20) // max(1, len(c)))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ c.T
        home = s.argmax(axis=1)
        apart = c[home] @ c.T
        np.subtract(2.0, 2.0 * apart, out=apart)
        np.sqrt(np.maximum(apart, 0, out=apart), out=apart)
        row, cell = np.nonzero(s >= s[np.arange(len(s)), home][:, None] - reach * apart)
        yield i, home, row, cell


def block_of(ident: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The block of a row within its cell, by a hash of its id."""
    return (((ident.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % splits.astype(np.uint64)).astype(np.int64)


def expand_blocks(row: np.ndarray, cell: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, unit) for every unit of the cells."""
    n = cells.splits[cell]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n), np.repeat(cell, n), np.repeat(cells.first_unit[cell], n) + at


def lists_by_unit(row: np.ndarray, unit: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """One entry for each (row, unit): the row, the unit, and the list of its cells."""
    order = np.lexsort((cell, unit, row))
    row, unit, cell = row[order], unit[order], cell[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (unit[1:] != unit[:-1])]) if len(row) else np.zeros(0, np.int64)
    ends = np.append(first, len(row)).astype(np.int32)
    return row[first], unit[first], pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))


@dataclass
class Layout:
    """The tasks of every unit: the first of them and their number; of each task its partition, and whether it is the first of its unit."""

    first: np.ndarray
    parts: np.ndarray
    partition: np.ndarray
    primary: np.ndarray

    @property
    def partitions(self) -> int:
        return int(self.partition[-1]) + 1 if len(self.partition) else 1

    def homes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, task) for every task that rows living in ``unit`` go to."""
        n = self.parts[unit]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(unit)), n), np.repeat(self.first[unit], n) + at

    def asked(self, unit: np.ndarray, ident: np.ndarray) -> np.ndarray:
        """The task in which each row that probes ``unit`` is answered."""
        return self.first[unit] + block_of(ident ^ 0x5555, self.parts[unit])


def lay_out(model: dict[str, Cells], loads: dict[int, float], part_bytes: int) -> Layout:
    """Tasks and partitions for the units of ``model``, of which ``loads`` has the bytes of probing rows; a task gets about ``part_bytes`` of these."""
    units = max((int((c.first_unit + c.splits).max()) for c in model.values()), default=0)
    own = np.zeros(units)
    for c in model.values():
        per_unit = c.rows / c.splits * (4 * c.dims + ROW_BYTES)
        n = c.splits
        np.add.at(own, np.repeat(c.first_unit, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(per_unit, n))
    load = np.zeros(units)
    for u, b in loads.items():
        load[u] = b
    parts = np.maximum(1, np.ceil(load / part_bytes)).astype(np.int64)
    first = np.cumsum(parts) - parts
    size = np.repeat(own + load / parts, parts)
    partition, number, held = np.zeros(len(size), np.int64), 0, 0.0
    for t, b in enumerate(size.tolist()):
        if held and held + b > TASK_BYTES:
            number, held = number + 1, 0.0
        partition[t] = number
        held += b
    primary = np.zeros(len(size), bool)
    primary[first] = True
    return Layout(first, parts, partition, primary)


def unit_loads(routed_share: DataFrame) -> dict[int, float]:
    """Estimated bytes of probing rows of the units that need more than one task, from one of ``LOAD_SHARE`` rows routed with one task a unit."""
    size = (F.octet_length("vec") + F.lit(ROW_BYTES)).cast("long")
    heavy = routed_share.filter("side = 1").groupBy("unit").agg((F.sum(size) * LOAD_SHARE).alias("bytes"))
    return {r["unit"]: float(r["bytes"]) for r in heavy.collect()}


def load_share(vectors: DataFrame) -> DataFrame:
    """The rows by which loads are estimated."""
    return vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(LOAD_SHARE)) == 0)


#: Rows on their way to a task of a unit.  Side 0 lives in the unit, side 1 only probes it.
ROUTED = "partition int, unit long, side int, index_no int, vec_id long, cells array<int>, mark int, vec binary"
ROUTED_SCHEMA = pa.schema(
    [("partition", pa.int32()), ("unit", pa.int64()), ("side", pa.int32()), ("index_no", pa.int32()), ("vec_id", pa.int64()), ("cells", pa.list_(pa.int32())), ("mark", pa.int32()), ("vec", pa.binary())]
)


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """(unit, index_no, side, rows) from rows sorted by unit and side."""
    for batch in batches:
        if not batch.num_rows:
            continue
        unit, side = batch["unit"].to_numpy(), batch["side"].to_numpy()
        cut = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])])
        for a, b in zip(cut, np.append(cut[1:], len(unit)), strict=True):
            yield int(unit[a]), int(batch["index_no"][int(a)].as_py()), int(side[a]), batch.slice(int(a), int(b - a))


def at_units(routed: DataFrame, layout: Layout) -> DataFrame:
    """The routed rows brought to their tasks; a unit's own rows come before those that probe it."""
    return routed.repartitionById(layout.partitions, "partition").sortWithinPartitions("unit", "side")
