"""Embedding whitening by incremental eigendecomposition.

Vectors are put on a grid (``x = floor(scale * c) + offset``), and the distinct
grid vectors are the fit list. Every partition of it keeps the eigendecomposition
of its centred scatter up to date, one vector at a time (``spectrum``: secular
equation with deflation). The partitions' spectra are merged in a tree of tasks,
again by rank-one changes. The merged basis is then refined over the whole list:
tasks sum the projections' products, and the eigenvectors of that small matrix
turn the basis into eigenvectors of the exact covariance (Rayleigh-Ritz).

The driver and a task hold a few matrices of dims x dims numbers, whatever the
number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rota.llm.spectrum import Spectrum
from rota.session import cut_lineage

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 52          # |scale * c| of an entry: beyond, floor is not exact
FIT_ROWS = 4096            # fit vectors a task adds one by one
FAN_IN = 16                # spectra or matrices that a task of the tree takes
_CELLS = 1 << 20           # numbers handled at a time

_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, vector_col: str, dims: int | None = None, scale: int = SCALE) -> DataFrame:
    """The rows with a vector of ``dims`` entries (any number if not given, but one),
    none of them NULL, NaN, infinite or too large for the grid; the vector as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST / scale), F.lit(False)))
    length = F.size(v) > 0 if dims is None else F.size(v) == dims
    return vectors.where(F.col(vector_col).isNotNull() & length & fits).withColumn(vector_col, v)


def common_length(vectors: DataFrame, vector_col: str) -> int | None:
    """The length that most vectors have, the longer one of a tie."""
    row = (vectors.groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.desc("d")).first())
    return row["d"] if row else None


def _grids(column: pa.Array, dims: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, floor(scale * c) as int64 by row) in slices of bounded size."""
    step = max(_CELLS // dims, 1)
    for i in range(0, len(column), step):
        flat = column.slice(i, step).flatten().to_numpy(zero_copy_only=False)
        yield i, np.floor(flat.reshape(-1, dims) * scale).astype(np.int64)


def _pack(grid: np.ndarray) -> list[bytes]:
    """A grid vector as its byte width and its numbers; distinct vectors of a slice once."""
    size = np.abs(grid).max(1)
    out = []
    for width, low, high in ((2, -1, 1 << 15), (4, 1 << 15, 1 << 31), (8, 1 << 31, None)):
        rows = grid[(size >= low) & (size < high if high else True)]
        if len(rows):
            raw = np.ascontiguousarray(rows.astype(f"<i{width}"))
            keys = np.unique(raw.view(f"V{raw.shape[1] * width}").ravel())
            out += [bytes([width]) + k.tobytes() for k in keys]
    return out


def _unpack(codes: pa.Array, dims: int) -> Iterator[np.ndarray]:
    step = max(_CELLS // dims, 1)
    for i in range(0, len(codes), step):
        part = codes.slice(i, step).to_pylist()
        yield np.array([np.frombuffer(c, f"<i{c[0]}", dims, 1) for c in part], np.int64)


def _centred(grid: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit where it fits, else Python integers. The offset of the
    grid drops out."""
    most = max(int(np.abs(grid).max(initial=0)) * n, max(map(abs, sums), default=0))
    kind = np.int64 if most < 1 << 62 else object
    return grid.astype(kind) * n - np.array(sums, kind)


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Sum of squares by row, exact; NULL where it is no 64-bit number."""
    most = max((abs(int(v)) for v in (centred.max(initial=0), centred.min(initial=0))), default=0)
    if most * most * centred.shape[1] >= 1 << 63:
        centred = centred.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (centred * centred).sum(1)]


def fit_list(vectors: DataFrame, vector_col: str, dims: int, scale: int = SCALE) -> DataFrame:
    """(``code``): every distinct grid vector of ``usable`` rows once, packed."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grid in _grids(batch.column(0), dims, scale):
                yield pa.RecordBatch.from_arrays([pa.array(_pack(grid), pa.binary())], names=["code"])

    parts = max(math.ceil(vectors.count() / FIT_ROWS), 1)
    return vectors.select(vector_col).mapInArrow(pack, "code binary").repartition(parts, "code").distinct()


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of fit vectors and their sums by dimension, without the grid's offset."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            for grid in _unpack(batch.column(0), dims):
                n += len(grid)
                sums = [a + int(b) for a, b in zip(sums, grid.sum(0, dtype=np.int64))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, dims), pa.int32()), pa.array([n, *sums], pa.decimal128(38, 0))],
                names=["dim", "s"])

    found = fit.mapInArrow(count, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s"))
    by_dim = {r["dim"]: int(r["s"]) for r in found.collect()}   # dims + 1 rows
    return by_dim.get(-1, 0), [by_dim.get(i, 0) for i in range(dims)]


def _tree(parts: DataFrame, count: int, combine: Callable[[list[bytes]], bytes]) -> bytes:
    """The rows (``m`` binary, at most ``count``) combined in tasks of about ``FAN_IN``,
    again and again, until a few are left, and those on the driver."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for raw in batch.column(0):
                held = raw.as_py() if held is None else combine([held, raw.as_py()])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], names=["m"])

    while count > FAN_IN:
        count = math.ceil(count / FAN_IN)
        parts = parts.repartition(count).mapInArrow(fold, "m binary")
    return combine([r["m"] for r in parts.collect()])


def _per_task(fit: DataFrame, work: Callable[[Iterator[np.ndarray]], bytes], dims: int) -> DataFrame:
    """One value of every task that has rows: ``work`` of its grid vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0]

        def grids():
            for batch in batches:
                for grid in _unpack(batch.column(0), dims):
                    seen[0] += len(grid)
                    yield grid
        out = work(grids())
        if seen[0]:
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["m"])
    return fit.mapInArrow(run, "m binary")


def local_spectra(fit: DataFrame, dims: int) -> DataFrame:
    """(``m``): the spectrum of every partition's vectors, added one by one."""
    def work(grids):
        spectrum = Spectrum(dims)
        for grid in grids:
            for x in grid.astype(np.float64):
                spectrum.add(x)
        return spectrum.to_bytes()
    return _per_task(fit, work, dims)


def merged(spectra: DataFrame, count: int, dims: int) -> Spectrum:
    """One spectrum of all, by rank-one changes."""
    def combine(raws):
        out = Spectrum(dims)
        for raw in raws:
            out.merge(Spectrum.from_bytes(raw, dims))
        return out.to_bytes()
    return Spectrum.from_bytes(_tree(spectra, count, combine), dims)


def projected_covariance(fit: DataFrame, count: int, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the fit list projected on the columns of ``basis``,
    centred exactly before multiplying."""
    dims, k = basis.shape

    def work(grids):
        total = np.zeros((k, k))
        for grid in grids:
            y = (_centred(grid, n, sums).astype(np.float64) / n) @ basis
            total += y.T @ y
        return total.tobytes()

    def combine(raws):
        return sum((np.frombuffer(r, np.float64) for r in raws), np.zeros(k * k)).tobytes()

    found = _tree(_per_task(fit, work, dims), count, combine)
    out = np.frombuffer(found, np.float64).reshape(k, k) / n
    return (out + out.T) / 2.0


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS, dims: int | None = None, scale: int = SCALE,
           offset: int = OFFSET) -> DataFrame:
    """A row per usable row and component: (``id_col``, component, n, deviation,
    whitened, explained, identity_error).

    ``component`` counts from 1 by falling eigenvalue; ``n`` is the size of the fit
    list; ``deviation`` the exact sum of (n x - S)^2 over the dimensions (NULL where
    it passes a long); ``whitened`` the centred vector on the component, over the
    root of its eigenvalue; ``explained`` the eigenvalue's part of the total
    variance; ``identity_error`` the largest entry, in absolute value, of the
    whitened fit list's covariance minus the identity.

    Dropped: rows whose vector is NULL or empty, holds a NULL, NaN or infinite
    entry or one of 2^52 / scale or more, or has not ``dims`` entries (default: the
    length that most of the others have, the longer of a tie). NULL ids and
    repeated rows stay. Components without variance (beyond the rank) have no
    rows, so one distinct vector alone, like an empty table, gives an empty
    result. Of equal eigenvalues any basis counts. Other columns are left out.
    ``offset`` moves every x alike, so that no result depends on it.
    """
    spark = vectors.sparkSession
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, {_RESULT}"
    rows = vectors.select(id_col, vector_col)
    if dims is None:
        dims = common_length(usable(rows, vector_col, None, scale), vector_col)
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = usable(rows, vector_col, dims, scale)

    fit = cut_lineage(fit_list(rows, vector_col, dims, scale))
    n, sums = totals(fit, dims)
    if not n:
        return spark.createDataFrame([], schema)
    tasks = max(fit.rdd.getNumPartitions(), 1)
    spectrum = merged(cut_lineage(local_spectra(fit, dims)), tasks, dims)
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    small = projected_covariance(fit, tasks, n, sums, basis)
    values, turned = np.linalg.eigh(small)
    values, vectors_ = values[::-1], (basis @ turned)[:, ::-1]
    total = float(np.trace(small))
    keep = [i for i in range(min(components, dims)) if values[i] > values[0] * dims * 64 * np.finfo(float).eps]
    if not keep:
        return spark.createDataFrame([], schema)
    explained = values[keep] / total
    project = vectors_[:, keep] / np.sqrt(values[keep])
    error = float(np.abs(projected_covariance(fit, tasks, n, sums, project) - np.eye(len(keep))).max())
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for batch in batches:
            for i, grid in _grids(batch.column(1), dims, scale):
                m = len(grid)
                centred = _centred(grid, n, sums)
                white = (centred.astype(np.float64) / n) @ project
                at = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, m).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(_deviation(centred), pa.int64()).take(pa.array(at)),
                    pa.array(white.ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))], names=names)

    return rows.mapInArrow(score, schema)
