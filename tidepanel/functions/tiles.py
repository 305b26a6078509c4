"""Products of all pairs of return series as tiles: blocks of symbols times blocks of time, multiplied as dense matrices.

A tile's rows travel once for each tile that it meets, not once for each pair and date. Absent returns are zeros and are
never written out; they exist only in the matrix of one tile and one block of time.

`covariances`, `row_sums` and `rolling_pairs` cut the symbols into a fixed number of tiles (as long as a tile fits). A tile is written
once, packed, and read by each task that pairs it with another: what goes through a shuffle and onto disk is the returns once, however
many tiles there are. Pairs are made block by block inside a tile pair and are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.cuts import cut

#: Symbols of a tile and grid points of a block of time: a dense block of 4 MB.
TILE, SPAN = 128, 4096
#: Tiles that all symbols are cut into, symbols that a tile has at least, cells of a dense tile at most (64 MB), and pairs of a
#: block that leaves a task at once.
TILES, LEAST, CELLS, BLOCK = 16, 32, 1 << 23, 1 << 18
#: Neighbouring tiles that lie in one part of the written tiles, where there are more than TILES.
TOGETHER = 8


def numbered(returns: DataFrame, tile: int = TILE) -> DataFrame:
    """(symbol, tile, pos, n_tiles) of the distinct symbols; the window runs over that small table."""
    order = Window.orderBy("symbol")
    x = returns.select("symbol").distinct().select("symbol", (F.row_number().over(order) - 1).alias("_k"), F.count("*").over(Window.partitionBy()).alias("_n"))
    return x.select("symbol", F.floor(F.col("_k") / tile).cast("int").alias("tile"), (F.col("_k") % tile).cast("int").alias("pos"), F.ceil(F.col("_n") / tile).cast("int").alias("n_tiles"))


def meetings(packed: DataFrame, *more: str) -> DataFrame:
    """Each row of a tile once for every pair of tiles (left <= right) that holds it."""
    other = F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))
    x = packed.withColumn("_other", other)
    return x.select(F.least("tile", "_other").alias("left"), F.greatest("tile", "_other").alias("right"), "tile", *more)


def dense(cells: pa.Array, height: int, width: int) -> np.ndarray:
    """Matrix of cells (t, pos, ret)."""
    out = np.zeros((height, width))
    t, pos, ret = (cells.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    out[t, pos] = ret
    return out


def gram(returns: DataFrame, names: DataFrame, grid: DataFrame, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """(left, i, right, j, xy): sums of products over the grid for each pair of symbols (left, i) <= (right, j), zeros included.

    returns: (symbol, ts, ret), unique in (symbol, ts); names from `numbered`; grid (ts, idx).
    """
    x = returns.join(names, "symbol").join(grid, "ts")
    cell = F.struct((F.col("idx") % span).cast("int").alias("t"), "pos", "ret")
    packed = x.groupBy("tile", F.floor(F.col("idx") / span).alias("span")).agg(F.collect_list(cell).alias("cells"), F.max("n_tiles").alias("n_tiles"))

    def run(key, table):
        left, right = key[0].as_py(), key[1].as_py()
        sides = {}
        for k in range(table.num_rows):
            sides[table.column("tile")[k].as_py()] = dense(table.column("cells")[k].values, span, tile)
        zero = np.zeros((span, tile))
        product = sides.get(left, zero).T @ sides.get(right, zero)
        i, j = np.triu_indices(tile) if left == right else np.indices((tile, tile)).reshape(2, -1)
        n = len(i)
        return pa.table({"left": pa.array(np.full(n, left), pa.int32()), "i": pa.array(i, pa.int32()), "right": pa.array(np.full(n, right), pa.int32()), "j": pa.array(j, pa.int32()), "xy": pa.array(product[i, j])})

    parts = meetings(packed, "span", "cells").groupBy("left", "right", "span").applyInArrow(run, "left int, i int, right int, j int, xy double")
    return parts.groupBy("left", "i", "right", "j").agg(F.sum("xy").alias("xy"))


def fitted(returns: DataFrame, size: DataFrame, side: str | None = None) -> DataFrame:
    """(symbol, tile, pos, n_tiles) with TILES tiles, more where a dense tile over the grid would have over CELLS cells.

    size: one row (g), the points of the grid. side: an int column, one value a symbol; a tile then has symbols of one value.
    """
    side_of = F.max(side) if side else F.lit(0)
    x = returns.groupBy("symbol").agg(side_of.alias("_g")) if side else returns.select("symbol").distinct().withColumn("_g", side_of)
    x = x.select("symbol", "_g", (F.row_number().over(Window.partitionBy("_g").orderBy("symbol")) - 1).alias("_k"), F.count("*").over(Window.partitionBy()).alias("_n"))
    width = F.greatest(F.least(F.ceil(F.col("_n") / TILES), F.floor(CELLS / F.greatest("g", F.lit(1)))), F.lit(LEAST))
    x = x.join(F.broadcast(size)).withColumn("_w", width).withColumn("_t", F.floor(F.col("_k") / F.col("_w")))
    # tiles are numbered through all sides
    x = x.withColumn("tile", (F.dense_rank().over(Window.orderBy("_g", "_t")) - 1).cast("int"))
    return x.select("symbol", "tile", (F.col("_k") % F.col("_w")).cast("int").alias("pos"), (F.max("tile").over(Window.partitionBy()) + 1).cast("int").alias("n_tiles"))


def by_symbol(returns: DataFrame, names: DataFrame, grid: DataFrame, *more: str) -> DataFrame:
    """(tile, n_tiles, pos, symbol, cells, *more) of each symbol, where cells are its (idx, ret) and more are columns with one value a
    symbol."""
    cells = F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "ret")).alias("cells")
    x = returns.join(grid, "ts").groupBy("symbol").agg(cells, *[F.max(c).alias(c) for c in more])
    return x.join(names, "symbol").select("tile", "n_tiles", "pos", "symbol", "cells", *more)


def written(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(tile, data): the rows of each tile (tile, n_tiles, ...) as one compressed Arrow stream, written once to the folder of cuts."""
    n = names.agg(F.max("n_tiles")).first()[0] or 1
    parts = min(n, max(TILES, -(-n // TOGETHER)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            tile = b.column("tile").to_numpy()
            for k in np.unique(tile):
                kept.setdefault(int(k), []).append(b.filter(pa.array(tile == k)))
        for k in sorted(kept):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, kept[k][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                for b in kept.pop(k):
                    to.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["tile", "data"])

    part = F.floor(F.col("tile") * parts / F.col("n_tiles")).cast("int")
    return cut(rows.repartitionById(parts, part).drop("n_tiles").mapInArrow(pack, "tile int, data binary"))


class Side:
    """The symbols of one tile in order, with their cells."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).sort_by("pos").combine_chunks()
        self.symbols = table.column("symbol").combine_chunks()
        cells = table.column("cells").combine_chunks()
        cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
        self.n, self.tile = table.num_rows, table.column("tile")[0].as_py()
        self.row = np.repeat(np.arange(self.n), np.diff(cells.offsets.to_numpy()))
        flat = cells.flatten()
        self.t, self.ret = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(2))
        self.table = table

    def matrix(self, g: int) -> np.ndarray:
        out = np.zeros((self.n, g))
        out[self.row, self.t] = self.ret
        return out

    def values(self, column: str) -> np.ndarray:
        return self.table.column(column).to_numpy()


#: Both tiles of a pair and whether they are one.
Pairs = Iterator[tuple[Side, Side, bool]]


def _opened(data: pa.BinaryScalar) -> Side:
    return Side(pa.ipc.open_stream(data.as_buffer()).read_all().to_batches())


def paired(tiled: DataFrame, make: Callable[[Pairs], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What make yields for the pairs of tiles that a task has, those of one left tile together. tiled: from `written`; tasks read its
    parts, no tile goes through a shuffle."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Pairs:
        at, a = -1, None
        for b in batches:
            for left, right, data, other in zip(*(b.column(c) for c in ("left", "right", "data", "other")), strict=True):
                if left.as_py() != at:
                    at, a = left.as_py(), _opened(data)
                same = right.as_py() == at
                yield a, a if same else _opened(other), same

    left = tiled.select(F.col("tile").alias("left"), "data").hint("shuffle_replicate_nl")
    right = tiled.select(F.col("tile").alias("right"), F.col("data").alias("other"))
    return left.join(right, F.col("left") <= F.col("right")).mapInArrow(lambda batches: make(pairs(batches)), schema)


def _centred(side: Side) -> tuple[np.ndarray, int]:
    """Returns on the grid, zeros included, less their means."""
    g = int(side.values("g")[0])
    x = side.matrix(g)
    return x - x.mean(1, keepdims=True), g


def _blocks(a: Side, b: Side) -> Iterator[tuple[slice, np.ndarray]]:
    """Covariances of some symbols of a with all of b; NaN where the grid has a single point."""
    x, g = _centred(a)
    y = x if b is a else _centred(b)[0]
    step = max(1, BLOCK // max(1, b.n))
    for k in range(0, a.n, step):
        rows = slice(k, min(k + step, a.n))
        yield rows, x[rows] @ y.T / (g - 1) if g > 1 else np.full((rows.stop - k, b.n), np.nan)


def on_grid(returns: DataFrame, *more: str) -> DataFrame:
    """Written tiles of returns (symbol, ts, ret, *more) on the grid of all ts; more are columns with one value a symbol."""
    x = cut(returns.select("symbol", "ts", "ret", *more))
    grid = x.select("ts").distinct().withColumn("idx", F.row_number().over(Window.orderBy("ts")) - 1)
    size = grid.agg(F.count("*").alias("g"))
    names = cut(fitted(x, size))
    return written(by_symbol(x, names, grid, *more).join(F.broadcast(size)), names)


def covariances(returns: DataFrame, but: str | None = None, tiled: DataFrame | None = None) -> DataFrame:
    """(sym_i, sym_j, cov), i <= j, of returns (symbol, ts, ret) whose absent values are zero on the grid of all ts.

    Pairs of two symbols for which the boolean column `but` is true are left out. (symbol, ts) is a key. tiled: their tiles from
    `on_grid`, if there are any yet.
    """
    symbol = dict(returns.dtypes)["symbol"]

    def make(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        for a, b, same in pairs:
            out_a, out_b = (s.values(but) if but else np.zeros(s.n, bool) for s in (a, b))
            for rows, cov in _blocks(a, b):
                keep = ~(out_a[rows, None] & out_b[None, :])
                if same:
                    keep &= np.arange(rows.start, rows.stop)[:, None] <= np.arange(b.n)[None, :]
                i, j = np.nonzero(keep)
                values = cov[i, j]
                yield pa.RecordBatch.from_arrays([a.symbols.take(pa.array(i + rows.start)), b.symbols.take(pa.array(j)), pa.array(values, mask=np.isnan(values))], ["sym_i", "sym_j", "cov"])

    return paired(tiled or on_grid(returns, *([but] if but else [])), make, f"sym_i {symbol}, sym_j {symbol}, cov double")


def row_sums(returns: DataFrame, tiled: DataFrame | None = None) -> DataFrame:
    """(symbol, d, r): variance and sum of the absolute covariances with all others of the same matrix; no pair leaves its tile."""
    symbol = dict(returns.dtypes)["symbol"]

    def make(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        for a, b, same in pairs:
            d, r, s = np.zeros(a.n), np.zeros(a.n), np.zeros(b.n)
            for rows, cov in _blocks(a, b):
                if same:
                    at = np.arange(rows.start, rows.stop)
                    d[rows] = cov[at - rows.start, at]
                    cov[at - rows.start, at] = 0.0
                size = np.abs(cov)
                r[rows] = size.sum(1)
                s += size.sum(0)
            for side, total in [(a, r)] if same else [(a, r), (b, s)]:
                own = d if same else np.zeros(side.n)
                yield pa.RecordBatch.from_arrays([side.symbols, pa.array(own, mask=np.isnan(own)), pa.array(total, mask=np.isnan(total))], ["symbol", "d", "r"])

    return paired(tiled or on_grid(returns), make, f"symbol {symbol}, d double, r double").groupBy("symbol").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))


def rolling_pairs(returns: DataFrame, n: int, tile: int | None = None) -> DataFrame:
    """(ts, sym_i, sym_j, cov): sample covariance of the last n rows in which both of a pair have a return, i <= j.

    A pair of tiles holds both histories; for a symbol and all of the other tile, running sums over the common rows give what
    the newest n have. What comes back is the result, in parts.
    """
    symbol = dict(returns.dtypes)["symbol"]
    x = cut(returns.select("symbol", "ts", "ret"))
    grid = x.select("ts").distinct().withColumn("idx", F.row_number().over(Window.orderBy("ts")) - 1)
    size = grid.agg(F.count("*").alias("g"), F.sort_array(F.collect_list("ts")).alias("days"))
    names = cut(fitted(x, size.select("g")) if tile is None else numbered(x, tile))
    rows = by_symbol(x, names, grid).join(F.broadcast(size.select("days"))).withColumn("days", F.when(F.col("pos") == 0, F.col("days")))

    def one(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
        days = a.table.column("days")[0].values
        g = len(days)

        def filled(side: Side) -> tuple[np.ndarray, np.ndarray]:
            there = np.zeros((side.n, g), bool)
            there[side.row, side.t] = True
            return side.matrix(g), there

        (xs, has_x), (ys, has_y) = filled(a), filled(b)
        step = max(1, BLOCK // max(1, g))
        for i in range(a.n):
            own = np.flatnonzero(has_x[i])
            if len(own) < n:
                continue
            for k in range(i if same else 0, b.n, step):
                j, t = np.nonzero(has_y[k : k + step, own])
                u, v = xs[i, own[t]], ys[k + j, own[t]]
                sums = np.cumsum(np.vstack((np.zeros((1, 3)), np.column_stack((u, v, u * v)))), axis=0)
                # the place of a row among the common ones of its pair; from the n-th on there is a result
                at = np.flatnonzero(np.arange(len(j)) - np.searchsorted(j, j) >= n - 1)
                su, sv, suv = (sums[at + 1] - sums[at + 1 - n]).T
                who = pa.array(np.full(len(at), i)), pa.array(k + j[at])
                yield pa.RecordBatch.from_arrays([days.take(pa.array(own[t[at]])), a.symbols.take(who[0]), b.symbols.take(who[1]), pa.array((suv - su * sv / n) / (n - 1))], ["ts", "sym_i", "sym_j", "cov"])

    def make(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        for a, b, same in pairs:
            yield from one(a, b, same)

    return paired(written(rows, names), make, f"ts {dict(returns.dtypes)['ts']}, sym_i {symbol}, sym_j {symbol}, cov double")
