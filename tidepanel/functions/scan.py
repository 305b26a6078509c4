"""Recursions y_t = a_t * y_t-1 + b_t along ordered histories, as an associative scan of affine maps.

A history is cut into pieces, which may lie in different tasks, and these into chunks of a few rows. The maps of a chunk are
composed by doubling (each row with the one 1, 2, 4, ... rows before it), so are the chunks of a key, of which there is one
row each; what a chunk starts from is joined back to its rows. All of it is windows and one join.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a chunk, and the doublings over the chunks of a key: at most 64 * 2**14 rows of a history, if pieces are long.
CHUNK_ROWS, ROUNDS = 64, 14


def _doubled(x: DataFrame, names: list[str], w: WindowSpec, rounds: int) -> DataFrame:
    """Columns _a_name, _b_name composed with those of all rows before them in the window."""
    for r in range(rounds):
        before = {f"_{p}_{n}_": F.lag(f"_{p}_{n}", 1 << r).over(w) for n in names for p in "ab"}
        x = x.withColumns(before)
        x = x.withColumns({f"_b_{n}": F.col(f"_b_{n}") + F.col(f"_a_{n}") * F.coalesce(f"_b_{n}_", F.lit(0.0)) for n in names} | {f"_a_{n}": F.col(f"_a_{n}") * F.coalesce(f"_a_{n}_", F.lit(1.0)) for n in names}).drop(*before)
    return x


def affine_scan(df: DataFrame, maps: dict[str, tuple[Column, Column]], start: dict[str, Column], key: str = "symbol", order: str = "date", piece: Column | None = None, seeded: bool = False) -> DataFrame:
    """df with a column y for each name of maps (a, b), from start, taken from the key's first row, before that row.

    seeded: y of the first row is start itself, to the last bit (as its map says but for rounding).

    piece must not fall along the order (default: the year of the order column); pieces of one key may be in different
    tasks. (key, order) must be unique; a and b must not be null.
    """
    names = list(maps)
    piece = F.year(order) if piece is None else piece
    place = ["_scan_piece", "_scan_chunk"]
    x = df.withColumns({"_scan_piece": piece} | {f"_a_{n}": a.cast("double") for n, (a, _) in maps.items()} | {f"_b_{n}": b.cast("double") for n, (_, b) in maps.items()} | {f"_s_{n}": s.cast("double") for n, s in start.items()})
    x = x.withColumn("_scan_row", F.row_number().over(Window.partitionBy(key, "_scan_piece").orderBy(order)) - 1)
    x = x.withColumn("_scan_chunk", F.floor(F.col("_scan_row") / CHUNK_ROWS))
    x = _doubled(x, names, Window.partitionBy(key, *place).orderBy(order), int(log2(CHUNK_ROWS)))
    ends = x.groupBy(key, *place).agg(*[F.max_by(f"_{p}_{n}", order).alias(f"_{p}_{n}") for n in names for p in "ab"], *[F.min_by(f"_s_{n}", order).alias(f"_s_{n}") for n in names])
    chunks = Window.partitionBy(key).orderBy(*place)
    first = F.col("_scan_n") == 1
    ends = ends.withColumn("_scan_n", F.row_number().over(chunks))
    # the first chunk maps everything to where it leads from the start
    ends = ends.withColumns({f"_b_{n}": F.when(first, F.col(f"_b_{n}") + F.col(f"_a_{n}") * F.col(f"_s_{n}")).otherwise(F.col(f"_b_{n}")) for n in names} | {f"_a_{n}": F.when(first, 0.0).otherwise(F.col(f"_a_{n}")) for n in names})
    ends = _doubled(ends, names, chunks, ROUNDS)
    fits = F.when(F.col("_scan_n") > 1 << ROUNDS, F.raise_error(F.lit("a history has too many chunks")).cast("double"))
    carried = ends.select("_scan_n", F.col(key).alias("_scan_key"), *[F.col(c).alias(f"{c}_") for c in place], *[F.coalesce(fits, F.when(first, F.col(f"_s_{n}")).otherwise(F.lag(f"_b_{n}").over(chunks))).alias(f"_c_{n}") for n in names])
    met = x.join(carried, F.col(key).eqNullSafe(F.col("_scan_key")) & (F.col("_scan_piece") == F.col("_scan_piece_")) & (F.col("_scan_chunk") == F.col("_scan_chunk_")))
    y = {n: F.col(f"_b_{n}") + F.col(f"_a_{n}") * F.col(f"_c_{n}") for n in names}
    if seeded:
        y = {n: F.when((F.col("_scan_n") == 1) & (F.col("_scan_row") == 0), F.col(f"_c_{n}")).otherwise(c) for n, c in y.items()}
    return met.select(*df.columns, *[c.alias(n) for n, c in y.items()])
