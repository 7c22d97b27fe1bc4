"""Time-series features of groups too long for one task: a segmented scan.

A group's rows get their positions from range totals and are cut into chunks, each a task's
own. Lags and rolling frames look back a fixed number of rows, which each chunk carries from
the one before it (its halo) and leaves out at the end. Exponential means are linear in what
came before: a chunk gives, for each row, its own part and the factor by which an earlier
mean still counts; a fold over the few chunks of a group then tells each one what it begins from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.operators.ordering import numbered
from tessella.operators.windows import TimeSeriesConfig, lag, momentum, rolling, trailing

#: Rows of a chunk.
CHUNK = 65_536


def chunked(df: DataFrame, group: str, order: list[str], halo: int, chunk: int = CHUNK) -> DataFrame:
    """Adds __at (position in the group), __chunk and __halo: the last ``halo`` rows of a chunk stand in the next one too."""
    if not 0 <= halo <= chunk:
        raise ValueError(f"features look back {halo} rows, a chunk has {chunk}")
    rows = numbered(df, order, "__at", group)
    own = F.floor(F.col("__at") / chunk)
    both = F.when(F.col("__at") % chunk >= chunk - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("__chunk", F.explode(both)).withColumn("__halo", F.col("__chunk") != own)


def decayed(x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's values (NaN: none): the mean as if the group began here (NaN before its first value), and part and factor of S + D * earlier mean."""
    alone, part, factor = np.full(len(x), np.nan), np.zeros(len(x)), np.ones(len(x))
    e, s, d = np.nan, 0.0, 1.0
    for i, v in enumerate(x.tolist()):
        if v == v:
            e = v if e != e else alpha * v + (1 - alpha) * e
            s, d = alpha * v + (1 - alpha) * s, d * (1 - alpha)
        alone[i], part[i], factor[i] = e, s, d
    return alone, part, factor


def scanned(columns: list[str], alphas: tuple[float, ...], names: list[str]):
    """For rows sorted by group, chunk and position: the rows with three numbers for each column and alpha. Chunks are whole however batches are cut."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        added = []
        for c in columns:
            x = table.column(c).cast(pa.float64()).to_numpy().astype(float)
            for a in alphas:
                added += [pa.array(v, mask=np.isnan(v)) for v in decayed(x, a)]
        whole = table.combine_chunks()
        flat = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns]
        return pa.RecordBatch.from_arrays([*flat, *added], names=[*table.column_names, *names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            chunk, run = batch.column(batch.schema.get_field_index("__chunk")).to_numpy(), batch.column(batch.schema.get_field_index("__run")).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (run[1:] != run[:-1])) + 1
            at = 0
            for cut in [*cuts.tolist(), batch.num_rows]:
                piece = batch.slice(at, cut - at)
                if held and piece.num_rows and (held[0].column("__chunk")[0] != piece.column("__chunk")[0] or held[0].column("__run")[0] != piece.column("__run")[0]):
                    yield finish(pa.Table.from_batches(held))
                    held = []
                if piece.num_rows:
                    held.append(piece)
                at = cut
        if held:
            yield finish(pa.Table.from_batches(held))

    return scan


def spread_time_series(df: DataFrame, group: str, order: list[str], columns: list[str], config: TimeSeriesConfig = TimeSeriesConfig(), chunk: int = CHUNK) -> DataFrame:
    """The features of ``windows.grouped_time_series``, with no task that holds more than a chunk of a group and its halo.

    ``order`` must tell a group's rows apart, its first column best; rows that share that
    column's value are numbered in one task.
    """
    halo = max([0, *config.lags, *(n - 1 for n in config.windows), *config.momenta])
    rows = chunked(df, group, order, halo, chunk)
    w = Window.partitionBy(group, "__chunk").orderBy("__at")
    out: dict[str, Column] = {}
    for c in columns:
        out |= {f"{c}_lag_{k}": lag(c, k, w) for k in config.lags}
        out |= {f"{c}_roll_{n}_{s}": rolling(c, s, trailing(w, n), config.min_periods) for n in config.windows for s in config.stats}
        out |= {f"{c}_ewma_{a:.2f}": F.lit(None).cast("double") for a in config.alphas}
        out |= {f"{c}_momentum_{k}": momentum(c, k, w) for k in config.momenta}
    final = [*(c for c in df.columns if c not in out), *out]
    rows = rows.withColumns(out).where("not __halo")
    if not config.alphas:
        return rows.select(*[f"`{c}`" for c in final])
    pairs = [(c, a) for c in columns for a in config.alphas]
    names = [f"__{n}{i}" for i in range(len(pairs)) for n in "esd"]
    rows = rows.drop(*[f"{c}_ewma_{a:.2f}" for c, a in pairs]).withColumn("__run", F.md5(F.concat(F.col(group).isNull().cast("string"), F.coalesce(F.col(group).cast("string"), F.lit("")))))
    sorted_rows = rows.repartition(F.col("__run"), F.col("__chunk")).sortWithinPartitions("__run", "__chunk", "__at")
    schema = StructType([*sorted_rows.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    local = sorted_rows.mapInArrow(scanned(columns, config.alphas, names), schema)
    ends = local.groupBy("__run", "__chunk").agg(F.max_by(F.array(*names), "__at").alias("v"))
    carried = ends.groupBy("__run").applyInArrow(lambda t: carries(t, len(pairs)), "run string, chunk long, carry array<double>")
    joined = local.join(carried, (F.col("__run") == F.col("run")) & (F.col("__chunk") == F.col("chunk")), "left")

    def mean(i: int) -> Column:
        carry = F.col("carry")[i]
        return F.when(carry.isNull(), F.col(f"__e{i}")).otherwise(F.col(f"__s{i}") + F.col(f"__d{i}") * carry)

    return joined.withColumns({f"{c}_ewma_{a:.2f}": mean(i) for i, (c, a) in enumerate(pairs)}).select(*[f"`{c}`" for c in final])


def carries(table: pa.Table, pairs: int) -> pa.Table:
    """What each chunk of a group begins from, by a fold over the chunks' last rows; NULL where no value has come yet."""
    order = np.argsort(table.column("__chunk").to_numpy())
    ends = table.column("v").to_pylist()
    now: list[float | None] = [None] * pairs
    run, chunk, out = [], [], []
    for k in order.tolist():
        run.append(table.column("__run")[k].as_py()), chunk.append(table.column("__chunk")[k].as_py()), out.append(list(now))
        for i in range(pairs):
            e, s, d = ends[k][3 * i : 3 * i + 3]
            now[i] = e if now[i] is None else s + d * now[i]
    return pa.table({"run": pa.array(run, pa.string()), "chunk": pa.array(chunk, pa.int64()), "carry": pa.array(out, pa.list_(pa.float64()))})
