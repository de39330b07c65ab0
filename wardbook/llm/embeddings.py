"""Operator 9: embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.graph import components
from wardbook.session import settle

BLOCK_DIMS = 8  # dimensions of a block
CELL_DIMS = 2  # of which so many make the grid that finds neighbours
# Rows of one cell compared by one task. A fuller cell is cut into pieces, and
# each pair of pieces is a task.
PIECE_ROWS = 2_000
MARGIN = 1e-9  # rounding of rotated coordinates


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed orthogonal matrix, so that no block holds all the variation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows that may be linked: (key, label, v) with v in double precision."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(label).isNotNull() & sound).select(F.col(key).alias("key"), F.col(label).alias("label"), v.alias("v"))


def block_rows(rows: DataFrame, threshold: float) -> DataFrame:
    """A row per vector, block and grid cell: its own cell (home) and those within reach."""
    budget = 2 * (1 - threshold)  # squared distance of unit vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            sizes = frame["v"].map(len)
            for size, part in frame.groupby(sizes):
                turn = turns.setdefault(size, rotation(size))
                x = np.stack(part["v"].to_numpy())
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn
                for block, start in enumerate(range(0, size, BLOCK_DIMS)):
                    b = x[:, start : start + BLOCK_DIMS]
                    # The budget is shared by the blocks in proportion to their dimensions.
                    radius = np.sqrt(budget * b.shape[1] / size) + MARGIN
                    used = min(CELL_DIMS, b.shape[1])
                    at = b[:, :used] / radius
                    home = np.floor(at).astype(np.int64)
                    # A pair within the radius lies in neighbouring cells, at most a half cell away on each side of the middle between them.
                    for step in np.ndindex(*[3] * used):
                        shift = np.array(step) - 1
                        is_home = not shift.any()
                        # Of two neighbouring cells only the later one is sent to the earlier one's place.
                        if not is_home and tuple(shift) > (0,) * used:
                            continue
                        gap = np.where(shift < 0, at - home, np.where(shift > 0, home + 1 - at, 0))
                        near = np.flatnonzero((gap**2).sum(1) <= 1 + MARGIN)
                        if not len(near):
                            continue
                        cell = [f"{size}:{block}:" + ",".join(map(str, c)) for c in (home[near] + shift).tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["id"].to_numpy()[near]), pa.array(part["label"].to_numpy()[near]).cast(batch.column("label").type), pa.array(cell),
                             pa.array(np.full(len(near), is_home)), pa.array(list(b[near]), pa.list_(pa.float64())), pa.array(np.full(len(near), radius))],
                            names=["id", "label", "cell", "home", "b", "radius"],
                        )

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "v").mapInArrow(run, f"id bigint, label {label}, cell string, home boolean, b array<double>, radius double")


def _in_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare the rows of each g; rows come ordered by g, of which at most two pieces of a cell share one."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        frame = pd.concat([rest, frame]) if rest is not None else frame
        open_ = frame["g"].to_numpy() == frame["g"].iloc[-1]  # goes on in the next batch, perhaps
        rest = frame[open_]
        yield _within(frame[~open_])
    if rest is not None:
        yield _within(rest)


def _within(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one g whose block distance is within the radius and of which at least one is at home there."""
    found = [np.empty((0, 2), np.int64)]
    if len(frame):
        g, ids = frame["g"].to_numpy(), frame["id"].to_numpy()
        home, side, same, radius = (frame[c].to_numpy() for c in ("home", "side", "same", "radius"))
        vectors = frame["b"].to_numpy()
        ends = np.flatnonzero(np.r_[g[1:] != g[:-1], True]) + 1
        for start, end in zip(np.r_[0, ends[:-1]], ends):
            if end - start < 2:
                continue
            b = np.stack(vectors[start:end])
            norm = (b * b).sum(1)
            rows = others = np.arange(end - start)
            if not same[start]:
                rows, others = np.flatnonzero(side[start:end] == 0), np.flatnonzero(side[start:end] == 1)
            for at in range(0, len(rows), 512):
                r = rows[at : at + 512]
                d = norm[r][:, None] + norm[others][None, :] - 2 * b[r] @ b[others].T
                ok = (d <= radius[start] ** 2 + 1e-9) & (home[start:end][r][:, None] | home[start:end][others][None, :])
                if same[start]:
                    ok &= r[:, None] < others[None, :]
                i, j = np.nonzero(ok)
                found.append(np.stack([ids[start + r[i]], ids[start + others[j]]], 1))
    pairs = np.concatenate(found)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pd.DataFrame({"x": pairs.min(1), "y": pairs.max(1)})


def candidate_pairs(blocks: DataFrame) -> DataFrame:
    """Distinct (x, y) that share a cell within the block radius."""
    blocks = settle(blocks, "blocks")
    sizes = blocks.groupBy("label", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = settle(sizes.withColumn("pieces", F.expr(f"cast((n + {PIECE_ROWS - 1}) div {PIECE_ROWS} as int)")), "cells")
    rows = blocks.join(sizes, ["label", "cell"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    # A row goes to each pair of pieces that has its own: (p, p), (p, q) and (q, p).
    pairs = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda q: F.struct(F.least("piece", q).alias("p"), F.greatest("piece", q).alias("q")))
    rows = rows.withColumn("pq", F.explode(pairs)).withColumns({"side": F.when(F.col("piece") == F.col("pq.p"), 0).otherwise(1), "same": F.expr("pq.p = pq.q")})
    # Most cells hold few rows, so a task reads its cells in order and compares them in one go.
    rows = rows.select(F.xxhash64("label", "cell", "pq").alias("g"), "id", "home", "b", "radius", "side", "same")
    rows = rows.repartition("g").sortWithinPartitions("g")
    return rows.mapInPandas(_in_groups, "x bigint, y bigint").distinct()


def embedding_links(df: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row per vector: key, n_links, component_id and kept.

    Two vectors with the same label link at a cosine of at least ``threshold``
    in double precision. Unit vectors that near have a squared distance of at
    most 2 - 2 * threshold, so after a rotation some block of dimensions has at
    most its share of it; candidates of each block come from a grid, and every
    one is checked exactly. A null label, and a vector that is null, empty,
    zero, or has a null or non-finite component links with nothing; vectors of
    different length don't link. Equal vectors are one class, joined once and
    counted with all its members. Keys are distinct and not null; an empty
    table gives no rows; other columns are left out.
    """
    rows = usable(df, key, vector, label)
    # Adding zero makes -0.0 and 0.0 equal.
    rows = settle(rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("hash", F.xxhash64("label", "v")), "vectors")
    classes = rows.groupBy("label", "v").agg(F.min("key").alias("id"), F.count("*").alias("n"))
    classes = settle(classes, "vector-classes")
    pairs = candidate_pairs(block_rows(classes, threshold))
    left = classes.select(F.col("id").alias("x"), F.col("v").alias("vx"), F.col("n").alias("nx"))
    right = classes.select(F.col("id").alias("y"), F.col("v").alias("vy"), F.col("n").alias("ny"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = dot("vx", "vy") / (F.sqrt(dot("vx", "vx")) * F.sqrt(dot("vy", "vy")))
    links = settle(pairs.join(left, "x").join(right, "y").where(cosine >= threshold).select("x", "y", "nx", "ny"), "vector-links")
    degree = links.select(F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("ny").alias("m")), F.struct(F.col("y").alias("id"), F.col("nx").alias("m")))).alias("e"))
    degree = degree.groupBy("e.id").agg(F.sum("e.m").alias("m"))
    label_of = components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "id")
    found = classes.join(degree, "id", "left").join(label_of, "id", "left")
    found = found.select("label", "v", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.join(found, ["label", "v"]).select(F.col("key").alias(key), "n_links", "component_id")
    out = df.select(key).join(linked, key, "left").select(key, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", key).alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
