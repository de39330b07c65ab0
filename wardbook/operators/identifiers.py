"""Recovering missing identifiers from the gaps of a sequential range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.predicates import name
from wardbook.operators.ranking import running_totals
from wardbook.session import settle

# Numbers per bitmap, fixed by Spark's bitmap functions.
BITMAP_BITS = 32_768
BYTES = f"transform(sequence(1, {BITMAP_BITS // 8}), k -> CAST(conv(hex(substring(bits, k, 1)), 16, 10) AS INT))"
IS_SET = "((bytes[shiftright(i, 3)] >> (i & 7)) & 1) = 1"


def fill_id_gaps(df: DataFrame, id_col: str, order_by: str) -> DataFrame:
    """Give rows without an id the unused ids between the smallest and largest one, in row order.

    ``order_by`` is an integer column, unique among the rows without an id. If
    ids run out the remaining rows stay null; unused ids left over stay unused;
    duplicate ids are not touched.

    The table is read once when this is called: the ids in use, and the order
    values of rows without one, become bitmaps, combined in each task before
    they are shuffled. Running counts of their bits rank the gaps and the rows,
    and the pairs of equal rank are written. The result reads the table a
    second time and joins the pairs, which Spark broadcasts or not by their
    written size.
    """
    own, key, missing = name(id_col), name(order_by), f"{name(id_col)} IS NULL"
    maps = settle(
        df.selectExpr(f"{missing} AS lacks_id", f"CAST(coalesce({own}, {key}) AS BIGINT) AS number")
        .selectExpr("lacks_id", "number", "shiftright(number, 15) AS bucket", "CAST(number & 32767 AS INT) AS at")
        .groupBy("lacks_id", "bucket")
        .agg(
            F.expr("bitmap_construct_agg(at) AS bits"),
            F.expr("count(*) AS n_rows"),
            F.expr("min(number) AS lo"),
            F.expr("max(number) AS hi"),
        ),
        "id-bitmaps",
    )
    stats = maps.selectExpr(
        "min(CASE WHEN NOT lacks_id THEN lo END) AS lo",
        "max(CASE WHEN NOT lacks_id THEN hi END) AS hi",
        "coalesce(sum(CASE WHEN NOT lacks_id THEN bitmap_count(bits) END), 0) AS n_ids",
        "coalesce(sum(CASE WHEN lacks_id THEN n_rows END), 0) AS n_missing",
        "coalesce(sum(CASE WHEN lacks_id AND bucket IS NOT NULL THEN bitmap_count(bits) END), 0) AS n_keys",
    ).first()
    if stats["n_missing"] == 0 or stats["lo"] is None:
        return df
    if stats["n_keys"] != stats["n_missing"]:
        raise ValueError(f"{order_by} must be unique and not null on rows without {id_col}")

    assigned = settle(_assignments(maps, stats), "assigned-ids")
    kind = df.schema[id_col].dataType.simpleString()
    # A row with an id gets a key that no pair has, its own id, so such rows spread evenly if the join shuffles.
    left = df.selectExpr("*", f"{missing} AS __lacks", f"CAST(coalesce({own}, {key}) AS BIGINT) AS __number")
    joined = left.join(assigned.selectExpr("true AS __lacks", "key AS __number", "new_id AS __new_id"), ["__lacks", "__number"], "left")
    return joined.selectExpr(*[f"coalesce({own}, CAST(__new_id AS {kind})) AS {own}" if c == id_col else name(c) for c in df.columns])


def _assignments(maps: DataFrame, stats) -> DataFrame:
    """(order value of a row without id, recovered id), pairing both by rank."""
    lo, n = int(stats["lo"]), int(stats["n_missing"])
    # Among the first (ids + missing ids) numbers there are enough gaps for
    # every missing id, so a sparse id range is not walked to its end, but for whole buckets.
    last_bucket = (lo + int(stats["n_ids"]) + n) >> 15
    hi = min(int(stats["hi"]), last_bucket * BITMAP_BITS + BITMAP_BITS - 1)
    buckets = maps.sparkSession.range(lo >> 15, (hi >> 15) + 1).withColumnRenamed("id", "bucket")
    used = maps.where("NOT lacks_id").select("bucket", "bits")
    places = f"greatest({lo} - bucket * {BITMAP_BITS}, 0)", f"least({hi} - bucket * {BITMAP_BITS}, {BITMAP_BITS - 1})"
    gaps = buckets.join(used, "bucket", "left").selectExpr("bucket", "bits", f"{places[0]} AS low", f"{places[1]} AS high")
    gaps = gaps.selectExpr("*", "high - low + 1 - coalesce(bitmap_count(bits), 0) AS n")
    free = f"filter(sequence(CAST(low AS INT), CAST(high AS INT)), i -> coalesce(NOT {IS_SET}, true))"
    keys = maps.where("lacks_id").selectExpr("bucket", "bits", "bitmap_count(bits) AS n")
    own = f"filter(sequence(0, {BITMAP_BITS - 1}), i -> {IS_SET})"
    return _ranked(keys, own, "key", n).join(_ranked(gaps, free, "new_id", n), "rank").select("key", "new_id")


def _ranked(buckets: DataFrame, numbers: str, out: str, n: int) -> DataFrame:
    """The first n numbers of the buckets with their rank; only bitmaps that hold one of them are spelled out."""
    upto = running_totals(buckets.where("n > 0"), "bucket", {"n": "upto"}).where(f"upto - n < {n}")
    spelled = upto.selectExpr("*", f"{BYTES} AS bytes").selectExpr("bucket", "upto - n AS before", f"posexplode({numbers}) AS (at, place)")
    return spelled.selectExpr("before + at + 1 AS rank", f"bucket * {BITMAP_BITS} + place AS {out}").where(f"rank <= {n}")
