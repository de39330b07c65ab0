"""Operator 1: shards as leaves of a k-d tree over document metadata, split at weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardbook.session import settle

# A split looks at this many equal slices of a node's remaining range at once.
BINS = 256


def _spread(nodes: DataFrame, dims: list[str]) -> DataFrame:
    return nodes.groupBy("node").agg(
        F.sum("weight").alias("total"),
        F.count("*").alias("n"),
        *[F.min(d).alias(f"lo_{d}") for d in dims],
        *[F.max(d).alias(f"hi_{d}") for d in dims],
    )


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([tuple(r.values()) for r in rows], schema))


def _weighted_cuts(rows: DataFrame, cuts: dict[int, dict]) -> dict[int, tuple[int, int]]:
    """The (value, row) at which each node's left part reaches its target weight.

    Rows are ordered by the node's dimension and, among equal values, by their
    number, so that one value holding most of a node can be split too. Each
    pass sums the weights of ``BINS`` slices of the remaining range and keeps
    the slice that holds the target, first over the values and then over the
    row numbers of the value found. Only one row per node reaches the driver.
    """
    spark = rows.sparkSession
    found: dict[int, tuple[int, int]] = {}
    state = {k: {"node": k, **c, "value": None} for k, c in cuts.items()}
    while state:
        schema = "node bigint, dim int, lo bigint, hi bigint, below bigint, target bigint, value bigint"
        open_ = _table(spark, [{k: s[k] for k in ("node", "dim", "lo", "hi", "below", "target", "value")} for s in state.values()], schema)
        at = F.when(F.col("value").isNull(), F.element_at("dims", F.col("dim") + 1)).when(
            F.element_at("dims", F.col("dim") + 1) == F.col("value"), F.col("row")
        )
        # The width is rounded up, so BINS slices always cover the range.
        width = F.expr(f"(hi - lo) div {BINS} + 1")
        inside = rows.join(open_, "node").withColumn("at", at).where("at BETWEEN lo AND hi")
        slices = inside.withColumn("width", width).withColumn("bin", F.expr("(at - lo) div width"))
        slices = slices.groupBy("node", "lo", "hi", "width", "below", "target", "bin").agg(F.sum("weight").alias("w"))
        upto = Window.partitionBy("node").orderBy("bin")
        slices = slices.withColumn("upto", F.col("below") + F.sum("w").over(upto))
        chosen = slices.where("upto >= target AND upto - w < target").select("node", "lo", "hi", "width", "bin", (F.col("upto") - F.col("w")).alias("below"))
        for r in chosen.collect():
            s = state[r["node"]]
            lo = r["lo"] + r["bin"] * r["width"]
            s |= {"lo": lo, "hi": min(r["hi"], lo + r["width"] - 1), "below": r["below"]}
            if s["lo"] < s["hi"]:
                continue
            if s["value"] is None:
                s |= {"value": lo, "lo": s["row_lo"], "hi": s["row_hi"]}
                if s["lo"] < s["hi"]:
                    continue
            found[r["node"]] = (s["value"], s["lo"])
            del state[r["node"]]
    return found


def kd_leaves(df: DataFrame, dims: dict[str, Column], weight: Column, target: int | None = None, leaves: int | None = None) -> DataFrame:
    """Append ``shard``, ``part`` and ``row``: the k-d tree leaf of each row.

    A node is split along the dimension whose values, relative to those of the
    whole table, spread widest, at the weighted median; a node that must give
    an odd number of leaves is split in that proportion. Splitting ends when a
    leaf's share is at most ``target``, or after ``leaves`` leaves. Dimensions
    are whole numbers; a null one counts as the lowest value. The weights are
    whole and positive.

    ``df`` should hold slim rows: it is written once, then read by each pass
    over it. The tree, with one entry per leaf, is kept by the driver.
    """
    spark = df.sparkSession
    names = list(dims)
    slim = df.withColumns({"dims": F.array(*[F.coalesce(c.cast("bigint"), F.lit(-1)) for c in dims.values()]), "weight": weight.cast("bigint")})
    rows = settle(slim.withColumn("row", F.monotonically_increasing_id()), "slim").withColumn("part", F.shiftright("row", 33))
    rows = rows.withColumn("node", F.lit(0).cast("bigint"))
    flat = [F.element_at("dims", i + 1).alias(n) for i, n in enumerate(names)]
    root = _spread(rows.select("node", "weight", *flat), names).first()
    if root is None:
        return rows.withColumn("shard", F.lit(None).cast("int")).drop("node", "dims", "weight")
    leaves = leaves or max(1, -(-root["total"] // target))
    row_hi = rows.agg(F.max("row")).first()[0]
    extent = {d: max(1, root[f"hi_{d}"] - root[f"lo_{d}"]) for d in names}
    # Node number -> leaves it must give; the first leaf of a node is its number.
    pending, done = {0: leaves}, {}
    while pending := {k: m for k, m in pending.items() if m > 1}:
        spreads = {r["node"]: r for r in _spread(rows.select("node", "weight", *flat), names).collect()}
        cuts = {}
        for node, m in pending.items():
            if node not in spreads or spreads[node]["n"] < 2:
                done[node] = m
                continue
            s = spreads[node]
            dim = max(range(len(names)), key=lambda i: (s[f"hi_{names[i]}"] - s[f"lo_{names[i]}"]) / extent[names[i]])
            lo, hi = s[f"lo_{names[dim]}"], s[f"hi_{names[dim]}"]
            goal = max(1, s["total"] * (m // 2) // m)
            cuts[node] = {"dim": dim, "lo": lo, "hi": hi, "below": 0, "target": goal, "row_lo": 0, "row_hi": row_hi}
        if not cuts:
            break
        found = _weighted_cuts(rows, cuts)
        split = [{"node": k, "dim": cuts[k]["dim"], "value": v, "upto": r, "right": k + pending[k] // 2} for k, (v, r) in found.items()]
        table = _table(spark, split, "node bigint, dim int, value bigint, upto bigint, right bigint")
        here = F.element_at("dims", F.col("dim") + 1)
        goes_right = (here > F.col("value")) | ((here == F.col("value")) & (F.col("row") > F.col("upto")))
        rows = rows.join(table, "node", "left").withColumn("node", F.when(goes_right, F.col("right")).otherwise(F.col("node"))).drop("dim", "value", "upto", "right")
        pending = {k: m for node in found for k, m in ((node, pending[node] // 2), (node + pending[node] // 2, pending[node] - pending[node] // 2))}
    return rows.withColumn("shard", F.col("node").cast("int")).drop("node", "dims", "weight")


def slots(rows: DataFrame) -> DataFrame:
    """Append ``slot``: a gapless place of each row in its shard.

    A shard is never sorted whole. Rows are numbered within the part of the
    input they come from, and the parts' counts give the number each begins at.
    """
    counts = settle(rows.groupBy("shard", "part").agg(F.count("*").alias("n")), "shard-counts")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("begin"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return rows.withColumn("place", place).join(begins, ["shard", "part"]).withColumn("slot", F.col("begin") + F.col("place")).drop("place", "begin")


def shard_documents(df: DataFrame, target_bytes: int | None = None, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of near equal bytes: key, size, text_crc32, shard, slot.

    Dimensions are the key (where it is a number), the size, and the language
    and source where the table has them, each as the first bytes of its text
    in alphabetical order. The size of a row is its text's bytes plus 1, so
    null and empty texts count 1. Rows with equal values, repeated rows
    included, are split by their place in the input; an empty table gives no
    rows. The text is read once.
    """
    def leading(name: str) -> Column:
        head = F.rpad(F.hex(F.substring(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("bigint")

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    dims = {"d_size": F.col("size")}
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        dims["d_key"] = F.col(key)
    extra = [c for c in ("source", "lang") if c in df.columns and c not in (key, text)]
    slim = df.select(key, size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), *[leading(c).alias(f"d_{c}") for c in extra])
    dims |= {f"d_{c}": F.col(f"d_{c}") for c in extra}
    leaves = kd_leaves(slim, dims, F.col("size"), target_bytes, shards)
    return slots(leaves.select(key, "size", "text_crc32", "shard", "part", "row")).drop("part", "row")
