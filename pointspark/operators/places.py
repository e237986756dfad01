"""Place recognition: descriptor retrieval, non-maximum suppression, plane verification, and session graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.operators import grid
from pointspark.operators.graph import connected_leads


def sign_bits(vector: Column, first: int, n: int) -> Column:
    """Bits of the signs of n array elements from ``first`` on, as a long."""
    bits = [F.when(F.element_at(vector, first + i + 1) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(n)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two bit sets; NULL if both are empty."""
    n = F.bit_count(a) + F.bit_count(b)
    return F.when(n > 0, 2 * F.bit_count(a.bitwiseAND(b)) / n)


def occupancy_bits(points: DataFrame, by: list[str], index: str, width: int = 62) -> DataFrame:
    """(by, word, bits): occupied height slices of each cell (X17); slice ``index`` is bit index % width of word index // width, so there is
    no highest or lowest slice."""
    word = F.floor(F.col(index) / width).cast("long")
    rows = points.where(F.col(index).isNotNull()).select(*by, word.alias("word"), F.pmod(F.col(index), F.lit(width)).cast("int").alias("_bit"))
    return rows.groupBy(*by, "word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"))


def candidates(query: DataFrame, index: DataFrame, skip: int, side_share: float, least_dice: float, sides: tuple[str, str, str] = ("s0", "s1", "s2")) -> DataFrame:
    """Descriptor matches (J17): 27-bin probe on side lengths, frame gap, side distance, Dice similarity.

    Rows need frame, id, three sides and bits. The index side keeps its bin; the query is sent to the 27 bins around.
    """
    bins = [f"b{i}" for i in range(3)]
    a = query.select(F.col("frame").alias("frame_q"), F.col("id").alias("id_q"), *[F.col(s).alias(f"q{i}") for i, s in enumerate(sides)], F.col("bits").alias("bits_q"), *[F.floor(s).cast("long").alias(b) for s, b in zip(sides, bins)])
    for b in bins:
        a = a.withColumn(b, F.explode(F.array(F.col(b) - 1, F.col(b), F.col(b) + 1)))
    c = index.select(F.col("frame").alias("frame_c"), F.col("id").alias("id_c"), *[F.col(s).alias(f"c{i}") for i, s in enumerate(sides)], F.col("bits").alias("bits_c"), *[F.floor(s).cast("long").alias(b) for s, b in zip(sides, bins)])
    m = a.join(c, bins).where(F.col("frame_q") - F.col("frame_c") > skip)
    off = F.sqrt(sum((F.col(f"q{i}") - F.col(f"c{i}")) ** 2 for i in range(3)))
    size = F.sqrt(sum(F.col(f"q{i}") ** 2 for i in range(3)))
    return m.withColumn("dice", dice(F.col("bits_q"), F.col("bits_c"))).where((off < side_share * size) & (F.col("dice") > least_dice)).select("frame_q", "id_q", "frame_c", "id_c", "dice")


def top_frames(matches: DataFrame, n: int, least_votes: int = 5) -> DataFrame:
    """(frame_q, frame_c, votes, place): the n frames with most votes (T5)."""
    votes = matches.groupBy("frame_q", "frame_c").agg(F.count("*").alias("votes")).where(F.col("votes") >= least_votes)
    return votes.withColumn("place", F.row_number().over(W.partitionBy("frame_q").orderBy(F.desc("votes"), "frame_c"))).where(F.col("place") <= n)


def suppress(corners: DataFrame, radius: float, item: str, strength: str) -> DataFrame:
    """Corners without an equally strong or stronger one within the radius; tied ones suppress each other (T4).

    Ids are unique. A corner without an id or a strength neither suppresses nor is suppressed.
    """
    given = F.col(item).isNotNull() & F.col(strength).isNotNull()
    rows = grid.located(corners)
    known = rows.where(given)
    # corners of a cell whose diagonal is shorter than the radius beat each other, so at most its strongest is left; so it is in cells moved by
    # half. Neither pass copies or pairs rows, and a crowd costs its size and not its square
    left = known.select(item, strength, *grid.XYZ)
    for moved in (0.0, 0.5):
        cell = W.partitionBy(*[F.floor(F.col(c) / (radius / 2) + moved) for c in grid.XYZ]).orderBy(F.desc(strength), F.desc(item))
        left = left.withColumn("_place", F.row_number().over(cell)).where(F.col("_place") == 1).drop("_place")
    # these go to all cells that their balls touch, at most eight each; the corners stay in their own. A corner meets itself there too, so one join
    # has both the rivals and the rows. It is a merge join because the planner doesn't see that the balls are copied, and would send them through
    # the driver
    size, names = 2 * radius, [f"_{c}" for c in grid.CELL]
    balls = left.select(F.col(item).alias("_id"), F.col(strength).alias("_s"), *[F.col(c).alias(f"_{c}") for c in grid.XYZ])
    for c, n in zip(grid.XYZ, names):
        balls = balls.withColumn(n, F.explode(F.sequence(F.floor((F.col(f"_{c}") - radius) / size), F.floor((F.col(f"_{c}") + radius) / size))))
    dx, dy, dz = [F.col(f"_{c}") - F.col(c) for c in grid.XYZ]
    met = known.withColumns({n: F.floor(F.col(c) / size) for c, n in zip(grid.XYZ, names)}).join(balls.hint("merge"), names).where((dx * dx + dy * dy + dz * dz < radius * radius) & (F.col(strength) >= F.col("_s")))
    own = F.col(item) == F.col("_id")
    ends = met.groupBy("_id").agg(F.count_if(~own).alias("_rivals"), *[F.first(F.when(own, F.col(c)), ignorenulls=True).alias(c) for c in corners.columns])
    return ends.where(F.col("_rivals") == 0).select(*corners.columns).unionByName(rows.where(~given))


def top_corners(corners: DataFrame, by: list[str], n: int, strength: str, item: str) -> DataFrame:
    return corners.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(strength), item))).where(F.col("place") <= n)


def plane_score(source: DataFrame, target: DataFrame, radius: float, least_cos: float, max_offset: float, item: str) -> DataFrame:
    """(matched, source, score): share of source planes whose nearest target agrees in normal and distance."""
    near = grid.halo_join(source, target, radius, item, item).groupBy("a_id").agg(F.min_by("b_id", F.struct("d2", "b_id")).alias("b_id"))
    side = lambda df, p, k: df.select(F.col(item).alias(k), *[F.col(c).alias(p + c) for c in ("x", "y", "z", "nx", "ny", "nz")])
    m = near.join(side(source, "s_", "a_id"), "a_id").join(side(target, "t_", "b_id"), "b_id")
    cos = F.abs(F.col("s_nx") * F.col("t_nx") + F.col("s_ny") * F.col("t_ny") + F.col("s_nz") * F.col("t_nz"))
    off = F.abs((F.col("s_x") - F.col("t_x")) * F.col("t_nx") + (F.col("s_y") - F.col("t_y")) * F.col("t_ny") + (F.col("s_z") - F.col("t_z")) * F.col("t_nz"))
    hit = m.agg(F.count_if((cos >= least_cos) & (off <= max_offset)).alias("matched"))
    return hit.crossJoin(source.agg(F.count("*").alias("source"))).withColumn("score", F.try_divide("matched", "source"))  # one row each


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over undirected edges (u, v)."""
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(connected_leads(edges), "node", "left").select("node", F.coalesce("lead", "node").alias("component"))
