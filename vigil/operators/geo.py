"""Small-area geography over vertex tables (zone_id, ring_no, seq, lon, lat)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.session import checkpointed
from vigil.functions.text import haversine_km, in_box


def boxes(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1, w, h)."""
    b = vertices.groupBy(*keys).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))
    return b.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})


def merge_boxes(zone_boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes of groups of boxes."""
    b = zone_boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return b.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})


def extent(vertices: DataFrame, landmarks: DataFrame, pad: float = 0.4) -> DataFrame:
    """One row (x0, y0, x1, y1): all vertices, widened to hold the landmarks with a pad."""
    v = vertices.agg(F.min("lon").alias("a"), F.min("lat").alias("b"), F.max("lon").alias("c"), F.max("lat").alias("d"))
    p = landmarks.agg((F.min("lon") - pad).alias("e"), (F.min("lat") - pad).alias("f"), (F.max("lon") + pad).alias("g"), (F.max("lat") + pad).alias("h"))
    return v.crossJoin(p).select(F.least("a", "e").alias("x0"), F.least("b", "f").alias("y0"), F.greatest("c", "g").alias("x1"), F.greatest("d", "h").alias("y1"))  # one row each


def project(points: DataFrame, frame: DataFrame, width: float = 1000.0, digits: int = 1) -> DataFrame:
    """Adds x and y in a frame `width` wide, y downwards. frame: one row."""
    scale = width / (F.col("x1") - F.col("x0"))
    df = points.crossJoin(F.broadcast(frame.select("x0", "y0", "x1", "y1")))  # one row
    return df.withColumns({"x": F.round((F.col("lon") - F.col("x0")) * scale, digits), "y": F.round((F.col("y1") - F.col("lat")) * scale, digits)}).drop("x0", "y0", "x1", "y1")


def province_frames(zone_boxes: DataFrame, province: str, margin: float = 0.14) -> DataFrame:
    """(province, x0, y0, x1, y1): boxes with a margin on each side."""
    b = merge_boxes(zone_boxes, [province])
    return b.select(province, (F.col("x0") - margin * F.col("w")).alias("x0"), (F.col("y0") - margin * F.col("h")).alias("y0"), (F.col("x1") + margin * F.col("w")).alias("x1"), (F.col("y1") + margin * F.col("h")).alias("y1"))


def _thinned(rings: DataFrame, tol: Column, keys: Sequence[str]) -> DataFrame:
    """Douglas-Peucker by levels: all segments that stray are split at once, at their farthest vertex; settled ones leave.

    A vertex row carries its segment's ends. The farthest vertex of a segment is one aggregate, combined before its shuffle, so
    a ring of any size is dealt to many tasks; only inner vertices of segments just split go on to the next
    level. There are as many levels as splits nest, which is the number of vertices at most.
    """
    rings = rings.withColumn("_tol", tol)
    vertex = F.struct("seq", "lon", "lat")
    ends = rings.groupBy(*keys).agg(F.min_by(vertex, "seq").alias("_a"), F.max_by(vertex, "seq").alias("_b"))
    kept = ends.select(*keys, F.explode(F.array("_a.seq", "_b.seq")).alias("seq")).distinct()
    inner = rings.select(*keys, "seq", "lon", "lat", "_tol").join(ends, list(keys))
    done = [kept]
    dx, dy = F.col("_b.lon") - F.col("_a.lon"), F.col("_b.lat") - F.col("_a.lat")
    px, py = F.col("lon") - F.col("_a.lon"), F.col("lat") - F.col("_a.lat")
    long = F.sqrt(dx * dx + dy * dy)
    away = F.when(long > 0, F.abs(dx * py - dy * px) / long).otherwise(F.sqrt(px * px + py * py))
    while True:
        inner = inner.where((F.col("seq") > F.col("_a.seq")) & (F.col("seq") < F.col("_b.seq"))).withColumn("_at", F.col("_a.seq"))
        far = F.max_by(vertex, F.struct(away, -F.col("seq")))
        split = inner.where(away > F.col("_tol")).groupBy(*keys, "_at").agg(far.alias("_m"))
        met = checkpointed(inner.join(split, [*keys, "_at"]))  # the vertices of segments that are split
        if met.isEmpty():
            break
        done.append(met.where(F.col("seq") == F.col("_m.seq")).select(*keys, "seq"))
        before = F.col("seq") < F.col("_m.seq")
        inner = met.withColumns({"_a": F.when(before, F.col("_a")).otherwise(F.col("_m")), "_b": F.when(before, F.col("_m")).otherwise(F.col("_b"))}).drop("_m", "_at")
        if len(done) == 32:
            done = [checkpointed(reduce(DataFrame.unionByName, done))]
    return rings.drop("_tol").join(checkpointed(reduce(DataFrame.unionByName, done)), [*keys, "seq"], "left_semi")


def simplify_rings(vertices: DataFrame, tol: Column, keys: Sequence[str] = ("zone_id", "ring_no"), least: int = 4) -> DataFrame:
    """Rings with fewer vertices, none that strays more than `tol`; rings left with fewer than `least` take a tolerance 4 and 16 times finer, then none."""
    rest, done = vertices, None
    for part in (1, 4, 16):
        thin = _thinned(rest, tol / part, keys)
        good = checkpointed(thin.groupBy(*keys).count().where(F.col("count") >= least).select(*keys))
        kept = thin.join(good, list(keys), "left_semi")
        done = kept if done is None else done.unionByName(kept)
        rest = checkpointed(rest.join(good, list(keys), "left_anti"))
    return done.unionByName(rest)


def ring_paths(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, path): 'M x y L x y … Z' of each ring's projected points in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.format_string("%.1f %.1f", "x", "y").alias("t"))))
    return points.groupBy(*keys).agg(F.concat(F.lit("M "), F.array_join(F.transform(ordered, lambda v: v["t"]), " L "), F.lit(" Z")).alias("path"))


def to_features(attrs: DataFrame, vertices: DataFrame, key: str = "zone_id") -> DataFrame:
    """(key, feature): GeoJSON text of each zone's rings with its attributes."""
    pair = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda v: F.array(v["lon"], v["lat"]))
    rings = vertices.groupBy(key, "ring_no").agg(pair.alias("ring"))
    polygons = rings.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_no", "ring"))), lambda r: r["ring"]).alias("coordinates"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("coordinates"))
    properties = F.struct(*(c for c in attrs.columns if c != key))
    return attrs.join(polygons, key).select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def audit_coordinates(current: DataFrame, candidates: DataFrame, key: str, box: tuple[float, float, float, float], max_km: float = 15.0) -> DataFrame:
    """(key, km, moved, in_country, same_province) of candidates beside current coordinates."""
    c, n = current.alias("c"), candidates.alias("n")
    km = haversine_km(F.col("c.lat"), F.col("c.lon"), F.col("n.lat"), F.col("n.lon"))
    df = c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"))
    return df.select(f"c.{key}", F.round(km, 6).alias("km"), (km > max_km).alias("moved"), in_box(F.col("n.lat"), F.col("n.lon"), box).alias("in_country"), (F.col("c.province") == F.col("n.province")).alias("same_province"))


def pairs_within(points: DataFrame, key: str, order: str, block: int = 1024) -> DataFrame:
    """(a, b): every pair of points of one key as structs, a before b; `order` tells a key's points apart.

    As many pairs as there are: a key's points are dealt by hash to blocks of about so many, each pair of blocks is a key of
    its own, and there is a task for each of these (65,536 at most), so a task holds blocks, whatever one key has.
    """
    sizes = points.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    n = F.col("_n").cast("bigint")
    blocks, tasks = (min(c or 1, 65_536) for c in sizes.agg(F.sum(n), F.sum(n * n)).first())
    own = points.join(sizes, F.col(key) == F.col("_key")).withColumn("_i", F.pmod(F.xxhash64(order), F.col("_n")).cast("int")).repartition(blocks, "_key", "_i")
    others, point = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)), F.struct(*points.columns)
    a = own.select("_key", F.col("_i").alias("_a"), others.alias("_b"), point.alias("a")).repartition(tasks, "_key", "_a", "_b")
    b = own.select("_key", others.alias("_a"), F.col("_i").alias("_b"), point.alias("b")).repartition(tasks, "_key", "_a", "_b")
    before = F.col(f"a.{order}") < F.col(f"b.{order}")
    return a.join(b.hint("merge"), ["_key", "_a", "_b"]).where(before).select("a", "b")


def unmatched_zones(ours: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    return ours.join(polygons.select(key).distinct(), key, "left_anti")


def within_search_frame(candidates: DataFrame, frames: DataFrame, province: str, pad: float = 0.3) -> DataFrame:
    """Adds `inside`: the candidate lies in its province's box, widened."""
    df = candidates.join(frames.select(province, "x0", "y0", "x1", "y1"), province)
    inside = F.col("lon").between(F.col("x0") - pad, F.col("x1") + pad) & F.col("lat").between(F.col("y0") - pad, F.col("y1") + pad)
    return df.withColumn("inside", inside).drop("x0", "y0", "x1", "y1")


def name_column_vote(attrs: DataFrame, names: DataFrame, columns: Sequence[str], name: str, min_hits: int = 5) -> DataFrame:
    """(column, hits): attribute columns that hold so many of the names, whatever the case."""
    long = attrs.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.upper(F.col(c).cast("string")).alias("_v")) for c in columns))))
    hits = long.distinct().join(names.select(F.upper(name).alias("_v")).distinct(), "_v", "left_semi").groupBy("column").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= min_hits)
