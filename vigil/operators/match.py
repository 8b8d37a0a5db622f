"""Joins of names, places and dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import bound, zone_key_tight, zone_key_upper
from vigil.operators.segments import filled, running_sum


def join_zone(a: DataFrame, b: DataFrame, how: str = "inner", name: str = "zone", province: str = "province") -> DataFrame:
    """Rows of b beside those of a with the same normalised (name, province); b's own name columns are dropped."""
    key = {"_z": zone_key_upper(F.col(name)), "_p": zone_key_upper(F.col(province))}
    return a.withColumns(key).join(b.withColumns(key).drop(name, province), ["_z", "_p"], how).drop("_z", "_p")


def resolve_zone(ours: DataFrame, reference: DataFrame, aliases: Mapping[str, str] | None = None, name: str = "zone", province: str = "province") -> DataFrame:
    """ours with `matched` (the reference name) or null: a key unique on both sides matches; otherwise the province must agree and be unique.

    aliases: other spellings and the names they stand for, compared as keys, on both sides.
    """
    as_key = lambda c: zone_key_tight(zone_key_upper(c))
    key, p = as_key(F.col(name)), zone_key_tight(F.col(province))
    if aliases:
        known = F.create_map(*(as_key(F.lit(x)) for pair in aliases.items() for x in pair))
        key = F.coalesce(F.try_element_at(known, key), key)
    a = ours.withColumns({"_k": key, "_p": p})
    a = a.withColumns({"_n": F.count("*").over(Window.partitionBy("_k")), "_np": F.count("*").over(Window.partitionBy("_k", "_p"))})
    b = reference.select(key.alias("_k"), p.alias("_rp"), F.col(name).alias("matched"))
    b = b.withColumns({"_rn": F.count("*").over(Window.partitionBy("_k")), "_rnp": F.count("*").over(Window.partitionBy("_k", "_rp"))})
    fits = ((F.col("_n") == 1) & (F.col("_rn") == 1)) | ((F.col("_p") == F.col("_rp")) & (F.col("_np") == 1) & (F.col("_rnp") == 1))
    keys = [F.col(f"a.{c}") for c in ours.columns]
    found = a.alias("a").join(b.alias("b"), (F.col("a._k") == F.col("b._k")) & fits, "left")
    return found.select(*keys, "matched")


def deletions(c: Column, most: int) -> Column:
    """array<string>: the text and what is left of it without up to `most` of its letters, each once."""
    less = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    out = last = F.array(c)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, less)))
        out = F.array_union(out, last)
    return out


def near_names(a: DataFrame, b: DataFrame, within: str, most: int) -> DataFrame:
    """(_k, within, _rk): pairs of keys of the same `within` that may be up to `most` edits apart; a(within, _k), b(within, _rk).

    Two names that near have a text in common among those left when up to `most` letters are taken out of each, so
    an equi-join of such texts finds all of them, and few others. Each name is posted a number of times that
    grows with its own length only.
    """
    side = lambda df, k: df.select(within, k).distinct().withColumn("_d", F.explode(deletions(F.col(k), most)))
    return side(a, "_k").join(side(b, "_rk"), [within, "_d"]).select("_k", within, "_rk").distinct()


def fuzzy_match(ours: DataFrame, reference: DataFrame, max_dist: int = 2, name: str = "zone", province: str = "province") -> DataFrame:
    """(name, province, matched, distance, status): an equal key first, else the nearest name of the same province within `max_dist` edits.

    status: exact, spelling or missing. Only what has no equal key is looked up, in an index of its province's names (see `near_names`).
    """
    k = zone_key_tight(F.col(name))
    ours, known = ours.select(name, province).withColumn("_k", k), reference.select(F.col(name).alias("_name"), F.col(province).alias("_p")).withColumn("_rk", zone_key_tight(F.col("_name")))
    first = known.groupBy("_rk").agg(F.min("_name").alias("matched"))
    exact = ours.join(first, F.col("_k") == F.col("_rk"), "left").drop("_rk")
    lacking = exact.where("matched IS NULL").select(F.col(province).alias("_p"), "_k")
    least = known.groupBy("_p", "_rk").agg(F.min("_name").alias("_name"))  # of names with one key the first
    near = near_names(lacking, least, "_p", max_dist).withColumn("distance", F.levenshtein("_k", "_rk", max_dist)).where("distance >= 0")
    best = near.join(least, ["_p", "_rk"]).groupBy("_p", "_k").agg(F.min(F.struct("distance", "_name")).alias("_b"))
    found = exact.join(best.withColumnRenamed("_p", province), [province, "_k"], "left")
    known_key = F.col("matched").isNotNull()
    status = F.when(known_key, "exact").when(F.col("_b").isNotNull(), "spelling").otherwise("missing")
    return found.select(name, province, F.coalesce("matched", "_b._name").alias("matched"), F.when(known_key, 0).otherwise(F.col("_b.distance")).alias("distance"), status.alias("status"))


def grams(c: Column, q: int) -> Column:
    """array<struct(gram, n)>: pieces of q letters of the text with q - 1 marks before and behind it, repeats numbered."""
    padded = F.concat(F.lit("^" * (q - 1)), c, F.lit("$" * (q - 1)))
    pieces = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - q + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(q))))
    numbered = lambda p: F.transform(p, lambda g, i: F.struct(g.alias("gram"), (i - F.array_position(p, g).cast("int")).alias("n")))
    return bound(pieces, numbered)


def gram_pairs(a: DataFrame, b: DataFrame, within: str, cutoff: float) -> DataFrame:
    """(within, _k, _rk): pairs of keys that may have a likeness of `cutoff` or more, by the number of grams that they share.

    Of two texts with m letters in the longer one, e edits leave at least m + q - 1 - q * e of its grams; likeness c allows
    (1 - c) * m edits. Above c = 0.5 pairs of letters serve, else single letters. Texts whose lengths alone are too far apart never meet.
    """
    q = 2 if cutoff > 0.5 else 1
    side = lambda df, k: df.select(within, k).distinct().select(within, k, F.length(k).alias(f"{k}n"), F.inline(grams(F.col(k), q)))
    m = F.greatest("_kn", "_rkn")
    edits = F.floor((1 - cutoff) * m + 1e-9)
    met = side(a, "_k").join(side(b, "_rk"), [within, "gram", "n"]).where(F.abs(F.col("_kn") - F.col("_rkn")) <= edits)
    counted = met.groupBy(within, "_k", "_rk", "_kn", "_rkn").agg(F.count("*").alias("_shared"))
    return counted.where(F.col("_shared") >= m + (q - 1) - q * edits).select(within, "_k", "_rk")


def name_candidates(ours: DataFrame, reference: DataFrame, n: int = 3, cutoff: float = 0.6, name: str = "zone", province: str = "province") -> DataFrame:
    """(name, province, candidate, score, rank): up to n names of the same province with likeness (1 - edits / longer length) of the cutoff (above 0) or more."""
    a = ours.select(name, province).withColumn("_k", zone_key_tight(F.col(name)))
    b = reference.select(F.col(name).alias("candidate"), F.col(province)).withColumn("_rk", zone_key_tight(F.col("candidate")))
    score = F.round(1 - F.levenshtein("_k", "_rk") / F.nullif(F.greatest(F.length("_k"), F.length("_rk")), F.lit(0)), 6)
    near = gram_pairs(a, b, province, cutoff).withColumn("score", score).where(F.col("score") >= cutoff)
    found = a.join(near, [province, "_k"]).join(b, [province, "_rk"])
    rank = F.row_number().over(Window.partitionBy(name, province).orderBy(F.col("score").desc(), "candidate"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select(name, province, "candidate", "score", "rank")


def asof_join(events: DataFrame, series: DataFrame, keys: Sequence[str], fields: Sequence[str], date: str = "d", known: str | None = None, segment: Column | None = None) -> DataFrame:
    """Events with the series' last row not after their date (with `known` not null, if given); null where there is none.

    One union, no join by range. Each key's rows are scanned in segments (months, unless `segment` cuts the
    date otherwise), so a key with most of the rows is dealt to many tasks.
    """
    rows = series if known is None else series.where(F.col(known).isNotNull())
    s = rows.select(*keys, date, F.struct(F.col(date).alias("_at"), *fields).alias("_s"), F.lit(0).alias("_side"))
    rest = [c for c in events.columns if c not in (*keys, date)]
    e = events.select(*keys, date, F.struct(F.lit(0).alias("_"), *rest).alias("_e"), F.lit(1).alias("_side"))
    months = F.trunc(date, "month") if segment is None else segment
    both = filled(s.unionByName(e, allowMissingColumns=True), F.col("_s"), keys, [date, "_side"], months, "_last")
    return both.where("_side = 1").select(*keys, date, *(F.col("_e")[c].alias(c) for c in rest), F.col("_last._at").alias("asof_date"), *(F.col("_last")[f].alias(f) for f in fields))


def cumulative_at(incr: DataFrame, dates: DataFrame, field: str, keys: Sequence[str], date: str = "d", segment: Column | None = None) -> DataFrame:
    """For each date the sum of increments up to it, 0 before any; in segments like `asof_join`."""
    months = F.trunc(date, "month") if segment is None else segment
    daily = incr.groupBy(*keys, date).agg(F.sum(field).alias(field))
    running = running_sum(daily, F.col(field), keys, [date], months, "total")
    out = asof_join(dates, running, keys, ["total"], date, segment=segment)
    return out.withColumn("total", F.coalesce("total", F.lit(0))).drop("asof_date")


def canonical_province(df: DataFrame, dim: DataFrame, unknown: str = "keep", province: str = "province") -> DataFrame:
    """The province's canonical spelling; an unknown one passes (`keep`) or its row is dropped (`drop`).

    dim(canonical): one row a province.
    """
    known = dim.select(zone_key_tight(F.col("canonical")).alias("_k"), F.col("canonical").alias("_c"))
    out = df.withColumn("_k", zone_key_tight(F.col(province))).join(known, "_k", "left" if unknown == "keep" else "inner")
    return out.withColumn(province, F.coalesce("_c", province)).drop("_k", "_c")


def validate_against(extracted: DataFrame, truth: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Adds `reason`: null where the value equals the trusted one, else 'no trusted value' or 'differs'."""
    t = truth.select(*on, F.col(value).alias("_t"))
    reason = F.when(F.col("_t").isNull(), "no trusted value").when(~F.col(value).eqNullSafe(F.col("_t")), "differs")
    return extracted.join(t, list(on), "left").withColumn("reason", reason).drop("_t")


#: Sizes below 2^LEAST are as points to the grid.
LEAST = -30


def boxes_that_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (_a, _b) of two tables with boxes (x0, y0, x1, y1) that touch or overlap; each pair once. Points are boxes without size.

    A hierarchical grid: cells of level n are 2^n wide, a box belongs to the level of its longer side and lies
    in four cells there at most. A pair meets at the coarser of its two levels, so each box is posted at its own
    level and at those coarser ones that the other table has, and the cell that holds the least corner of what the two share
    tells one meeting from the others. Equi-joins on cells, whatever the sizes.
    """
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))), F.lit(LEAST))
    marked = lambda df: df.select(F.struct("*").alias("_row"), "x0", "y0", "x1", "y1", F.coalesce(level, F.lit(LEAST)).cast("int").alias("_level")).where("x0 <= x1 AND y0 <= y1")
    a, b = marked(a), marked(b)

    def posted(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("_levels", other.agg(F.collect_set("_level")).scalar())  # some dozens of levels at most
        levels = F.array_union(F.array("_level"), F.filter("_levels", lambda n: n > F.col("_level")))
        df = df.withColumn("_at", F.explode(levels)).withColumn("_wide", F.pow(F.lit(2.0), F.col("_at")))
        cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("_wide")), F.floor(F.col(high) / F.col("_wide"))))
        df = df.withColumn("_x", cells("x0", "x1")).withColumn("_y", cells("y0", "y1"))
        return df.select("_at", "_x", "_y", F.struct("x0", "y0", "x1", "y1", "_level", "_wide").alias(f"{name}box"), F.col("_row").alias(name))

    met = posted(a, b, "_a").join(posted(b, a, "_b"), ["_at", "_x", "_y"])
    p, q = F.col("_abox"), F.col("_bbox")
    meet = (p["x1"] >= q["x0"]) & (p["x0"] <= q["x1"]) & (p["y1"] >= q["y0"]) & (p["y0"] <= q["y1"])
    corner = (F.floor(F.greatest(p["x0"], q["x0"]) / p["_wide"]) == F.col("_x")) & (F.floor(F.greatest(p["y0"], q["y0"]) / p["_wide"]) == F.col("_y"))
    return met.where((F.col("_at") == F.greatest(p["_level"], q["_level"])) & meet & corner).select("_a", "_b")


def frame_zones(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, zone_id, inside): boxes that overlap a frame; inside if wholly. Tables of any size, see `boxes_that_meet`."""
    b, f = F.col("_a"), F.col("_b")
    inside = (b["x0"] >= f["x0"]) & (b["x1"] <= f["x1"]) & (b["y0"] >= f["y0"]) & (b["y1"] <= f["y1"])
    met = boxes_that_meet(boxes.select("zone_id", "x0", "y0", "x1", "y1"), frames.select("frame", "x0", "y0", "x1", "y1"))
    return met.select(f["frame"].alias("frame"), b["zone_id"].alias("zone_id"), inside.alias("inside"))


def frame_landmarks(points: DataFrame, frames: DataFrame, province: str = "province") -> DataFrame:
    """(frame, point_id): points within a frame that are of its province or of none. Tables of any size, see `boxes_that_meet`."""
    at = [F.col(c).alias(n) for n, c in (("x0", "lon"), ("y0", "lat"), ("x1", "lon"), ("y1", "lat"))]
    met = boxes_that_meet(points.select("point_id", F.col(province).alias("province"), *at), frames.select("frame", "x0", "y0", "x1", "y1"))
    p, f = F.col("_a"), F.col("_b")
    return met.where(p["province"].isNull() | (p["province"] == f["frame"])).select(f["frame"].alias("frame"), p["point_id"].alias("point_id"))
