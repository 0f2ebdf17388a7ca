"""Planar geometry over arrays of points struct<x, y>, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<type:string,parts:array<array<{POINT}>>>"


def segments(line: Column) -> Column:
    """Consecutive point pairs as struct(a, b)."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0))), lambda i: F.struct(line[i].alias("a"), F.get(line, i + 1).alias("b")))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, g: s + F.coalesce(F.hypot(g["b"]["x"] - g["a"]["x"], g["b"]["y"] - g["a"]["y"]), F.lit(0.0)))


def ring_area(ring: Column) -> Column:
    """The area that a closed ring bounds, without sign; 0 for less than a triangle."""
    twice = F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + F.coalesce(s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"], F.lit(0.0)))
    return F.abs(twice) / 2


def bbox(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting by the even-odd rule; the ring's last point repeats its first."""
    def crosses(s):
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def interval_in_box(a: Column, b: Column, x0, y0, x1, y1) -> Column:
    """The part lo to hi (0 to 1) of a segment inside a closed box; lo > hi where it stays outside (Liang and Barsky)."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    lo, hi = F.lit(0.0), F.lit(1.0)
    for d, start, low, high in ((dx, a["x"], x0, x1), (dy, a["y"], y0, y1)):
        t0, t1 = (F.lit(low) - start) / F.nullif(d, F.lit(0.0)), (F.lit(high) - start) / F.nullif(d, F.lit(0.0))
        level = F.when(start.between(low, high), F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))).otherwise(F.struct(F.lit(2.0).alias("a"), F.lit(-1.0).alias("b")))
        lo = F.greatest(lo, F.when(d == 0, level["a"]).otherwise(F.least(t0, t1)))
        hi = F.least(hi, F.when(d == 0, level["b"]).otherwise(F.greatest(t0, t1)))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def line_in_box(line: Column, x0, y0, x1, y1) -> Column:
    """The runs of a line inside a closed box, as lines; a place that only touches is a run of one point.

    A run goes on where one segment is kept to its end and the next from its begin, so a line that
    leaves and comes back gives two runs, and a closed line inside the box stays closed.
    """
    def ends(s):
        a, b, t = s["a"], s["b"], s["t"]
        inside = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
        at = lambda t: F.struct(inside(a["x"] + t * (b["x"] - a["x"]), x0, x1).alias("x"), inside(a["y"] + t * (b["y"] - a["y"]), y0, y1).alias("y"))
        return F.struct(F.when(t["lo"] == 0, a).otherwise(at(t["lo"])).alias("p"), F.when(t["hi"] == 1, b).otherwise(at(t["hi"])).alias("q"), (t["lo"] == 0).alias("begins"), (t["hi"] == 1).alias("ends"))

    def grow(runs, s):
        last = F.try_element_at(runs["done"], F.lit(-1))
        longer = F.when(s["p"] == s["q"], last).otherwise(F.concat(last, F.array(s["q"])))
        joins = runs["open"] & s["begins"]
        new = F.when(s["p"] == s["q"], F.array(s["p"])).otherwise(F.array(s["p"], s["q"]))
        done = F.when(joins, F.concat(F.slice(runs["done"], 1, F.greatest(F.size(runs["done"]) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs["done"], F.array(new)))
        return F.struct(done.alias("done"), s["ends"].alias("open"))

    # A segment outside breaks the run: the one after it does not begin where the last kept one ended.
    timed = F.transform(segments(line), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), interval_in_box(s["a"], s["b"], x0, y0, x1, y1).alias("t")))
    kept = F.transform(F.filter(timed, lambda s: s["t"]["lo"] <= s["t"]["hi"]), ends)
    start = F.struct(F.array().cast(f"array<array<{POINT}>>").alias("done"), F.lit(False).alias("open"))
    return F.aggregate(kept, start, grow)["done"]


def ring_in_box(ring: Column, x0, y0, x1, y1) -> Column:
    """A closed ring cut to a box side by side (Sutherland and Hodgman); empty where nothing is left."""
    def side(points, inside, cut):
        def step(out, s):
            a, b = s["a"], s["b"]
            here, there = inside(a), inside(b)
            more = F.when(here & there, F.array(b)).when(here, F.array(cut(a, b))).when(there, F.array(cut(a, b), b)).otherwise(F.array().cast(f"array<{POINT}>"))
            return F.concat(out, more)

        got = F.aggregate(F.filter(segments(points), lambda s: s["b"].isNotNull()), F.array().cast(f"array<{POINT}>"), step)
        return F.transform(F.array(got), lambda g: F.when(F.size(g) > 0, F.concat(g, F.slice(g, 1, 1))).otherwise(g))[0]

    on_x = lambda v: lambda a, b: F.struct(F.lit(v).cast("double").alias("x"), (a["y"] + (F.lit(v) - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"])).alias("y"))
    on_y = lambda v: lambda a, b: F.struct((a["x"] + (F.lit(v) - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"])).alias("x"), F.lit(v).cast("double").alias("y"))
    sides = ((lambda p: p["x"] >= x0, on_x(x0)), (lambda p: p["x"] <= x1, on_x(x1)), (lambda p: p["y"] >= y0, on_y(y0)), (lambda p: p["y"] <= y1, on_y(y1)))
    def one(inside, cut):
        return lambda points: side(points, inside, cut)

    out = ring
    for inside, cut in sides:
        out = F.transform(F.array(out), one(inside, cut))[0]
    return out


def cells_passed(df, segment: str, cell: float, x0: float = 0.0, y0: float = 0.0, pad: float = 1e-6):
    """df with cx and cy: one row for each cell of a grid that the segment (struct a, b) passes.

    Cells beside the segment by pad, in parts of their size, count too, so rounding loses none.
    """
    at = lambda p, c, start: (F.col(f"{segment}.{p}.{c}") - start) / cell
    ax, ay, bx, by = at("a", "x", x0), at("a", "y", y0), at("b", "x", x0), at("b", "y", y0)
    columns = df.withColumn("cx", F.explode(F.sequence(F.floor(F.least(ax, bx) - pad), F.floor(F.greatest(ax, bx) + pad))))
    # The part of the segment over this column of cells, from level to level.
    left, right = F.greatest(F.least(ax, bx), F.col("cx") - pad), F.least(F.greatest(ax, bx), F.col("cx") + 1 + pad)
    level = lambda x: F.when(ax == bx, None).otherwise(ay + (x - ax) / F.nullif(bx - ax, F.lit(0.0)) * (by - ay))
    low = F.coalesce(F.least(level(left), level(right)), F.least(ay, by))
    high = F.coalesce(F.greatest(level(left), level(right)), F.greatest(ay, by))
    steep = F.abs(bx - ax) < 1e-9
    low, high = F.when(steep, F.least(ay, by)).otherwise(low), F.when(steep, F.greatest(ay, by)).otherwise(high)
    return columns.withColumn("cy", F.explode(F.sequence(F.floor(low - pad), F.floor(high + pad))))


def clipped_length(a: Column, b: Column, x0, y0, x1, y1) -> Column:
    """Length of a segment inside a closed box (Liang and Barsky)."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    lo, hi = F.lit(0.0), F.lit(1.0)
    for d, start, low, high in ((dx, a["x"], x0, x1), (dy, a["y"], y0, y1)):
        t0, t1 = (F.lit(low) - start) / F.nullif(d, F.lit(0.0)), (F.lit(high) - start) / F.nullif(d, F.lit(0.0))
        inside = (start >= low) & (start <= high)
        lo = F.greatest(lo, F.when(d == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(t0, t1)))
        hi = F.least(hi, F.when(d == 0, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(t0, t1)))
    return F.hypot(dx, dy) * F.greatest(F.lit(0.0), hi - lo)


def line_length_in_box(line: Column, x0, y0, x1, y1) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, g: s + F.coalesce(clipped_length(g["a"], g["b"], x0, y0, x1, y1), F.lit(0.0)))


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def crossing_point(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The point where segments ab and cd meet properly or touch, NULL if they don't or run along."""
    # NULL where the segments are parallel, as a shared subexpression may be computed before its condition.
    denominator = F.nullif((b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"]), F.lit(0.0))
    t = ((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"])) / denominator
    u = ((c["x"] - a["x"]) * (b["y"] - a["y"]) - (c["y"] - a["y"]) * (b["x"] - a["x"])) / denominator
    meet = denominator.isNotNull() & t.between(0, 1) & u.between(0, 1)
    return F.when(meet, F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y")))


def ring_distance(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    """Distance of a point from the outline of a box."""
    dx, dy = F.greatest(F.lit(x0) - x, F.lit(0.0), x - F.lit(x1)), F.greatest(F.lit(y0) - y, F.lit(0.0), y - F.lit(y1))
    inner = F.least(x - F.lit(x0), F.lit(x1) - x, y - F.lit(y0), F.lit(y1) - y)
    return F.when((dx == 0) & (dy == 0), inner).otherwise(F.hypot(dx, dy))


def canonical(line: Column, places: int = 9) -> Column:
    """Coordinates in the direction that sorts first, rounded: equal for a line and its reverse."""
    rounded = F.transform(line, lambda p: F.struct(F.round(p["x"], places).alias("x"), F.round(p["y"], places).alias("y")))
    return F.least(rounded, F.reverse(rounded))


def interior_point(ring: Column) -> Column:
    """The middle of the widest run inside a closed ring, on a level between two vertex levels.

    Unlike a centroid it lies inside a concave ring; a ring without area gives its first point.
    """
    def of_level(level):
        met = F.filter(segments(ring), lambda s: (s["a"]["y"] > level) != (s["b"]["y"] > level))
        xs = F.array_sort(F.transform(met, lambda s: s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * (level - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"])))
        runs = F.transform(xs, lambda x, i: F.when(i % 2 == 0, F.struct((F.get(xs, i + 1) - x).alias("width"), ((F.get(xs, i + 1) + x) / 2).alias("x"))))
        return F.struct(F.array_max(runs)["x"].alias("x"), level.alias("y"))

    box = bbox(ring)
    ys, middle = F.transform(ring, lambda p: p["y"]), (box["y_min"] + box["y_max"]) / 2
    level = (F.array_max(F.filter(ys, lambda y: y <= middle)) + F.array_min(F.filter(ys, lambda y: y > middle))) / 2
    found = F.transform(F.array(level), of_level)[0]
    return F.when(found["x"].isNotNull(), found).otherwise(ring[0])


def middle_vertex(line: Column) -> Column:
    """The vertex nearest to a line's centroid; ends count only where a line has nothing else."""
    def of_centre(centre):
        vertices = F.when(F.size(line) > 2, F.slice(line, 2, F.greatest(F.size(line) - 2, F.lit(1)))).otherwise(line)
        return F.array_min(F.transform(vertices, lambda p: F.struct(F.hypot(p["x"] - centre["x"], p["y"] - centre["y"]).alias("d"), p.alias("p"))))["p"]

    weight = lambda s: F.coalesce(F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]), F.lit(0.0))
    part = lambda c: F.aggregate(segments(line), F.lit(0.0), lambda t, s: t + F.coalesce(weight(s) * (s["a"][c] + s["b"][c]) / 2, F.lit(0.0)))
    total = length(line)
    centre = F.struct(F.when(total > 0, part("x") / total).otherwise(line[0]["x"]).alias("x"), F.when(total > 0, part("y") / total).otherwise(line[0]["y"]).alias("y"))
    return F.transform(F.array(centre), of_centre)[0]


def representative_point(kind: Column, parts: Column) -> Column:
    """A point on the geometry: itself, inside the first ring, or a vertex of the first line."""
    first = parts[0]
    return F.when(kind.isin("Point", "MultiPoint"), first[0]).when(kind.isin("Polygon", "MultiPolygon"), interior_point(first)).otherwise(middle_vertex(first))
