"""Shapes and rigid motions as Column expressions. Vectors are triples (or pairs) of Columns; matrices are three rows of three."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]
Matrix = Sequence[Sequence[Column]]


def vec(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def lits(*values: float) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def dot(a: Vector, b: Vector) -> Column:
    return sum(x * y for x, y in zip(a, b))


def sub(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def add(a: Vector, b: Vector) -> list[Column]:
    return [x + y for x, y in zip(a, b)]


def times(a: Vector, f: Column | float) -> list[Column]:
    return [x * f for x in a]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def apply(m: Matrix, p: Vector, t: Vector | None = None) -> list[Column]:
    """R p + T."""
    out = [dot(row, p) for row in m]
    return out if t is None else add(out, t)


def transpose(m: Matrix) -> list[list[Column]]:
    return [list(c) for c in zip(*m)]


def matmul(a: Matrix, b: Matrix) -> list[list[Column]]:
    cols = transpose(b)
    return [[dot(row, c) for c in cols] for row in a]


def compose(r2: Matrix, t2: Vector, r1: Matrix, t1: Vector):
    """First (r1, t1), then (r2, t2)."""
    return matmul(r2, r1), apply(r2, t1, t2)


def invert(r: Matrix, t: Vector):
    """Inverse of a rigid transform."""
    back = transpose(r)
    return back, [-x for x in apply(back, t)]


def apply_inverse(r: Matrix, t: Vector, p: Vector) -> list[Column]:
    """R^T (p - T)."""
    return apply(transpose(r), sub(p, t))


def rotation_from_rpy(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rz(yaw) Ry(pitch) Rx(roll), in radians."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def rpy_from_rotation(m: Matrix) -> tuple[Column, Column, Column]:
    return F.atan2(m[2][1], m[2][2]), F.atan2(-m[2][0], F.sqrt(m[2][1] * m[2][1] + m[2][2] * m[2][2])), F.atan2(m[1][0], m[0][0])


def axis_rotation(axis: str, angle: Column) -> list[list[Column]]:
    c, s, o, z = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {"x": [[o, z, z], [z, c, -s], [z, s, c]], "y": [[c, z, s], [z, o, z], [-s, z, c]], "z": [[c, -s, z], [s, c, z], [z, z, o]]}[axis]


def givens(a: Column, b: Column) -> tuple[Column, Column]:
    """(cos, sin) of the rotation that takes (a, b) to (r, 0)."""
    r = F.sqrt(a * a + b * b)
    return F.coalesce(F.try_divide(a, r), F.lit(1.0)), F.coalesce(F.try_divide(-b, r), F.lit(0.0))


def quaternion_from_rpy(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw))
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def ned_to_enu(p: Vector) -> list[Column]:
    return [p[1], p[0], -p[2]]


# --- planes, segments, triangles ------------------------------------------------------------------------------------


def project_on_plane(p: Vector, normal: Vector, at: Vector) -> list[Column]:
    """Orthogonal projection; the normal has unit length."""
    return sub(p, times(normal, dot(sub(p, at), normal)))


def plane_hit(a: Vector, b: Vector, normal: Vector, at: Vector) -> Column:
    """Fraction of the way from a to b at which the line meets a plane; null if they are parallel."""
    return F.try_divide(dot(sub(at, a), normal), dot(sub(b, a), normal))


def three_planes(normals: Sequence[Vector], offsets: Sequence[Column]) -> list[Column]:
    """The point on planes n . p = d, by Cramer's rule; null if there is no single one."""
    n1, n2, n3 = normals
    det = dot(n1, cross(n2, n3))
    sums = add(add(times(cross(n2, n3), offsets[0]), times(cross(n3, n1), offsets[1])), times(cross(n1, n2), offsets[2]))
    return [F.try_divide(s, det) for s in sums]


def in_box(p: Vector, low: Vector, high: Vector) -> Column:
    out = F.lit(True)
    for x, a, b in zip(p, low, high):
        out = out & (x >= a) & (x <= b)
    return out


def boxes_meet(low_a: Vector, high_a: Vector, low_b: Vector, high_b: Vector) -> Column:
    out = F.lit(True)
    for a0, a1, b0, b1 in zip(low_a, high_a, low_b, high_b):
        out = out & (a0 <= b1) & (b0 <= a1)
    return out


def boxes_abut(low_a: Vector, high_a: Vector, low_b: Vector, high_b: Vector, error: float) -> Column:
    """Boxes that touch on some side within the error."""
    near = boxes_meet([x - error for x in low_a], [x + error for x in high_a], low_b, high_b)
    side = F.lit(False)
    for a0, a1, b0, b1 in zip(low_a, high_a, low_b, high_b):
        side = side | (F.abs(a1 - b0) <= error) | (F.abs(b1 - a0) <= error)
    return near & side


def segment_meets_box(a: Vector, b: Vector, low: Vector, high: Vector) -> Column:
    """Slab test of a closed segment and a closed box, in two or three dimensions."""
    start, end = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for p, q, lo, hi in zip(a, b, low, high):
        d = q - p
        t0, t1 = F.try_divide(lo - p, d), F.try_divide(hi - p, d)
        start = F.when(d == 0, start).otherwise(F.greatest(start, F.least(t0, t1)))
        end = F.when(d == 0, end).otherwise(F.least(end, F.greatest(t0, t1)))
        outside = outside | ((d == 0) & ((p < lo) | (p > hi)))
    return ~outside & (start <= end)


def orient2d(a: Vector, b: Vector, c: Vector) -> Column:
    """Twice the signed area of a triangle; positive if it runs anticlockwise."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def in_triangle(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Edges belong to the triangle, which may run either way."""
    s = [orient2d(a, b, p), orient2d(b, c, p), orient2d(c, a, p)]
    return (F.least(*s) >= 0) | (F.greatest(*s) <= 0)


def circumcircle(a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column]:
    """Centre and radius; null for collinear points."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    ux = F.try_divide(cy * (bx * bx + by * by) - by * (cx * cx + cy * cy), d)
    uy = F.try_divide(bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by), d)
    return a[0] + ux, a[1] + uy, F.sqrt(ux * ux + uy * uy)


def in_circle(a: Vector, b: Vector, c: Vector, p: Vector) -> Column:
    """Positive if p lies within the circle of the anticlockwise triangle a, b, c."""
    rows = [(v[0] - p[0], v[1] - p[1], (v[0] - p[0]) * (v[0] - p[0]) + (v[1] - p[1]) * (v[1] - p[1])) for v in (a, b, c)]
    return dot(rows[0], cross(rows[1], rows[2]))


def centroid(*points: Vector) -> list[Column]:
    return [sum(c) / float(len(points)) for c in zip(*points)]


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    if len(a) == 2:
        return F.abs(orient2d(a, b, c)) / 2
    return norm(cross(sub(b, a), sub(c, a))) / 2


def triangle_normal(a: Vector, b: Vector, c: Vector) -> list[Column]:
    n = cross(sub(b, a), sub(c, a))
    return [F.try_divide(x, norm(n)) for x in n]


def distance(a: Vector, b: Vector) -> Column:
    return norm(sub(a, b))


def segment_crossing(a: Vector, b: Vector, c: Vector, d: Vector) -> tuple[Column, Column]:
    """Fractions along a-b and c-d at which the lines cross; null if they are parallel."""
    r, s, w = sub(b, a), sub(d, c), sub(c, a)
    det = r[0] * s[1] - r[1] * s[0]
    return F.try_divide(w[0] * s[1] - w[1] * s[0], det), F.try_divide(w[0] * r[1] - w[1] * r[0], det)


def point_segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    d = sub(b, a)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(sub(p, a), d), dot(d, d)), F.lit(0.0))))
    return distance(p, add(a, times(d, t)))


def collinear(a: Vector, b: Vector, c: Vector, error: float = 1e-9) -> Column:
    return F.abs(orient2d(a, b, c)) <= error


def corner_cosine(at: Vector, a: Vector, b: Vector) -> Column:
    u, v = sub(a, at), sub(b, at)
    return F.try_divide(dot(u, v), norm(u) * norm(v))


def in_tetrahedron(p: Vector, a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """All four corners see p on the same side as the opposite corner, or on a face."""
    def volume(q, r, s, t):
        return dot(sub(q, t), cross(sub(r, t), sub(s, t)))

    whole = volume(a, b, c, d)
    parts = [volume(p, b, c, d), volume(a, p, c, d), volume(a, b, p, d), volume(a, b, c, p)]
    return ((whole > 0) & (F.least(*parts) >= 0)) | ((whole < 0) & (F.greatest(*parts) <= 0))


def ray_triangle(origin: Vector, ray: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Distance along a ray, in lengths of `ray`, to a triangle; null if it is missed or behind."""
    e1, e2 = sub(b, a), sub(c, a)
    h, s = cross(ray, e2), sub(origin, a)
    det = dot(e1, h)
    q = cross(s, e1)
    u, v, t = F.try_divide(dot(s, h), det), F.try_divide(dot(ray, q), det), F.try_divide(dot(e2, q), det)
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t > 0), t)


def polygon_contains(x: Column, y: Column, polygon: Column) -> Column:
    """Whether an array of struct<x, y> holds a point, its boundary included, by counting crossings of a ray."""
    n = F.size(polygon)
    edges = F.transform(polygon, lambda p, i: F.struct(p.alias("p"), F.get(polygon, (i + 1) % n).alias("q")))
    on = F.exists(edges, lambda e: (F.abs((e.q.x - e.p.x) * (y - e.p.y) - (e.q.y - e.p.y) * (x - e.p.x)) < 1e-12) & x.between(F.least(e.p.x, e.q.x), F.greatest(e.p.x, e.q.x)) & y.between(F.least(e.p.y, e.q.y), F.greatest(e.p.y, e.q.y)))
    hits = F.filter(edges, lambda e: ((e.p.y > y) != (e.q.y > y)) & (x < (e.q.x - e.p.x) * F.try_divide(y - e.p.y, e.q.y - e.p.y) + e.p.x))
    return on | (F.size(hits) % 2 == 1)


def polygon_area(polygon: Column) -> Column:
    """Signed area of an array of struct<x, y>."""
    n = F.size(polygon)
    parts = F.transform(polygon, lambda p, i: p.x * F.get(polygon, (i + 1) % n).y - F.get(polygon, (i + 1) % n).x * p.y)
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2


# --- cells of trees ---------------------------------------------------------------------------------------------------


def child_octant(p: Vector, centre: Vector) -> Column:
    """0 to 7: bits x, y, z are set on the upper side of the centre."""
    return sum(F.when(x >= c, 1 << i).otherwise(0) for i, (x, c) in enumerate(zip(p, centre)))


def morton(ix: Column, iy: Column, iz: Column, bits: int = 20) -> Column:
    """Z-order key of three non-negative integers."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, v in enumerate((ix, iy, iz)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 3 * b + k))
    return out


def depth_for(half_width: Column, res: float) -> Column:
    """Depth at which cells of a tree are no larger than res."""
    return F.ceil(F.log2(2 * half_width / res))


def face_position(pa: Column, pb: Column, ca: Column, cb: Column) -> Column:
    """Where the probability between two leaf centres passes 0.5, by linear interpolation; the middle if it does not."""
    t = F.try_divide(0.5 - pa, pb - pa)
    return ca + (cb - ca) * F.when(t.between(0.0, 1.0), t).otherwise(0.5)


def face_position_variance(pa: Column, pb: Column, va: Column, vb: Column, gap: Column) -> Column:
    """Variance of that position from those of the two probabilities."""
    d2 = (pb - pa) * (pb - pa)
    return gap * gap * F.try_divide((pb - 0.5) * (pb - 0.5) * va + (pa - 0.5) * (pa - 0.5) * vb, d2 * d2)


def face_area(hw_a: Column, hw_b: Column) -> Column:
    return 4 * F.least(hw_a, hw_b) * F.least(hw_a, hw_b)


def polygon_normal(points: Column) -> list[Column]:
    """Unit normal of an array of struct<x, y, z>, from the areas of its shadows on the three planes."""
    n = F.size(points)

    def area(u, v):
        parts = F.transform(points, lambda p, i: (p[u] - F.get(points, (i + 1) % n)[u]) * (p[v] + F.get(points, (i + 1) % n)[v]))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    raw = [area("y", "z"), area("z", "x"), area("x", "y")]
    return [F.try_divide(c, norm(raw)) for c in raw]


def nearest_on_planes(p: Vector, n1: Vector, d1: Column, n2: Vector, d2: Column) -> list[Column]:
    """The point nearest to p on both planes n . q = d: p moved within the span of the normals; null if they are parallel."""
    a, b, c = dot(n1, n1), dot(n1, n2), dot(n2, n2)
    e, f = d1 - dot(n1, p), d2 - dot(n2, p)
    det = a * c - b * b
    s, t = F.try_divide(e * c - f * b, det), F.try_divide(f * a - e * b, det)
    return [x + u * s + v * t for x, u, v in zip(p, n1, n2)]


def window_corners(a: Vector, b: Vector, floor: Column, ceiling: Column, min_h: Column, min_v: Column, max_h: Column, max_v: Column) -> list[list[Column]]:
    """World corners of a window on the wall from a to b, positions along and up the wall being shares from 0 to 1."""
    def at(h, v):
        return [a[0] + (b[0] - a[0]) * h, a[1] + (b[1] - a[1]) * h, floor + (ceiling - floor) * v]

    return [at(min_h, min_v), at(max_h, min_v), at(max_h, max_v), at(min_h, max_v)]


def shared_edge(low_a: Vector, high_a: Vector, low_b: Vector, high_b: Vector) -> tuple[list[Column], list[Column]]:
    """Lowest and highest corner of what two touching boxes share."""
    return [F.greatest(x, y) for x, y in zip(low_a, low_b)], [F.least(x, y) for x, y in zip(high_a, high_b)]


def from_gravity(ax: Column, ay: Column, az: Column, heading: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw of a resting sensor from its acceleration and a heading."""
    return F.atan2(ay, az), F.atan2(-ax, F.sqrt(ay * ay + az * az)), heading


def face_planarity(pa: Column, pb: Column, sa: Column, sb: Column) -> Column:
    """Planarity between two leaves at the place where their probability passes 0.5."""
    t = F.try_divide(0.5 - pa, pb - pa)
    f = F.when(t.between(0.0, 1.0), t).otherwise(0.5)
    return sa * (1 - f) + sb * f
