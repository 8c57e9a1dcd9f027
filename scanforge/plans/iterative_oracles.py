"""SQL of queries whose steps follow on each other or solve small systems: recursion over rows in order, folds, closed forms."""

from __future__ import annotations

from .inputs import sql
from .mesh_queries import _DENSE
from .registry import ORACLES
from .shape_queries import _AXES, _P2, _P3, _VOX

ORACLES["x42_x44_colours"] = sql("SELECT CAST(CAST(trunc(z * 64.0) AS BIGINT) % 256 AS INT) AS hr, CAST(floor(255 * greatest(0.0, 1 - abs(greatest(0.0, least(1.0, (y - 1) / 49.0)) - 0.5) * 2)) AS INT) AS tg, count(*) AS n FROM points GROUP BY ALL", "points")

ORACLES["x46_x76_fisheye"] = f"""WITH {_P3}, q AS (SELECT k, cx, cy, sqrt(cx * cx + cy * cy) AS flat, atan2(-cz, sqrt(cx * cx + cy * cy)) AS t FROM p),
    r AS (SELECT k, coalesce(cx / nullif(flat, 0), 0) * ((10 * t + 150) * t + 300) AS x, coalesce(cy / nullif(flat, 0), 0) * ((10 * t + 150) * t + 300) AS y FROM q)
    SELECT k, round(x + 0.001 * y + 640, 6) AS u, round(-0.001 * x + y + 480, 6) AS v FROM r"""

ORACLES["a07_wedge_samples"] = f"""WITH {_DENSE}, wedge AS (SELECT row_number() OVER (ORDER BY a.frame, a.p) - 1 AS wedge_id, a.frame AS fa, a.p AS a1, a.q AS a2, b.frame AS fb, b.p AS b1, b.q AS b2 FROM d a JOIN o ON a.frame = o.frame JOIN d b ON b.frame = o.nf AND b.i = a.i WHERE a.q IS NOT NULL AND b.q IS NOT NULL),
    e AS (SELECT wedge_id, fa AS frame, a1 AS p FROM wedge UNION ALL SELECT wedge_id, fa, a2 FROM wedge UNION ALL SELECT wedge_id, fb, b1 FROM wedge UNION ALL SELECT wedge_id, fb, b2 FROM wedge),
    m AS (SELECT l_orderkey AS frame, l_linenumber AS p, avg(l_quantity) AS w, sqrt(avg(l_discount) + 0.0031) AS pr, sqrt(avg(l_tax) + 0.0031) AS s FROM lineitem GROUP BY ALL)
    SELECT wedge_id, round(sum(w), 7) AS w, round(sum(w * pr) / sum(w), 7) AS p, round(sum(w * s) / sum(w), 7) AS corner, round(sum(w * pr) / sum(w), 7) AS planar, round(1 - product(1 - s), 7) AS surface FROM e JOIN m USING (frame, p) GROUP BY wedge_id"""

# Faces between leaves of both kinds; `sign` is 1 where the solid leaf is on the upper side
_FACES = f"""{_VOX}, {_AXES}, n AS (SELECT a.ix AS ax, a.iy AS ay, a.iz AS az, b.ix AS bx, b.iy AS by2, b.iz AS bz, axis, (a.ix + a.iy) % 3 > 0 AS ai, (b.ix + b.iy) % 3 > 0 AS bi FROM vox a, ax, vox b WHERE b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.iz = a.iz + dz),
    f AS (SELECT CASE WHEN ai THEN concat_ws(',', ax, ay, az) ELSE concat_ws(',', bx, by2, bz) END AS interior, CASE WHEN ai THEN concat_ws(',', bx, by2, bz) ELSE concat_ws(',', ax, ay, az) END AS exterior, axis, CASE WHEN ai THEN 1 ELSE -1 END AS sign,
        CASE WHEN ai THEN ax ELSE bx END + 0.5::DOUBLE AS ix, CASE WHEN ai THEN ay ELSE by2 END + 0.5::DOUBLE AS iy, CASE WHEN ai THEN az ELSE bz END + 0.5::DOUBLE AS iz FROM n WHERE ai <> bi),
    face AS (SELECT interior, exterior, axis, sign, 1.0::DOUBLE AS area, ix + CASE WHEN axis = 'x' THEN sign * 0.5 ELSE 0 END AS fx, iy + CASE WHEN axis = 'y' THEN sign * 0.5 ELSE 0 END AS fy, iz + CASE WHEN axis = 'z' THEN sign * 0.5 ELSE 0 END AS fz,
        CASE WHEN axis = 'x' THEN -sign ELSE 0 END::DOUBLE AS nx, CASE WHEN axis = 'y' THEN -sign ELSE 0 END::DOUBLE AS ny, CASE WHEN axis = 'z' THEN -sign ELSE 0 END::DOUBLE AS nz,
        ix + CASE WHEN axis = 'x' THEN sign * 4 / 7.0 ELSE 0 END AS px, iy + CASE WHEN axis = 'y' THEN sign * 4 / 7.0 ELSE 0 END AS py, iz + CASE WHEN axis = 'z' THEN sign * 4 / 7.0 ELSE 0 END AS pz FROM f)"""

ORACLES["g78_x50_leaf_faces"] = f"WITH {_FACES} SELECT * REPLACE (round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz) FROM face"

ORACLES["t14_g10_planar_regions"] = f"""WITH RECURSIVE {_FACES}, k AS (SELECT *, row_number() OVER (ORDER BY interior, exterior) AS id FROM face),
    link AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.axis = b.axis AND a.sign = b.sign AND abs(a.fx - b.fx) + abs(a.fy - b.fy) + abs(a.fz - b.fz) = 1 AND CASE a.axis WHEN 'x' THEN a.fx = b.fx WHEN 'y' THEN a.fy = b.fy ELSE a.fz = b.fz END),
    reach(a, b) AS (SELECT id, id FROM k UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    reg AS (SELECT a AS id, min(b) AS region FROM reach GROUP BY a),
    c AS (SELECT region, sum(area) AS area, count(*) AS faces, avg(fx) AS cx, avg(fy) AS cy, avg(fz) AS cz, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz, min(fx) AS min_x, max(fx) AS max_x, min(fy) AS min_y, max(fy) AS max_y, min(fz) AS min_z, max(fz) AS max_z FROM k JOIN reg USING (id) GROUP BY 1)
    SELECT c.area AS area, 1.0::DOUBLE AS planarity, faces, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(cz), 6) AS cz, min_x, max_x, min_y, max_y, min_z, max_z, round(any_value(sx) / sqrt(any_value(sx) * any_value(sx) + any_value(sy) * any_value(sy) + any_value(sz) * any_value(sz)), 6) AS nx, round(any_value(sy) / sqrt(any_value(sx) * any_value(sx) + any_value(sy) * any_value(sy) + any_value(sz) * any_value(sz)), 6) AS ny, round(any_value(sz) / sqrt(any_value(sx) * any_value(sx) + any_value(sy) * any_value(sy) + any_value(sz) * any_value(sz)), 6) AS nz,
        round(max(greatest(abs(fx - cx), abs(fy - cy), abs(fz - cz))), 6) AS radius
    FROM k JOIN reg USING (id) JOIN c USING (region) GROUP BY region, c.area, faces, min_x, max_x, min_y, max_y, min_z, max_z"""
ORACLES["j46_g31_segment_triangles"] = f"""WITH {_P2}, s AS (SELECT px AS x0, py AS y0, bx + 0.017 AS x1, cy + 0.019 AS y1 FROM p), m AS (SELECT * FROM s, p AS t),
    e AS (SELECT k, x0, y0, x1, y1, ax, ay, bx, by2, cx, cy,
        least((bx - ax) * (y0 - ay) - (by2 - ay) * (x0 - ax), (cx - bx) * (y0 - by2) - (cy - by2) * (x0 - bx), (ax - cx) * (y0 - cy) - (ay - cy) * (x0 - cx)) >= 0 OR greatest((bx - ax) * (y0 - ay) - (by2 - ay) * (x0 - ax), (cx - bx) * (y0 - by2) - (cy - by2) * (x0 - bx), (ax - cx) * (y0 - cy) - (ay - cy) * (x0 - cx)) <= 0 AS inside,
        list_transform([[ax, ay, bx, by2], [bx, by2, cx, cy], [cx, cy, ax, ay]], lambda v: [(v[1] - x0) * (v[4] - v[2]) - (v[2] - y0) * (v[3] - v[1]), (v[1] - x0) * (y1 - y0) - (v[2] - y0) * (x1 - x0), (x1 - x0) * (v[4] - v[2]) - (y1 - y0) * (v[3] - v[1])]) AS w FROM m)
    SELECT k AS t, count(*) AS crossed FROM e WHERE inside OR len(list_filter(w, lambda v: v[3] <> 0 AND v[1] / v[3] BETWEEN 0 AND 1 AND v[2] / v[3] BETWEEN 0 AND 1)) > 0 GROUP BY k"""

ORACLES["g26_g27_door_positions"] = sql(f""", {_P2}, c AS (SELECT CAST(floor(x / 4) AS BIGINT) AS i0, CAST(floor(y / 4) AS BIGINT) AS i1, avg(z) AS h FROM points GROUP BY ALL),
    a AS (SELECT p.k AS door, s.k, px * 4 + cos(p.k % 7 * 0.4) * (s.k * 0.75) AS sx, py * 4 + sin(p.k % 7 * 0.4) * (s.k * 0.75) AS sy FROM p, (SELECT unnest(generate_series(-8, 8)) AS k) s),
    b AS (SELECT door, arg_min([sx, sy, coalesce(h, 1e9)], (coalesce(h, 1e9), abs(k), k)) AS m FROM a LEFT JOIN c ON floor(sx / 4) = i0 AND floor(sy / 4) = i1 GROUP BY door)
    SELECT door, round(m[1], 6) AS x, round(m[2], 6) AS y, CASE WHEN m[3] < 1e9 THEN round(m[3], 6) END AS open_height FROM b""", "points")

_BY_USER = "p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {}) AS pos FROM samples)"

ORACLES["w08_sample_by_distance"] = "WITH RECURSIVE " + sql(
    f", {_BY_USER.format('t')}, r AS (SELECT user_id, pos, value AS last, true AS keep FROM p WHERE pos = 1 UNION ALL SELECT p.user_id, p.pos, CASE WHEN (p.value - r.last) * (p.value - r.last) >= 625 THEN p.value ELSE r.last END, (p.value - r.last) * (p.value - r.last) >= 625 FROM r JOIN p ON p.user_id = r.user_id AND p.pos = r.pos + 1) SELECT event_id, user_id, t, value FROM p JOIN r USING (user_id, pos) WHERE keep",
    "samples",
).removeprefix("WITH ")

ORACLES["j39_w10_spacing"] = "WITH RECURSIVE " + sql(
    f", {_BY_USER.format('event_id')}, r AS (SELECT user_id, pos, [value] AS kept, true AS keep FROM p WHERE pos = 1 UNION ALL SELECT p.user_id, p.pos, CASE WHEN len(list_filter(r.kept, lambda q: (p.value - q) * (p.value - q) < 100)) = 0 THEN list_append(r.kept, p.value) ELSE r.kept END, len(list_filter(r.kept, lambda q: (p.value - q) * (p.value - q) < 100)) = 0 FROM r JOIN p ON p.user_id = r.user_id AND p.pos = r.pos + 1) SELECT user_id, event_id, value FROM p JOIN r USING (user_id, pos) WHERE keep",
    "samples",
).removeprefix("WITH ")

ORACLES["g05_o05_small_rooms"] = """WITH RECURSIVE room AS (SELECT l_partkey % 50 % 5 AS level, l_partkey % 50 AS room, round(sum(l_quantity), 3) AS area FROM lineitem GROUP BY ALL),
    b AS (SELECT l_partkey % 50 % 5 AS level, l_partkey % 50 AS a, l_suppkey % 50 AS b, round(sum(l_tax), 3) AS n FROM lineitem WHERE l_partkey % 50 < l_suppkey % 50 AND l_partkey % 50 % 5 = l_suppkey % 50 % 5 GROUP BY ALL),
    nb AS (SELECT level, a, list(b) AS near FROM (SELECT level, a, b FROM b WHERE n > 2.4384 UNION ALL SELECT level, b, a FROM b WHERE n > 2.4384) WHERE (level, b) IN (SELECT (level, room) FROM room) GROUP BY ALL),
    p AS (SELECT room.*, coalesce(near, []) AS near, row_number() OVER (PARTITION BY room.level ORDER BY area, room) AS pos FROM room LEFT JOIN nb ON nb.level = room.level AND nb.a = room.room),
    r AS (SELECT level, 0::BIGINT AS pos, []::BIGINT[] AS gone FROM (SELECT DISTINCT level FROM p) UNION ALL SELECT p.level, p.pos, CASE WHEN len(list_filter(p.near, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, p.room) ELSE r.gone END FROM r JOIN p ON p.level = r.level AND p.pos = r.pos + 1),
    z AS (SELECT level, arg_max(gone, pos) AS gone FROM r GROUP BY level)
    SELECT p.level, p.room, p.area FROM p JOIN z USING (level) WHERE NOT list_contains(gone, room)"""

ORACLES["j48_blended_colour"] = """WITH c AS (SELECT l_orderkey AS p, l_discount AS q, CAST(l_partkey % 256 AS DOUBLE) AS v, l_linenumber * 1000000 + l_partkey AS o FROM lineitem),
    g AS (SELECT p, list(struct_pack(q := q, v := v) ORDER BY o, q, v) AS l FROM c GROUP BY p),
    r AS (SELECT p, list_reduce(l, lambda s, n: CASE WHEN n.q > s.q + 0.02 THEN n WHEN abs(n.q - s.q) <= 0.02 THEN struct_pack(q := s.q, v := s.v * (1 - (n.q - s.q + 0.02) / 0.04) + n.v * ((n.q - s.q + 0.02) / 0.04)) ELSE s END) AS f FROM g)
    SELECT p, round(f.v, 6) AS colour, f.q AS quality FROM r"""

# The least root of the characteristic polynomial in closed form, and the longest product of two rows of what it leaves
ORACLES["a45_a46_fit_planes"] = sql(
    """, m AS (SELECT part % 40 AS k, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, covar_pop(y, y) AS d, covar_pop(y, z) AS e, covar_pop(z, z) AS f FROM points GROUP BY 1),
    q AS (SELECT *, (a + d + f) / 3 AS q FROM m), p AS (SELECT *, sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)) / 6) AS p FROM q),
    r AS (SELECT *, greatest(-1.0, least(1.0, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (p * p * p) / 2)) AS r FROM p),
    l AS (SELECT *, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l FROM r),
    v AS (SELECT *, [[b * e - c * (d - l), c * b - (a - l) * e, (a - l) * (d - l) - b * b], [b * (f - l) - c * e, c * c - (a - l) * (f - l), (a - l) * e - b * c], [(d - l) * (f - l) - e * e, e * c - b * (f - l), b * e - (d - l) * c]] AS v FROM l),
    w AS (SELECT *, list_sort(list_transform(v, lambda t: [sqrt(t[1] * t[1] + t[2] * t[2] + t[3] * t[3]), t[1], t[2], t[3]]))[3] AS w FROM v),
    s AS (SELECT *, CASE WHEN abs(w[2]) >= abs(w[3]) AND abs(w[2]) >= abs(w[4]) THEN sign(w[2]) WHEN abs(w[3]) >= abs(w[4]) THEN sign(w[3]) ELSE sign(w[4]) END / w[1] AS s FROM w)
    SELECT k, n, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(mz, 6) AS mean_z, round(w[2] * s, 6) AS nx, round(w[3] * s, 6) AS ny, round(w[4] * s, 6) AS nz, round(greatest(l, 0.0), 6) AS error FROM s""",
    "points",
)
