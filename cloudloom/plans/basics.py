"""Registered queries: frames, scalar functions, predicates and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import geometry as geo
from ..functions import shapes as sh
from ..functions import values as va
from ..operators import containment as co
from ..operators import sampling as sa
from . import adapters as ad
from .registry import query

R = lambda c, d=6: F.round(c, d)
BOX = {"type": "obb", "center": [5.0, 0.6, 5.0], "size": [4.0, 1.0, 3.0], "rotation": [0.2, 0.7, -0.3]}
PRISM = {"type": "prism", "polygon": [[1.0, 1.0], [7.0, 1.5], [4.0, 3.0], [6.5, 6.0], [1.5, 5.0]], "y0": 0.2, "height": 0.7}
TUBE = {"type": "tube", "paths": [{"points": [[1.0, 0.5, 1.0], [5.0, 0.6, 4.0], [9.0, 0.4, 5.0]], "radius": 0.6, "smooth": False}]}


def _obb_sql(c, s, r, eps="0", p=("x", "y", "z")):
    """Text of the box test for a check query; arguments are SQL expressions."""
    d = [f"({a}-({o}))" for a, o in zip(p, c)]
    a, b, g = (f"({v})" for v in r)
    m = [
        f"cos({b})*cos({g})", f"-cos({b})*sin({g})", f"sin({b})",
        f"cos({a})*sin({g})+sin({a})*sin({b})*cos({g})", f"cos({a})*cos({g})-sin({a})*sin({b})*sin({g})", f"-sin({a})*cos({b})",
        f"sin({a})*sin({g})-cos({a})*sin({b})*cos({g})", f"sin({a})*cos({g})+cos({a})*sin({b})*sin({g})", f"cos({a})*cos({b})",
    ]
    return "(" + " AND ".join(
        f"abs({d[0]}*({m[j]})+{d[1]}*({m[3 + j]})+{d[2]}*({m[6 + j]})) <= ({s[j]})/2.0+{eps}" for j in range(3)
    ) + ")"


def _ring_sql(ring, x="x", z="z"):
    """Even-odd test text: count of crossed edges is odd."""
    edges = []
    for (ax, az), (bx, bz) in zip(ring, ring[1:] + ring[:1]):
        edges.append(
            f"CASE WHEN ((({az})>{z})<>(({bz})>{z})) AND {x} < ({ax})+({z}-({az}))*(({bx})-({ax}))/(CASE WHEN ({bz})<>({az}) THEN ({bz})-({az}) ELSE 1.0 END) THEN 1 ELSE 0 END"
        )
    return "((" + "+".join(edges) + ")%2=1)"


def _seg_sql(a, b, r2):
    d = [f"(({q})-({p}))" for p, q in zip(a, b)]
    w = [f"({v}-({p}))" for v, p in zip("xyz", a)]
    l2 = "(" + "+".join(f"{v}*{v}" for v in d) + ")"
    t = f"greatest(0.0, least(1.0, ({'+'.join(f'{p}*{q}' for p, q in zip(w, d))})/{l2}))"
    return "((" + "+".join(f"({p}-{t}*{q})*({p}-{t}*{q})" for p, q in zip(w, d)) + f") <= {r2})"


BOX_SQL = _obb_sql(BOX["center"], BOX["size"], BOX["rotation"])
PRISM_SQL = f"(y BETWEEN 0.2 AND 0.2::DOUBLE+0.7::DOUBLE AND {_ring_sql(PRISM['polygon'])})"
_p = TUBE["paths"][0]
TUBE_SQL = "(" + " OR ".join(_seg_sql(a, b, 0.6 * 0.6) for a, b in zip(_p["points"], _p["points"][1:])) + ")"


@query("fn1_frame_turns", "SELECT point_id, round(x,6) AS yx, round(z,6) AS yy, round(-y,6) AS yz, round(x,6) AS zx, round(-z,6) AS zy, round(y,6) AS zz FROM li", "li")
def _(s, d):
    p = ad.points(s, d)
    a, b = fr.z_up_to_y_up("x", "y", "z"), fr.y_up_to_z_up("x", "y", "z")
    return p.select("point_id", *[R(c).alias("y" + n) for c, n in zip(a, "xyz")], *[R(c).alias("z" + n) for c, n in zip(b, "xyz")])


@query("fn2_recenter", """WITH m AS (SELECT avg(x+4000) mx, avg(y) my, avg(z) mz FROM li)
SELECT point_id, round(x+4000-mx,7) AS x, round(y-my,7) AS y, round(z-mz,7) AS z FROM li, m""", "li")
def _(s, d):
    out = fr.recenter(ad.points(s, d).withColumn("x", F.col("x") + 4000))
    return out.select("point_id", *[R(c, 7).alias(c) for c in "xyz"])


@query("fn3_display_round_trip", "SELECT point_id, round(x-1,6) AS dx, round(z-2,6) AS dy, round(-y-3,6) AS dz, round(x,6) AS sx, round(y,6) AS sy, round(z,6) AS sz FROM li", "li")
def _(s, d):
    off = (1.0, 2.0, 3.0)
    shown = fr.to_display("x", "y", "z", True, off)
    p = ad.points(s, d).withColumns(dict(zip(("dx", "dy", "dz"), shown)))
    back = fr.to_source("dx", "dy", "dz", True, off)
    return p.select("point_id", *[R(c).alias(c) for c in ("dx", "dy", "dz")], *[R(c).alias("s" + n) for c, n in zip(back, "xyz")])


@query("fn4_is_z_up", """SELECT o_orderkey AS scan, NOT (o_orderstatus='O' AND NOT o_orderpriority='1-URGENT') AS z_up FROM orders""")
def _(s, d):
    o = ad.table(s, d, "orders")
    mesh = F.when(F.col("o_orderstatus") == "O", "m.glb")
    laz = F.when(F.col("o_orderpriority") == "1-URGENT", "a.laz")
    return o.select(F.col("o_orderkey").alias("scan"), fr.is_z_up(mesh, laz).alias("z_up"))


@query("fn5_euler_matrix", """SELECT shape_id, round(cos(a)*cos(b),6) AS m0, round(-cos(a)*sin(b),6) AS m1, round(sin(a),6) AS m2,
round(cos(g)*sin(b)+sin(g)*sin(a)*cos(b),6) AS m3, round(sin(g)*sin(b)-cos(g)*sin(a)*cos(b),6) AS m6
FROM (SELECT shape_id, ry AS a, ry*0.5 AS b, ry*0.25 AS g FROM boxes)""", "boxes")
def _(s, d):
    m = fr.euler_matrix(F.col("ry") * 0.25, "ry", F.col("ry") * 0.5)
    return ad.boxes(s, d).select("shape_id", *[R(m[i]).alias(f"m{i}") for i in (0, 1, 2, 3, 6)])


@query("fn6_euler_from_basis", "SELECT shape_id, round(ry*0,5) AS rx, round(asin(sin(ry)),5) AS ay, round(0,5)::DOUBLE AS rz FROM boxes WHERE cos(ry)>0.001", "boxes")
def _(s, d):
    m = fr.euler_matrix("rx", "ry", "rz")
    e = fr.euler_from_basis((m[0], m[3], m[6]), (m[1], m[4], m[7]), (m[2], m[5], m[8]))
    rows = ad.boxes(s, d).filter(F.cos("ry") > 0.001)
    return rows.select("shape_id", *[(R(c, 5) + 0.0).alias(n) for c, n in zip(e, ("rx", "ay", "rz"))])


@query("fn7_apply_transform", "SELECT point_id, round(0.6*x-0.8*z+1,6) AS x, round(y+2,6) AS y, round(0.8*x+0.6*z+3,6) AS z FROM li", "li")
def _(s, d):
    m = [0.6, 0, -0.8, 1, 0, 1, 0, 2, 0.8, 0, 0.6, 3, 0, 0, 0, 1]
    eye = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    t = fr.apply_transform(fr.compose_transform(m, eye), "x", "y", "z")
    return ad.points(s, d).select("point_id", *[R(c).alias(n) for c, n in zip(t, "xyz")])


@query("fn8_fn9_prism_bounds", """SELECT shape_id, round(x0+1,6) AS x0, round(y0+2,6) AS y0, round(z0+3,6) AS z0, round(x0+2.8,6) AS x1, round(y0+2.8,6) AS y1, round(z0+4.9,6) AS z1 FROM reg""", "reg")
def _(s, d):
    moved = ad.regions(s, d).select("shape_id", fr.shift_prism(F.struct("polygon", "y0", "height"), 1.0, 2.0, 3.0).alias("p"))
    return moved.select("shape_id", *[R(c).alias(n) for n, c in fr.prism_aabb("p").items()])


@query("fn10_catmull_rom", """WITH s AS (SELECT s_suppkey//4 AS path_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY s_suppkey//4) AS n,
 s_suppkey*CAST(0.5 AS DOUBLE) AS x, s_acctbal/CAST(2000 AS DOUBLE) AS y, (s_suppkey%7)*CAST(0.3 AS DOUBLE) AS z FROM supplier WINDOW w AS (PARTITION BY s_suppkey//4 ORDER BY s_suppkey)),
q AS (SELECT b.path_id, b.i, b.n, [a.x,a.y,a.z] AS p0, [b.x,b.y,b.z] AS p1, [c.x,c.y,c.z] AS p2, [d.x,d.y,d.z] AS p3,
 sqrt((c.x-b.x)*(c.x-b.x)+(c.y-b.y)*(c.y-b.y)+(c.z-b.z)*(c.z-b.z)) AS len FROM s b JOIN s c ON c.path_id=b.path_id AND c.i=b.i+1
 JOIN s a ON a.path_id=b.path_id AND a.i=greatest(1,b.i-1) JOIN s d ON d.path_id=b.path_id AND d.i=least(b.n,b.i+2)),
g AS (SELECT *, CASE WHEN n>=3 THEN greatest(1, CAST(ceil(len/CAST(0.2 AS DOUBLE)) AS BIGINT)) ELSE 1 END AS parts FROM q),
e AS (SELECT *, unnest(range(1, parts+1)) AS j FROM g), t AS (SELECT *, j/CAST(parts AS DOUBLE) AS t FROM e),
v AS (SELECT path_id, i, j, list_transform([1,2,3], lambda k: CASE WHEN n<3 THEN p2[k] ELSE 0.5*(2*p1[k]+(p2[k]-p0[k])*t+(2*p0[k]-5*p1[k]+4*p2[k]-p3[k])*t*t+(3*p1[k]-p0[k]-3*p2[k]+p3[k])*t*t*t) END) AS o FROM t)
SELECT path_id, 0 AS seq, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM s WHERE i=1 AND n>=2
UNION ALL SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY i, j) AS INT), round(o[1],6), round(o[2],6), round(o[3],6) FROM v""")
def _(s, d):
    """Smooth paths through four suppliers' positions each, sampled every half radius."""
    sup = ad.table(s, d, "supplier").selectExpr("CAST(s_suppkey DIV 4 AS BIGINT) AS path_id", "s_suppkey", "array(s_suppkey*0.5D, s_acctbal/2000D, (s_suppkey%7)*0.3D) AS p")
    paths = sup.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "p"))), lambda e: e["p"]).alias("points"))
    paths = paths.select("path_id", F.col("path_id").cast("int").alias("instance_id"), "points", F.lit(0.4).alias("radius"), F.lit(True).alias("smooth"))
    return geo.catmull_rom(paths).select("path_id", "seq", *[R(c).alias(c) for c in "xyz"])


@query("fn11_beam_to_obb", """WITH b AS (SELECT p_partkey AS k, p_size*0.1 ax, 0.2 ay, p_retailprice/500 az, p_size*0.1+1.5 bx, 0.2 by_, p_retailprice/500+2.0 bz FROM part)
SELECT k AS id, round((ax+bx)/2,5) AS cx, round(0.2,5)::DOUBLE AS cy, round((az+bz)/2,5) AS cz, round(2.5,5)::DOUBLE AS sx, round(0.3,5)::DOUBLE AS sy FROM b""")
def _(s, d):
    p = ad.table(s, d, "part").selectExpr("p_partkey AS id", "p_size*0.1D AS ax", "0.2D AS ay", "p_retailprice/500 AS az")
    p = p.withColumns({"bx": F.col("ax") + 1.5, "by": F.col("ay"), "bz": F.col("az") + 2.0})
    o = geo.beam_to_obb(("ax", "ay", "az"), ("bx", "by", "bz"), F.lit(0.3))
    return p.select("id", *[R(o[c], 5).alias(c) for c in ("cx", "cy", "cz", "sx", "sy")])


@query("fn12_prism_from_corners", """SELECT n_nationkey AS id, CASE WHEN n_nationkey%5*0.02 >= 0.05 THEN CAST(n_nationkey%3 AS DOUBLE) END AS y0, CASE WHEN n_nationkey%5*0.02 >= 0.05 THEN CAST(round(n_nationkey%5*0.02,6) AS DOUBLE) END AS height FROM nation""")
def _(s, d):
    n = ad.table(s, d, "nation").selectExpr("n_nationkey AS id", "CAST(n_nationkey%3 AS DOUBLE) AS y", "n_nationkey%5*0.02D AS h")
    corners = F.array(*[F.array(F.lit(float(i)), F.col("y") + i * 0.1, F.lit(float(i * i))) for i in range(4)])
    p = geo.prism_from_corners(corners, F.col("y") + F.col("h"))
    return n.select("id", R(p["y0"]).alias("y0"), R(p["height"]).alias("height"))


@query("fn13_rgb16_to_8", "SELECT point_id, CAST((r16 // 256) AS INT) AS r FROM li", "li")
def _(s, d):
    p = ad.li(s, d).select("scan_id", "point_id", F.col("r16").alias("r"), "g", "b")
    return va.rgb16_to_8(p).select("point_id", "r")


@query("fn14_color_normalize", "SELECT point_id, round(CASE WHEN r>250 THEN 0.55 ELSE r/255.0 END,6)::DOUBLE AS r FROM li", "li")
def _(s, d):
    p = ad.points(s, d, "r")
    return p.select("point_id", R(va.color_normalize(F.when(F.col("r") <= 250, F.col("r")))).alias("r"))


@query("fn15_intensity_normalize", "SELECT point_id, round(intensity/(SELECT max(intensity) FROM li),6) AS intensity FROM li", "li")
def _(s, d):
    return va.intensity_normalize(ad.points(s, d, "intensity")).select("point_id", R("intensity").alias("intensity"))


_PAL = ",".join(f"'{c}'" for c in va.FALLBACK_PALETTE)


@query("fn16_class_palette", f"""SELECT id, label, ([{_PAL}])[id%15+1] AS color FROM (
SELECT coalesce(n.n_nationkey, c.k) AS id, coalesce(n.n_name, c.l) AS label FROM nation n FULL JOIN (SELECT DISTINCT c_nationkey+10 AS k, 'cust_'||(c_nationkey+10) AS l FROM customer) c ON n.n_nationkey=c.k)""")
def _(s, d):
    reg = ad.table(s, d, "nation").selectExpr("n_nationkey AS id", "n_name AS label")
    cm = ad.table(s, d, "customer").selectExpr("c_nationkey+10 AS id", "concat('cust_', c_nationkey+10) AS label")
    return va.class_palette(reg, cm)


@query("fn17_label_to_class", """SELECT p_partkey AS id, CAST(CASE WHEN lower(p_name) LIKE '%pipe%' THEN 0 WHEN lower(p_name) LIKE '%drum%' OR lower(p_name) LIKE '%tank%' OR lower(p_name) LIKE '%vessel%' OR lower(p_name) LIKE '%silo%' THEN 1
WHEN regexp_matches(lower(p_name),'flat_surface|wall|floor|ceiling|beam|structural|plane') THEN 3 WHEN regexp_matches(lower(p_name),'fitting|elbow|joint|flange') THEN 4
WHEN regexp_matches(lower(p_name),'equipment|pump|valve|motor|instrument') THEN 2 WHEN lower(p_name)='blue bolt' THEN 9 ELSE 5 END AS INT) AS class_id FROM part""")
def _(s, d):
    names = [(0, "Pipe"), (1, "Tank"), (2, "Equipment"), (3, "Structural"), (4, "Fitting"), (5, "Unknown"), (9, "Blue Bolt")]
    cls = s.createDataFrame(names, "id int, name string")
    return va.label_to_class(ad.table(s, d, "part").selectExpr("p_partkey AS id", "p_name"), "p_name", cls).select("id", "class_id")


@query("fn18_parse_category", "SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_linenumber%4 AS INT) AS category FROM lineitem")
def _(s, d):
    names = F.array(*[F.lit(n) for n in ("none", "1", "transient", "excluded_review")])
    li = ad.table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), va.parse_category(F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int"))).alias("category"))


@query("fn19_coerce_class", "SELECT c_custkey AS id, CAST(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 7 END AS INT) AS class_id FROM customer")
def _(s, d):
    cls = s.createDataFrame([(1, "Household"), (2, "Machinery")], "id int, name string")
    c = ad.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"), F.col("c_mktsegment")).otherwise("7").alias("v"))
    return va.coerce_class(c, "v", cls).select("id", "class_id")


@query("fn20_loa_band", """SELECT point_id, CASE WHEN z/100<=0.001 THEN 'LOA50' WHEN z/100<=0.005 THEN 'LOA40' WHEN z/100<=0.015 THEN 'LOA30' WHEN z/100<=0.05 THEN 'LOA20' ELSE 'LOA10' END AS loa FROM li""", "li")
def _(s, d):
    return ad.points(s, d).select("point_id", geo.loa_band(F.col("z") / 100).alias("loa"))


@query("fn21_classify_cylinder", """SELECT point_id, CASE WHEN rr>0.4 THEN 'tank' WHEN rr>0.15 THEN (CASE WHEN z/(2*rr)<3 THEN 'tank' ELSE 'large_pipe' END)
WHEN rr>0.03 THEN (CASE WHEN z/(2*rr)>5 THEN 'pipe' WHEN z/(2*rr)>1.5 THEN 'short_pipe' ELSE 'fitting' END) ELSE 'small_pipe' END AS label
FROM (SELECT point_id, z, x/20 AS rr FROM li)""", "li")
def _(s, d):
    return ad.points(s, d).select("point_id", geo.classify_cylinder(F.col("x") / 20, "z").alias("label"))


@query("fn22_fov_vertical", """SELECT s_suppkey AS id, round(CASE WHEN s_suppkey%3=0 THEN degrees(2*atan(tan(radians(40.0+s_suppkey%30)/2)*3/4)) WHEN s_suppkey%3=1 THEN 40.0+s_suppkey%30 ELSE 60.0 END,5)::DOUBLE AS fov FROM supplier""")
def _(s, d):
    p = ad.table(s, d, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey%3<2 THEN CAST(40+s_suppkey%30 AS DOUBLE) END AS f", "CASE WHEN s_suppkey%3=0 THEN 'horizontal' END AS a")
    return p.select("id", R(fr.fov_vertical("f", "a", F.lit(4), F.lit(3)), 5).alias("fov"))


@query("fn23_yaw_target", """SELECT s_suppkey AS id, round(CASE WHEN s_suppkey%2=0 THEN 7.0 ELSE s_suppkey+cos(s_suppkey*0.1) END,5)::DOUBLE AS tx, round(CASE WHEN s_suppkey%2=0 THEN 9.0 ELSE sin(s_suppkey*0.1) END,5)::DOUBLE AS tz FROM supplier""")
def _(s, d):
    p = ad.table(s, d, "supplier").selectExpr("s_suppkey AS id", "array(CAST(s_suppkey AS DOUBLE), 1D, 0D) AS p", "CASE WHEN s_suppkey%2=0 THEN array(7D,8D,9D) END AS t", "s_suppkey*0.1D AS yaw")
    t = fr.yaw_target("p", "t", "yaw")
    return p.select("id", R(t[0], 5).alias("tx"), R(t[2], 5).alias("tz"))


@query("fn24_look_at", """WITH c AS (SELECT s_suppkey AS id, s_suppkey*0.3 px, 1.0 py, s_suppkey%5*0.7 pz FROM supplier), f AS (SELECT *, 10-px fx, 0.5-py fy, 12-pz fz FROM c),
n AS (SELECT *, sqrt(fx*fx+fy*fy+fz*fz) l FROM f), u AS (SELECT *, fx/l ux, fy/l uy, fz/l uz FROM n)
SELECT id, round(-uz/sqrt(uz*uz+ux*ux),5) AS m0, round(ux/sqrt(uz*uz+ux*ux),5) AS m2, round(-ux,5) AS m6, round(-uy,5) AS m7, round(ux*px+uy*py+uz*pz,5) AS t2 FROM u""")
def _(s, d):
    p = ad.table(s, d, "supplier").selectExpr("s_suppkey AS id", "array(s_suppkey*0.3D, 1D, s_suppkey%5*0.7D) AS p", "array(10D, 0.5D, 12D) AS t")
    v = fr.look_at("p", "t")
    return p.select("id", R(v[0], 5).alias("m0"), R(v[2], 5).alias("m2"), R(v[6], 5).alias("m6"), R(v[7], 5).alias("m7"), R(v[11], 5).alias("t2"))


@query("fn25_slug_and_naming", """SELECT p_partkey AS id, trim(regexp_replace(lower(p_name||' '||p_brand),'[^a-z0-9]+','_','g'),'_') AS slug, regexp_matches(trim(regexp_replace(lower(p_name||' '||p_brand),'[^a-z0-9]+','_','g'),'_'),'^[a-z0-9]+(-[a-z0-9]+)*_[a-z0-9-]+(_[a-z0-9-]+)?$') AS ok FROM part""")
def _(s, d):
    p = ad.table(s, d, "part").select(F.col("p_partkey").alias("id"), va.slug_id(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))
    return p.withColumn("ok", va.naming_ok("slug"))


@query("fn26_utc_stamp", "SELECT event_id AS id, strftime(ts,'%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts,'%Y%m%d_%H%M%S') AS version FROM events")
def _(s, d):
    e = ad.table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), va.utc_stamp("ts").alias("iso"), va.utc_stamp("ts", "yyyyMMdd_HHmmss").alias("version"))


@query("fn27_fingerprint_stable", "SELECT 'li' AS scan_id, true AS same, true AS differs")
def _(s, d):
    """Same content in another order has one fingerprint; changed content has another."""
    a = ad.li(s, d).select("scan_id", "point_id", "ca", "ia", "cb")
    x = va.table_fingerprint(a, ["ca", "ia"]).select("scan_id", F.col("fingerprint").alias("a"))
    y = va.table_fingerprint(a.repartition(7, "cb"), ["ca", "ia"]).select("scan_id", F.col("fingerprint").alias("b"))
    z = va.table_fingerprint(a, ["cb", "ia"]).select("scan_id", F.col("fingerprint").alias("c"))
    return x.join(y, "scan_id").join(z, "scan_id").selectExpr("scan_id", "a = b AS same", "a <> c AS differs")


@query("fn28_cache_key", "SELECT s_suppkey AS id, substr(sha256(concat_ws(',', s_name, CAST(s_nationkey AS VARCHAR), 'fp')),1,16) AS cache_key FROM supplier")
def _(s, d):
    return ad.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), va.cache_key("s_name", "s_nationkey", F.lit("fp")).alias("cache_key"))


@query("fn29_instance_color", "SELECT count(DISTINCT ia) AS instances, true AS one_color_each, true AS grey_unassigned FROM li", "li")
def _(s, d):
    c = ad.labels(s, d).withColumns(va.instance_color("instance_id"))
    per = c.groupBy("instance_id").agg(F.count_distinct("r", "g", "b").alias("k"), F.min("r").alias("lo"), F.max("b").alias("hi"))
    grey = (F.col("instance_id") >= 0) | ((F.col("lo") == 60) & (F.col("hi") == 60))
    return per.agg(F.count("*").alias("instances"), (F.max("k") == 1).alias("one_color_each"), F.min(grey).alias("grey_unassigned"))


@query("fn30_query_intensity", """WITH c AS (SELECT event_type AS q, quantile_cont(value,0.95) AS cap FROM events WHERE value>0 GROUP BY 1)
SELECT event_id AS id, round(greatest(0,least(1,value/cap)),5) AS norm FROM events JOIN c ON event_type=q""")
def _(s, d):
    e = ad.table(s, d, "events").selectExpr("event_id AS id", "event_type AS query", "value")
    return va.query_intensity(e, "value").select("id", R("norm", 5).alias("norm"))


@query("fn30_overlay_colour", """WITH h AS (SELECT point_id, k AS query, CAST((point_id//64) % (k+3) AS INT) AS value FROM li, (SELECT unnest([0,1,2]) AS k)),
w AS (SELECT point_id, query, value, row_number() OVER (PARTITION BY point_id ORDER BY value DESC, query) rn FROM h WHERE value>0)
SELECT point_id, CAST(floor((query*50+40)*(0.25+0.75*(value/10.0))) AS INT) AS r FROM w WHERE rn=1""", "li")
def _(s, d):
    pts = ad.points(s, d).select("scan_id", "point_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("query"))
    hits = pts.withColumn("value", F.expr("CAST((point_id DIV 64) % (query+3) AS INT)")).withColumn("norm", F.col("value") / 10.0)
    pal = s.createDataFrame([(q, q * 50 + 40, 1, 2) for q in range(3)], "query int, r int, g int, b int")
    return va.overlay_colour(hits, pal).select("point_id", "r")


@query("prd1_in_aabb", "SELECT point_id FROM li WHERE x BETWEEN 2 AND 6 AND y BETWEEN 0.2 AND 0.9 AND z BETWEEN 1 AND 7", "li")
def _(s, d):
    return ad.points(s, d).filter(sh.in_aabb((2, 0.2, 1), (6, 0.9, 7))).select("point_id")


@query("prd2_in_obb", f"SELECT point_id FROM li WHERE {BOX_SQL}", "li")
def _(s, d):
    return ad.points(s, d).filter(sh.in_shape(BOX)).select("point_id")


@query("prd3_in_prism", f"SELECT point_id FROM li WHERE {PRISM_SQL}", "li")
def _(s, d):
    return ad.points(s, d).filter(sh.in_shape(PRISM)).select("point_id")


@query("prd4_in_tube", f"SELECT point_id FROM li WHERE {TUBE_SQL}", "li")
def _(s, d):
    return ad.points(s, d).filter(sh.in_shape(TUBE)).select("point_id")


@query("prd5_in_ball", "SELECT point_id FROM li WHERE (x-5)*(x-5)+(y-0.6)*(y-0.6)+(z-5)*(z-5) <= 4 AND (x-5)*0.6+(z-5)*0.8 <= 0.5", "li")
def _(s, d):
    return ad.points(s, d).filter(sh.in_ball((5, 0.6, 5), 2.0, (3, 0, 4), 0.5)).select("point_id")


@query("prd6_shape_dispatch", f"SELECT point_id, {BOX_SQL} AS obb, {PRISM_SQL} AS prism, {TUBE_SQL} AS tube FROM li", "li")
def _(s, d):
    return ad.points(s, d).select("point_id", *[sh.in_shape(v).alias(v["type"]) for v in (BOX, PRISM, TUBE)])


_OPS = [
    {"op": "keep", "center": [5, 0.6, 5], "size": [8, 2, 8], "rotation": [0, 0.3, 0]},
    {"op": "delete", "center": [4, 0.5, 4], "size": [2, 0.6, 2], "rotation": [0, 0, 0]},
    {"op": "keep", "center": [5, 0.4, 5], "size": [7, 1.2, 9], "rotation": [0, 0, 0]},
]
_CHAIN = " AND ".join(("NOT " if o["op"] == "delete" else "") + _obb_sql(o["center"], o["size"], o["rotation"], "1e-6") for o in _OPS)


@query("prd7_ops_chain", f"SELECT point_id FROM li WHERE {_CHAIN}", "li")
def _(s, d):
    return ad.points(s, d).filter(sh.ops_chain(_OPS)).select("point_id")


_CHAIN_Z = " AND ".join(("NOT " if o["op"] == "delete" else "") + _obb_sql(o["center"], o["size"], o["rotation"], "1e-6", ("x", "(z-5)", "(-y+5)")) for o in _OPS)


@query("prd8_slice_export", f"SELECT point_id, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM li WHERE {_CHAIN_Z}", "li")
def _(s, d):
    out = sh.slice_export(ad.points(s, d), _OPS, True, (0.0, 5.0, -5.0))
    return out.select("point_id", *[R(c).alias(c) for c in "xyz"])


@query("prd9_region_mask", f"SELECT point_id FROM li WHERE y BETWEEN 0.1 AND 0.1::DOUBLE+0.7::DOUBLE AND {_ring_sql([[a - 0.5, b + 0.25] for a, b in PRISM['polygon']])}", "li")
def _(s, d):
    prism = {**PRISM, "y0": 0.35}
    return ad.points(s, d).filter(sh.region_mask(prism, (0.5, 0.25, -0.25))).select("point_id")


@query("prd10_drop_unlabeled", "SELECT point_id, ca AS class_id FROM li WHERE ca >= 0", "li")
def _(s, d):
    return sh.drop_unlabeled(ad.labels(s, d)).select("point_id", "class_id")


@query("prd12_box_outside", f"SELECT point_id FROM li WHERE NOT {BOX_SQL}", "li")
def _(s, d):
    return ad.points(s, d).filter(sh.in_box(BOX, inside=False)).select("point_id")


_MANY = _obb_sql(("cx", "cy", "cz"), ("sx", "sy", "sz"), ("rx", "ry", "rz"))


@query("jn1_points_in_boxes", f"SELECT shape_id, count(*) AS n, min(point_id) AS first_id, max(point_id) AS last_id FROM li JOIN boxes ON x BETWEEN cx-0.3 AND cx+0.3 AND z BETWEEN cz-0.3 AND cz+0.3 AND {_MANY} GROUP BY 1", "li boxes")
def _(s, d):
    hits = co.points_in_boxes(ad.points(s, d), ad.boxes(s, d))
    return hits.groupBy("shape_id").agg(F.count("*").alias("n"), F.min("point_id").alias("first_id"), F.max("point_id").alias("last_id"))


_QUAD = _ring_sql([["x0", "z0"], ["x0+1.8::DOUBLE", "z0+0.2::DOUBLE"], ["x0+1.6::DOUBLE", "z0+1.9::DOUBLE"], ["x0+0.1::DOUBLE", "z0+1.7::DOUBLE"]])


@query("jn1_points_in_prisms", f"SELECT shape_id, point_id FROM li JOIN reg ON y BETWEEN y0 AND y0+height AND {_QUAD}", "li reg")
def _(s, d):
    return co.points_in_prisms(ad.points(s, d), ad.regions(s, d)).select("shape_id", "point_id")


@query("jn1_points_in_tubes", f"SELECT point_id FROM li WHERE {TUBE_SQL}", "li")
def _(s, d):
    path = TUBE["paths"][0]
    paths = s.createDataFrame([(0, 1, path["points"], path["radius"], False)], "path_id int, instance_id int, points array<array<double>>, radius double, smooth boolean")
    chords = geo.chords(paths).withColumnRenamed("path_id", "shape_id")
    return co.points_in_tubes(ad.points(s, d), chords).select("point_id")


@query("smp1_stride_sample", "SELECT point_id FROM li WHERE point_id % CAST(ceil((SELECT count(*) FROM li)/7000.0) AS BIGINT) = 0", "li")
def _(s, d):
    return sa.stride_sample(ad.points(s, d), 7000).select("point_id")


@query("smp2_random_sample", "SELECT least(5000, count(*)) AS n, least(5000, count(*)) AS distinct_ids, least(5000, count(*)) AS known FROM li", "li")
def _(s, d):
    p = ad.points(s, d)
    got = sa.random_sample(p, 5000, 7).select("point_id")
    return got.join(p.select("point_id", F.lit(1).alias("k")), "point_id", "left").agg(F.count("*").alias("n"), F.count_distinct("point_id").alias("distinct_ids"), F.count("k").alias("known"))


@query("smp3_region_sample", "SELECT count(*) AS total, least(800, count(*)) AS n FROM li WHERE x BETWEEN 2 AND 6 AND y BETWEEN 0 AND 1 AND z BETWEEN 2 AND 5", "li")
def _(s, d):
    got, total = sa.region_sample(ad.points(s, d), (2, 0, 2), (6, 1, 5), 800)
    return got.agg(F.lit(total).cast("bigint").alias("total"), F.count("*").alias("n"))


_ORG = "o AS (SELECT min(x) ox, min(y) oy, min(z) oz FROM li)"


@query("smp4_voxel_downsample", f"""WITH {_ORG} SELECT CAST(floor((x-ox)/0.5) AS BIGINT) AS vx, CAST(floor((y-oy)/0.5) AS BIGINT) AS vy, CAST(floor((z-oz)/0.5) AS BIGINT) AS vz,
count(*) AS n_points, round(sum(x),6) AS x, round(sum(z),6) AS z, sum(r)::DOUBLE AS r FROM li, o GROUP BY 1,2,3""", "li")
def _(s, d):
    v = sa.voxel_downsample(ad.points(s, d, "r", "g", "b"), 0.5)
    total = lambda c, d: R(F.col(c) * F.col("n_points"), d).alias(c)
    return v.select("vx", "vy", "vz", "n_points", total("x", 6), total("z", 6), total("r", 0))


@query("smp5_voxel_to_target", "SELECT true AS close_enough, 3000::BIGINT AS exact")
def _(s, d):
    p = ad.points(s, d, "r", "g", "b")
    n = sa.voxel_downsample_to_target(p, 3000).count()
    exact = sa.voxel_downsample_to_target(p, 3000, exact=True)
    return exact.agg(F.lit(abs(n - 3000) <= 90).alias("close_enough"), F.count("*").alias("exact"))


@query("smp6_voxel_segments", f"""WITH {_ORG}, k AS (SELECT point_id, floor((x-ox+0.25)/0.25) a, floor((y-oy+0.25)/0.25) b2, floor((z-oz+0.25)/0.25) c FROM li, o),
f AS (SELECT a, b2, c, row_number() OVER (ORDER BY min(point_id))-1 AS id FROM k GROUP BY 1,2,3) SELECT point_id, id AS segment_id FROM k JOIN f USING (a,b2,c)""", "li")
def _(s, d):
    return sa.voxel_segments(ad.points(s, d), 0.25).select("point_id", "segment_id")


@query("smp6_supervoxel_summary", f"""WITH {_ORG} SELECT n_points, count(*) AS voxels, 'supervoxel' AS label FROM (SELECT count(*) AS n_points FROM li, o GROUP BY floor((x-ox+0.25)/0.25), floor((y-oy+0.25)/0.25), floor((z-oz+0.25)/0.25)) GROUP BY 1""", "li")
def _(s, d):
    seg = sa.segment_sizes(sa.voxel_segments(ad.points(s, d), 0.25))
    return seg.groupBy("n_points", "label").agg(F.count("*").alias("voxels"))


@query("smp7_chunk_reservoir", "WITH c AS (SELECT point_id//50000000000 AS c, count(*) n FROM li GROUP BY 1) SELECT least(3, count(*))::BIGINT AS chunks, true AS whole FROM c", "li")
def _(s, d):
    p, size = ad.points(s, d), 50_000_000_000
    got = sa.chunk_reservoir(p, 3, size)
    by = lambda df, n: df.groupBy(F.floor(F.col("point_id") / size).alias("c")).agg(F.count("*").alias(n))
    return by(got, "a").join(by(p, "b"), "c").agg(F.count("*").alias("chunks"), F.min(F.col("a") == F.col("b")).alias("whole"))


@query("smp8_subsample_propagate", "SELECT count(*) AS n, true AS all_assigned FROM emb", "emb")
def _(s, d):
    got = sa.subsample_and_propagate(ad.emb(s, d), 100, lambda p: sa.voxel_segments(p, 1.0))
    return got.agg(F.count("*").alias("n"), (F.min("segment_id") >= 0).alias("all_assigned"))


@query("smp9_subset_bbox", "SELECT round((min(x)+max(x))/2,6) AS cx, round((min(y)+max(y))/2,6) AS cy, round((min(z)+max(z))/2,6) AS cz, round(greatest(max(x)-min(x),0.01),6) AS sx, round(greatest(max(y)-min(y),0.01),6) AS sy, round(greatest(max(z)-min(z),0.01),6) AS sz FROM li WHERE ia=7", "li")
def _(s, d):
    p = ad.li(s, d).filter("ia = 7")
    return sa.subset_bbox(p).select(*[R(c).alias(c) for c in ("cx", "cy", "cz", "sx", "sy", "sz")])
