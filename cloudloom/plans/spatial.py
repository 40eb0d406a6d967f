"""Registered queries: neighbours, clusters, boxes, segmentation, cameras, storage and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import cluster as cl
from ..operators import export as ex
from ..operators import fusion as fu
from ..operators import graph as gr
from ..operators import hulls as hu
from ..operators import labels as lb
from ..operators import segmentation as se
from ..operators import spatial as sp
from ..session import cut, shared_folder
from ..sources import fixedwidth, sinks
from . import adapters as ad
from .basics import R
from .registry import query


def _scratch(s) -> str:
    return f"{shared_folder(s)}/out-{uuid.uuid4().hex}"


_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


def _lab(s, d):
    """Embedding points as labels: one instance per class."""
    return ad.emb(s, d).selectExpr("scan_id", "point_id", "class_id", "class_id AS instance_id", "0 AS category", "class_id%4 AS cand_id")


@query("jn2_nearest_neighbor", "SELECT a.point_id, arg_min(b.point_id, (a.x+0.3-b.x)*(a.x+0.3-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS nn_id, round(sqrt(min((a.x+0.3-b.x)*(a.x+0.3-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))),6) AS distance FROM emb a, emb b GROUP BY 1", "emb")
def _(s, d):
    e = ad.emb(s, d)
    return sp.nearest_neighbor(e.withColumn("x", F.col("x") + 0.3), e).select("point_id", "nn_id", R("distance").alias("distance"))


@query("jn3_knn", f"SELECT point_id, CAST(rank AS INT) AS rank, nn_id, round(sqrt(d),6) AS distance FROM (SELECT a.point_id, b.point_id AS nn_id, {_D2} AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY {_D2}, b.point_id) AS rank FROM emb a JOIN emb b ON a.point_id<>b.point_id) WHERE rank<=5", "emb")
def _(s, d):
    e = ad.emb(s, d)
    return sp.knn(e, e, 5).select("point_id", "rank", "nn_id", R("distance").alias("distance"))


@query("jn3_knn_dense_cloud", f"""WITH p AS (SELECT point_id, x, y, z, floor(x/0.25) AS gx, floor(y/0.25) AS gy, floor(z/0.25) AS gz FROM li),
o AS (SELECT i, j, k FROM (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), (SELECT unnest([-1,0,1]) AS k)),
s AS (SELECT p.*, gx+i AS hx, gy+j AS hy, gz+k AS hz FROM p, o),
c AS (SELECT a.point_id, b.point_id AS nn_id, {_D2} AS d FROM s a JOIN p b ON b.gx=a.hx AND b.gy=a.hy AND b.gz=a.hz WHERE a.point_id<>b.point_id),
n AS (SELECT point_id, min(d) AS d FROM c GROUP BY point_id), far AS (SELECT p.* FROM p LEFT JOIN n USING (point_id) WHERE d IS NULL OR d > 0.0625),
f AS (SELECT a.point_id, b.point_id AS nn_id, {_D2} AS d FROM far a JOIN p b ON a.point_id<>b.point_id),
u AS (SELECT c.* FROM c WHERE point_id NOT IN (SELECT point_id FROM far) UNION ALL SELECT * FROM f)
SELECT point_id, arg_min(nn_id, (d, nn_id)) AS nn_id, round(sqrt(min(d)),6) AS distance FROM u GROUP BY point_id""", "li")
def _(s, d):
    """Every line-item point's nearest other point; ties and coincident layers included."""
    p = ad.points(s, d)
    return sp.knn(p, p, 1).select("point_id", "nn_id", R("distance").alias("distance"))


@query("jn4_radius_join", f"SELECT a.point_id AS a_id, b.point_id AS b_id, round(sqrt({_D2}),6) AS distance FROM emb a JOIN emb b ON a.point_id<b.point_id WHERE {_D2} <= 0.64", "emb")
def _(s, d):
    return sp.radius_join(ad.emb(s, d), 0.8).select("a_id", "b_id", R("distance").alias("distance"))


_NN = f"n AS (SELECT a.point_id, sqrt(min({_D2})) AS dd FROM emb a JOIN emb b ON a.point_id<>b.point_id GROUP BY 1)"


@query("agg14_sample_spacing", f"WITH {_NN} SELECT round(quantile_cont(dd,0.5),5) AS p50, round(quantile_cont(dd,0.9),5) AS p90 FROM n", "emb")
def _(s, d):
    return ex.sample_spacing(ad.emb(s, d)).select(R("p50", 5).alias("p50"), R("p90", 5).alias("p90"))


@query("agg15_raw_region_spacing", f"WITH e AS (SELECT * FROM emb WHERE y BETWEEN -1 AND 1 AND x BETWEEN -1 AND 1 AND z BETWEEN -1.5 AND 1.5), n AS (SELECT a.point_id, sqrt(min({_D2})) AS dd FROM e a JOIN e b ON a.point_id<>b.point_id GROUP BY 1) SELECT count(*) AS n_points, round(quantile_cont(dd,0.5),5) AS p50, round(quantile_cont(dd,0.9),5) AS p90 FROM n", "emb")
def _(s, d):
    prism = {"polygon": [[-1, -1.5], [1, -1.5], [1, 1.5], [-1, 1.5]], "y0": -1.0, "height": 2.0}
    return ex.raw_region_spacing(ad.emb(s, d), prism).select(F.col("n_points").cast("bigint").alias("n_points"), R("p50", 5).alias("p50"), R("p90", 5).alias("p90"))


@query("agg16_agg17_accuracy_report", f"WITH {_NN} SELECT round(quantile_cont(dd,0.5),5) AS p50, round(quantile_cont(dd,0.9),5) AS p90, 'LOA10' AS loa, true AS is_raw FROM n", "emb")
def _(s, d):
    """Few large chunks hold the whole cloud, so the reservoir keeps all of it."""
    out = ex.accuracy_report(ad.emb(s, d), True, n_chunks=5, chunk=1_000_000)
    return out.select(R("p50", 5).alias("p50"), R("p90", 5).alias("p90"), "loa", "is_raw")


@query("agg21_fit_gravity_obb")
def _(s, d):
    p = ad.li(s, d).selectExpr("scan_id", "point_id", "x", "y", "z", "ia AS instance_id")
    return hu.fit_gravity_obb(p).select("instance_id", "n", *[R(c, 4).alias(c) for c in ("cx", "cy", "cz", "sx", "sy", "sz")])


@query("agg23_convex_hulls")
def _(s, d):
    p = ad.li(s, d).selectExpr("scan_id", "point_id", "x", "y", "z", "ia AS instance_id")
    return hu.convex_hulls(p).select("instance_id", "n", "is_box", R("volume", 4).alias("volume"), F.size("vertices").alias("n_vertices"))


@query("agg24_instance_meshes", "SELECT class_id AS instance_id, count(*) AS n_points, CASE WHEN count(*)<50 THEN 'too few points' END AS skipped FROM emb GROUP BY 1", "emb")
def _(s, d):
    p = ad.emb(s, d).withColumnRenamed("class_id", "instance_id")
    return hu.instance_meshes(p, p.select("scan_id", "instance_id").distinct(), 50).select("instance_id", "n_points", "skipped")


def _pred(s, d):
    return ad.boxes(s, d).withColumns({"scan_id": F.lit("p"), "cx": F.col("cx") + 0.1, "class_id": F.when(F.col("shape_id") % 5 == 0, 9).otherwise(F.col("class_id"))})


@query("agg30_box_match_metrics")
def _(s, d):
    gt = ad.boxes(s, d).withColumn("scan_id", F.lit("p"))
    out = cl.box_match_metrics(gt, _pred(s, d).filter("shape_id % 4 <> 0"))
    return out.select("class_id", "tp", "fp", "fn", *[R(c).alias(c) for c in ("precision", "recall", "f1", "mean_iou")])


@query("agg31_coverage_metrics", """WITH g AS (SELECT * FROM boxes), p AS (SELECT shape_id, cx+0.1 AS cx, cy, cz, CASE WHEN shape_id%5=0 THEN 9 ELSE class_id END AS class_id FROM boxes WHERE shape_id%4<>0),
i AS (SELECT g.shape_id, greatest(0,0.5-abs(g.cx-p.cx))*1.0*greatest(0,0.3-abs(g.cz-p.cz)) AS inter FROM g JOIN p ON g.class_id=p.class_id AND abs(g.cx-p.cx)<0.5 AND abs(g.cz-p.cz)<0.3), b AS (SELECT shape_id, max(inter/(0.3-inter)) AS iou FROM i GROUP BY 1)
SELECT round(avg(CASE WHEN coalesce(iou,0)>=0.6 THEN 1.0 ELSE 0.0 END),6) AS coverage, round(avg(coalesce(iou,0)),5) AS best_iou_mean, round((SELECT count(*) FROM p)/CAST(count(*) AS DOUBLE),6) AS pred_per_gt FROM g LEFT JOIN b USING (shape_id)""", "boxes")
def _(s, d):
    gt = ad.boxes(s, d).withColumn("scan_id", F.lit("p"))
    out = cl.coverage_metrics(gt, _pred(s, d).filter("shape_id % 4 <> 0"), 0.6)
    return out.select(R("coverage").alias("coverage"), R("best_iou_mean", 5).alias("best_iou_mean"), R("pred_per_gt").alias("pred_per_gt"))


@query("clu1_components", """WITH RECURSIVE c AS (SELECT ia, floor(x/1.5) gx, floor(y/1.5) gy, floor(z/1.5) gz, min(point_id) m FROM li WHERE ia>=0 GROUP BY 1,2,3,4),
e AS (SELECT a.ia, a.m AS u, b.m AS v FROM c a JOIN c b ON a.ia=b.ia AND abs(a.gx-b.gx)<=1 AND abs(a.gy-b.gy)<=1 AND abs(a.gz-b.gz)<=1), r AS (SELECT m AS u, m AS v FROM c UNION SELECT r.u, e.v FROM r JOIN e ON r.v=e.u),
k AS (SELECT u, min(v) AS root FROM r GROUP BY 1), n AS (SELECT c.ia, root, row_number() OVER (PARTITION BY c.ia ORDER BY root)-1 AS id FROM (SELECT DISTINCT c.ia, root FROM c JOIN k ON c.m=k.u) c)
SELECT point_id, CAST(coalesce(n.id,-1) AS INT) AS component_id FROM li LEFT JOIN c ON li.ia=c.ia AND floor(x/1.5)=gx AND floor(y/1.5)=gy AND floor(z/1.5)=gz LEFT JOIN k ON c.m=k.u LEFT JOIN n ON n.ia=li.ia AND n.root=k.root""", "li")
def _(s, d):
    return cl.components(ad.points(s, d), ad.labels(s, d), 1.5).select("point_id", F.col("component_id").cast("int").alias("component_id"))


@query("clu2_connected_components", "WITH RECURSIVE w AS (SELECT p_partkey AS k, p_partkey AS c, p_partkey-p_size*7 AS nx FROM part UNION ALL SELECT w.k, p.p_partkey, p.p_partkey-p.p_size*7 FROM w JOIN part p ON p.p_partkey=w.nx) SELECT k AS node, min(c) AS component FROM w GROUP BY 1")
def _(s, d):
    p = ad.table(s, d, "part")
    edges = p.selectExpr("p_partkey AS a", "p_partkey - p_size*7 AS b").filter("b >= 0")
    return gr.connected_components(edges, p.selectExpr("p_partkey AS node"))


@query("clu3_dbscan", f"""WITH RECURSIVE p AS (SELECT a.point_id AS u, b.point_id AS v FROM emb a, emb b WHERE {_D2} <= 1.0), k AS (SELECT u FROM p GROUP BY 1 HAVING count(*)>=6), e AS (SELECT u, v FROM p WHERE u IN (SELECT u FROM k) AND v IN (SELECT u FROM k)),
r AS (SELECT u, u AS v FROM k UNION SELECT r.u, e.v FROM r JOIN e ON r.v=e.u), c AS (SELECT u, min(v) AS id FROM r GROUP BY 1), b AS (SELECT p.u, min(c.id) AS id FROM p JOIN c ON p.v=c.u GROUP BY 1)
SELECT point_id, coalesce(c.id, b.id, -1) AS cluster_id FROM emb LEFT JOIN c ON point_id=c.u LEFT JOIN b ON point_id=b.u""", "emb")
def _(s, d):
    return cl.dbscan(ad.emb(s, d), 1.0, 6).select("point_id", "cluster_id")


_SOR = f"k AS (SELECT point_id, avg(dd) AS m FROM (SELECT a.point_id, sqrt({_D2}) AS dd, row_number() OVER (PARTITION BY a.point_id ORDER BY {_D2}) AS rn FROM emb a JOIN emb b ON a.point_id<>b.point_id) WHERE rn<=16 GROUP BY 1), t AS (SELECT avg(m)+2*stddev_pop(m) AS th FROM k)"


@query("clu4_sor_outliers", f"WITH {_SOR} SELECT point_id FROM k, t WHERE m>th", "emb")
def _(s, d):
    return cl.sor_outliers(ad.emb(s, d)).select("point_id")


@query("clu5_denoise", f"WITH {_SOR} SELECT point_id, CAST(CASE WHEN m>th THEN (SELECT max(class_id)+1 FROM emb) WHEN class_id=4 THEN -1 ELSE class_id END AS INT) AS instance_id, CAST(CASE WHEN m>th THEN 1 ELSE 0 END AS INT) AS category FROM emb JOIN k USING (point_id), t", "emb")
def _(s, d):
    return lb.denoise(ad.emb(s, d), _lab(s, d), replace_instance=4).labels.select("point_id", "instance_id", "category")


@query("clu6_denoise_selection", f"""WITH e AS (SELECT * FROM emb WHERE class_id=3), k AS (SELECT point_id, avg(dd) AS m FROM (SELECT a.point_id, sqrt({_D2}) AS dd, row_number() OVER (PARTITION BY a.point_id ORDER BY {_D2}) AS rn FROM e a JOIN e b ON a.point_id<>b.point_id) WHERE rn<=16 GROUP BY 1),
t AS (SELECT avg(m)+1.5*stddev_pop(m) AS th FROM k) SELECT count(*) FILTER (m<=th) AS kept, count(*) FILTER (m>th) AS removed FROM k, t""", "emb")
def _(s, d):
    return lb.denoise_selection(ad.emb(s, d), _lab(s, d), "instance", 3, 16, 1.5)[1]


@query("clu7_estimate_normals")
def _(s, d):
    return se.estimate_normals(ad.emb(s, d).select("scan_id", "point_id", "x", "y", "z"), 12).select("point_id", *[R(f"n{a}", 4).alias(f"n{a}") for a in "xyz"])


def _curved(s, d):
    e = cut(ad.emb(s, d).select("scan_id", "point_id", "x", "y", "z"))
    near = cut(sp.knn(e, e, 40))
    normals = cut(se.estimate_normals(e, 30, near))
    return e, normals, cut(se.principal_curvatures(e, normals, near=near))


@query("clu8_clu9_surface_classes")
def _(s, d):
    return se.classify_surface(_curved(s, d)[2]).select("point_id", "surface", R("k1", 4).alias("k1"), R("k2", 4).alias("k2"))


@query("clu10_set4_ransac_planes", "SELECT true AS unit, true AS near, true AS enough, true AS once, count(*) AS n_points FROM emb", "emb")
def _(s, d):
    """All planes of the cloud at the default limit of rounds, held against what every plane must fulfil."""
    e = ad.emb(s, d)
    taken, models = se.ransac_planes(e, distance=0.3, min_inliers=30, eps=1.5)
    taken = cut(taken)
    rows = taken.join(models, ["scan_id", "plane_id"]).join(e.select("scan_id", "point_id", "x", "y", "z"), ["scan_id", "point_id"])
    each = rows.groupBy("scan_id", "plane_id").agg(
        F.count("*").alias("n"), F.max(F.abs(F.expr("a*a + b*b + c*c") - 1)).alias("u"), F.max(F.abs(F.expr("a*x + b*y + c*z + d"))).alias("off"))
    held = each.agg(F.coalesce(F.max("u"), F.lit(0.0)).alias("u"), F.coalesce(F.max("off"), F.lit(0.0)).alias("off"), F.coalesce(F.min("n"), F.lit(30)).alias("least"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    ids = taken.select(F.count("*").alias("rows"), F.count_distinct("point_id").alias("ids"))
    rest = e.join(taken, ["scan_id", "point_id"], "left_anti").select(F.count("*").alias("rest"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(held).join(one(ids), "k").join(one(rest), "k").select((F.col("u") < 1e-9).alias("unit"), (F.col("off") <= 0.3).alias("near"), (F.col("least") >= 30).alias("enough"), (F.col("rows") == F.col("ids")).alias("once"), (F.col("n") + F.col("rest")).alias("n_points"))


@query("clu11_clu12_clu14_cylinders")
def _(s, d):
    e, _n, curved = _curved(s, d)
    rows = e.join(curved, ["scan_id", "point_id"])
    grown = cut(se.grow_cylinders(rows, 1.2, 0.9, 1.8))
    fits = cut(se.fit_cylinders(grown.join(rows, ["scan_id", "point_id"]), distance=0.3))
    return se.merge_coaxial(fits).join(fits, ["scan_id", "cluster_id"]).select("cluster_id", "merged_id", "n", R("radius", 4).alias("radius"), "label")


@query("clu12_fitted_pieces", """SELECT concat('s', scan_no) AS scan_id, piece AS cluster_id, count(*) AS n, count(*) AS n_inliers, CAST(0.2 AS DOUBLE) AS radius, round(max(x) - min(x), 4) AS length
 FROM bodies WHERE body = 'pipe' GROUP BY scan_no, piece HAVING count(*) >= 20""", "bodies")
def _(s, d):
    """Circles through three points drawn from all points of a piece; all of its points are on the winner."""
    return se.fit_cylinders(_pieces(s, d)).select("scan_id", "cluster_id", "n", "n_inliers", R("radius", 4).alias("radius"), R("length", 4).alias("length"))


@query("clu14_refitted_pipes", """SELECT concat('s', scan_no) AS scan_id, min(piece) AS cluster_id, count(*) AS n, count(*) AS n_inliers, CAST(0.2 AS DOUBLE) AS radius, round(max(x) - min(x), 4) AS length
 FROM bodies WHERE body = 'pipe' GROUP BY scan_no HAVING count(*) >= 20""", "bodies")
def _(s, d):
    """Two pieces of a pipe become one, with the length of the whole."""
    points = _pieces(s, d)
    fits = cut(se.fit_cylinders(points))
    return se.refit_merged(points, fits, cut(se.merge_coaxial(fits))).select("scan_id", "cluster_id", "n", "n_inliers", R("radius", 4).alias("radius"), R("length", 4).alias("length"))


def _pieces(s, d):
    return ad.bodies(s, d).filter("body = 'pipe'").selectExpr("scan_id", "point_id", "x", "y", "z", "piece AS cluster_id", "1D AS ax", "0D AS ay", "0D AS az")


@query("clu16_presegment", """SELECT concat('s', scan_no) AS scan_id, body, count(*) AS n_points, 0 AS unassigned, true AS one_segment, CASE body WHEN 'floor' THEN 'plane' ELSE 'cylinder' END AS type,
 body = 'pipe' AS has_radius FROM bodies GROUP BY scan_no, body""", "bodies")
def _(s, d):
    """Full segmentation of all scans together: every body comes back as one segment of its kind."""
    points = cut(ad.bodies(s, d))
    seg, summary = se.presegment(points.select("scan_id", "point_id", "x", "y", "z"))
    both = points.join(seg, ["scan_id", "point_id"]).groupBy("scan_id", "body", "segment_id").agg(F.count("*").alias("c"))
    main = both.groupBy("scan_id", "body").agg(F.sum("c").alias("n_points"), F.max("c").alias("top"), F.max_by("segment_id", F.struct("c", "segment_id")).alias("segment_id"), F.sum(F.when(F.col("segment_id") < 0, F.col("c")).otherwise(0)).cast("int").alias("unassigned"))
    return main.join(summary.select("scan_id", "segment_id", "type", "radius"), ["scan_id", "segment_id"]).select(
        "scan_id", "body", "n_points", "unassigned", (F.col("top") >= 0.9 * F.col("n_points")).alias("one_segment"), "type",
        F.coalesce(F.abs(F.col("radius") - 0.2) < 0.02, F.lit(False)).alias("has_radius"))


def _grid_segments(s, d):
    """One grid bin in three left unassigned."""
    bins = cl.grid_bin(ad.emb(s, d), 1.0)
    return cut(bins.selectExpr("scan_id", "point_id", "CASE WHEN cluster_id%3=0 THEN -1 ELSE cluster_id END AS segment_id"))


@query("clu13_assign_stragglers")
def _(s, d):
    e, normals, _c = _curved(s, d)
    seg = _grid_segments(s, d)
    types = seg.filter("segment_id>=0").select("scan_id", "segment_id", F.lit("unknown").alias("type")).distinct()
    return se.assign_stragglers(e.join(normals, ["scan_id", "point_id"]), seg, types, 1.0).select("point_id", "segment_id")


@query("clu15_leftover_clusters", "SELECT count(*) AS n, true AS all_assigned FROM emb", "emb")
def _(s, d):
    out = se.leftover_clusters(ad.emb(s, d), _grid_segments(s, d), 0.9, 12)
    return out.agg(F.count("*").alias("n"), (F.min("segment_id") >= 0).alias("all_assigned"))


@query("clu17_feature_split", "SELECT count(*) AS n, true AS first_ids_kept FROM emb", "emb")
def _(s, d):
    lab = _lab(s, d).withColumn("instance_id", F.col("class_id") % 2)
    out = se.feature_split(lab, ad.emb(s, d).select("scan_id", "point_id", "feature"), min_size=60, target=80, max_k=4, iters=4)
    kept = F.count_distinct(F.when(F.col("instance_id") < 2, F.col("instance_id"))) == 2
    return out.agg(F.count("*").alias("n"), kept.alias("first_ids_kept"))


@query("clu18_merge_by_feature")
def _(s, d):
    bins = cl.grid_bin(ad.emb(s, d), 1.5).withColumnRenamed("cluster_id", "segment_id")
    feats = ad.emb(s, d).select("scan_id", "point_id", "feature", F.lit(1).alias("seen"))
    return se.merge_by_feature(ad.emb(s, d), cut(bins), feats, 1.5, max_d=3.0, cos=0.3).select("segment_id", "merged_id")


@query("clu19_grid_bin", "WITH c AS (SELECT floor(x/0.5) a, floor(y/0.5) b, floor(z/0.5) c, row_number() OVER (ORDER BY min(point_id))-1 AS id FROM li GROUP BY 1,2,3) SELECT point_id, id AS cluster_id FROM li JOIN c ON floor(x/0.5)=a AND floor(y/0.5)=c.b AND floor(z/0.5)=c", "li")
def _(s, d):
    return cl.grid_bin(ad.points(s, d), 0.5).select("point_id", "cluster_id")


@query("clu20_pca_reduce")
def _(s, d):
    feats = ad.emb(s, d).select("scan_id", "point_id", "feature", F.lit(1).alias("seen"))
    return se.pca_reduce(feats, 8).select("point_id", F.size("feature").alias("dim"))


@query("clu21_icp_align")
def _(s, d):
    e = ad.emb(s, d)
    pose, fitness, rmse = se.icp_align(e.withColumn("x", F.col("x") + 3.0), e, iters=3)
    return s.createDataFrame([(round(pose[0][3], 4), fitness, rmse < 0.05)], "tx double, fitness double, tight boolean")


@query("lab9_replay_labels")
def _(s, d):
    """Labels replayed on the whole cloud from a half-density scan and the part boxes."""
    pts = ad.points(s, d)
    scan = pts.filter("y > 0.3")
    base = ad.labels(s, d).join(scan.select("scan_id", "point_id"), ["scan_id", "point_id"], "left_semi")
    vol = ad.boxes(s, d).selectExpr("shape_id", "CAST(shape_id + 100000 AS INT) AS instance_id", "CAST(shape_id AS INT) AS seq", "CAST(shape_id AS INT) AS ord", "cx", "cy", "cz", "sx", "sy", "sz", "rx", "ry", "rz")
    cmap = vol.selectExpr("instance_id", "instance_id%6 AS class_id").unionByName(ex.instance_class_map(ad.instances(s, d), base))
    seq = vol.select("instance_id", "seq").unionByName(ad.instances(s, d).selectExpr("segId AS instance_id", "seq"))
    out = ex.replay_labels(pts, scan, base, vol, None, None, seq, cmap)
    return out.groupBy("instance_id", "class_id").agg(F.count("*").alias("n_points"))


_VOL = """b AS (SELECT point_id, class_id AS own, x, y, z FROM emb), v AS (SELECT unnest([100,101,102]) AS vid), h AS (SELECT point_id, vid FROM b, v WHERE abs(x-(vid-101))<=0.6 AND abs(y)<=1.0 AND abs(z)<=1.0)"""


_REPLAY = f"""WITH {_VOL}, s AS (SELECT * FROM emb WHERE point_id%2=0), n AS (SELECT a.point_id, arg_min(b.class_id, {_D2}) AS base FROM emb a, s b GROUP BY 1),
c AS (SELECT point_id, vid AS inst, CAST(CASE vid WHEN 101 THEN 50 ELSE 5 END AS DOUBLE) AS seq, vid AS place FROM h UNION ALL SELECT point_id, base, CASE WHEN base%3=0 THEN NULL ELSE base*8.0 END, 999 FROM n)
SELECT point_id, CAST(inst AS INT) AS instance_id, CAST(inst%6 AS INT) AS class_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY coalesce(seq,-1e9) DESC, place) AS rn FROM c) WHERE rn=1"""


def _replay(s, d):
    e = ad.emb(s, d)
    scan = e.filter("point_id%2=0")
    vol = s.createDataFrame([(i, 100 + i, 50 if i == 1 else 5, i, float(i - 1), 0.0, 0.0, 1.2, 2.0, 2.0, 0.0, 0.0, 0.0) for i in range(3)],
                            "shape_id int, instance_id int, seq int, ord int, cx double, cy double, cz double, sx double, sy double, sz double, rx double, ry double, rz double")
    ids = e.select(F.col("class_id").alias("instance_id")).union(vol.select("instance_id")).distinct()
    seq = e.selectExpr("class_id AS instance_id", "CASE WHEN class_id%3=0 THEN NULL ELSE class_id*8 END AS seq").distinct().unionByName(vol.select("instance_id", "seq"))
    return scan, _lab(s, d).filter("point_id%2=0"), (vol, None, None, seq, ids.selectExpr("instance_id", "instance_id%6 AS class_id"))


@query("lab9_replay_small_volumes", _REPLAY, "emb")
def _(s, d):
    scan, labels, rest = _replay(s, d)
    return ex.replay_labels(ad.emb(s, d), scan, labels, *rest).select("point_id", "instance_id", "class_id")


@query("lab10_collect_volumes", "SELECT p_partkey AS id, CASE WHEN p_partkey%3=0 THEN 'box' ELSE 'prism' END AS kind FROM part WHERE p_partkey%3<2")
def _(s, d):
    p = ad.table(s, d, "part")
    inst = p.selectExpr(
        "CAST(p_partkey AS INT) AS segId", "CAST(p_partkey AS INT) AS seq", "CAST(p_partkey AS INT) AS ord", "element_at(array('box','prism','preseg'), CAST(p_partkey%3+1 AS INT)) AS source",
        "array(0D,0D,0D) AS center", "array(1D,1D,1D) AS size", "CAST(NULL AS array<double>) AS rotation",
        "named_struct('polygon', array(array(0D,0D),array(1D,0D),array(0D,1D)), 'y0', 0D, 'height', 1D) AS prism",
    )
    none = s.createDataFrame([], "path_id int, instance_id int, points array<array<double>>, radius double, smooth boolean")
    boxes, prisms, _tubes = ex.collect_volumes(inst, none)
    return boxes.selectExpr("CAST(shape_id AS BIGINT) AS id", "'box' AS kind").unionByName(prisms.selectExpr("CAST(shape_id AS BIGINT) AS id", "'prism' AS kind"))


# ---- cameras -----------------------------------------------------------

_FR = """f00 AS (SELECT s_suppkey, CAST(s_suppkey AS INT) AS frame_id, s_suppkey%10+CAST(0.537 AS DOUBLE) qx, CAST(0.5 AS DOUBLE) qy, (s_suppkey//10)%10+CAST(0.537 AS DOUBLE) qz FROM supplier),
f0 AS (SELECT frame_id, qx, qy, qz, qx+1.5*cos(s_suppkey*CAST(0.785398 AS DOUBLE)) px, CAST(3 AS DOUBLE) py, qz+1.5*sin(s_suppkey*CAST(0.785398 AS DOUBLE)) pz FROM f00),
f1 AS (SELECT *, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)+(qz-pz)*(qz-pz))+1e-12 AS l FROM f0), f2 AS (SELECT *, (qx-px)/l ux, (qy-py)/l uy, (qz-pz)/l uz FROM f1), f3 AS (SELECT *, sqrt(uz*uz+ux*ux)+1e-12 AS sl FROM f2),
f4 AS (SELECT *, -uz/sl AS sx, ux/sl AS sz FROM f3), f5 AS (SELECT *, -sz*uy AS tx, sz*ux-sx*uz AS ty, sx*uy AS tz FROM f4),
q AS (SELECT frame_id, point_id, r, g, b, (x-px)*sx+(z-pz)*sz AS ca_, (x-px)*tx+(y-py)*ty+(z-pz)*tz AS cb_, (x-px)*ux+(y-py)*uy+(z-pz)*uz AS depth FROM li, f5),
w AS (SELECT *, ca_*60/tan(radians(CAST(12 AS DOUBLE))/2)/greatest(depth,1e-6)+80 AS pu, -cb_*60/tan(radians(CAST(12 AS DOUBLE))/2)/greatest(depth,1e-6)+60 AS pv FROM q),
o AS (SELECT *, CAST(floor(pu) AS INT) AS u, CAST(floor(pv) AS INT) AS v FROM w WHERE depth>0.05 AND depth<80 AND pu>=0 AND pu<160 AND pv>=0 AND pv<120)"""
_Z = """zp AS (SELECT frame_id, u, v, min(depth) AS zm FROM o GROUP BY 1,2,3), zs AS (SELECT frame_id, greatest(0,least(159,u+du)) AS u, greatest(0,least(119,v+dv)) AS v, min(zm) AS zm FROM zp, (SELECT unnest([-2,-1,0,1,2]) AS du), (SELECT unnest([-2,-1,0,1,2]) AS dv) GROUP BY 1,2,3),
vis AS (SELECT o.* FROM o JOIN zs ON o.frame_id=zs.frame_id AND o.u=zs.u AND o.v=zs.v WHERE depth <= zm+greatest(0.15,0.01*zm))"""
_MASK = """mk AS (SELECT frame_id, m, 1+(frame_id+m)%3 AS class_id, CAST(0.5 AS DOUBLE)+CAST(0.0625 AS DOUBLE)*(frame_id%8)+CAST(0.03125 AS DOUBLE)*m AS score FROM f0, (SELECT unnest([0,1]) AS m)),
hit AS (SELECT vis.*, m, class_id, score FROM vis JOIN mk ON vis.frame_id=mk.frame_id WHERE (vis.u//20+vis.v//15+m*(1+vis.frame_id))%2=0)"""


@query("cam1_project", f"WITH {_FR} SELECT frame_id, point_id, round(pu,4) AS pu, round(pv,4) AS pv, round(depth,4) AS depth FROM o", "li")
def _(s, d):
    out = fu.on_screen(fu.project(ad.points(s, d), ad.frames(s, d)), None)
    return out.select("frame_id", "point_id", *[R(c, 4).alias(c) for c in ("pu", "pv", "depth")])


@query("cam2_visible", f"WITH {_FR}, {_Z} SELECT frame_id, point_id, u, v FROM vis", "li")
def _(s, d):
    return fu.visible(ad.points(s, d), ad.frames(s, d), keep=["point_id"]).select("frame_id", "point_id", "u", "v")


@query("cam3_raster_render", f"WITH {_FR}, {_Z} SELECT frame_id, u, v, round(zm,4) AS depth FROM zs", "li")
def _(s, d):
    return fu.raster_render(ad.points(s, d, "r", "g", "b"), ad.frames(s, d)).select("frame_id", "u", "v", R("depth", 4).alias("depth"))


@query("cam4_points_in_mask", f"""WITH {_FR}, {_Z}, {_MASK} SELECT frame_id, point_id, CAST(frame_id*2+m AS INT) AS mask_id FROM hit""", "li")
def _(s, d):
    """The cloud's own depth image is the reference buffer, so the window test equals visibility."""
    pts, fr = ad.points(s, d, "r", "g", "b"), ad.frames(s, d)
    depth = cut(fu.on_screen(fu.project(pts, fr, None), None).groupBy("frame_id", "u", "v").agg(F.min("depth").alias("depth")))
    return fu.points_in_mask(pts, fr, ad.masks(s, d), depth).select("frame_id", "point_id", "mask_id")


@query("cam5_cam6_registration", f"WITH {_FR}, {_Z} SELECT round(count(DISTINCT point_id)/CAST((SELECT count(*) FROM li) AS DOUBLE),6) AS coverage, count(DISTINCT point_id) AS n_seen, true AS ok FROM vis", "li")
def _(s, d):
    score = fu.check_registration(fu.registration_score(ad.points(s, d), ad.frames(s, d)), min_coverage=0.01)
    return score.select(R("coverage").alias("coverage"), "n_seen", "ok")


@query("cam7_verify_registration")
def _(s, d):
    fr = ad.frames(s, d)
    clouds = s.createDataFrame([("li", "c", "v", "fp")], "scan_id string, canonical_id string, variant_id string, fingerprint string")
    runs = fr.select("run_id").distinct().selectExpr("'li' AS scan_id", "run_id", "'c' AS run_canonical_id", "'v' AS source_variant", "'fp' AS source_fingerprint")
    pixels = fu.raster_render(ad.points(s, d, "r", "g", "b"), fr)
    verdict, _o = fu.verify_registration(ad.points(s, d, "r", "g", "b"), clouds, runs, fr, pixels)
    return verdict.select("run_id", "action", R("coverage", 4).alias("coverage"), R("photometric", 4).alias("photometric"), "ok")


@query("cam8_fuse_features", f"WITH {_FR}, {_Z} SELECT count(*) AS n, sum(k)::BIGINT AS seen, true AS unit FROM (SELECT point_id, count(*) AS k FROM vis GROUP BY 1)", "li")
def _(s, d):
    cells = ad.frames(s, d).select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("row"))
    cells = cells.select("frame_id", "row", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("column"))
    cells = cells.selectExpr("frame_id", "row", "column", "6 AS map_h", "8 AS map_w", "array(1D+row, 1D+column, 1D+frame_id) AS feature")
    out = fu.fuse_features(ad.points(s, d), ad.frames(s, d), cells)
    norm = F.aggregate("feature", F.lit(0.0), lambda a, v: a + v * v)
    return out.agg(F.count("*").alias("n"), F.sum("seen").alias("seen"), (F.max(F.abs(norm - 1)) < 1e-9).alias("unit"))


@query("cam9_class_votes", f"""WITH {_FR}, {_Z}, {_MASK}, best AS (SELECT frame_id, point_id, class_id, max(score) AS s FROM hit GROUP BY 1,2,3), t AS (SELECT point_id, class_id, sum(s) AS s FROM best GROUP BY 1,2),
top AS (SELECT point_id, class_id, row_number() OVER (PARTITION BY point_id ORDER BY round(s,9) DESC, class_id) AS rn FROM t) SELECT li.point_id, CAST(CASE WHEN k.point_id IS NULL THEN -1 ELSE coalesce(top.class_id,0) END AS INT) AS class_id FROM li LEFT JOIN (SELECT DISTINCT point_id FROM vis) k ON li.point_id=k.point_id LEFT JOIN top ON li.point_id=top.point_id AND rn=1""", "li")
def _(s, d):
    return fu.class_votes(ad.points(s, d), ad.frames(s, d), ad.masks(s, d)).select("point_id", "class_id")


@query("cam10_query_hits_union", f"WITH {_FR}, {_Z}, {_MASK} SELECT point_id, CAST(class_id AS INT) AS query, count(DISTINCT frame_id) AS hits FROM hit WHERE score>0.6 GROUP BY 1,2", "li")
def _(s, d):
    return fu.query_hits(ad.points(s, d), ad.frames(s, d), ad.masks(s, d), "union", 0.6)[0].select("point_id", "query", "hits")


@query("cam10_query_hits_argmax", f"WITH {_FR}, {_Z}, {_MASK}, t AS (SELECT point_id, frame_id, class_id, row_number() OVER (PARTITION BY point_id, frame_id ORDER BY score DESC, class_id) AS rn FROM hit WHERE score>0.3) SELECT point_id, CAST(class_id AS INT) AS query, count(*) AS hits FROM t WHERE rn=1 GROUP BY 1,2", "li")
def _(s, d):
    return fu.query_hits(ad.points(s, d), ad.frames(s, d), ad.masks(s, d), "argmax", 0.3)[0].select("point_id", "query", "hits")


@query("cam11_masks_to_segments", f"""WITH {_FR}, {_Z}, {_MASK}, big AS (SELECT frame_id, m FROM hit GROUP BY 1,2 HAVING count(DISTINCT point_id)>=20), t AS (SELECT point_id, frame_id*2+m AS mask_id, row_number() OVER (PARTITION BY point_id ORDER BY frame_id DESC, score DESC) AS rn FROM hit JOIN big USING (frame_id, m))
SELECT CAST(mask_id AS INT) AS mask_id, count(*) AS n_points FROM t WHERE rn=1 GROUP BY 1""", "li")
def _(s, d):
    return fu.masks_to_segments(ad.points(s, d), ad.frames(s, d), ad.masks(s, d))[1].select("mask_id", "n_points")


@query("cam11_masks_to_segments_first", f"""WITH RECURSIVE {_FR}, {_Z}, {_MASK}, mks AS (SELECT frame_id, m, max(score) AS score, list(DISTINCT point_id) AS pts FROM hit GROUP BY 1,2),
od AS (SELECT *, row_number() OVER (ORDER BY frame_id, score DESC, m DESC) AS k FROM mks),
fo AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(0 AS BIGINT) AS got
 UNION ALL SELECT k, CASE WHEN len(free)>=20 THEN list_concat(taken, free) ELSE taken END, CASE WHEN len(free)>=20 THEN len(free) ELSE 0 END
 FROM (SELECT od.k, taken, list_filter(pts, lambda p: NOT list_contains(busy, p)) AS free FROM (SELECT od.k, taken, pts, list_intersect(pts, taken) AS busy FROM fo JOIN od ON od.k=fo.k+1) od) x)
SELECT CAST(frame_id*2+m AS INT) AS mask_id, got AS n_points FROM fo JOIN od USING (k) WHERE got>0""", "li")
def _(s, d):
    return fu.masks_to_segments(ad.points(s, d), ad.frames(s, d), ad.masks(s, d), conflict="first")[1].select("mask_id", "n_points")


@query("cam12_auto_instances", f"WITH {_FR}, {_Z}, {_MASK} SELECT count(DISTINCT point_id) AS n FROM hit", "li")
def _(s, d):
    return fu.auto_instances(ad.points(s, d), ad.frames(s, d), ad.masks(s, d)).filter("mask_id >= 0").agg(F.count("*").alias("n"))


@query("cam13_project_masks", f"WITH {_FR}, {_Z}, {_MASK} SELECT point_id, CAST(frame_id*2+m AS INT) AS mask_id FROM hit WHERE m=1 AND frame_id%2=0", "li")
def _(s, d):
    pts, fr = ad.points(s, d), ad.frames(s, d)
    depth = cut(fu.on_screen(fu.project(pts, fr, None), None).groupBy("frame_id", "u", "v").agg(F.min("depth").alias("depth")))
    accepted = fr.filter("frame_id%2 = 0").selectExpr("frame_id*2 + 1 AS mask_id")
    return fu.project_masks(pts, fr, ad.masks(s, d), depth, accepted, 2 * fr.count() + 2, "fp", "fp").select("point_id", "mask_id")


@query("cam14_camera_to_native", f"WITH {_FR} SELECT frame_id, round(px+1+100,4) AS nx, round(-(pz+3)+200,4) AS ny, round(py+2+300,4) AS nz FROM f0", "li")
def _(s, d):
    from ..functions.frames import camera_to_native

    p, _t = camera_to_native("position", "target", (1.0, 2.0, 3.0), (100.0, 200.0, 300.0), True)
    return ad.frames(s, d).select("frame_id", *[R(p[i], 4).alias(n) for i, n in enumerate(("nx", "ny", "nz"))])


# ---- storage and streams -----------------------------------------------

@query("snk1_src1_ply_round_trip", "SELECT row_number() OVER (ORDER BY point_id)-1 AS point_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, r, g, b FROM li", "li")
def _(s, d):
    fixedwidth.register(s)
    path = _scratch(s) + ".ply"
    n = sinks.write_ply(ad.points(s, d, "r", "g", "b"), path)
    if fixedwidth.ply_vertex_count(path) != n:
        raise ValueError("vertex count differs")
    return s.read.format("ply").option("rowsPerSplit", 7000).load(path).select("point_id", "x", "z", "r", "g", "b")


@query("snk2_labeled_ply", "SELECT row_number() OVER (ORDER BY point_id)-1 AS point_id, r, ca AS class_id, ia AS instance_id FROM li", "li")
def _(s, d):
    fixedwidth.register(s)
    path = _scratch(s) + ".ply"
    sinks.write_labeled_ply(ad.points(s, d, "r", "g", "b"), ad.labels(s, d), path)
    return s.read.format("ply").load(path).select("point_id", "r", "class_id", "instance_id")


@query("snk4_save_and_load", "SELECT point_id, cc AS class_id FROM li", "li")
def _(s, d):
    root = _scratch(s)
    for i, which in enumerate("abc"):
        sinks.save_labels(ad.labels(s, d, which).select("scan_id", "point_id", "class_id", "instance_id"), root, version=f"20240101_00000{i}", keep=1)
    return sinks.load_labels(s, root).select("point_id", "class_id")


@query("snk6_snk7_presegs", "SELECT 'grid' AS preseg_id, count(DISTINCT preseg_id) AS n_segments FROM li", "li")
def _(s, d):
    root = _scratch(s)
    sinks.register_preseg(ad.labels(s, d).selectExpr("scan_id", "point_id", "preseg_id AS instance_id"), root, "grid", "modulo", {"k": 200})
    return sinks.list_presegs(s, root).select("preseg_id", "n_segments")


@query("snk8_runs", "SELECT 'a' AS run_id, count(*) AS n_points, false AS is_default FROM li UNION ALL SELECT 'c', count(*), true FROM li", "li")
def _(s, d):
    root = _scratch(s)
    for which in "ac":
        sinks.write_run(ad.labels(s, d, which).withColumnRenamed("instance_id", "segment_id"), root, which)
    return sinks.runs_index(s, root, "c")


@query("snk9_scaffold_scan", "SELECT 2000::BIGINT AS n_points, 5005.0::DOUBLE AS ox, true AS centred")
def _(s, d):
    pts, meta = sinks.scaffold_scan(ad.points(s, d, "r", "g", "b").withColumn("x", F.col("x") + 5000), 2000)
    mid = pts.agg((F.abs(F.avg("x")) < 1).alias("centred"))
    return meta.select("n_points", "ox").join(mid, how="cross")


@query("src16_mesh_sample", "SELECT 5000::BIGINT AS n, true AS near_share FROM nation LIMIT 1")
def _(s, d):
    """Part rows as triangles of two sizes; samples follow the areas."""
    from ..sources.mesh import mesh_sample

    tri = ad.table(s, d, "part").selectExpr("'m' AS scan_id", "p_partkey AS face_id", "p_partkey*1D AS ax", "0D AS ay", "0D AS az", "p_partkey+IF(p_partkey%2=0,2D,1D) AS bx", "0D AS by", "0D AS bz", "p_partkey*1D AS cx", "1D AS cy", "0D AS cz")
    out = mesh_sample(tri, 5000)
    share = F.avg(F.when(F.col("face_id") % 2 == 0, 1.0).otherwise(0.0))
    return out.agg(F.count("*").alias("n"), (F.abs(share - 2 / 3) < 0.01).alias("near_share"))


@query("src17_faces_in_bbox", "SELECT p_partkey AS face_id FROM part WHERE p_partkey*0.01 BETWEEN (SELECT min(x) FROM li WHERE ia=7)-0.553 AND (SELECT max(x) FROM li WHERE ia=7)+0.453", "li")
def _(s, d):
    from ..sources.mesh import faces_in_selection_bbox

    tri = ad.table(s, d, "part").selectExpr("p_partkey AS face_id", *[f"p_partkey*0.01D + 0.05D AS {v}x" for v in "abc"], *[f"0.5D AS {v}{a}" for v in "abc" for a in "yz"])
    sel = ad.li(s, d).filter("ia = 7").select("x", F.lit(0.5).alias("y"), F.lit(0.5).alias("z"))
    return faces_in_selection_bbox(tri, sel, 0.503).select("face_id")


_HISTORY = """WITH RECURSIVE c AS (SELECT CAST(user_id%5 AS VARCHAR) AS session_id, event_id AS seq, event_type='purchase' AS fresh,
  CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'set' END AS op, row_number() OVER (PARTITION BY user_id%5 ORDER BY event_id) AS i FROM events),
h AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS u, CAST([] AS BIGINT[]) AS r, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS op, CAST(NULL AS BIGINT) AS target, CAST(-1 AS BIGINT) AS made FROM c
 UNION ALL SELECT c.session_id, c.i,
  CASE c.op WHEN 'undo' THEN u[1:len(u)-1] WHEN 'redo' THEN CASE WHEN len(r)>0 THEN list_append(u, r[len(r)]) ELSE u END ELSE list_append(u, c.seq)[greatest(1, len(u)-98):] END,
  CASE c.op WHEN 'undo' THEN CASE WHEN len(u)>0 THEN list_append(r, u[len(u)]) ELSE r END WHEN 'redo' THEN r[1:len(r)-1] ELSE CAST([] AS BIGINT[]) END,
  CASE WHEN c.op='set' THEN greatest(n, 100) + CASE WHEN fresh THEN 1 ELSE 0 END ELSE n END, c.seq, c.op,
  CASE c.op WHEN 'undo' THEN u[len(u)] WHEN 'redo' THEN r[len(r)] ELSE c.seq END, CASE WHEN c.op='set' AND fresh THEN greatest(n, 100) ELSE -1 END
  FROM h JOIN c ON c.session_id=h.session_id AND c.i=h.i+1)
SELECT 'li' AS scan_id, session_id, seq AS edit_seq, op, target AS target_seq, op<>'undo' AS active, made AS new_instance_id FROM h WHERE target IS NOT NULL"""


@query("str2_edit_stream", _HISTORY)
def _(s, d):
    """Events as edit commands; the history of every session resolved by the stream."""
    from ..streaming.jobs import edit_stream

    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = ad.stream(s, d, "events")
    cmds = src.selectExpr(
        "'li' AS scan_id", "CAST(user_id%5 AS STRING) AS session_id", "event_id AS edit_seq", "CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'set' END AS op",
        "event_type = 'purchase' AS allocate", "CAST(99 AS BIGINT) AS high_water",
    )
    out = _scratch(s)
    q = edit_stream(cmds, out, _scratch(s)).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("scan_id string, session_id string, edit_seq bigint, op string, target_seq bigint, active boolean, new_instance_id bigint").parquet(out).drop("epoch")


@query("str1_replay_stream", _REPLAY, "emb")
def _(s, d):
    """The dense cloud arrives as a stream; every chunk is labelled from the static scan."""
    from ..streaming.jobs import replay_stream

    scan, labels, rest = _replay(s, d)
    raw = ad.stream(s, d, "embeddings")
    raw = raw.selectExpr("'emb' AS scan_id", "vec_id AS point_id", *[f"CAST(embedding[{i}] AS DOUBLE)*10 AS {a}" for i, a in enumerate("xyz")])
    out = _scratch(s)
    names = ("boxes", "prisms", "tubes", "seq", "class_map")
    replay_stream(raw, scan, labels, dict(zip(names, rest)), out, _scratch(s)).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select("point_id", "instance_id", "class_id")


@query("str3_autosave", "SELECT point_id, ca AS class_id FROM li", "li")
def _(s, d):
    """A manual save of a later date, then a burst of changes: the autosave is what is read back."""
    from ..streaming.jobs import autosave

    root, labels = _scratch(s), ad.labels(s, d)
    sinks.save_labels(labels.withColumn("class_id", F.lit(-9)), root, version="20990101_000000")
    src = ad.stream(s, d, "events")
    autosave(src, lambda: labels, root, _scratch(s)).trigger(availableNow=True).start().awaitTermination()
    return sinks.load_labels(s, root).select("point_id", "class_id")
