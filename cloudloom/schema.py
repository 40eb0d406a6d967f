"""Table schemas, sentinels and fixed domain values."""

from pyspark.sql import types as T

UNSET = -1  # sentinel of class, instance, component, preseg and candidate ids

# Point categories.
CATEGORIES = {"none": 0, "artifact": 1, "transient": 2, "excluded_review": 3}
REVIEW = CATEGORIES["excluded_review"]
ARTIFACT = CATEGORIES["artifact"]

# Level-of-accuracy bands, upper spacing bound in metres.
LOA_BANDS = [(0.001, "LOA50"), (0.005, "LOA40"), (0.015, "LOA30"), (0.050, "LOA20")]
LOA_REST = "LOA10"

# Region gate thresholds.
GATE_MIN_POINTS = 100
GATE_MIN_P50 = 1e-6
GATE_MAX_P90 = 0.010
GATE_MAX_REVIEW = 0.03

HISTORY_CAP = 100
MIN_SEGMENT_POINTS = 10
BOX_FLOOR = 0.01
FIT_PAD = 0.005

POINTS = T.StructType(
    [
        T.StructField("scan_id", T.StringType(), False),
        T.StructField("point_id", T.LongType(), False),
        T.StructField("x", T.DoubleType(), False),
        T.StructField("y", T.DoubleType(), False),
        T.StructField("z", T.DoubleType(), False),
        T.StructField("r", T.ShortType()),
        T.StructField("g", T.ShortType()),
        T.StructField("b", T.ShortType()),
        T.StructField("intensity", T.FloatType()),
        T.StructField("face_id", T.IntegerType()),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("scan_id", T.StringType(), False),
        T.StructField("point_id", T.LongType(), False),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("instance_id", T.IntegerType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("preseg_id", T.IntegerType()),
        T.StructField("cand_id", T.IntegerType()),
    ]
)

VEC3 = T.ArrayType(T.DoubleType())

PRISM = T.StructType(
    [
        T.StructField("polygon", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("y0", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
    ]
)

INSTANCE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("cls", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("center", VEC3),
        T.StructField("size", VEC3),
        T.StructField("rotation", VEC3),
        T.StructField("prism", PRISM),
        T.StructField("conf", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("confirmed", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("segId", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("subtype", T.StringType()),
        T.StructField("insulated", T.BooleanType()),
        T.StructField("note", T.StringType()),
    ]
)

PATH = T.StructType(
    [
        T.StructField("instance_id", T.IntegerType()),
        T.StructField("points", T.ArrayType(VEC3)),
        T.StructField("radius", T.DoubleType()),
        T.StructField("smooth", T.BooleanType()),
    ]
)

REGION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("prism", PRISM),
        T.StructField("created_at", T.StringType()),
        T.StructField(
            "accuracy",
            T.StructType(
                [
                    T.StructField("p50", T.DoubleType()),
                    T.StructField("p90", T.DoubleType()),
                    T.StructField("loa", T.StringType()),
                    T.StructField("n_points", T.LongType()),
                    T.StructField("measured_at", T.StringType()),
                ]
            ),
        ),
    ]
)

NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("pos", VEC3)])
EDGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("a", T.StringType()),
        T.StructField("b", T.StringType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("instance_id", T.IntegerType()),
        T.StructField("dirty", T.BooleanType()),
    ]
)


def seg_key(table) -> list[str]:
    """Key of instance rows: those with a scan_id hold for their scan only, others for every scan."""
    return ["scan_id", "instance_id"] if "scan_id" in table.columns else ["instance_id"]
