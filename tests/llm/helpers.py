"""Small tables with awkward rows, and comparison with the SQL checks."""

import duckdb
import pyarrow as pa

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """(doc_id, text, source) rows as a documents table; ``extra`` adds columns with clashing names."""
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS).repartition(3)
    if extra:
        for name in ("target", "taken", "rank", "n", "node", "k1", "kept", "size", "words", "_n", "key", "sha", "host", "ids"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([None if r[i] is None else round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


def same_as_sql(df, sql, tables):
    """``tables``: name -> path of Parquet files, or rows of documents."""
    con = duckdb.connect()
    for name, rows in tables.items():
        if isinstance(rows, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{rows}'")
        else:
            con.register(name, pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), names)
