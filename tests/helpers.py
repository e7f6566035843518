import os

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def against_sql(spark, query, sql, folder):
    """Rows of a query and of its SQL, sorted, by the names of the columns."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    mine = sorted(tuple(str(r[n]) for n in names) for r in df.collect())
    return mine, sorted(tuple(str(r[cols.index(n)]) for n in names) for r in cur.fetchall())
