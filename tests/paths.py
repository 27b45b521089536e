"""Folders of the given tables and row builders that several test modules share."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def make_txn(spark, rows, schema):
    """rows: dicts with any subset of the transaction columns."""
    cols = [c.split()[0] for c in schema.split(", ")]
    full = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(full, schema)
