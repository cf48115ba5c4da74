import hashlib
from collections import defaultdict

import pytest

from tubeql.llm import line_dedup
from tubeql.llm.common import table

SCHEMA = "doc_id long, text string"


def brute(rows, min_docs, min_chars=1):
    where = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for d, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add((d, t))
    gone = {k for k, v in where.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("min_docs,partitions", [(1, 1), (2, 3), (3, 7), (10, 4)])
def test_against_brute_force(spark, min_docs, partitions):
    rows = [(i, "\n".join(["Shared", f"line {i % 5}", f"own {i}", "", "  SHARED\t", "Été", "x" * (i * 1000 if i == 7 else 3)])) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "shared\nlone"), (3, rows[3][1]), (102, "a\n\nb\n")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert got(line_dedup.digest(spark.createDataFrame(rows, SCHEMA), min_docs)) == brute(rows, min_docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_documents_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(line_dedup.digest(docs, 10)) == brute(rows, 10)


def test_hot_line_over_many_partitions(spark):
    rows = [(i, f"hot\nrow {i}\nhot") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        for min_docs in (10, 2500, 3000, 3001):
            assert got(line_dedup.digest(df, min_docs)) == brute(rows, min_docs)
        first = line_dedup.deduplicate(df, 1, keep="first").select("doc_id", "text").collect()
        assert sorted(tuple(r) for r in first) == [(i, f"hot\nrow {i}" if i == 0 else f"row {i}") for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_other_columns(spark):
    assert line_dedup.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a\nb", 5, "x"), (2, "A \nc", 6, "y")], "doc_id long, text string, pos int, h1 string")
    out = line_dedup.deduplicate(docs, 2).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "b", 5, "x"), (2, "c", 6, "y")]
    names = ["k1", "k2", "_k1", "_k2", "bitmap", "_bitmap", "n_lines", "n_dropped", "_n_lines", "_n_dropped", "h2", "state", "c0", "C2", "a.b", "at"]
    odd = spark.createDataFrame([(i, "Same\nown" + str(i), *range(len(names))) for i in range(3)] + [(None, None, *range(len(names)))], SCHEMA + "".join(f", `{x}` int" for x in names))
    out = line_dedup.deduplicate(odd, 3, length="n_lines")
    assert out.schema.simpleString() == odd.schema.simpleString()
    kept = [(i, f"own{i}", *[4 if x == "n_lines" else k for k, x in enumerate(names)]) for i in range(3)]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([*kept, (None, None, *range(len(names)))], key=str)


def test_repeated_rows_in_code_brute_force_and_sql(spark, tmp_path):
    """Rows that agree in doc_id and text are one document, in all three."""
    import duckdb

    rows = [(1, "twelve times\nx")] * 12 + [(2, "Shared \nown")] + [(k, "shared\n") for k in range(3, 12)] + [(None, "shared")] * 2 + [(None, None), (None, ""), (7, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = brute(rows, 10)
    assert got(line_dedup.digest(df, 10)) == want
    assert sorted(con.execute(line_dedup.ORACLE).fetchall(), key=str) == want
    assert want[0][2] == 0 or any(x[2] for x in want)


def test_keep_must_be_known(spark):
    with pytest.raises(ValueError):
        line_dedup.dropped_lines(spark.createDataFrame([], SCHEMA), keep="last")
