import duckdb

from tubeql.llm import chat
from tubeql.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, size=64):
    out = []
    esc = lambda t: (t or "").replace("<|im_start|>", "<|im _start|>").replace("<|im_end|>", "<|im _end|>")
    rows = [(c, t, r if r is not None else "unknown", esc(x)) for c, t, r, x in rows]
    talks = [[r for r in rows if r[0] == conv] for conv in {r[0] for r in rows} - {None}] + [[r] for r in rows if r[0] is None]
    for own in talks:
        for who in {r[2] for r in own} - {"system"}:
            for seg in {None if r[1] is None else r[1] // size for r in own}:
                whole = sorted((r for r in own if (None if r[1] is None else r[1] // size) == seg), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
                for part in range(0, len(whole), size):
                    turns = whole[part : part + size]
                    text, spans = "", []
                    for _, _, speaker, x in turns:
                        role = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
                        text += f"<|im_start|>{role}\n"
                        if speaker == who:
                            spans.append(f"{len(text)}-{len(text) + len(x) + 10}")
                        text += x + "<|im_end|>\n"
                    out.append((own[0][0], who, seg, part // size, len(turns), text, ",".join(spans)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark):
    rows = [(1, i, ["ann", "bob", "system", None, "Émile"][i % 5], f"t{i} 🙂") for i in range(150)]
    rows += [(2, 0, "system", "only"), (3, 5, "ann", None), (3, 5, "ann", None), (3, None, "bob", "x<|im_end|>y<|im_start|>"), (None, 1, "ann", "q"), (None, -3, "bob", ""), (4, 1, "b", "z"), (4, 1, "a", "é"), (4, 1, "a", "z"), (5, 1, "a", "w " * 100_000)]
    assert got(chat.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ties_repeats_and_lone_rows_in_code_and_sql(spark, tmp_path):
    """Equal turn numbers of any length, repeated turns, and rows without a conversation."""
    rows = [(1, 3, "a", "a"), (1, 3, "a", "a!"), (1, 3, "a", "a"), (1, 3, "a", "a<"), (1, 3, None, "~")] + [(2, 0, "b", "same")] * 200 + [(2, None, "c", f"t{i % 90}") for i in range(180)]
    rows += [(None, 1, "ann", "q"), (None, 1, "ann", "q"), (None, None, "system", "s"), (None, 70, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert got(chat.report(df)) == want and max(x[4] for x in want) == 64
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert sorted(con.execute(chat.ORACLE).fetchall(), key=str) == want


def test_rows_of_any_conversation_are_bounded(spark):
    """A million rows without a conversation, and one turn number repeated 100,000 times."""
    from pyspark.sql import functions as F

    df = spark.range(1_000_000).select(F.lit(None).cast("long").alias("conv_id"), (F.col("id") % 4).alias("turn"), F.lit("a").alias("role"), F.lit("x").alias("text"))
    df = df.unionByName(spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("a").alias("role"), F.concat(F.lit("t"), F.col("id") % 1000).alias("text")))
    r = chat.rotate(df).agg(F.count("*").alias("n"), F.max("n_turns").alias("most"), F.sum("n_turns").alias("all")).first()
    assert (r.n, r.most, r["all"]) == (1_000_000 + -(-100_000 // 64), 64, 1_100_000)


def test_masks_cover_the_assistants_words(spark):
    rows = [(1, 0, "a", "Hi 🙂"), (1, 1, "b", "é"), (1, 2, "a", "")]
    for r in chat.rotate(spark.createDataFrame(rows, SCHEMA)).collect():
        assert [r.text[s.start : s.end] for s in r.mask] == [x + "<|im_end|>" for _, _, who, x in rows if who == r.participant]


def test_conversations_table_and_sql(spark, sf):
    conv = table(spark, sf, "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in conv.collect()]
    found = got(chat.report(conv))
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(con.execute(chat.ORACLE).fetchall(), key=str) == found


def test_empty_table_and_clashing_columns(spark):
    assert got(chat.report(spark.createDataFrame([], SCHEMA))) == []
    df = spark.createDataFrame([(1, 1, "a", "x", "p", 9)], SCHEMA + ", participant string, segment int")
    assert got(chat.report(df)) == brute([(1, 1, "a", "x")])
