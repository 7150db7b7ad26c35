"""Joins that deal hot keys over several parts give the plain join's rows; near-duplicates with hot classes, leaders and shingles."""

from pyspark.sql import functions as F

from larkspan.llm import near_dedup as module
from larkspan.llm.components import connected_components
from larkspan.llm.near_dedup import near_dedup
from larkspan.llm.skew import PARTS, dealt_join, hot_keys


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_dealt_join_gives_the_plain_joins_rows(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 17 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    others = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).union(spark.sql("SELECT 7L, 70L UNION ALL SELECT 7L, 71L"))
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("many")), ["k"], 6000)
    assert {r["__k"]: r["__parts"] for r in hot.where("__parts > 100").collect()}[7] == -(-2000 * PARTS // 6000)
    for how in ("inner", "left"):
        got = dealt_join(rows, others, hot, ["k"], "v", how)
        assert got.columns == ["k", "v", "w"] and rows_of(got) == rows_of(rows.join(others, "k", how))


def test_dealt_join_of_empty_tables(spark):
    none = spark.createDataFrame([], "k long, v long")
    hot = hot_keys(none.groupBy("k").agg(F.count("*").alias("many")), ["k"], 0)
    assert dealt_join(none, none.select("k", F.col("v").alias("w")), hot, ["k"], "v", "left").collect() == []


def test_components_of_a_star_and_a_chain(spark):
    edges = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.range(5000, 5040).select("id", F.col("id") + 1))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5041)}


def test_op6_a_third_of_the_rows_in_one_class_and_one_cluster(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base)) for i in range(300)]  # exact copies
    docs += [(1000 + i, " ".join([*base, f"tail{i}"])) for i in range(300)]  # near copies of them and of each other
    docs += [(5000 + i, f"common words stand here {i} " + " ".join(f"x{i}y{j}" for j in range(20))) for i in range(300)]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), k=4).collect()}
    assert len(got) == 900
    for i, _ in docs:
        want = 0 if i < 5000 else i
        assert got[i] == (want, i == want)


def test_telling_hot_keys_joins_nothing(spark):
    """Hot keys were looked up by a left join on either side, whose rows grew with the table."""
    rows = spark.range(6000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    others = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("many")), ["k"], 6000)
    got = dealt_join(rows, others, hot, ["k"], "v")
    assert got._jdf.queryExecution().analyzed().toString().count("Join ") == 1
    assert got.count() == 6000


def test_texts_that_fill_one_template_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Four shingles of five in common (similarity 4 / 6): all are open classes, and a common shingle is in the longer prefix of each."""
    compared, joined = [], module.dealt_join

    def counted(rows, others, hot, keys, *more):
        if keys == ["gram"] and "x_id" in others.columns:
            compared.append(rows.join(others, keys).count())
        return joined(rows, others, hot, keys, *more)

    monkeypatch.setattr(module, "dealt_join", counted)
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('w1 w2 w3 w4 w5 w6 w7 w8 x', id) AS text")
    assert near_dedup(docs, k=5).where("kept").count() == 600
    assert compared and sum(compared) < 6000


def test_links_by_prefixes_are_those_of_all_pairs(spark):
    """Sets of 4 to 12 of 16 shingles, each a component of its own or one of three large ones."""
    rows = [(i, i if i % 4 else -(i % 3), sorted({(i * p + j * j * (1 + i % 5)) % 16 for j, p in enumerate([3, 5, 7, 11, 13] * 4)})[: 4 + i % 9]) for i in range(160)]
    rows += [(200 + i, 200 + i, [*range(100, 110 + i % 3)]) for i in range(9)]
    sets = spark.createDataFrame([(i, len(g), g) for i, _, g in rows], "id long, n long, grams array<long>")
    open_ = spark.createDataFrame([(i, c) for i, c, _ in rows], "id long, component long")
    got = {(r.a, r.b) for r in module._prefix_pairs(open_, sets, 80).collect()}
    want = {(i, j) for i, c, g in rows for j, d, h in rows if i > j and c != d and 100 * len({*g} & {*h}) >= 80 * len({*g} | {*h})}
    assert want <= got and len(want) > 100
