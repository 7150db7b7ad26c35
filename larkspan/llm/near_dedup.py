"""MinHash near-deduplication: fast similarity sketching, banding, exact verification.

Plan, none of it quadratic in a group:

1. one Arrow pass sketches each whole text and fingerprints its shingle set;
2. rows with equal sets form a class, held by its least id (copies are never paired);
3. classes that share a band key meet in a bucket. The bucket's most central
   class (most bucket mates over all its bands) is paired with each other member,
   and the pairs are verified on the full sets;
4. classes of buckets that still hold two components are joined exactly among
   themselves by a rarest-first prefix filter, each key's largest component
   being paired only with the others; what passes is verified too;
5. components of the verified links, least id first.

With 40 bands of 5 coordinates a pair at the threshold of 0.8 shares no band
once in about ten million.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.components import connected_components
from larkspan.llm.skew import dealt_join, hot_keys
from larkspan.session import discard, materialize

BANDS, ROWS = 40, 5
#: Texts sketched together; bounds a Python worker's memory.
TOGETHER = 256


def _sketches(k: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("digest", pa.binary()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        import numpy as np

        from larkspan.llm.shingles import band_keys, fast_similarity_sketch, mix, shingle_sets

        def emit(part, sets):
            n = np.array([len(s) for s in sets], np.int64)
            fp1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            fp2 = np.array([mix(~s).sum(dtype=np.uint64) for s in sets], np.uint64)
            keys = band_keys(fast_similarity_sketch(sets, BANDS * ROWS), BANDS, ROWS)[n > 0].view(np.int64)
            offs = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.ravel()))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), lists], schema=schema)

        for batch in batches:
            sets, first = [], 0
            for s in shingle_sets(batch.column(1), k):
                sets.append(s)
                if len(sets) == TOGETHER:
                    yield emit(batch.slice(first, len(sets)), sets)
                    first, sets = first + len(sets), []
            if sets:
                yield emit(batch.slice(first, len(sets)), sets)

    return run


def _sets(k: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        import numpy as np

        from larkspan.llm.shingles import shingle_sets

        def emit(ids, sets):
            n = np.array([len(s) for s in sets], np.int64)
            offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([ids, pa.array(n), lists], schema=schema)

        for batch in batches:
            sets, first = [], 0
            for s in shingle_sets(batch.column(1), k):
                sets.append(s)
                if len(sets) == TOGETHER:
                    yield emit(batch.column(0).slice(first, len(sets)), sets)
                    first, sets = first + len(sets), []
            if sets:
                yield emit(batch.column(0).slice(first, len(sets)), sets)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass 100 * |a & b| >= percent * |a | b|."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    pairs = materialize(pairs, "pairs")
    total = pairs.count()
    hot = {c: hot_keys(pairs.groupBy(c).agg(F.count("*").alias("many")), [c], total) for c in ("a", "b")}
    both = dealt_join(dealt_join(pairs, left, hot["a"], ["a"], "b"), right, hot["b"], ["b"], "a")
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _close(a: str, b: str, percent: int):
    """Set sizes that leave the threshold within reach."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _leader_pairs(members: DataFrame, percent: int, total: int) -> DataFrame:
    """(a, b): each bucket's most central member with every other one."""
    central = members.groupBy("id").agg(F.sum("size").alias("central"))
    ranked = members.join(central, "id")
    lead = ranked.groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("n").alias("na")), F.struct("central", -F.col("id"))).alias("lead"), F.first("size").alias("many"))
    lead = materialize(lead, "lead")
    hot = hot_keys(lead, ["key"], total)
    return dealt_join(members, lead.select("key", "lead.a", "lead.na"), hot, ["key"], "id").where("a <> id").where(_close("n", "na", percent)).select("a", F.col("id").alias("b")).distinct()


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of different components that may pass, by shingles that come first in one order, rarest first.

    Of two sets that pass, each has one of the common shingles among its first
    n - least + 1, where least is the least overlap that its size allows: with
    any partner for the larger set, with a partner at least its own size for
    the smaller. Shingles that one set alone has cannot be common, which bounds
    the overlap from above. Of a shingle's components, the largest is paired
    with the others only. A shingle joins the sets that have it in the smaller
    one's prefix with those that have it in the larger one's: a shingle that is
    in no set's shorter prefix, as one of a template that many texts fill, makes
    no pair.
    """
    grams = sets.join(open_, "id").select("id", "n", "component", F.explode("grams").alias("gram"))
    often = materialize(grams.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1"), "often")
    total = sets.join(open_.select("id").distinct(), "id", "left_semi").agg(F.sum("n").alias("n")).first().n or 0
    ranked = dealt_join(grams, often, hot_keys(often, ["gram"], total, "often"), ["gram"], "id").groupBy("id", "n", "component").agg(F.sort_array(F.collect_set(F.struct("often", "gram"))).alias("all"))
    ranked = ranked.withColumn("most", F.size("all"))
    first = lambda per: (F.col("n") - F.ceil(F.col("n") * per) + 1).cast("int")
    overlap = 2.0 * percent / (100 + percent)
    # a hair less than the exact share, so that rounding can only lengthen a prefix
    ranked = ranked.where(F.col("most") >= F.floor(F.col("n") * (percent / 100 - 1e-9)))
    # the n - most shingles that the set alone has come first, without rows of their own
    alone = (F.col("n") - F.col("most")).cast("int")
    lead = F.posexplode(F.slice("all", F.lit(1), F.greatest(first(percent / 100 - 1e-9) - alone, F.lit(0)))).alias("at", "one")
    prefix = ranked.select("id", "n", "component", "most", lead, (first(overlap - 1e-9) - alone).alias("short"))
    prefix = prefix.select("id", "n", "component", "most", F.col("one.gram").alias("gram"), (F.col("at") < F.col("short")).alias("as_smaller"))
    prefix = materialize(prefix, "prefix")
    shared = prefix.groupBy("gram", "component").agg(F.count("*").alias("many"))
    kinds = shared.groupBy("gram").agg(F.max_by("component", F.struct("many", "component")).alias("largest"), F.count("*").alias("kinds"), F.sum("many").alias("many")).where("kinds > 1")
    kinds = materialize(kinds, "kinds")
    hot = hot_keys(kinds, ["gram"], prefix.count())
    placed = materialize(dealt_join(prefix, kinds.select("gram", "largest"), hot, ["gram"], "id"), "placed")
    discard(often, prefix, kinds)
    named = lambda rows: rows.select("gram", *(F.col(c).alias(f"x_{c}") for c in ("id", "n", "component", "most")))
    small, few = F.col("as_smaller"), F.col("component") != F.col("largest")
    # (larger, smaller): one of the two is outside the gram's largest component
    either = [(placed, placed.where(small & few)), (placed.where(few), placed.where(small & ~few))]
    reach = F.least("most", "x_most") * (100 + percent) >= percent * (F.col("n") + F.col("x_n"))
    role = (F.col("x_n") < F.col("n")) | (F.col("x_n") == F.col("n")) & small
    found = [dealt_join(large, named(one), hot, ["gram"], "id").where("component <> x_component").where(_close("n", "x_n", percent) & role & reach) for large, one in either]
    pairs = found[0].union(found[1])
    return pairs.select(F.greatest("id", "x_id").alias("a"), F.least("id", "x_id").alias("b")).distinct()


def _told_apart(rows: DataFrame) -> DataFrame | None:
    """(id, digest, node): a node for each text of the ids that have several, below all ids; None where ids tell texts apart.

    Such texts are documents of their own: joined under their id, one that has
    a duplicate elsewhere would take the others with it.
    """
    several = rows.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
    texts = materialize(rows.join(several, "id", "left_semi").select("id", "digest").distinct().withColumn("m", F.monotonically_increasing_id()), "texts")
    if texts.isEmpty():
        return None
    below = rows.agg(F.least(F.min("id"), F.lit(0)).alias("m")).first().m
    return texts.select(F.col("id").alias("t_id"), F.col("digest").alias("t_digest"), (F.lit(below) - 1 - F.col("m")).alias("node"))


def _named(rows: DataFrame, told: DataFrame | None) -> DataFrame:
    """rows (id, digest, ...) with their node."""
    if told is None:
        return rows.withColumn("node", F.col("id"))
    return rows.join(told, (F.col("id") == F.col("t_id")) & (F.col("digest") == F.col("t_digest")), "left").withColumn("node", F.coalesce("node", "id")).drop("t_id", "t_digest")


def _labelled(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, join_ids: bool) -> tuple[DataFrame, bool]:
    """((id, digest, n, component) of every row, whether some id has several texts).

    component is the least id of the row's component. With join_ids, texts of
    one id are linked; without, they are documents of their own.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    long = pa.int64()
    rows = materialize(source.mapInArrow(_sketches(k, long), "id long, digest binary, n long, fp1 long, fp2 long, bands array<long>"), "sketches")
    told = _told_apart(rows.where("id is not null and n > 0"))
    if told is not None:
        rows = materialize(_named(rows, told), "nodes")
    else:
        rows = rows.withColumn("node", F.col("id"))
    known = rows.where("id is not null and n > 0").drop("id").withColumnRenamed("node", "id")
    classes = materialize(known.groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("many")), "classes")

    reps = known.join(classes.select("fp1", "fp2", "n", F.col("rep").alias("id")), ["fp1", "fp2", "n", "id"], "left_semi").dropDuplicates(["id", "fp1", "fp2"])
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    total = classes.count() * BANDS
    members = materialize(dealt_join(banded, buckets, hot_keys(buckets, ["key"], total, "size"), ["key"], "id"), "members")

    wanted = members.select("id").distinct()
    texts = _named(source, told).select(F.col("node").alias("id"), "text").join(wanted, "id", "left_semi")
    sets = materialize(texts.mapInArrow(_sets(k, long), "id long, n long, grams array<long>"), "sets")
    links = materialize(_verified(_leader_pairs(members, percent, total), sets, percent), "links")
    first = materialize(connected_components(links), "components")

    placed = members.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = materialize(placed.join(split, "key", "left_semi").select("id", "component").distinct(), "open")
    links = links.union(_verified(_prefix_pairs(open_, sets, percent), sets, percent))
    if told is not None and join_ids:
        # the texts of an id through its least node; a text that is not its class' head is linked to that too
        heads = told.groupBy("t_id").agg(F.min("node").alias("head")).withColumnRenamed("t_id", "h_id")
        same = told.join(heads, F.col("t_id") == F.col("h_id")).select(F.col("node").alias("a"), F.col("head").alias("b"))
        held = known.join(told.select(F.col("node").alias("id")), "id", "left_semi").join(classes, ["fp1", "fp2", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = links.union(same).union(held)
    final = materialize(connected_components(links), "components")
    discard(members, sets, first, open_)

    of_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component"))
    named = rows.select("id", "digest", "n", "fp1", "fp2")
    keys = ["fp1", "fp2", "n"]  # a class may hold much of the table
    out = dealt_join(named.where("n > 0 and id is not null"), of_class, hot_keys(classes, keys, rows.count()), keys, "digest" if told is not None else "id", "left")
    out = out.unionByName(named.where("n = 0 or id is null").withColumn("component", F.lit(None).cast("long")))
    if told is not None:  # a component's name is its least id, which its least node is not
        least = out.where("component is not null and id is not null").groupBy(F.col("component").alias("c")).agg(F.min("id").alias("least"))
        out = out.join(least, F.col("component") == F.col("c"), "left").drop("component", "c").withColumnRenamed("least", "component")
    label = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    if told is not None and join_ids:  # the empty text of an id that has others goes with them
        named = out.where("n > 0 and id is not null").join(told.select(F.col("t_id").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("o_id")).agg(F.min("component").alias("other"))
        out = out.join(named, F.col("id") == F.col("o_id"), "left")
        label = F.coalesce("other", label)
    return out.select("id", "digest", "n", F.when(F.col("id").isNotNull(), label).alias("component")), told is not None


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Texts link when 100 * |A & B| >= percent * |A | B| over their sets of
    distinct k-word shingles; component_id is the least id reachable by links,
    and kept marks the row whose id that is. A text without words, empty or
    null, is linked with nothing and kept. A null id is a component of its own
    (component_id null, kept true). Rows with one id are one node, whatever
    their texts: they get the same component. An empty table gives an empty
    result. Other columns of docs, whatever their names, are not read.
    """
    rows, _ = _labelled(docs, id_col, text_col, k, percent, join_ids=True)
    out = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose text's component has a smaller id; columns as given.

    Every text that has no kept duplicate stays: where rows share an id but
    not a text, each text is a document of its own, and a row goes by its own
    text's component alone. Rows equal in id and text stay together. Null ids
    and texts without words stay.
    """
    rows, several = _labelled(docs, id_col, text_col, k, percent, join_ids=False)
    gone = rows.where("component <> id")
    same = docs[id_col].cast("long") == F.col("__gone")
    if several:
        gone = gone.select(F.col("id").alias("__gone"), F.col("digest").alias("__digest"))
        same = same & (F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"))) == F.col("__digest"))
    else:
        gone = gone.select(F.col("id").alias("__gone"))
    return docs.join(gone.distinct(), same, "left_anti")
