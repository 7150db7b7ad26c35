"""Operators against plain Python that shares no code with them."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from larkspan.llm.mixing import mix_sources, tempered_weights
from larkspan.llm.quality import _judged, keep_good, site_posteriors
from larkspan.llm.sharding import minimax_cuts, shard_documents


def brute_sites(rows):
    """The posteriors of README's formulas over (host, path, p)."""
    total, mean = len(rows), sum(p for *_, p in rows) / len(rows)
    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    squares = lambda groups: sum(sum(v) ** 2 / len(v) for v in groups.values())

    def strength(groups, square, spread):
        beyond = max(square - groups * spread, 0) / total
        return min(max(spread / beyond - 1, 1.0), 1e4) if groups >= 1 and beyond > 0 else 1e4

    a = strength(len(hosts) - 1, squares(hosts) - total * mean**2, mean * (1 - mean))
    b = strength(len(paths) - len(hosts), squares(paths) - squares(hosts), mean - squares(hosts) / total)
    host = lambda h, out=(): (sum(hosts[h]) - sum(out) + a * mean) / (len(hosts[h]) - len(out) + a)
    path = lambda h, q, out=(): (sum(paths[h, q]) - sum(out) + b * host(h, out)) / (len(paths[h, q]) - len(out) + b)
    logit = lambda p: math.log(p / (1 - p))
    good = lambda h, q, p: 1 / (1 + math.exp(-(logit(p) + logit(path(h, q, (p,))) - logit(mean))))
    return host, path, good


def test_op3_posteriors(spark):
    rnd = random.Random(1)
    rows = []
    for h in range(12):
        base = rnd.uniform(0.2, 0.9)
        for q in range(rnd.randint(1, 6)):
            own = min(max(base + rnd.uniform(-0.15, 0.15), 0.05), 0.95)
            rows += [(f"h{h}" if h else None, f"q{q}" if q else None, min(max(rnd.gauss(own, 0.2), 0.01), 0.99)) for _ in range(rnd.choice([1, 2, 30]))]
    evidence = spark.createDataFrame([(*r, 0.0) for r in rows], "host string, path string, p_evidence double, p_toxic double")
    sites = site_posteriors(evidence)
    host, path, good = brute_sites(rows)
    for r in sites.collect():
        assert r.p_host == pytest.approx(host(r.host)) and r.p_path == pytest.approx(path(r.host, r.path))
    got = sorted((r.host or "", r.path or "", r.p_evidence, r.p_good) for r in _judged(evidence, sites, "host", "path").collect())
    want = sorted((h or "", q or "", p, good(h, q, p)) for h, q, p in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_op3_repeated_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "good words here", "s", "en", 1.0), (1, "other words", "s", "en", 2.0), (2, None, None, None, None)], "doc_id long, text string, source string, lang string, p_evidence double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 3
    assert keep_good(docs.where("false"), labels).collect() == []


def brute_capacity(sizes, shards):
    """The least capacity of a greedy fill, a larger group alone: by trying one after the other."""

    def needed(capacity):
        count, room = 0, 0
        for s in sizes:
            if s > room:
                count, room = count + 1, capacity
            room = room - s if s <= room else 0
        return count

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("digits", "whole"), [(4, 20_000), (1, 0), (2, 5)])
def test_op5_capacity_by_every_path(spark, sf, digits, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"))
    groups = {r["key"]: r["size"] for r in docs.groupBy("key").agg(F.sum("size").alias("size")).collect()}
    cuts = minimax_cuts(docs, 16, digits, whole)
    keys = sorted(groups)
    shard = lambda k: sum(c <= k for c in cuts)
    loads = {}
    for k in keys:
        loads.setdefault(shard(k), []).append(groups[k])
    capacity = brute_capacity([groups[k] for k in keys], 16)
    assert len(loads) <= 16 and max(sum(v) for v in loads.values() if len(v) > 1) <= capacity
    assert max(sum(v) for v in loads.values()) == max(capacity, max(groups.values()))


def test_op5_spread_copies(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(40) for _ in range(5)], "doc_id long, text string")
    rows = shard_documents(docs, shards=4, spread_copies=True).collect()
    assert len(rows) == 200 and all(r.text_crc32 == zlib.crc32((f"text {r.doc_id} " * 9).encode()) for r in rows)
    assert sum(len({r.shard for r in rows if r.doc_id == i}) > 1 for i in range(40)) > 30
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_op2_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(i, "t" * 50, "a" if i % 3 else "b", i, i + 1, i + 2, "own") for i in range(60)], "doc_id long, text string, source string, __n int, __rate int, c0 int, copy string")
    mixed = mix_sources(docs, tempered_weights(docs, 0.5), copy_col="nth", key_col="order")
    assert mixed.columns == [*docs.columns, "nth", "order"]
    rows = mixed.collect()
    assert rows and all((r["__n"], r["__rate"], r["c0"], r["copy"]) == (r.doc_id, r.doc_id + 1, r.doc_id + 2, "own") for r in rows)
