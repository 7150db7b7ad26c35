"""URL filter: rules, and logistic regression on hashed character n-grams of host and path, in DataFrame operations.

The model is fitted by full-batch gradient steps: an epoch is one grouped
aggregation over the labelled table, whose result, at most DIMS numbers, moves
the weights.
"""

from __future__ import annotations

import json
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.grams import code_points, gram_hash, let, map_grams
from larkspan.session import discard, materialize

#: Hashed features, n-gram lengths, epochs, step and ridge.
DIMS, LENGTHS, EPOCHS, STEP, RIDGE = 1 << 14, (3, 4, 5), 20, 1.5, 1e-4

#: Labelled urls to a task of an epoch.
ROWS_A_TASK = 50_000

# fixed values: (verdict, host and its subdomains, start of the path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# fixed values: parts of the small labelled table; a url is blocked for the words of its host or path
_GOOD_HOSTS = "news blog docs wiki library museum school science history weather recipes travel garden music sport forum shop bank health city archive press research studio market council".split()
_GOOD_PATHS = "about articles/2041 index.html contact guide/chapter-3 lessons/7 story help/faq today page/18 products/item-55.html events/2019/05 team images/logo.png data/v2 search p/9 notes/12/3".split()
_BAD_HOSTS = "spam-farm casino-win xxx-videos free-pills cheap-loans hot-dates click-bait lucky-slots adult-chat fake-bags ad-tracker porn-hub poker-cash warez-crack spam-links viagra-sale".split()
_BAD_PATHS = "casino/bonus xxx/hot pills/cheap loans/payday slots/jackpot poker/win porn/free crack/serial spam/offer adult/cams click/track viagra/buy".split()
_ZONES = ("example.org", "example.com", "example.net", "org", "co.uk", "info")


def labelled_urls() -> list[tuple[str, float]]:
    """About 260 urls with 1.0 for those to be blocked: every host word with a few paths of either kind, under zones of all kinds."""
    out = []
    for i, host in enumerate(_GOOD_HOSTS + _BAD_HOSTS):
        bad = host in _BAD_HOSTS
        for j in range(3 if bad else 6):
            path = _GOOD_PATHS[(5 * i + 4 * j) % len(_GOOD_PATHS)]
            out.append((f"https://{host}.{_ZONES[(i + j) % len(_ZONES)]}/{path}", float(bad)))
        if not bad:
            out.append((f"http://{host}.{_ZONES[i % len(_ZONES)]}/{_BAD_PATHS[i % len(_BAD_PATHS)]}", 1.0))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty for a null or a url without `://`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, upper, upper.lower()), path


def features(host: Column, path: Column) -> Column:
    """Hashed n-grams of `.host.` and path, each by its length and part, as numbers under DIMS."""

    def grams(part: Column, tag: int) -> Column:
        one = lambda p, n: map_grams(p, n, lambda i: F.pmod(gram_hash(p, i, n, F.lit(tag), F.lit(n)), F.lit(DIMS)))
        return let(code_points(part), lambda p: F.concat(*(one(p, n) for n in LENGTHS)))

    return F.concat(grams(F.concat(F.lit("."), host, F.lit(".")), 0), grams(path, 1))


def _vector(weights: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def margin(found: Column, weights: Column, bias: float) -> Column:
    """The model's log odds for blocking: the features' weights over the root of their number."""
    total = F.aggregate(found, F.lit(0.0), lambda s, f: s + F.get(weights, f.cast("int")))
    return total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")) + F.lit(bias)


def train(labelled: DataFrame, epochs: int = EPOCHS) -> tuple[list[float], float]:
    """Weights and bias from labelled (url, block), by gradient steps scaled by each weight's past gradients."""
    host, path = url_parts(F.col("url"))
    rows = labelled.where("url is not null and block is not null").select(features(host, path).alias("f"), F.col("block").cast("double").alias("y"))
    rows = materialize(rows.repartition(max(1, -(-labelled.count() // ROWS_A_TASK))), "labelled")
    n = rows.count()
    weights, bias, past, bias_past = [0.0] * DIMS, 0.0, [1e-8] * DIMS, 1e-8
    for _ in range(epochs if n else 0):
        error = F.col("y") - 1 / (1 + F.exp(-margin(F.col("f"), _vector(weights), bias)))
        part = rows.select(F.explode(F.concat(F.col("f"), F.array(F.lit(-1).cast("bigint")))).alias("d"), error.alias("e"), F.sqrt(F.size("f").cast("double")).alias("root"))
        slope = part.groupBy("d").agg(F.sum(F.when(F.col("d") < 0, F.col("e")).otherwise(F.col("e") / F.col("root"))).alias("g"))
        for d, g in slope.collect():
            if d < 0:
                bias_past += g * g
                bias += STEP * g / sqrt(bias_past)
            else:
                g -= RIDGE * weights[d] * n
                past[d] += g * g
                weights[d] += STEP * g / sqrt(past[d])
    discard(rows)
    return weights, bias


def _rule(host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule, rule_host, rule_path in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, rule).otherwise(verdict)
    return name, verdict


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{url}', {y}D)" for url, y in labelled_urls())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, block)")


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages; one pass, no shuffle.

    A rule's verdict stands; without one the model blocks where its odds are
    above even. A null url has an empty host and path, no features, and so
    follows the model's bias. Repeated rows are judged each; an empty labelled
    table blocks nothing; an empty table gives an empty result. Other columns
    are not read.
    """
    weights, bias = train(labelled)
    host, path = url_parts(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = _rule(F.col("host"), F.col("path"))
    odds = margin(features(F.col("host"), F.col("path")), _vector(weights), bias)
    by_model = F.when(odds > 0, "block").otherwise("allow")
    return parts.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"))
