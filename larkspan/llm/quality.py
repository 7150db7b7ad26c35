"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

Two logistic models over shape features and a few telling words give each
document the evidence that it is good (label quality) and that it is toxic
(label toxic). The chance of good is averaged over each host and each path of
a host; both means are shrunk, a path's toward its host's and a host's toward
the global one, with a strength estimated from how much sites differ. What the
path's other documents say then moves the document's odds. A document is kept if its
posterior is at least one half and it is not more likely toxic than not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.session import materialize

#: Labelled documents that the models are fitted on, at most (about; chosen by a hash of the id).
SAMPLE = 8000
#: Telling words for a label: how many standard errors their frequencies differ by, and how many at most.
TELLING, WORDS = 6.0, 200

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SHAPES = ("upper", "symbol_words", "bar_words", "digits", "spread", "length", "lines")


def shape_features(data: np.ndarray, offs: np.ndarray, words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One row for each text: shares of kinds of bytes and words, from UTF-8 bytes and word hashes."""
    n = len(offs) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offs[1:]] - sums[offs[:-1]]).astype(float)

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    symbol = np.isin(data, np.frombuffer(b"#$%&*@^~!<>{}[]\\=_", np.uint8))
    ends = symbol & ~np.concatenate([symbol[1:], [False]])
    nw = np.bincount(text, minlength=n).astype(float)
    kinds = np.bincount(np.unique(np.stack([text.astype(np.uint64), words]), axis=1)[0].astype(np.int64), minlength=n) if len(words) else np.zeros(n)
    some = np.maximum(nw, 1)
    bytes_ = np.maximum(np.diff(offs), 1)
    return np.stack(
        [
            count(upper) / np.maximum(count(upper) + count(lower), 1),
            np.minimum(count(ends) / some, 2),
            np.minimum(count(data == 124) / some, 2),
            count((data >= 48) & (data <= 57)) / bytes_,
            kinds / some,
            np.log1p(nw),
            count(data == 10) / some,
        ],
        axis=1,
    )


def features(texts: pa.Array):
    """(shapes, words, text): shape rows, hashes of the words, and the words' text numbers."""
    import pyarrow.compute as pc

    from larkspan.llm.shingles import word_hashes

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offs[0] : offs[-1]]
    offs = offs - offs[0]
    words, text = word_hashes(np.where(_SEPARATOR[data], np.uint8(32), data), offs)
    return shape_features(data, offs, words, text), words, text


def telling_words(words: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Hashes whose share of documents differs most between the labels, sorted."""
    n1, n0 = max(int(label.sum()), 1), max(int((~label).sum()), 1)
    flat = np.concatenate([*words, np.zeros(0, np.uint64)])
    hashes, at = np.unique(flat, return_inverse=True)
    mine = np.repeat(label, [len(w) for w in words])
    d1, d0 = (np.bincount(at[m], minlength=len(hashes)) for m in (mine, ~mine))
    p1, p0, p = d1 / n1, d0 / n0, (d1 + d0) / (n1 + n0)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    best = np.argsort(-z, kind="stable")[:WORDS]
    return np.sort(hashes[best[(z[best] >= TELLING) & (d1 + d0 >= 3)[best]]])


def presence(words: np.ndarray, text: np.ndarray, n: int, telling: np.ndarray) -> np.ndarray:
    """1 where a text has a telling word."""
    out = np.zeros((n, len(telling)))
    if len(telling):
        at = np.minimum(np.searchsorted(telling, words), len(telling) - 1)
        hit = telling[at] == words
        out[text[hit], at[hit]] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights (intercept last) of ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Head:
    """One logistic model: scaled shapes and telling words."""

    def __init__(self, shapes: np.ndarray, words: list[np.ndarray], label: np.ndarray):
        self.telling = telling_words(words, label)
        self.mean, self.scale = (shapes.mean(0), shapes.std(0) + 1e-6) if len(shapes) else (np.zeros(len(SHAPES)), np.ones(len(SHAPES)))
        flat, text = np.concatenate([*words, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(words)), [len(w) for w in words])
        if label.all() or not label.any():  # nothing to tell apart
            self.weights = np.zeros(len(SHAPES) + len(self.telling) + 1)
            self.weights[-1] = 0.0 if not len(label) else 5.0 if label.all() else -5.0
        else:
            self.weights = fit_logistic(self._x(shapes, flat, text), label.astype(float))

    def _x(self, shapes: np.ndarray, words: np.ndarray, text: np.ndarray) -> np.ndarray:
        return np.hstack([(shapes - self.mean) / self.scale, presence(words, text, len(shapes), self.telling)])

    def chance(self, shapes: np.ndarray, words: np.ndarray, text: np.ndarray) -> np.ndarray:
        x = self._x(shapes, words, text)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _extract(batches):
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            shapes, words, text = features(part.column(0))
            cuts = np.searchsorted(text, np.arange(len(shapes) + 1))
            lists = [np.unique(words[a:b]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(list(shapes), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int64()))], names=["quality", "toxic", "shapes", "words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Head, Head]:
    """The models of good and of toxic, from at most about `sample` labelled documents.

    Labels are (id_col, quality, toxic); a null label counts as quality 1 or
    toxic 0. Of repeated labels the least quality and the greatest toxicity
    count, of repeated documents the least text, so that the sample is bounded
    by ids and rows alike. Without labels, or with one class alone, a model
    gives a constant.
    """
    labels = labels.select(F.col(id_col).alias("__id"), F.coalesce(F.col("quality").cast("int"), F.lit(1)).alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic"))
    labels = labels.where("__id is not null").groupBy("__id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = labels.count()
    chosen = labels.where(F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30)) + 1)
    # the sample's size is bounded by the parameter
    joined = docs.select(F.col(id_col).alias("__d"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("__d") == F.col("__id"))
    joined = joined.groupBy("__id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    got = joined.select("text", "quality", "toxic").mapInArrow(_extract, "quality int, toxic int, shapes array<double>, words array<long>").toArrow()
    shapes = np.array(got.column("shapes").to_pylist(), float).reshape(-1, len(SHAPES))
    words = [np.asarray(w.values, np.int64).view(np.uint64) for w in got.column("words").combine_chunks()] if len(shapes) else []
    good, toxic = (np.array(got.column(c).to_pylist(), int) == 1 for c in ("quality", "toxic"))
    return Head(shapes, words, good), Head(shapes, words, toxic)


def _score(heads, text_at: int, keep: list[int]):
    def run(batches):
        good, toxic = heads.value
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = features(part.column(text_at))
                columns = [part.column(i) for i in keep] + [pa.array(h.chance(*found)) for h in (good, toxic)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(part.schema.names[i] for i in keep), "p_evidence", "p_toxic"])

    return run


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, n, s, hn, hs, global_mean, a, b, p_host, p_path) from evidence (host, path, p_evidence), by grouped aggregation alone.

    n, s and hn, hs are rows and sums of a path and of its host. A host's mean
    is shrunk toward the global one with strength a, a path's toward its
    host's with strength b. A strength is the mean m (1 - m) of the level
    above over the variance between groups that sampling does not explain,
    less 1, held to 1..10,000: for hosts around the global mean, for paths
    around their own hosts' means, so what tells hosts apart is counted once.
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_evidence").alias("s"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    top = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n"), F.count("*").alias("k"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("q")).first()
    low = paths.agg(F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).first()
    total = top["n"] or 0
    mean = min(max(top["s"] / total if total else 0.5, 1e-6), 1 - 1e-6)

    def strength(groups: int, square: float, spread: float) -> float:
        # the square that `groups` free means show by sampling alone is theirs times m (1 - m)
        if not total or groups < 1:
            return 10_000.0
        beyond = max(square - groups * spread, 0.0) / total
        return float(min(max(spread / beyond - 1, 1.0), 10_000.0)) if beyond > 0 else 10_000.0

    a = strength(top["k"] - 1, (top["q"] or 0.0) - total * mean * mean, mean * (1 - mean))
    b = strength(low["k"] - top["k"], (low["q"] or 0.0) - (top["q"] or 0.0), max(mean - (top["q"] or 0.0) / total, 1e-12) if total else 0.0)
    hosts = hosts.select(F.col("host").alias("h"), "hn", "hs", ((F.col("hs") + a * mean) / (F.col("hn") + a)).alias("p_host"))
    out = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    constants = (F.lit(v).alias(k) for k, v in (("global_mean", mean), ("a", a), ("b", b)))
    return out.select("host", "path", "n", "s", "hn", "hs", *constants, "p_host", ((F.col("s") + b * F.col("p_host")) / (F.col("n") + b)).alias("p_path"))


def _logit(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _judged(evidence: DataFrame, sites: DataFrame, host: str, path: str) -> DataFrame:
    """evidence with p_host, p_path, p_site, p_good and kept; p_site is what the path's other documents say."""
    columns = [c for c in sites.columns if c not in ("host", "path")]
    sites = sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = evidence.join(sites, F.col(host).eqNullSafe(F.col("__h")) & F.col(path).eqNullSafe(F.col("__p")))
    e, a, b, mean = F.col("p_evidence"), F.col("__a"), F.col("__b"), F.col("__global_mean")
    # the document's own evidence is left out of its site, or it would count twice
    others = (F.col("__hs") - e + a * mean) / (F.col("__hn") - 1 + a)
    site = (F.col("__s") - e + b * others) / (F.col("__n") - 1 + b)
    out = out.withColumns({"p_host": F.col("__p_host"), "p_path": F.col("__p_path"), "p_site": site}).drop("__h", "__p", *(f"__{c}" for c in columns if c != "global_mean"))
    odds = _logit(e) + _logit(F.col("p_site")) - _logit(mean)
    out = out.withColumn("p_good", 1 / (1 + F.exp(-odds))).drop("__global_mean")
    return out.withColumn("kept", (F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(id_col, host, path, p_evidence, p_toxic, p_host, p_path, p_site, p_good, kept) for every row of docs.

    host_col and path_col name the two levels of a site; null is a value of
    its own. A null text is empty and judged by its shape. Rows with one id
    are judged each. An empty table gives an empty result. Other columns are
    not read.
    """
    heads = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    evidence = materialize(source.mapInArrow(_score(heads, 3, [0, 1, 2]), "id long, host string, path string, p_evidence double, p_toxic double"), "evidence")
    judged = _judged(evidence, site_posteriors(evidence), "host", "path")
    return judged.select(F.col("id").alias(id_col), "host", "path", "p_evidence", "p_toxic", "p_host", "p_path", "p_site", "p_good", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """docs without the rows that the classifier rejects; columns as given, whatever their names.

    Texts are scored once: the scored rows are written, the site means are
    read from their two narrow columns, and the rows are judged as they lie.
    A null text is judged by its shape, null sites are sites, repeated rows
    are judged each, and an empty table stays empty.
    """
    heads = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    text, host, path = (columns.index(c) for c in (text_col, host_col, path_col))
    schema = T.StructType([*plain.schema.fields, T.StructField("p_evidence", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
    scored = materialize(plain.mapInArrow(_score(heads, text, list(range(len(columns)))), schema), "scored")
    site = lambda i: F.col(f"c{i}").cast("string")
    sites = materialize(site_posteriors(scored.select(site(host).alias("host"), site(path).alias("path"), "p_evidence")), "sites")
    return _judged(scored.withColumns({"__host": site(host), "__path": site(path)}), sites, "__host", "__path").where("kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
