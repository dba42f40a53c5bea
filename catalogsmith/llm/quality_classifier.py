"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A logistic regression on two dozen measures of the text (shares of character classes, of common words, of repeated lines and
word windows, and such) gives each document's probability. Hosts, and paths within hosts, then get posteriors from grouped sums
of these: a host's mean is shrunk toward the global prior, a path's toward its host's, each by a strength estimated from the
variation between groups (method of moments), so a sparse site says little. The site's log-odds beyond the prior are added to
the document's, at ``site_weight``.

A site is a URL (host and first path segment) or any name (a host, perhaps with a path after a slash). A null or empty site
adds nothing. A null text or one without words: probability 0, not kept. Repeated rows are repeated rows in all sums; an empty
table gives an empty result. With labels of one kind only, or none, the text says nothing and every document with words is kept.
Sums are pre-aggregated per task, so a hot host costs one row from each; site tables are joined by size (broadcast only below
Spark's threshold).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .quality_rules import _base, _histograms, _shares
from .sampling import labelled_texts
from .sparkio import mapped, quoted, written
from .textkernel import Slab, slabs


@dataclass(frozen=True)
class Sample:
    """Most labelled rows of each kind, and the longest text, that the classifier learns from."""

    each: int = 2000
    chars: int = 30_000


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is a constant
    informed: bool = True


def measures(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """A row of measures per text, and its number of words."""
    starts, ends, owner = slab.words()
    m = len(slab)
    base = _base(slab, starts, ends, owner)
    chars, words = _histograms(slab, starts, ends, owner)
    n = np.maximum(base["n_words"], 1)
    length = ends - starts
    last = slab.codes[ends - 1] if len(ends) else np.zeros(0, np.uint32)
    letter_last = (last - ord("a") < 26) | (last - ord("A") < 26) | (last >= 128)
    odd = ~letter_last & (last != ord(".")) & (last != ord(","))
    upper = np.concatenate([[0], np.cumsum((slab.codes >= ord("A")) & (slab.codes <= ord("Z")))])
    loud = (upper[ends] - upper[starts]) * 2 > length
    count = lambda mask: np.bincount(owner[mask], minlength=m)
    breaks = np.bincount(slab.owner(np.flatnonzero(slab.codes == 10)), minlength=m)
    share = _shares(chars)
    rows = [
        *share.T,
        1 - words[:, -1] / n,
        base["word_chars"] / n / 10,
        base["n_symbols"] / n,
        base["n_dup_lines"] / (breaks + 1),
        base["n_repeat_words"] / n,
        count(odd) / n,
        count(loud) / n,
        count(length == 1) / n,
        count(length > 20) / n,
        np.log1p(base["n_words"]) / 5,
        np.minimum(n / 50, 1),
        breaks / n,
    ]
    x = np.stack(rows, 1).astype(np.float64)
    return np.hstack([x, np.sqrt(x[:, [3, 6, 7]]), x[:, 8:17] ** 2]), base["n_words"]


def fit(texts: list[str], labels: list[int]) -> Model:
    parts = [measures(slab) for _, slab in slabs(texts)]
    size = measures(Slab([""]))[0].shape[1]
    x, y = np.vstack([p[0] for p in parts] or [np.zeros((0, size))]), np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), np.ones(size), np.zeros(size + 1), False)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w, ridge = np.zeros(size + 1), np.diag([0.3] * size + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w = w - step * min(1, 2 / max(np.abs(step).max(), 1e-9))
    return Model(mean, scale, w)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: Sample = Sample()) -> Model:
    found = labelled_texts(df, labels, id_col, text_col, label_col, {0: sample.each, 1: sample.each}, sample.chars)
    return fit([f[1] for f in found], [f[0] for f in found])


def site_keys(site: Column) -> tuple[Column, Column]:
    """Host and path key of a URL or a name; null where there is none."""
    name = F.lower(F.regexp_replace(site.cast("string"), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", ""))
    host = F.nullif(F.substring_index(name, "/", 1), F.lit(""))
    return host, F.when(host.isNotNull(), F.substring_index(name, "/", 2))


def document_evidence(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """p (double) and row, a struct of all of df's columns, so that names may clash."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("p", DoubleType()), StructField("row", StructType(df.schema.fields), False)])
    rows = df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, slab in slabs(batch.column(1).to_pylist()):
                x, n = measures(slab)
                z = np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights[:-1] + model.weights[-1]
                p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))) if model.informed else 1.0, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(p), batch.column(0).slice(first, len(slab))], names=["p", "row"])

    return mapped(rows, step, schema)


def _strength(groups: DataFrame) -> Column:
    """Pseudo-counts that a group's prior is worth: from how much group means vary beyond what chance explains."""
    n, m = F.col("n"), F.col("s") / F.col("n")
    total, mean = F.sum("n"), F.sum("s") / F.sum("n")
    within = F.sum(F.col("q") - n * m * m) / F.greatest(total - F.count("*"), F.lit(1))
    between = F.sum(n * m * m) / total - mean * mean
    noise = within * F.count("*") / total
    return F.coalesce(F.least(F.greatest(within / F.greatest(between - noise, F.lit(1e-4)), F.lit(5.0)), F.lit(1000.0)), F.lit(50.0))


def site_posteriors(evidence: DataFrame, host: Column, path: Column) -> tuple[DataFrame, float]:
    """path_key and site (posterior mean) for every path; and the global prior. One grouped pass over documents."""
    p = F.col("p")
    paths = written(evidence.select(host.alias("host"), path.alias("path_key"), p.alias("p")).where("host is not null").groupBy("host", "path_key").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    top = hosts.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5)).alias("prior"), _strength(hosts).alias("k")).first()
    below = paths.agg(_strength(paths).alias("k")).first()
    hosts = hosts.select("host", ((F.col("s") + top.k * top.prior) / (F.col("n") + top.k)).alias("m"))
    site = paths.join(hosts, "host").select("path_key", ((F.col("s") + below.k * F.col("m")) / (F.col("n") + below.k)).alias("site"))
    return written(site, "quality-sites"), float(top.prior)


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def judged(df: DataFrame, model: Model, text_col: str = "text", site_col: str = "source", site_weight: float = 0.5, threshold: float = 0.35) -> DataFrame:
    """row (a struct of df's columns, of any names), p_doc, p_site, quality_score and quality_kept."""
    found = document_evidence(df, model, text_col)
    host, path = site_keys(F.col("row").getField(site_col))
    sites, prior = site_posteriors(found, host, path)
    joined = found.withColumn("path", path).join(sites, F.col("path") == F.col("path_key"), "left")
    site = F.coalesce(F.col("site"), F.lit(prior))
    odds = _logit(F.col("p")) + site_weight * (_logit(site) - _logit(F.lit(prior)))
    score = F.when(F.col("p") == 0, 0.0).otherwise(1 / (1 + F.exp(-odds)))
    return joined.select("row", F.col("p").alias("p_doc"), site.alias("p_site"), score.alias("quality_score"), (score >= threshold).alias("quality_kept"))


def kept(df: DataFrame, model: Model, text_col: str = "text", site_col: str = "source", site_weight: float = 0.5, threshold: float = 0.35) -> DataFrame:
    """The rows of df that judged() keeps. Most documents are kept, or not, whatever their site's posterior may be: only the others
    are joined to their site, so that most texts stay where they are and a hot path sends but its doubtful ones."""
    found = document_evidence(df, model, text_col).where("p > 0")
    host, path = site_keys(F.col("row").getField(site_col))
    sites, prior = site_posteriors(document_evidence(df, model, text_col), host, path)
    ends = sites.agg(F.least(F.min("site"), F.lit(prior)).alias("low"), F.greatest(F.max("site"), F.lit(prior)).alias("high")).first()
    odds = lambda site: _logit(F.col("p")) + site_weight * (_logit(site) - _logit(F.lit(prior)))
    cut = float(np.log(threshold / (1 - threshold)))
    low, high = odds(F.lit(prior if ends.low is None else ends.low)), odds(F.lit(prior if ends.high is None else ends.high))
    if site_weight < 0:
        low, high = high, low
    sure, open_ = low > cut + 1e-9, (low <= cut + 1e-9) & (high >= cut - 1e-9)
    joined = found.where(open_).withColumn("path", path).join(sites, F.col("path") == F.col("path_key"), "left")
    score = 1 / (1 + F.exp(-odds(F.coalesce(F.col("site"), F.lit(prior)))))
    return found.where(sure).select("row.*").union(joined.where(score >= threshold).select("row.*"))


def classify(df: DataFrame, model: Model, text_col: str = "text", site_col: str = "source", site_weight: float = 0.5, threshold: float = 0.35) -> DataFrame:
    """df's columns, then p_doc, p_site, quality_score and quality_kept; a column of df that has one of these names gives way to
    the new one (judged() keeps both)."""
    new = ("p_doc", "p_site", "quality_score", "quality_kept")
    found = judged(df, model, text_col, site_col, site_weight, threshold)
    return found.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c not in new), *new)
