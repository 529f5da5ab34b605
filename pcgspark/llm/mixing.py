"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives each document posteriors over the domains; a document belongs to every
domain with that share. Nonnegative document rates are then fitted so that the expected tokens of each domain, the sum
of rate * tokens * posterior, meet the targets: distributed projected gradient on the squared residual. A document's
rate is a function of its posteriors and the short history of steps, max(0, rate - <posterior, step>) folded over
them, so nothing but a few sums over the table moves in an iteration. Steps are scaled by the inverse second-moment
matrix of the posteriors of documents whose rate is within its bounds, and halved while they do not lower the
residual; where short ones do not either, a plain gradient step follows. The fit ends when the targets are met or no step gains anything, and ``Classifier.residual`` tells what is
left. With an upper bound of 1 rates are chances to draw a document with, and the drawn text meets the targets.

The classifier is naive Bayes with normal densities over features of the whole text, fitted on a bounded sample of
labelled rows (about ``ROWS`` of each domain, by a hash of doc_id); its word lists are bounded by the constants below.
Tokens are white-space separated words. Null and empty texts have no tokens, prior posteriors and a rate, and weigh
nothing. Without labels all documents are in one domain. Repeated rows count as often as they occur, with equal rates;
rows of one doc_id with different texts have rates of their own. Ties between domains go to the first in alphabetical
order. Other columns are ignored, whatever their names. Very long texts count whole; an empty table stays empty.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pcgspark.llm.common import materialise

ROWS = 3000
LEXICON = 200
MIN_SUPPORT, MIN_RATIO = 0.008, 20.0
PASSES, SHORTEST, LEAST_GAIN = 60, 0.2, 1e-4
TOLERANCE = 1e-6
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), "")


def features(docs: DataFrame, lexicons: list[list[str]]) -> DataFrame:
    """Adds ``tokens`` and the array ``x``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__w", _words(F.col("text"))).withColumn("tokens", F.size("__w").cast("bigint"))
    every = sorted({w for words in lexicons for w in words})
    out = out.withColumn("__hit", F.array_intersect("__w", F.array(*map(F.lit, every))) if every else F.array().cast("array<string>"))
    n, chars = F.col("tokens"), F.length(text)
    share = lambda count: F.sqrt(count / F.greatest(chars, F.lit(1)))
    exclaims = chars - F.length(F.replace(text, F.lit("!"), F.lit("")))
    kinds = F.size(F.array_distinct("__w"))
    x = [
        share(chars - F.length(F.translate(text, SYMBOLS, ""))),
        share(chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))),
        share(exclaims),
        F.log1p(n) - F.log1p(kinds),
        F.log1p(chars) - F.log1p(n),
        *[F.least(F.lit(4.0), F.log1p(F.size(F.array_intersect("__hit", F.array(*map(F.lit, words)))))) for words in lexicons],
    ]
    return out.withColumn("x", F.array(*[c.cast("double") for c in x])).drop("__w", "__hit")


@dataclass
class Classifier:
    domains: list[str]
    prior: np.ndarray
    mean: np.ndarray  # domains by features
    variance: np.ndarray
    lexicons: list[list[str]]
    residual: float = 0.0  # largest miss of a target that the fitted rates leave, as a share of all targets

    def posterior(self, x: str = "x") -> Column:
        """An array of posteriors in the order of ``domains``."""
        scores = []
        for k in range(len(self.domains)):
            s = F.lit(float(math.log(self.prior[k]) - 0.5 * np.log(self.variance[k]).sum()))
            for j in range(self.mean.shape[1]):
                d = F.col(x)[j] - float(self.mean[k, j])
                s = s - d * d / float(2 * self.variance[k, j])
            scores.append(s)
        if len(scores) == 1:
            return F.array(F.lit(1.0))
        top = F.greatest(*scores)
        powers = F.array(*[F.exp(s - top) for s in scores])
        return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _share(salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit_classifier(docs: DataFrame, labelled: DataFrame, rows: int = ROWS) -> Classifier:
    """From labelled rows (doc_id, domain). Broadcast: at most about ``rows`` labels of each domain."""
    one = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["n"] for r in one.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Classifier(["all"], np.ones(1), np.zeros((1, 5)), np.ones((1, 5)), [])
    rate = F.create_map(*[F.lit(v) for d, n in sizes.items() for v in (d, min(1.0, rows / n))])
    chosen = one.filter(_share(5) < rate[F.col("domain")])
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    lexicons = _lexicons(sample, sorted(sizes))
    lexicons = [w for w in lexicons if w]
    measured = features(sample, lexicons)
    size = 5 + len(lexicons)
    sums = [F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(size)] + [F.sum(F.col("x")[j] * F.col("x")[j]).alias(f"q{j}") for j in range(size)]
    got = {r["domain"]: r for r in measured.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    domains = sorted(got)
    if not domains:
        return Classifier(["all"], np.ones(1), np.zeros((1, 5)), np.ones((1, 5)), [])
    n = np.array([[got[d]["n"]] for d in domains], float)
    mean = np.array([[got[d][f"s{j}"] for j in range(size)] for d in domains]) / n
    square = np.array([[got[d][f"q{j}"] for j in range(size)] for d in domains]) / n
    pooled = ((square - mean**2) * n).sum(0) / n.sum()
    variance = (n * np.maximum(square - mean**2, 0) + 5 * pooled) / (n + 5) + 0.02 * pooled + 1e-4
    total = sum(sizes.values())
    return Classifier(domains, np.array([sizes[d] / total for d in domains]), mean, variance, lexicons)


def _lexicons(sample: DataFrame, domains: list[str]) -> list[list[str]]:
    """For each domain the words that have far more distinct left neighbours there than elsewhere."""
    w = sample.select("domain", _words(F.col("text")).alias("w"))
    pairs = w.select("domain", F.explode(F.arrays_zip(F.col("w").alias("w"), F.concat(F.array(F.lit("")), F.col("w")).alias("p"))).alias("x"))
    pairs = pairs.filter("length(x.w) between 3 and 64").select("domain", F.col("x.w").alias("w"), F.xxhash64("x.p").alias("p")).distinct()
    counts = materialise(pairs.groupBy("w").pivot("domain", domains).agg(F.count(F.lit(1))).na.fill(0))
    n = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for d in domains:
        others = sum((F.col(f"`{o}`") for o in domains if o != d), F.lit(0))
        n_others = sum(v for o, v in n.items() if o != d)
        lift = F.log((F.col(f"`{d}`") + 0.5) / (n.get(d, 0) + 1)) - F.log((others + 0.5) / (n_others + 1))
        typical = counts.filter((F.col(f"`{d}`") >= max(5, MIN_SUPPORT * n.get(d, 0))) & (lift > math.log(MIN_RATIO)))
        out.append([r["w"] for r in typical.orderBy(F.desc(F.col(f"`{d}`") * lift), "w").limit(LEXICON).collect()])
    return out


def _rate(steps: list[list[float]], p: str = "p", most: float | None = None) -> Column:
    """The rate after all steps, from the posteriors, between 0 and ``most``."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    table = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    k = len(steps[0])
    high = lambda r: r if most is None else F.least(F.lit(float(most)), r)
    return F.aggregate(table, rate, lambda r, s: F.greatest(F.lit(0.0), high(r - sum((F.col(p)[i] * s[i] for i in range(1, k)), F.col(p)[0] * s[0]))))


def fit_rates(members: DataFrame, targets: list[float], passes: int = PASSES, tolerance: float = TOLERANCE, most: float | None = None) -> tuple[list[list[float]], float]:
    """Steps of projected gradient for rows with ``tokens`` and posteriors ``p``, and the largest miss they leave, as a
    share of all targets; targets are tokens of each domain."""
    k = len(targets)
    t = np.array(targets, float)
    scale = max(t.sum(), 1.0)

    def state(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rated = members.withColumn("r", _rate(steps, most=most))
        mass = [F.sum(F.col("r") * F.col("tokens") * F.col("p")[i]).alias(f"m{i}") for i in range(k)]
        inside = F.col("r") > 0 if most is None else (F.col("r") > 0) & ((F.col("r") < most) | F.lit(not steps))
        active = F.when(inside, F.col("tokens")).otherwise(0)
        second = [F.sum(active * F.col("p")[i] * F.col("p")[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        got = rated.agg(*mass, *second).first()
        m = np.array([got[f"m{i}"] or 0.0 for i in range(k)])
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return (m - t) / scale, h / scale

    steps: list[list[float]] = []
    residual, second = state(steps)
    # with steps this short a plain gradient step always descends: the metric is 1/tokens, so this is the curvature of all rows
    curvature = float(np.linalg.eigvalsh(second)[-1]) or 1.0
    size = 1.0
    for _ in range(passes):
        if np.abs(residual).max() <= tolerance:
            break
        scaled = size >= SHORTEST
        step = size * np.linalg.solve(second + (1e-9 * np.trace(second) / k + 1e-15) * np.eye(k), residual) if scaled else residual / curvature
        tried = [*steps, [float(v) for v in step]]
        new_residual, new_second = state(tried)
        gained = 1 - (new_residual**2).sum() / (residual**2).sum()
        if gained > 0:
            steps, residual, second = tried, new_residual, new_second
        if not scaled and gained < LEAST_GAIN:
            break
        size = min(1.0, 2 * size) if scaled and gained > LEAST_GAIN else size / 2 if scaled else 1.0
    return steps, float(np.abs(residual).max())


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a label table: junk if the quality is 0, else toxic or clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality").isNotNull(), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0, most: float | None = None, whole: str | None = None) -> tuple[DataFrame, Classifier]:
    """Rows (doc_id, t, tokens, p, domain, rate, u) of all documents. ``weights``: the share of the tokens that a domain
    is to get (unknown domains are left out, domains without a weight get none); ``budget``: tokens of the mixture as
    a multiple of those there are, or, with ``whole``, as many as give that domain its weight with all its tokens;
    ``most``: upper bound of a rate. ``t`` is a hash of the text, ``u`` a uniform number from doc_id, to draw with."""
    model = fit_classifier(docs, labelled)
    members = features(docs.select("doc_id", "text"), model.lexicons)
    members = materialise(members.select("doc_id", F.xxhash64("text").alias("t"), "tokens", model.posterior().alias("p")))
    masses = [F.sum(F.col("tokens") * F.col("p")[i]).alias(f"m{i}") for i in range(len(model.domains))]
    masses = np.array([v or 0.0 for v in members.agg(*masses).first()], float)
    wanted = np.array([weights.get(d, 0.0) for d in model.domains])
    wanted = wanted / wanted.sum() if wanted.sum() > 0 else np.full(len(wanted), 1 / len(wanted))
    total = budget * masses.sum()
    if whole in model.domains and wanted[at := model.domains.index(whole)] > 0:
        total = masses[at] / wanted[at]
    steps, model.residual = fit_rates(members, [float(v) for v in wanted * total], most=most)
    best = F.array_max(F.col("p"))
    names = F.array(*map(F.lit, model.domains))
    rated = members.withColumns({"rate": _rate(steps, most=most), "domain": F.element_at(names, F.array_position("p", best).cast("int")), "u": F.coalesce(_share(6), F.lit(0.0))})
    return rated, model


#: Shares of tokens by domain.
WEIGHTS = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The query: doc_id, tokens, domain, posterior_<domain>, rate, copies (the rate rounded up or down by chance)."""
    rated, model = mix(docs, domains_of(labels), weights)
    posteriors = [F.col("p")[i].alias(f"posterior_{d}") for i, d in enumerate(model.domains)]
    return rated.select("doc_id", "tokens", "domain", *posteriors, "rate", F.floor(F.col("rate") + F.col("u")).cast("bigint").alias("copies"))
