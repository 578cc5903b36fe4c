"""Mixing to target weights by soft domain membership, in DataFrame operations only.

A naive Bayes classifier over the hashed distinct words of a document, learned from a labelled table,
gives each document evidence for domains; only words that clearly tell domains apart count. A softmax
regression on that evidence, fitted on labelled rows that the word counts did not see, gives posteriors. Document d has a nonnegative rate r(d), the expected number of its copies; the
expected tokens of domain k are the sum of r(d) tokens(d) p(k | d). Projected gradient steps on the
squared distance from the targets fit the rates. A step is implicit: rates go along the gradient at the place where the
step ends, and to zero where they would be negative, so a step may be very long and never overshoots. Its K multipliers
(K domains) are the root of a convex function, found by Newton's method: each of its rounds is one aggregation over all documents, whose
K sums and K x K moments go to the driver. Rates have no upper bound and every domain is steered.

Training rows: at most about `per_domain` of each domain and `sample_rows` in all, chosen by a hash of the id; the model has
`BUCKETS` rows. All domains count, however many. Everything else covers all documents.

Defined results: a null text has no tokens and the posteriors of texts without evidence; texts of any length are split whole; equal
texts get equal posteriors and rates, and rows with equal ids are fitted each; null labels are left out; targets that no rates meet (a domain without
documents, posteriors that hardly differ) are met as far as they can be; without labels there is one domain, `all`; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import WORD_SPLIT, cut

BUCKETS = 1 << 17
#: Documents by which a word's counts are drawn to what is expected, and the least logarithm of a ratio that tells.
SHRINK, TELLING = 5.0, 0.7
#: Length of a step, against the largest moment of the posteriors, and number of steps.
STEP, STEPS = 1e6, 3
#: The same where documents are kept or dropped by the rates: a short step stays nearer to the start, so that a
#: target out of reach (a weak classifier, few labels) does not leave a few documents alone with all the weight.
SHORT = {"step": 100.0, "steps": 1}


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    priors: tuple[float, ...]
    #: bucket and l0, l1, ...: how much likelier a word of the bucket is in each domain, by logarithm; telling buckets only
    words: DataFrame | None
    #: softmax factors: a row a domain, for the evidence and one
    factors: np.ndarray | None = None


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _split(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SPLIT)


def _number(parts: Column) -> Column:
    """Words among the parts; only the first and the last can be empty."""
    return F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, per_domain: int = 4000, sample_rows: int = 32_000, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """labelled: id and domain."""
    known = labelled.where(F.col("domain").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "domain")
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a domain
    domains = tuple(sorted(sizes))
    per_domain = max(1, min(per_domain, sample_rows // max(1, len(domains))))
    if len(domains) < 2:
        return DomainModel(domains or ("all",), (1.0,), None)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    wanted = F.lit(False)
    for d in domains:
        wanted = wanted | ((F.col("domain") == d) & (draw < int((1 << 30) * min(1.0, per_domain / sizes[d]))))
    chosen = known.where(wanted).limit(2 * per_domain * len(domains))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(chosen), "id")  # bounded by the sample
    half = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("half")), F.lit(2))
    words = sample.where(half == 0).select("domain", F.explode(F.array_distinct(_split(F.col("body")))).alias("word")).where("word <> ''")
    counts = words.groupBy("domain", _bucket(F.col("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, d in enumerate(domains)))
    drawn = {r["domain"]: r["n"] for r in chosen.where(half == 0).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(sizes.values())
    rate = sum((F.col(f"n{k}") * (sizes[d] / whole / max(1, drawn.get(d, 0))) for k, d in enumerate(domains)), F.lit(0.0))
    ratios = [F.log((F.col(f"n{k}") + SHRINK) / (F.col("rate") * drawn.get(d, 0) + SHRINK)) for k, d in enumerate(domains)]
    telling = wide.withColumn("rate", rate).select("bucket", *(F.when(F.abs(r) >= TELLING, r).otherwise(0.0).alias(f"l{k}") for k, r in enumerate(ratios)))
    some = sum((F.abs(F.col(f"l{k}")) for k in range(1, len(domains))), F.abs(F.col("l0"))) > 0
    telling = cut(telling.where(some), "domain-model")
    seen = _evidence(sample.where(half == 1).select(F.monotonically_increasing_id().alias("row_id"), "domain", _split(F.col("body")).alias("parts")), telling, len(domains)).collect()  # of the bounded sample
    x = np.array([[r[f"f{i}"] for i in range(2 * len(domains))] + [1.0] for r in seen]).reshape(-1, 2 * len(domains) + 1)
    y = np.array([domains.index(r["domain"]) for r in seen], int)
    share = np.array([sizes[d] / whole for d in domains])
    present = np.bincount(y, minlength=len(domains)) / max(1, len(y))
    factors = _softmax(x, y, len(domains))
    factors[:, -1] += np.log(np.maximum(share, 1e-9) / np.maximum(present, 1e-9))  # domains were drawn at different rates
    return DomainModel(domains, tuple(share.tolist()), telling, factors)


def _softmax(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Multinomial regression with a ridge.

    Steps in a fixed metric that bounds the curvature from above (half the moments of x, whatever the domains), with
    Nesterov's momentum: one matrix as wide as x however many domains there are.
    """
    n, m = x.shape
    w = np.zeros((k, m))
    pull = np.full(m, ridge)
    pull[-1] = 1e-3
    hot = np.eye(k)[y] if n else np.zeros((0, k))
    bound = np.linalg.inv(x.T @ x / 2 + np.diag(pull))
    ahead, t = w, 1.0
    for _ in range(rounds):
        z = x @ ahead.T
        p = np.exp(z - z.max(1, keepdims=True)) if n else np.zeros((0, k))
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        slope = (p - hot).T @ x + pull * ahead
        new = ahead - slope @ bound
        if ((ahead - new) * (new - w)).sum() > 0:  # momentum leads astray: begin it anew
            t = 1.0
        grown = (1 + math.sqrt(1 + 4 * t * t)) / 2
        moved = np.abs(new - w).max()
        ahead, w, t = new + (t - 1) / grown * (new - w), new, grown
        if moved < 1e-7:
            break
    return w - w[0]


def _evidence(parts: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """For every row of parts (its other columns are keys): of each domain the sum of what speaks for it, by logarithm, and the mean of all evidence."""
    keys = [c for c in parts.columns if c != "parts"]
    met = parts.select(*keys, F.explode(F.array_distinct("parts")).alias("word")).withColumn("bucket", _bucket(F.col("word")))
    met = met.join(F.broadcast(words), "bucket", "left")  # at most BUCKETS rows
    sums = met.groupBy(*keys).agg(F.count("l0").alias("n"), *(F.coalesce(F.sum(F.greatest(F.col(f"l{i}"), F.lit(0.0))), F.lit(0.0)).alias(f"u{i}") for i in range(k)), *(F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)))
    return sums.select(*keys, *(F.log1p(f"u{i}").alias(f"f{i}") for i in range(k)), *((F.col(f"s{i}") / (1 + F.col("n"))).alias(f"f{k + i}") for i in range(k)))


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, text_hash, n_tokens and p0, p1, ... of every row of docs."""
    k = range(len(model.domains))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), _split(F.col(text_col)).alias("parts"))
    parts = rows.select("row_id", "doc_id", "text_hash", _number(F.col("parts")).cast("long").alias("n_tokens"), "parts")
    if model.words is None:
        return cut(parts.drop("parts").withColumn("p0", F.lit(1.0)), "posteriors")
    keys = ("row_id", "doc_id", "text_hash", "n_tokens")
    evidence = _evidence(parts, model.words, len(model.domains))
    factors = model.factors.tolist()
    logits = evidence.select(*keys, *(sum((F.col(f"f{j}") * w for j, w in enumerate(factors[i][:-1])), F.lit(factors[i][-1])).alias(f"s{i}") for i in k))
    top = F.greatest(*(F.col(f"s{i}") for i in k))
    scaled = logits.select(*keys, *(F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in k))
    total = sum((F.col(f"e{i}") for i in k[1:]), F.col("e0"))
    return cut(scaled.select(*keys, *((F.col(f"e{i}") / total).alias(f"p{i}") for i in k)), "posteriors")


def fit_rates(members: DataFrame, targets: list[float], start: float, step: float = STEP, steps: int = STEPS, rounds: int = 40, tolerance: float = 1e-4) -> DataFrame:
    """members with `rate`, zero or more; members: n_tokens and p0, p1, ... of each document, as written out; targets: tokens of each domain.

    start: the rate that every document has before the first step; rates stay near it where targets allow. Steps end
    when every target is met to `tolerance` of it; targets out of reach are met as far as least squares go. A shorter
    `step` weighs the distance from the targets against that from the start.
    """
    k = range(len(targets))
    goal = np.array(targets, float)

    def moved(rated: DataFrame, move: np.ndarray) -> DataFrame:
        slope = sum((F.col(f"p{i}") * float(move[i]) for i in k[1:]), F.col("p0") * float(move[0]))
        return rated.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - slope))

    def measured(rated: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        """(distance of each domain's tokens from its target; moments of the posteriors where the rate is not zero; half the squared rates)."""
        tokens, live = F.col("n_tokens") * F.col("rate"), F.when(F.col("rate") > 0, F.col("n_tokens"))
        sums = [F.sum(tokens * F.col(f"p{i}")) for i in k] + [F.sum(live * F.col(f"p{i}") * F.col(f"p{j}")) for i in k for j in k if j >= i]
        got = iter(rated.agg(F.coalesce(F.sum(tokens * F.col("rate")), F.lit(0.0)).alias("b"), *(F.coalesce(s, F.lit(0.0)).alias(f"a{n}") for n, s in enumerate(sums))).first())
        half = next(got) / 2
        gap = np.array([next(got) for _ in k]) - goal
        moments = np.zeros((len(goal), len(goal)))
        for i in k:
            for j in k[i:]:
                moments[i, j] = moments[j, i] = next(got)
        return gap, moments, half

    rated = members.withColumn("rate", F.lit(float(start)))
    gap, moments, half = measured(rated)
    stiff = max(float(np.linalg.eigvalsh(moments).max()), 1e-9) / step
    for _ in range(steps):
        if (np.abs(gap) <= tolerance * goal).all():
            break
        move, value, before = np.zeros(len(goal)), half, gap
        for _ in range(rounds):
            slope = stiff * move - gap  # of the convex function half + move . goal + stiff / 2 |move|^2
            if np.abs(slope).max() <= 0.1 * tolerance * max(float(goal.min()), 1e-3 * float(goal.max())):
                break
            newton = -np.linalg.solve(moments + stiff * np.eye(len(goal)), slope)
            part = 1.0
            while part > 1e-6:
                tried = move + part * newton
                new_gap, new_moments, new_half = measured(moved(rated, tried))
                new_value = new_half + float(tried @ goal) + stiff / 2 * float(tried @ tried)
                if new_value <= value + 1e-4 * part * float(newton @ slope) + 1e-12 * abs(value):
                    break
                part /= 4
            else:
                break
            move, gap, moments, value, half = tried, new_gap, new_moments, new_value, new_half
        rated = moved(rated, move)
        if np.linalg.norm(gap) > 0.999 * np.linalg.norm(before):
            break
    return rated


def copies(rate: Column, *keys: Column) -> Column:
    """rate rounded down or up, up with the probability of its fraction, decided by a hash of keys."""
    return F.floor(rate + F.pmod(F.xxhash64(*keys, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", **fitting: float) -> tuple[DataFrame, DomainModel]:
    """Rates of all documents for domain weights.

    fitting: parameters of fit_rates. budget: expected tokens of the mix; by default so many that the domain of the largest weight (of equal ones the larger) is used once.
    Other domains are thinned or repeated, so one that the corpus hardly holds does not take the mix with it.
    """
    model = fit_domains(docs, labelled, id_col=id_col, text_col=text_col)
    members = posteriors(docs, model, id_col, text_col)
    have = members.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{i}")), F.lit(0.0)) for i in range(len(model.domains)))).first()
    wanted = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    if not wanted.sum():
        wanted = np.ones(len(model.domains))
    wanted = wanted / wanted.sum()
    if budget is None:
        weight, tokens = max(((w, h) for w, h in zip(wanted, have, strict=True) if w and h), default=(1.0, 0.0))
        budget = tokens / weight
    whole = sum(have)
    rated = fit_rates(members, [float(budget * w) for w in wanted], budget / whole if whole else 1.0, **fitting)
    return rated, model


#: Domains of the labelled table and their weights.
WEIGHTS = {"good": 0.9, "low": 0.06, "toxic": 0.04}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and the domain that its labels say."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def document_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies of every document."""
    rated, model = mix(docs, label_domains(labels), WEIGHTS)
    return rated.select("doc_id", "n_tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(model.domains)), "rate", copies(F.col("rate"), F.col("doc_id"), F.col("text_hash")).alias("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as its copies say; rows with equal ids and texts follow the first of them."""
    rated, _ = mix(docs, label_domains(labels), WEIGHTS, **SHORT)
    often = rated.groupBy("doc_id", "text_hash").agg(F.max("rate").alias("rate"))
    often = often.select(F.col("doc_id").alias("__cf_id"), F.col("text_hash").alias("__cf_hash"), copies(F.col("rate"), F.col("doc_id"), F.col("text_hash")).alias("__cf_copies")).where("__cf_copies > 0")
    found = docs.withColumn("__cf_own", F.xxhash64("text")).join(often, F.col("doc_id").eqNullSafe(F.col("__cf_id")) & (F.col("__cf_own") == F.col("__cf_hash")))
    return found.withColumn("__cf_k", F.explode(F.sequence(F.lit(1), F.col("__cf_copies")))).select(*docs.columns)
