"""Mixing documents to target weights with soft domain memberships.

A softmax classifier learned from the labels table gives every document a posterior over
the domains good, poor and toxic. Rates of documents, none below ``floor``, are then
fitted so that the expected tokens of each domain meet their targets: projected gradient
steps on weighted least squares with a small pull towards rate 1. A document's rate
depends only on its posterior and the residuals of the steps so far, so a step is one
aggregation over the table of posteriors, and only one number per domain comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.lm import held_out
from baitline.llm.samples import draw, labelled
from baitline.llm.tables import bounded_batches, written
from baitline.llm.words import Words, runs
from baitline.llm.worker import release

ship_with_tasks(__name__)

DOMAINS = ("good", "poor", "toxic")
BUCKETS, SHAPES = 1 << 15, 6
#: The most labelled documents of each domain that the classifier is fitted on, in the order of a hash of their ids, and their bytes in all.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 48 << 20
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.3, 1e-5
#: The most steps; the share of tokens a domain may miss its target by; by how much the total grows where the floor keeps targets out of reach.
STEPS, CLOSE_ENOUGH, GROWTH = 40, 5e-4, 1.05
PULL = 1e-3
_UPPER, _LETTER = np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def _features(run: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, and of every text: its size, and its shares of distinct, short and neighbouring equal words, capitals and other signs."""
    buckets = (run.hashes % np.uint64(BUCKETS)).astype(np.int64)
    n, of = len(run.counts), run.text_of()
    per = np.maximum(run.counts, 1)
    distinct = np.bincount(np.unique(of * (1 << 32) + (run.hashes >> np.uint64(32)).astype(np.int64)) >> 32, minlength=n)
    same = np.zeros(len(of))
    same[1:] = (run.hashes[1:] == run.hashes[:-1]) & (of[1:] == of[:-1])
    size = (run.ends - run.starts).astype(float)
    upper, letters = (np.concatenate([[0], np.cumsum(t[run.data], dtype=np.int64 if len(run.data) >> 31 else np.int32)]) for t in (_UPPER, _LETTER))
    total = lambda x: np.bincount(of, weights=x, minlength=n)
    chars = np.maximum(total(size), 1)
    shapes = np.stack([
        np.log1p(run.counts) / 5, distinct / per, total(same) / per, total(size <= 2) / per,
        total(upper[run.ends] - upper[run.starts]) / chars, 1 - total(letters[run.ends] - letters[run.starts]) / chars,
    ], axis=1)
    return buckets, shapes


@dataclass
class Classifier:
    """Weights of words (BUCKETS, K), of shapes (SHAPES, K) and of domains (K)."""

    words: np.ndarray
    shapes: np.ndarray
    prior: np.ndarray

    def posteriors(self, run: Words) -> np.ndarray:
        buckets, shapes = _features(run)
        n, of = len(run.counts), run.text_of()
        scale = 1 / np.sqrt(np.maximum(run.counts, 1))
        z = np.stack([np.bincount(of, weights=self.words[buckets, k], minlength=n) for k in range(len(DOMAINS))], axis=1) * scale[:, None]
        z += shapes @ self.shapes + self.prior
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _fit(texts: pa.Array, domain: np.ndarray, shares: np.ndarray) -> Classifier:
    """Adagrad on minibatches of a sample; the log shares of all labels replace those of the sample."""
    words, bounds, shapes = [], [0], []
    for run in runs(texts, lower=False):
        b, s = _features(run)
        words.append(b)
        shapes.append(s)
        bounds += (bounds[-1] + run.first[1:]).tolist()
    k, rng = len(DOMAINS), np.random.default_rng(3)
    w, v = np.zeros((BUCKETS, k)), np.zeros((SHAPES, k))
    counts = np.bincount(domain, minlength=k).astype(float)
    prior = np.log(np.maximum(counts / max(counts.sum(), 1), 1e-9))
    if len(domain):
        words_all, shapes_all, bounds_all = np.concatenate(words), np.concatenate(shapes), np.array(bounds)
        seen_w, seen_v, truth = np.full((BUCKETS, k), 1e-3), np.full((SHAPES, k), 1e-3), np.eye(k)[domain]
        for _ in range(EPOCHS):
            order = rng.permutation(len(domain))
            for i in range(0, len(order), BATCH):
                rows = order[i:i + BATCH]
                sizes = bounds_all[rows + 1] - bounds_all[rows]
                own = np.concatenate([words_all[bounds_all[r]:bounds_all[r + 1]] for r in rows])
                of, scale = np.repeat(np.arange(len(rows)), sizes), 1 / np.sqrt(np.maximum(sizes, 1))
                z = np.stack([np.bincount(of, weights=w[own, j], minlength=len(rows)) for j in range(k)], axis=1) * scale[:, None]
                z += shapes_all[rows] @ v + prior
                p = np.exp(z - z.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - truth[rows]) / len(rows)
                touched, inverse = np.unique(own, return_inverse=True)
                spread = (g * scale[:, None])[of]
                change = np.stack([np.bincount(inverse, weights=spread[:, j], minlength=len(touched)) for j in range(k)], axis=1) + DECAY * w[touched]
                seen_w[touched] += change**2
                w[touched] -= RATE * change / np.sqrt(seen_w[touched])
                change = shapes_all[rows].T @ g
                seen_v += change**2
                v -= RATE * change / np.sqrt(seen_v)
    return Classifier(w, v, np.log(np.maximum(shares, 1e-9)))


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels that are not held out; several labels of a document count as toxic or poor if one is."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id"),
    ).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).filter(~held_out())
    return known.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain"))


def fit_on(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on at most SAMPLE_ROWS documents of each domain and SAMPLE_BYTES of text; shares come from all labels of these documents."""
    bounded_batches(docs.sparkSession)
    found = labelled(docs, domain_labels(labels).withColumnRenamed("domain", "label"))
    counts = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(counts.values()))
    shares = np.array([counts.get(k, 0) / total for k in range(len(DOMAINS))]) if counts else np.full(len(DOMAINS), 1 / len(DOMAINS))
    # as many rows and bytes as the sample's limits allow, whatever the tables hold
    sample = draw(docs, found, {k: SAMPLE_ROWS for k in range(len(DOMAINS))}, SAMPLE_BYTES).toArrow().combine_chunks()
    if not sample.num_rows:
        return _fit(pa.array([], pa.string()), np.empty(0, np.int64), shares)
    sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    model = _fit(sample.column("text").combine_chunks(), sample.column("label").to_numpy().astype(np.int64), shares)
    del sample
    release()
    return model


def with_posterior(docs: DataFrame, model: Classifier, out: str) -> DataFrame:
    """``docs`` with the posterior of each text as array ``out``, in one pass over the rows."""
    arrays = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("array<double>")
    def posterior(texts: pa.Array) -> pa.Array:
        loaded = Classifier(**arrays.value)
        found = [loaded.posteriors(run) for run in runs(texts, lower=False)]
        p = np.concatenate(found) if found else np.empty((0, len(DOMAINS)))
        release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(DOMAINS), pa.int32()), pa.array(p.reshape(-1)))

    return docs.withColumn(out, posterior(F.coalesce("text", F.lit(""))))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every row; tokens are words."""
    rows = with_posterior(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "posterior")
    spaced = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.select("doc_id", spaced.cast("long").alias("n_tokens"), "posterior")


def rate(posterior: Column, steps: list[np.ndarray], floor: float) -> Column:
    """A document's rate after the given steps, each one number per domain."""
    start = F.lit(float(max(1.0, floor)))
    if not steps:
        return start
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in u]) for u in steps])

    def step(so_far: Column, move: Column) -> Column:
        along = F.aggregate(F.zip_with(posterior, move, lambda p, m: p * m), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(F.lit(float(floor)), so_far - (along + F.lit(PULL) * (so_far - start)) / (1 + PULL))

    return F.aggregate(moves, start, step)


@dataclass
class Fit:
    """Steps for ``rate``, and by domain the shares of the present tokens that were aimed at and reached."""

    steps: list[np.ndarray]
    target: np.ndarray
    reached: np.ndarray

    @property
    def residual(self) -> float:
        """The largest share by which a listed domain misses its part of the listed domains' tokens."""
        listed = ~np.isnan(self.target)
        target, reached = self.target[listed], self.reached[listed]
        if not target.any():
            return 0.0
        return float(np.abs(reached / max(reached.sum(), 1e-300) - target / target.sum()).max())


def fit_rates(members: DataFrame, weights: dict[str, float], floor: float = 0.0, growth: float = GROWTH) -> Fit:
    """Steps whose ``rate`` brings the expected tokens of the domains in proportion to ``weights``.

    Domains that ``weights`` does not list take what falls to them. Rates are at least ``floor``.
    With floor 0 the total of tokens stays as it is. With a higher one it starts where no
    domain must go below floor times its tokens; what raises one domain's tokens raises a
    little of the others' too, so the total grows by ``growth`` each time that the steps come
    no closer, until targets are met; with growth 1 it stays and the steps end at the least squares. Least squares are weighted by the inverse of the
    memberships' second moments over the documents that are not held at the floor. After
    STEPS steps the closest ones so far count; ``residual`` says what is missed, as where
    a domain has no tokens at all.
    """
    k = len(DOMAINS)
    tokens, posterior = F.col("n_tokens"), F.col("posterior")

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        rated = members.withColumn("rate", rate(posterior, steps, floor))
        free = F.when((F.col("rate") > floor) | F.lit(not steps), tokens).otherwise(0)
        found = rated.agg(
            F.sum("n_tokens").alias("n"), *[F.sum(tokens * F.col("rate") * posterior[i]).alias(f"s{i}") for i in range(k)],
            *[F.sum(free * posterior[i] * posterior[j]).alias(f"c{i * k + j}") for i in range(k) for j in range(k)],
        ).first()
        n = float(found["n"] or 0)
        scaled = lambda x, size: np.array([found[f"{x}{i}"] or 0.0 for i in range(size)]) / max(n, 1.0)
        return scaled("s", k), scaled("c", k * k).reshape(k, k), n

    reached, moment, n = sums([])
    if not n:
        return Fit([], np.zeros(k), np.zeros(k))
    whole = moment
    held = reached / max(1.0, floor)
    share = np.array([weights.get(d, np.nan) for d in DOMAINS])
    listed = ~np.isnan(share)
    share[listed] *= held[listed].sum() / share[listed].sum()
    some = listed & (share > 0) & (held > 0)
    total = 1.0 if floor <= 0 or not some.any() else max(1.0, floor * float((held[some] / share[some]).max()))
    target = share * total
    missed = lambda: (reached - target)[listed]
    steps: list[np.ndarray] = []
    best = Fit([], target, reached)
    for _ in range(STEPS if some.any() else 0):
        if np.abs(missed()).max() < CLOSE_ENOUGH:
            break
        # free documents carry the step; a tenth of the whole moment keeps it finite where few are free
        step, inner = np.zeros(k), (moment + 0.1 * whole)[np.ix_(listed, listed)]
        step[listed] = np.linalg.pinv(inner, rcond=1e-6) @ missed()
        steps.append(step)
        last = np.abs(missed()).max()
        reached, moment, _ = sums(steps)
        now = Fit(list(steps), target, reached)
        if now.residual < best.residual or growth == 1:
            best = now
        if floor > 0 and np.abs(missed()).max() > 0.5 * last:
            total *= growth
            target = share * total
    return best


def fit_steps(members: DataFrame, weights: dict[str, float], floor: float = 0.0) -> list[np.ndarray]:
    """Steps to the least squares at the total that ``fit_rates`` begins with."""
    return fit_rates(members, weights, floor, growth=1.0).steps


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], floor: float = 0.0) -> DataFrame:
    """One row for every row of documents: doc_id, n_tokens, the posteriors ``good``, ``poor`` and ``toxic``, and ``rate``.

    Null and empty texts have no tokens and the posterior of a text without words. Null
    doc_ids stay null, repeated rows each get a rate, other columns are left out. Without
    labels the posteriors are even. The table of posteriors is written once.
    """
    members = written(memberships(docs, fit_on(docs, labels)), "memberships")
    steps = fit_rates(members, weights, floor).steps
    shares = [F.col("posterior")[k].alias(d) for k, d in enumerate(DOMAINS)]
    return members.select("doc_id", "n_tokens", *shares, rate(F.col("posterior"), steps, floor).alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], floor: float = 1.0) -> DataFrame:
    """``docs`` with every row as often as its rate says, fractions decided by a hash of its doc_id.

    With floor 1 every row stays at least once. Columns stay as they are. Posteriors are
    found twice, once to fit and once to apply, so that no text is shuffled.
    """
    model = fit_on(docs, labels)
    steps = fit_rates(written(memberships(docs, model), "memberships"), weights, floor).steps
    rated = with_posterior(docs, model, "__posterior")
    times = copies(rate(F.col("__posterior"), steps, floor), F.col("doc_id"))
    numbered = rated.withColumn("__copies", times).filter(F.col("__copies") > 0)
    return numbered.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*[numbered[c] for c in docs.columns])


def copies(rate: Column, key: Column) -> Column:
    """A whole number of copies whose mean over keys is the rate: the rate rounded by a hash of the key."""
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + draw).cast("int")
