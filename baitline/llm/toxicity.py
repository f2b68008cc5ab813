"""Toxicity scores from a convolutional text classifier.

Words get the sum of three hashed embeddings (the word without closing punctuation, its
first four and its first six bytes). Filters of widths 1, 2 and 3 slide over the whole
text, each keeps its maximum, and a logistic layer scores the maxima. The model is
trained in numpy on a bounded sample of labelled texts; a part of that sample sets one
threshold for each language, which is guessed from the text's function words, and the
score is shifted so that the threshold lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.lm import held_out
from baitline.llm.samples import draw, labelled
from baitline.llm.tables import bounded_batches
from baitline.llm.words import Words, mix, runs
from baitline.llm.worker import release, tidy

ship_with_tasks(__name__)

BUCKETS, DIMENSIONS, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
PREFIXES = (4, 6)
#: The most labelled texts of each class that training takes, in the order of a hash of their ids, and their bytes in all.
SAMPLE_ROWS, SAMPLE_BYTES = {1: 2500, 0: 5000}, 48 << 20
#: Words that are convolved together, so that a very long text is held in parts.
SLICE_WORDS = 1 << 14
EPOCHS, LEAST_STEPS, BATCH, RATE, CALIBRATION = 8, 700, 64, 0.1, 5
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "be", "by", "on", "not", "this", "are", "or"],
    "fr": ["le", "la", "les", "et", "un", "une", "du", "des", "que", "pour", "dans", "est", "au", "par", "avec", "sur", "ne", "pas"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "ein", "eine", "ist", "im", "dem", "nicht", "für", "auf", "sich", "des"],
    "es": ["el", "los", "las", "y", "por", "con", "del", "se", "lo", "como", "más", "pero", "sus", "su", "al", "para", "una", "es"],
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[list(b".,!?;:)\"'")] = True
_OFFSETS = [(w, o) for w in WIDTHS for o in range(w)]


def _eight(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start, packed into one number."""
    packed = np.zeros(len(start), dtype=np.uint64)
    for j in range(8):
        byte = data[np.minimum(start + j, len(data) - 1)].astype(np.uint64) << np.uint64(8 * j)
        packed |= np.where(size > j, byte, np.uint64(0))
    return packed


def word_buckets(run: Words) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (n, 3) of a run's words, and their hashes without closing punctuation."""
    if not len(run.starts):
        return np.empty((0, 1 + len(PREFIXES)), np.uint16), np.empty(0, np.uint64)
    ends = run.ends.copy()
    for _ in range(3):
        ends -= _CLOSING[run.data[ends - 1]] & (ends - 1 > run.starts)
    size = ends - run.starts
    head = _eight(run.data, run.starts, size)
    tail = _eight(run.data, np.maximum(ends - 8, run.starts), size)
    whole = mix(head ^ (mix(tail) + size.astype(np.uint64)))
    columns = [whole]
    for p in PREFIXES:
        columns.append(mix((head & np.uint64((1 << 8 * p) - 1)) + np.uint64(p << 56)))
    return np.stack([(c % np.uint64(BUCKETS)).astype(np.uint16) for c in columns], axis=1), whole


def _function_table() -> np.ndarray:
    table = np.full(1 << 16, len(LANGUAGES) - 1, dtype=np.int64)
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        for run in runs(pa.array([" ".join(listed)])):
            table[(word_buckets(run)[1] % np.uint64(1 << 16)).astype(np.int64)] = k
    return table


def language_votes(run: Words, whole: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many words of each text are function words of each language."""
    n, k = len(run.counts), len(LANGUAGES)
    return np.bincount(run.text_of() * k + table[(whole % np.uint64(1 << 16)).astype(np.int64)], minlength=n * k).reshape(n, k)


def guess_languages(votes: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES for each text: the language with most function words, else ``other``."""
    n, k = votes.shape
    best = votes[:, :-1].argmax(axis=1)
    return np.where(votes[np.arange(n), best] > 0, best, k - 1)


def _convolved(mapped: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Filter outputs (words, widths * FILTERS): words past a text's end add nothing."""
    last = first[1:] - 1
    out, at = [], 0
    for w in WIDTHS:
        total = mapped[:, at * FILTERS:(at + 1) * FILTERS].copy()
        for o in range(1, w):
            part = mapped[:, (at + o) * FILTERS:(at + o + 1) * FILTERS]
            shifted = np.zeros_like(part)
            shifted[:-o] = part[o:]
            for back in range(o):
                rows = last - back
                shifted[rows[rows >= first[:-1]]] = 0
            total += shifted
        out.append(total)
        at += w
    return np.concatenate(out, axis=1)


def _pooled(conv: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest positive output of every filter for each text; 0 without words."""
    out = np.zeros((len(first) - 1, conv.shape[1]), dtype=conv.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(conv, first[some], axis=0)
    return np.maximum(out, 0, out=out)


@dataclass
class Classifier:
    """``mapped``: per bucket the embedding times all filters; thresholds (logits) by LANGUAGES."""

    mapped: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def logits(self, run: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text of a run."""
        n = len(run.counts)
        pooled, votes = np.zeros((n, len(self.bias)), self.mapped.dtype), np.zeros((n, len(LANGUAGES)), np.int64)
        for part, own in run.parts(SLICE_WORDS, beyond=max(WIDTHS) - 1):
            ids, whole = word_buckets(part)
            mapped = self.mapped[ids[:, 0]]
            for k in range(1, ids.shape[1]):
                mapped += self.mapped[ids[:, k]]
            # filters that begin in the words beyond belong to the next part
            conv = _convolved(mapped, part.first)[:own]
            conv += self.bias
            first = np.minimum(part.first, own)
            np.maximum(pooled, _pooled(conv, first), out=pooled)
            kept = Words(part.row, part.hashes[:own], first, part.data, part.starts[:own], part.ends[:own])
            votes += language_votes(kept, whole[:own], table)
        return pooled @ self.weights + self.intercept, guess_languages(votes)


def _strongest(ids: np.ndarray, emb: np.ndarray, filt: np.ndarray, bias: np.ndarray, pooled: np.ndarray, top: np.ndarray) -> None:
    """Put the largest positive output of every filter over one text into ``pooled``, and where its word is into ``top``."""
    for low in range(0, len(ids), SLICE_WORDS):
        part = ids[low:low + SLICE_WORDS + max(WIDTHS) - 1]
        conv = _convolved(emb[part].sum(axis=1) @ filt, np.array([0, len(part)]))[:SLICE_WORDS] + bias
        at = conv.argmax(axis=0)
        best = conv[at, np.arange(len(bias))]
        higher = best > pooled
        pooled[higher], top[higher] = best[higher], low + at[higher]


def _train(ids: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Classifier:
    """Adagrad on minibatches; only the words that won a maximum carry gradients."""
    rng = np.random.default_rng(seed)
    wide = len(_OFFSETS) * FILTERS
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    filt = rng.normal(0, 0.3, (DIMENSIONS, wide)).astype(np.float32)
    bias, weights, intercept = np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0
    seen = [np.full(x, 1e-4, np.float32) for x in (BUCKETS, filt.shape, bias.shape, weights.shape, ())]
    column = [(w, o, k * FILTERS) for k, (w, o) in enumerate(_OFFSETS)]

    def step(value, grad, k):
        seen[k] = seen[k] + grad**2
        return value - RATE * grad / np.sqrt(seen[k])

    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(ids))))):
        order = rng.permutation(len(ids))
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            pooled, top = np.zeros((len(rows), len(bias)), np.float32), np.zeros((len(rows), len(bias)), np.int64)
            for d, r in enumerate(rows):
                _strongest(ids[r], emb, filt, bias, pooled[d], top[d])
            p = 1 / (1 + np.exp(-np.clip(pooled @ weights + intercept, -30, 30)))
            g = ((p - y[rows]) / len(rows)).astype(np.float32)
            back = g[:, None] * weights * (pooled > 0)
            hit = []
            for d in np.flatnonzero(back.any(axis=1)):
                for w, o, at in column:
                    f = slice((w - 1) * FILTERS, w * FILTERS)
                    place = top[d][f] + o
                    ok = place < len(ids[rows[d]])
                    hit.append((ids[rows[d]][place[ok]], (at + np.arange(FILTERS))[ok], back[d][f][ok]))
            if hit:
                # one row of words, filter column and gradient for each winner
                words, col, value = (np.concatenate(x) for x in zip(*hit, strict=True))
                vectors, to_words = emb[words].sum(axis=1), value[:, None] * filt.T[col]
                change = np.zeros_like(filt)
                np.add.at(change.T, col, value[:, None] * vectors)
                filt = step(filt, change, 1)
                touched, inverse = np.unique(words, return_inverse=True)
                change = np.zeros((len(touched), DIMENSIONS), np.float32)
                np.add.at(change, inverse.reshape(-1), np.repeat(to_words, words.shape[1], axis=0))
                seen[0][touched] += (change**2).mean(axis=1)
                emb[touched] -= RATE * change / np.sqrt(seen[0][touched])[:, None]
                bias = step(bias, back.sum(axis=0), 2)
            weights = step(weights, pooled.T @ g, 3)
            intercept = float(step(intercept, g.sum(), 4))
    return Classifier(emb @ filt, bias, weights, intercept)


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors; the middle of the gap where classes are apart."""
    order = np.argsort(logits)
    z, t = logits[order], y[order]
    missed = np.concatenate([[0], np.cumsum(t)])
    false = len(t) - t.sum() - np.concatenate([[0], np.cumsum(1 - t)])
    cost = missed + false
    best = np.flatnonzero(cost == cost.min())
    k = best[len(best) // 2]
    low, high = z[k - 1] if k else z[0] - 1, z[k] if k < len(z) else z[-1] + 1
    return float((low + high) / 2)


def fit(texts: pa.Array, toxic: np.ndarray) -> Classifier:
    """Train on labelled texts; every fifth of them only calibrates thresholds. Needs both classes, else scores are constant."""
    ids: list[np.ndarray] = []
    for run in runs(texts):
        rows = word_buckets(run)[0]
        ids += [rows[run.first[i]:run.first[i + 1]].copy() for i in range(len(run.counts))]
    y = toxic.astype(np.float32)
    hold = np.arange(len(y)) % CALIBRATION == 0
    if len(set(y[~hold].tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        width = len(_OFFSETS) * FILTERS
        return Classifier(
            np.zeros((BUCKETS, width), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32),
            np.zeros(len(WIDTHS) * FILTERS, np.float32), 5.0 if share > 0.5 else -5.0,
        )
    model = _train([x for x, h in zip(ids, hold, strict=True) if not h], y[~hold])
    table, logits, languages = _function_table(), [], []
    held = texts.filter(pa.array(hold))
    for run in runs(held):
        z, lang = model.logits(run, table)
        logits.append(z)
        languages.append(lang)
    z, lang, t = np.concatenate(logits), np.concatenate(languages), y[hold]
    overall = _threshold(z, t) if 0 < t.sum() < len(t) else 0.0
    for k in range(len(LANGUAGES)):
        own = lang == k
        enough = min((t[own] == 1).sum(), (t[own] == 0).sum()) >= 10
        model.thresholds[k] = _threshold(z[own], t[own]) if enough else overall
    return model


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of at most SAMPLE_ROWS labelled documents of each class and SAMPLE_BYTES of text, none held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("label"),
    ).filter(~held_out())
    return draw(docs, labelled(docs, known), SAMPLE_ROWS, SAMPLE_BYTES).withColumnRenamed("label", "toxic")


def fit_on(docs: DataFrame, labels: DataFrame) -> Classifier:
    bounded_batches(docs.sparkSession)
    # as many rows and bytes as the sample's limits allow, whatever the tables hold
    sample = training_sample(docs, labels).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    if not sample.num_rows:
        return fit(pa.array([], pa.string()), np.empty(0))
    shuffled = np.random.default_rng(1).permutation(sample.num_rows)
    sample = sample.take(pa.array(shuffled))
    model = fit(sample.column("text").combine_chunks(), sample.column("toxic").to_numpy())
    del sample
    release()
    return model


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score, predicted) of every row: null and empty texts score as texts without any signal.

    Null doc_ids stay null, repeated rows are each scored, other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    arrays = docs.sparkSession.sparkContext.broadcast(vars(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, table = Classifier(**arrays.value), _function_table()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for run in runs(batch.column(1)):
                z, language = loaded.logits(run, table)
                z = np.clip(z - loaded.thresholds[language], -60, 60)
                out[run.row:run.row + len(z)] = 1 / (1 + np.exp(-z))
            predicted = pa.array((out >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), predicted], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(work), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs`` that the model does not find toxic, with all their columns, in one pass."""
    bounded_batches(docs.sparkSession)
    arrays = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        loaded, table = Classifier(**arrays.value), _function_table()
        out = [loaded.logits(run, table) for run in runs(texts)]
        below = [z < loaded.thresholds[language] for z, language in out]
        release()
        return pa.array(np.concatenate(below) if below else np.empty(0, bool))

    return docs.filter(clean(F.coalesce("text", F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that are not held out and score every document."""
    return score(docs, fit_on(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
