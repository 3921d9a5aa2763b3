"""Quality scores by positive-unlabelled learning.

A linear logistic model minimises the non-negative unbiased risk: trusted positives stand for class 1, web text as it
comes (labelled or not) for the mixture, and the class prior says how much of the mixture is positive, so that its
positive part can be subtracted; where the remaining estimate of the negatives' risk falls below zero, the step goes
back up instead. Labelled negatives are never used.

The prior is estimated from the mixture: two models, each fitted on one half (by hash of doc_id), score the other half.
Above a threshold lie at least prior times as many texts of the mixture as of the positives, so the prior is where the
two tails' ratio, with two standard errors added, is least. At the end the logit is scaled and shifted by the unbiased
risk with this prior, which needs no negatives either.

Features come from the whole text and nothing else: frequencies of bytes and of hashed byte pairs, and the shares of
repeated words and lines, lengths and the like. Weights are fitted on the driver on at most SAMPLE positives and SAMPLE
texts of the mixture (those of the smallest hash of doc_id); the prior and the logit's scale come from histograms of
the scores of all rows of the mixture. What reaches the driver doesn't depend on the input's size.

Defined cases: null and empty texts have the features of an empty text and get its score; repeated rows are scored
each and count each; without a positive everything scores PRIOR; a null doc_id is never sampled, but is in the
histograms; of repeated labels the largest counts, labels without a document do nothing; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .words import coded, slices, split_words

#: The most texts of either kind that the model is fitted on.
SAMPLE = 8000
PAIRS = 512
STATS = 12
FEATURES = 256 + PAIRS + STATS
#: Where the estimate of the prior begins, and the score of everything if there is nothing to learn from.
PRIOR = 0.5
#: Histograms of logits go from -LOGIT to LOGIT in steps of 1/STEP.
LOGIT, STEP = 64, 32
#: The pull of the logit's scale towards 1: where texts part well the unbiased risk alone would drive all scores to 0 or 1.
SCALE_PULL = 0.01


def _byte_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b"".join(x.as_buffer() for x in texts.cast(pa.binary())) if len(texts) else b""
    return np.frombuffer(joined, np.uint8), lengths


def _repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: the share of its items that came before in it, and that equal the one just before."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), 2))
    if len(codes):
        ordered = np.sort(doc * (int(codes.max()) + 1) + codes)
        distinct = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
        distinct_of = np.bincount(distinct // (int(codes.max()) + 1), minlength=len(n))
        same = np.zeros(len(codes), bool)
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        out[:, 0] = 1 - distinct_of / np.maximum(n, 1)
        out[:, 1] = np.bincount(doc[same], minlength=len(n)) / np.maximum(n, 1)
        out[n == 0] = 0
    return out


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    texts = pc.fill_null(texts, "")
    raw, lengths = _byte_parts(texts)
    k = len(lengths)
    doc = np.repeat(np.arange(k), lengths)
    size = np.maximum(lengths, 1)[:, None]
    counts = np.bincount(doc * 256 + raw, minlength=k * 256).reshape(k, 256)
    pair = (raw[:-1].astype(np.int64) * 37 + raw[1:]) * 2654435761 % 4294967296 * PAIRS // 4294967296 if len(raw) else np.zeros(0, np.int64)
    inside = doc[:-1] == doc[1:]
    pairs = np.bincount((doc[:-1] * PAIRS + pair)[inside], minlength=k * PAIRS).reshape(k, PAIRS)
    words, at = split_words(texts, lower=False)
    n_words = np.diff(at)
    codes, _ = coded(words)
    word_repeats = _repeats(codes, at)
    lines = pc.split_pattern(texts, "\n")
    line_at = lines.offsets.to_numpy().astype(np.int64)
    line_codes, _ = coded(lines.flatten())
    line_repeats = _repeats(line_codes, line_at - line_at[0])
    shares = counts / size
    letters = shares[:, 65:91].sum(1) + shares[:, 97:123].sum(1) + shares[:, 128:].sum(1)
    stats = np.stack(
        [
            np.log1p(lengths), np.log1p(n_words), lengths / np.maximum(n_words, 1) / 10, word_repeats[:, 0], word_repeats[:, 1], line_repeats[:, 0], line_repeats[:, 1],
            np.diff(line_at) / np.maximum(n_words, 1), letters, shares[:, 65:91].sum(1) / np.maximum(letters, 1e-9), shares[:, 48:58].sum(1), 1 - letters - shares[:, 32] - shares[:, 10],
        ],
        1,
    )
    return np.concatenate([np.sqrt(shares), np.sqrt(pairs / size), stats], 1).astype(np.float32)


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        # Far outside what was seen, a feature counts no more than at eight deviations.
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.01, decay: float = 2e-3) -> Model:
    """Non-negative unbiased risk with the logistic loss, by Adam on all rows."""
    rows = np.concatenate([positive, unlabelled])
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    norm = lambda x: np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    p, u = norm(positive), norm(unlabelled)
    w, b = np.zeros(p.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = soft(zu).mean() - prior * soft(zp).mean()
        if negative >= 0:
            gp, gu = prior * (sig(zp) - 1 - sig(zp)) / len(p), sig(zu) / len(u)
        else:
            gp, gu = prior * sig(zp) / len(p), -sig(zu) / len(u)
        g = np.concatenate([gp @ p + gu @ u + decay * w, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return Model(mean, scale, w, b)


def _centres() -> np.ndarray:
    return (np.arange(2 * LOGIT * STEP) + 0.5) / STEP - LOGIT


def _bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + LOGIT) * STEP), 0, 2 * LOGIT * STEP - 1).astype(np.int64)


def tail_prior(positive: np.ndarray, mixture: np.ndarray) -> float:
    """The prior from histograms of logits of positives and of the mixture: their tails' ratio where its upper bound is least."""
    n, m = positive.sum(), mixture.sum()
    p, u = np.cumsum(positive[::-1])[::-1] / n, np.cumsum(mixture[::-1])[::-1] / m
    low = p - 2 * np.sqrt(p * (1 - p) / n)
    bound = np.where(low > 0, (u + 2 * np.sqrt(u * (1 - u) / m)) / np.where(low > 0, low, 1), np.inf)
    k = int(bound.argmin())
    return float(np.clip(u[k] / p[k], 0.01, 0.99))


def calibrated(model: Model, positive: np.ndarray, mixture: np.ndarray, prior: float) -> Model:
    """model with its logit scaled and shifted to least unbiased logistic risk; positive and mixture: histograms of logits."""
    z = _centres()
    x = np.stack([z, np.ones(len(z))], 1)
    goal = prior * (positive @ x) / positive.sum()
    weight = mixture / mixture.sum()
    pull = np.array([SCALE_PULL, 1e-9])
    risk = lambda c: weight @ np.logaddexp(0, x @ c) - goal @ c + pull @ (c - [1, 0]) ** 2 / 2
    c = np.array([1.0, 0.0])
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(pull), (weight * q) @ x - goal + pull * (c - [1, 0]))
        rate = 1.0
        while rate > 1e-6 and risk(c - rate * step) > risk(c):
            rate /= 2
        if rate <= 1e-6:
            break
        c = c - rate * step
    return Model(model.mean, model.scale, model.weights * c[0], model.bias * c[0] + c[1]) if c[0] > 0 else model


_FOLD = "cast(coalesce(pmod(xxhash64(doc_id), 2), 0) as int)"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("fold", F.expr(_FOLD))


def _sampled(docs: DataFrame, ids: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most `most` of the documents named by ids (distinct), and their halves."""
    chosen = ids.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fold"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "fold", "x"])

    rows = _rows(docs.join(F.broadcast(chosen), "doc_id", "left_semi"))
    got = rows.mapInArrow(run, "doc_id long, fold int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    return np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES), got["fold"].to_numpy()


def _histograms(docs: DataFrame, models: list[Model]) -> np.ndarray:
    """For each model the histogram of its logits over the rows of its fold; one model has all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(models), 2 * LOGIT * STEP), np.int64)
        for b in slices(batches):
            x, fold = features(b.column("text")), b.column("fold").to_numpy()
            for k, m in enumerate(models):
                own = x[fold == k] if len(models) > 1 else x
                out[k] += np.bincount(_bins(m.logit(own)), minlength=out.shape[1])
        k, at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(out[k, at])], names=["k", "bin", "n"])

    out = np.zeros((len(models), 2 * LOGIT * STEP))
    for r in _rows(docs).mapInArrow(run, "k int, bin int, n long").groupBy("k", "bin").agg(F.sum("n").alias("n")).collect():
        out[r["k"], r["bin"]] = r["n"]
    return out


def _counted(z: np.ndarray) -> np.ndarray:
    return np.bincount(_bins(z), minlength=2 * LOGIT * STEP).astype(float)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | float:
    """The model from the positives of labels (doc_id, quality) and all of docs; PRIOR if there is no positive."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    p, p_fold = _sampled(docs, known.where("quality = 1").select("doc_id"), most)
    u, u_fold = _sampled(docs, docs.select("doc_id").distinct(), most)
    if not len(p) or not len(u):
        return PRIOR
    prior = PRIOR
    if all((f == k).any() for f in (p_fold, u_fold) for k in (0, 1)):
        # A half is scored by the model of the other.
        models = [fit(p[p_fold != k], u[u_fold != k], PRIOR, steps=300) for k in (0, 1)]
        mixture = _histograms(docs, models)
        prior = float(np.mean([tail_prior(_counted(m.logit(p[p_fold == k])), mixture[k]) for k, m in enumerate(models)]))
    model = fit(p, u, prior)
    return calibrated(model, _counted(model.logit(p)), _histograms(docs, [model])[0], prior)


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = np.full(b.num_rows, model) if isinstance(model, float) else model.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double")
