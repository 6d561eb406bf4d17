"""Toxicity by non-negative positive-unlabelled learning of a linear classifier."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_limits, fold, table
from matchloom.llm.labelled import sample, sample_unlabelled

#: Bounds of the training sample: confirmed toxic rows, and rows of the whole table, whatever their labels.
TOXIC_ROWS = 2500
UNLABELLED_ROWS = 5000
FEATURES = 1024
PREFIXES = (4, 5, 6)
#: A feature must be in so many confirmed texts.
LEAST = 3
#: The class prior that its own estimate starts from, and that stands where there is too little text for one.
START = 0.1
#: Texts of either kind that the prior's estimate takes at least, and the confidence of its bounds.
LEAST_TEXTS, DELTA = 20, 0.05
CUT = 0.5
HELD_OUT = 0
FOLDS = 5
CACHE = 300_000


def word_features(word: str) -> list[str]:
    """Of a blank-separated word: itself without marks and case, and its beginnings."""
    w = word.strip("\"'.,;:!?()[]{}<>*#$%&|+-_=~`").lower()
    return [w, *[f"{w[:k]}*" for k in PREFIXES if len(w) > k]] if len(w) > 2 else []


class _Weights(dict):
    """Summed weights of a word's features, remembered up to CACHE words."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float:
        found = sum(self.known.get(f, 0.0) for f in word_features(word))
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


@dataclass
class Model:
    weights: dict[str, float]
    constant: float
    prior: float

    def scores(self, texts: list[str | None], cache: _Weights | None = None) -> np.ndarray:
        """Probability of toxicity by whole text: the constant and the weights of its different words."""
        cache = _Weights(self.weights) if cache is None else cache
        z = [self.constant + sum(map(cache.__getitem__, sorted(set((t or "").split())))) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))


def _counts(texts: list[str], index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(index)), np.float32)
    for row, text in enumerate(texts):
        for word in set(text.split()):
            for f in word_features(word):
                if (k := index.get(f)) is not None:
                    x[row, k] += 1
    return x


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise the non-negative PU risk with logistic loss.

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)): where the second part, the risk on negatives corrected
    for the positives among the unlabelled, turns negative, the step goes against its gradient (Kiryo et al. 2017).
    """
    n = p.shape[1]
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    a, b = np.column_stack([p, np.ones(len(p), np.float32)]), np.column_stack([u, np.ones(len(u), np.float32)])
    w[-1] = np.log(prior / (1 - prior))
    single = lambda x: x.astype(np.float32)
    for t in range(1, steps + 1):
        zp, zu = (np.clip((x @ single(w)).astype(float), -30, 30) for x in (a, b))
        up, uu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        g_neg = (b.T @ single(uu)).astype(float) / len(b) - prior * (a.T @ single(up)) / len(a)
        g = -g_neg if negative < 0 else g_neg - prior * (a.T @ single(1 - up)) / len(a)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def prior_of(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of texts that weren't trained on.

    Above any threshold the unlabelled hold at least prior times the share that the positives hold; the threshold
    where the upper bound of that ratio is least gives the estimate (best bin, Garg et al. 2021).
    """
    cuts = np.unique(p)
    q_p, q_u = 1 - np.searchsorted(np.sort(p), cuts) / len(p), 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    slack_p, slack_u = (np.sqrt(np.log(2 / DELTA) / (2 * len(x))) for x in (p, u))
    bound = (q_u + slack_u) / np.maximum(q_p - slack_p, 1e-9)
    best = int(np.argmin(bound))
    return float(q_u[best] / q_p[best])


def _estimate(p: np.ndarray, u: np.ndarray) -> float:
    """The class prior, by training on either half of the texts and looking at the other."""
    if min(len(p), len(u)) < 2 * LEAST_TEXTS:
        return START
    out = []
    for k in (0, 1):
        w, c = nnpu(p[k::2], u[k::2], START)
        out.append(prior_of(p[1 - k :: 2] @ w + c, u[1 - k :: 2] @ w + c))
    return sum(out) / 2


def train(toxic: list[str], unlabelled: list[str], prior: float | None = None, features: int = FEATURES) -> Model:
    """The classifier from confirmed toxic texts and texts of unknown kind; prior: share of toxic ones among the latter (None: estimated).

    Features are those that speak most for the confirmed, by the z value of the difference of their shares, and
    enter in proportion to it, so that weak ones cost more of the penalty; the risk sets all weights. Without texts of
    one kind, or without a feature, every text scores the prior.
    """
    toxic, unlabelled = sorted(set(toxic)), sorted(set(unlabelled))
    clipped = lambda x: min(max(x, 1e-3), 0.9)
    alike = lambda x: Model({}, float(np.log(x / (1 - x))), x)
    if not toxic or not unlabelled:
        return alike(clipped(START if prior is None else prior))
    of = lambda text: {f for w in set(text.split()) for f in word_features(w)}
    in_p = Counter(f for t in toxic for f in of(t))
    in_p = Counter({f: n for f, n in in_p.items() if n >= LEAST})
    in_u = Counter(f for t in unlabelled for f in of(t) if f in in_p)
    size_p, size_u = len(toxic), len(unlabelled)

    def z(f: str) -> float:
        a, b = in_p[f] / size_p, (in_u[f] + 0.5) / size_u
        return (a - b) / np.sqrt((in_p[f] + in_u[f] + 0.5) / (size_p + size_u) * (1 / size_p + 1 / size_u))

    best = sorted(((z(f), f) for f in in_p), key=lambda x: (-x[0], x[1]))[:features]
    best = [(s, f) for s, f in best if s > 0]
    if not best:
        return alike(clipped(START if prior is None else prior))
    index = {f: k for k, (_, f) in enumerate(best)}
    scale = np.array([s for s, _ in best], np.float32) / np.float32(best[0][0])
    p, u = _counts(toxic, index) * scale, _counts(unlabelled, index) * scale
    prior = clipped(_estimate(p, u) if prior is None else prior)
    w, c = nnpu(p, u, prior)
    return Model({f: float(w[k] * scale[k]) for f, k in index.items()}, c, prior)


def fit_model(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, prior: float | None = None) -> Model:
    """From at most toxic_rows confirmed rows and unlabelled_rows rows of docs taken as unlabelled, held-out folds left out.

    Of the labels only the positive ones are read; the unlabelled rows come from the whole table, so most have no
    label. prior: share of toxic texts in docs; None: estimated from the two samples. Without a positive label every
    text scores START. Rows without an id aren't trained on; of repeated ids and labels the greatest text and label
    count, so every run trains on the same.
    """
    label, learn = F.col(label_col), fold(FOLDS, id_col) != held_out
    toxic = sample(docs, labels, label, learn & (label == 1), toxic_rows, 5, id_col, text_col)
    rest = sample_unlabelled(docs, learn, unlabelled_rows, 7, id_col, text_col)
    return train([t for t, _, _ in toxic], rest, prior)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score of every row of docs, from its whole text alone; empty and null texts get the constant's score.

    Ids may be null or repeated, other columns are ignored, an empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        cache = _Weights(model.weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist(), cache))], ["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.withColumnRenamed("doc_id", id_col)


def op10_toxicity_pu(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
