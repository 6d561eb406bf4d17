"""Quality by compression: zstandard dictionaries of good and bad text, and which one fits a text better."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_limits, fold, give_back, table
from matchloom.llm.labelled import sample

#: Bound of the training sample: labelled rows of each class.
ROWS = 1200
DICT_BYTES = 64 << 10
#: Texts are compressed in windows of so many bytes, so that a long text is held against the dictionaries
#: all the way and not against its own beginning.
WINDOW = 2048
LEVEL = 3
CUT = 0.7
HELD_OUT = 2
FOLDS = 4


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    window: int = WINDOW
    level: int = LEVEL
    #: False where there were no texts of one class: scores then say nothing.
    trained: bool = True

    def compressors(self):
        import zstandard as z

        out = []
        for raw in (self.good, self.bad):
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(level=self.level)
            out.append(z.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def features(self, text: str, compressors) -> tuple[float, float]:
        """Normalised difference of the compressed sizes, (bad - good) / (bad + good), over the text and in its worst window."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0
        good, bad, low = 0, 0, 1.0
        a, b = compressors
        for at in range(0, len(raw), self.window):
            part = raw[at : at + self.window]
            g, x = len(a.compress(part)), len(b.compress(part))
            good, bad = good + g, bad + x
            if len(part) * 4 >= self.window or at == 0:
                low = min(low, (x - g) / (x + g))
        return (bad - good) / (bad + good), low

    def score(self, features) -> np.ndarray:
        f = np.asarray(features, float).reshape(-1, 2)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + f @ w[1:], -500, 500)))


def _dictionary(texts: list[str], size: int, window: int) -> bytes:
    import zstandard as z

    parts = [raw[at : at + window] for t in texts for raw in [t.encode("utf-8", "surrogatepass")] for at in range(0, len(raw), window)]
    parts = [p for p in parts if len(p) >= 8]
    try:
        return z.train_dictionary(size, parts, k=512, d=8).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[-size:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method on standardised columns; weights for the columns as they are, the constant first."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a / len(x) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) / len(x) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / std).sum()], w[1:] / std])


def train(good: list[str], bad: list[str], fit: list[tuple[str, int, float]], dict_bytes: int = DICT_BYTES, window: int = WINDOW) -> Model:
    """Dictionaries from good and bad texts; the score calibrated on the rows of `fit` (text, label, weight is ignored).

    Where `fit` holds one class alone, or none, there is nothing to calibrate on: every text scores the share of
    good rows, with one more of either class, 0.5 without any, and the model counts as untrained. Without good or
    without bad texts it is untrained too.
    """
    model = Model(_dictionary(good, dict_bytes, window), _dictionary(bad, dict_bytes, window), (0.0, 0.0, 0.0), window)
    y = np.array([k for _, k, _ in fit], float)
    if len(set(y)) > 1 and good and bad:
        c = model.compressors()
        model.weights = tuple(map(float, _logistic(np.array([model.features(t, c) for t, _, _ in fit]), y)))
    else:
        share = (y.sum() + 1) / (len(y) + 2)
        model.weights, model.trained = (float(np.log(share / (1 - share))), 0.0, 0.0), False
    return model


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = ROWS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most `rows` labelled texts of each class for the dictionaries, and twice as many, as they come, for the calibration.

    Rows whose crc32(id) mod 4 is held_out are never read; dictionaries and calibration share no row. Rows with a
    null id or label, and labels without a document, aren't trained on; null texts are empty; of repeated ids and
    labels the greatest text and label count, so every run trains on the same. Empty tables, and labels of one class
    alone, give an untrained model, see train().
    """
    label = F.col(label_col)
    part = fold(FOLDS, id_col)
    fitting = (held_out + 1) % FOLDS
    for_dict = (part != held_out) & (part != fitting)
    good = sample(docs, labels, label, for_dict & (label == 1), rows, 1, id_col, text_col)
    bad = sample(docs, labels, label, for_dict & (label == 0), rows, 2, id_col, text_col)
    fit = sample(docs, labels, label, part == fitting, 2 * rows, 3, id_col, text_col)
    return train([t for t, _, _ in good], [t for t, _, _ in bad], fit)


def _score(model: Model):
    def run(batches):
        import pyarrow as pa

        c = model.compressors()
        for batch in batches:
            f = [model.features(t or "", c) for t in batch.column(1).to_pylist()]
            f = np.array(f, float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f[:, 0]), pa.array(model.score(f))], ["doc_id", "difference", "score"])
        give_back()

    return run


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, difference, score of every row of docs, from its whole text alone.

    score is the calibrated probability of good quality; empty and null texts, having no difference, get that of
    difference 0. Ids may be null or repeated, other columns are ignored, an empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(model), "doc_id long, difference double, score double")
    return out.withColumnRenamed("doc_id", id_col)


def keep_good(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """docs whose score is `cut` or more, all columns as they came.

    An untrained model rejects nothing. Null and empty texts are kept if difference 0 scores `cut`; ids aren't looked
    at, repeated rows fare alike, an empty table gives an empty result.
    """
    if not model.trained:
        return docs
    arrow_limits(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        c = model.compressors()
        for batch in batches:
            f = [model.features(t or "", c) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.score(f) >= cut))
        give_back()

    return docs.mapInArrow(run, schema)


def op1_quality_zstd(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "difference"
    )
