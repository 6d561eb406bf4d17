"""Masked pseudo-likelihood: a window network predicts every word from both sides, their log-probabilities score a text."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_limits, partitions, staged, table

#: The network predicts one of CLUSTERS * CLUSTERS branches. The KNOWN commonest words are one each, the TAIL others hold all further words by hash.
CLUSTERS = 32
BRANCHES = CLUSTERS * CLUSTERS
KNOWN = 768
TAIL = BRANCHES - KNOWN
#: Words that the network sees as themselves, each with a vector of its own: GROWTH * square root of the number of different words, KNOWN at least.
GROWTH = 4.5
#: Added to every count within a branch. As many words as it is known to hold are taken to be unseen.
SMOOTH = 0.5
#: Counts that tasks hold at once: so many times the words with a vector of their own. Rarer words meet theirs in a join.
HELD = 16
#: Words on either side that the network sees.
SIDE = 2
PLACES = tuple(k for k in range(-SIDE, SIDE + 1) if k)
WIDTH = 16
MINIBATCH = 8192
RATE = 0.1
SEED = 11
#: Numbers of a parameter block, the unit in which partitions' networks are averaged.
BLOCK = 8192
#: Partitions of the first averaging step, by salt: at most so many sums meet in the second.
SALTS = 16
#: Words without an entry that a worker remembers, and different words that it counts at once.
REMEMBERED = 300_000
COUNTED = 300_000


def _own(known: int) -> int:
    """Vectors of known words, in whole multiples of TAIL."""
    return KNOWN + TAIL * max(0, -(-(known - KNOWN) // TAIL))


def _shared(known: int) -> int:
    """Vectors that all other words share by hash: a multiple of TAIL."""
    return TAIL * max(1, round(_own(known) / 3 / TAIL))


def classes_of(known: list[str]) -> int:
    """Vectors, but for the one outside the text."""
    return _own(len(known)) + _shared(len(known))


def branch_of(word: bytes, rank: int | None) -> int:
    """What the network predicts for a word: itself, for the KNOWN commonest, or a branch by hash."""
    return rank if rank is not None and rank < KNOWN else KNOWN + zlib.crc32(word) % TAIL


class Words(dict):
    """Entry number of a word (UTF-8), and by entry its vector's number, its branch and log p(word | branch).

    Entries are the known words, then words whose counts are held, then one for each shared vector. Where the count
    isn't held, as for the latter, the term is NaN. known: words, commonest first. held: further (word, count).
    totals: of smoothed counts by tail branch; None leaves all terms 0.
    """

    def __init__(self, known: list[str], held: list[tuple[str, int]] = (), totals: np.ndarray | None = None):
        super().__init__()
        own, self.shared = _own(len(known)), _shared(len(known))
        rank = {w.encode("utf-8", "surrogatepass"): k for k, w in enumerate(known)}
        count = {w.encode("utf-8", "surrogatepass"): n for w, n in held}
        entries = [*rank, *(w for w in count if w not in rank)]
        crc = np.array([zlib.crc32(w) for w in entries], np.int64)
        at = np.arange(len(entries))
        slots = np.arange(self.shared)
        self.fixed = {w: k for k, w in enumerate(entries)}
        self.vector = np.concatenate([np.where(at < len(rank), at, own + crc % self.shared), own + slots]).astype(np.int32)
        self.branch = np.concatenate([np.where(at < min(len(rank), KNOWN), at, KNOWN + crc % TAIL), KNOWN + slots % TAIL]).astype(np.int16)
        self.term = np.zeros(len(self.vector))
        if totals is not None:
            n = np.array([count.get(w, np.nan) for w in entries], float)
            self.term = np.concatenate([np.where(at < KNOWN, 0.0, np.log((n + SMOOTH) / totals[crc % TAIL])), np.full(self.shared, np.nan)])
        self.temporary = 0
        self.update(self.fixed)

    def __missing__(self, word: bytes) -> int:
        k = len(self.fixed) + zlib.crc32(word) % self.shared
        if self.temporary >= REMEMBERED:
            self.clear()
            self.update(self.fixed)
            self.temporary = 0
        if len(word) <= 64:
            self[word] = k
            self.temporary += 1
        return k


@dataclass
class Network:
    """A vector for each word, weighed by place around the predicted one; hidden layer tanh(sum); softmax over clusters, then over the branches of one.

    Words come as a stream of vector numbers in which SIDE times the last vector, outside the text, stand around each text.
    """

    embed: np.ndarray  # vectors + 1, WIDTH
    place: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def shapes(classes: int) -> list[tuple[int, ...]]:
        return [(classes + 1, WIDTH), (len(PLACES), WIDTH), (WIDTH, CLUSTERS), (CLUSTERS,), (CLUSTERS, WIDTH, CLUSTERS), (CLUSTERS, CLUSTERS)]

    @classmethod
    def of(cls, flat: np.ndarray, classes: int = BRANCHES) -> Network:
        parts, at = [], 0
        for shape in cls.shapes(classes):
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape))
            at += n
        return cls(*parts)

    @classmethod
    def start(cls, classes: int = BRANCHES) -> np.ndarray:
        n = sum(int(np.prod(s)) for s in cls.shapes(classes))
        flat = (np.random.default_rng(SEED).standard_normal(n) * 0.1).astype(np.float32)
        cls.of(flat, classes).place[:] += 1
        return flat

    def hidden(self, stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of the stream from SIDE before the first place of `at` to SIDE after the last, and the hidden layer at those places."""
        x = self.embed.take(stream[at[0] - SIDE : at[-1] + SIDE + 1], axis=0)
        n = len(x) - 2 * SIDE
        h = x[SIDE + PLACES[0] : SIDE + PLACES[0] + n] * self.place[0]
        for k, p in enumerate(PLACES[1:], 1):
            h += x[SIDE + p : SIDE + p + n] * self.place[k]
        h = h.take(at - at[0], axis=0)
        return x, np.tanh(h, out=h)

    def log_probs(self, stream: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(branch | context) for the words at ascending places of the stream."""
        if not len(at):
            return np.zeros(0)
        h = self.hidden(stream, at)[1]
        c, j = np.divmod(target, CLUSTERS)
        z = h @ self.w1 + self.b1
        out = z[np.arange(len(target)), c] - _log_sum(z)
        for k, rows in _by_cluster(c):
            z = h.take(rows, axis=0) @ self.w2[k] + self.b2[k]
            out[rows] += z[np.arange(len(rows)), j[rows]] - _log_sum(z)
        return out

    def gradients(self, stream: np.ndarray, at: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the mean negative log-probability: the vectors that occur, their gradients, and the other parts'."""
        n = len(target)
        x, h = self.hidden(stream, at)
        c, j = np.divmod(target, CLUSTERS)
        p = _softmax(h @ self.w1 + self.b1)
        p[np.arange(n), c] -= 1
        dh = p @ self.w1.T
        parts = [h.T @ p / n, p.sum(axis=0) / n]
        dw, db = np.zeros_like(self.w2), np.zeros_like(self.b2)
        for k, rows in _by_cluster(c):
            own = h.take(rows, axis=0)
            q = _softmax(own @ self.w2[k] + self.b2[k])
            q[np.arange(len(rows)), j[rows]] -= 1
            dw[k], db[k] = own.T @ q / n, q.sum(axis=0) / n
            dh[rows] += q @ self.w2[k].T
        dh *= 1 - h * h
        dh /= n
        inner = np.zeros((len(x) - 2 * SIDE, WIDTH), dh.dtype)
        inner[at - at[0]] = dh
        dx, dplace = np.zeros_like(x), np.zeros_like(self.place)
        for k, d in enumerate(PLACES):
            here = slice(SIDE + d, SIDE + d + len(inner))
            dx[here] += inner * self.place[k]
            dplace[k] = np.einsum("ij,ij->j", inner, x[here])
        seen = stream[at[0] - SIDE : at[-1] + SIDE + 1]
        order = np.argsort(seen.astype(np.uint16) if len(self.embed) <= 1 << 16 else seen, kind="stable")  # short numbers are sorted by digits
        inside = seen[order]
        first = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
        return inside[first], np.add.reduceat(dx.take(order, axis=0), first, axis=0), [dplace, *parts, dw, db]

    def gradient(self, stream: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """gradients(), flat."""
        rows, de, parts = self.gradients(stream, at, target)
        whole = np.zeros(self.embed.shape)
        whole[rows] = de
        return np.concatenate([x.ravel() for x in (whole, *parts)]).astype(np.float32)

    def step(self, squares: Network, stream: np.ndarray, at: np.ndarray, target: np.ndarray, rate: float) -> None:
        """Adagrad, in place."""
        rows, de, parts = self.gradients(stream, at, target)
        sums = squares.embed.take(rows, axis=0) + de * de
        squares.embed[rows] = sums
        self.embed[rows] -= rate * de / np.sqrt(sums)
        for name, g in zip(("place", "w1", "b1", "w2", "b2"), parts, strict=True):
            sums, own = getattr(squares, name), getattr(self, name)
            sums += g * g
            own -= rate * g / np.sqrt(sums)


def _by_cluster(cluster: np.ndarray):
    """(cluster, places of it) for all that occur."""
    order = np.argsort(cluster.astype(np.uint8), kind="stable")
    ends = np.searchsorted(cluster[order], np.arange(CLUSTERS + 1))
    return [(k, order[a:b]) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if a < b]


#: Logits stop here, far beyond what a hidden layer of tanh gives, so that exp() stays finite without a search for the largest.
_MOST = 60


def _log_sum(z: np.ndarray) -> np.ndarray:
    e = np.minimum(z, _MOST)
    return np.log(np.exp(e, out=e) @ np.ones(z.shape[1], z.dtype))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(np.minimum(z, _MOST, out=z), out=z)
    e /= (e @ np.ones(z.shape[1], z.dtype))[:, None]
    return e


def entries(docs: list[list[bytes]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers of all words of some documents, one after the other, and how many each has."""
    sizes = np.array([len(d) for d in docs], np.int64)
    return np.fromiter(map(words.__getitem__, chain.from_iterable(docs)), np.int32, int(sizes.sum())), sizes


def stream_of(vectors: np.ndarray, sizes: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Vector numbers of all words of some documents with SIDE times `classes`, what is outside a text, around each; and where the words are."""
    padded = np.full(len(vectors) + SIDE * (len(sizes) + 1), classes, np.int32)
    at = np.arange(len(vectors)) + np.repeat(np.arange(1, len(sizes) + 1), sizes) * SIDE
    padded[at] = vectors
    return padded, at


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes are split at [\x20\x09-\x0D]


def _count(batches):
    """Counts of the different words of a task's texts, handed on whenever there are COUNTED of them."""
    import pyarrow as pa

    held: Counter = Counter()

    def counted():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(_split(text or ""))
        if len(held) >= COUNTED:
            yield counted()
    yield counted()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, count: every different word of all texts, over every row. Tasks add up their own first."""
    arrow_limits(docs.sparkSession)
    words = docs.select(text_col).mapInArrow(_count, "word string, n long")
    return staged(words.groupBy("word").agg(F.sum("n").alias("count")), "words")


def commonest(counts: DataFrame, share: int = 1) -> list[tuple[str, int]]:
    """The commonest words, by count and then by code point: `share` times as many as have vectors of their own.

    With a share above 1, words of the last count that would fit in part only are left out. The driver gets a
    histogram of the counts first, then these words alone, not so many of every partition.
    """
    steps = sorted(((r["count"], r.n) for r in counts.groupBy("count").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = max(KNOWN, int(GROWTH * sum(n for _, n in steps) ** 0.5)) * share
    least = None
    for count, n in steps:
        if n > left:
            break
        left, least = left - n, count
    found = [] if least is None else [(r.word, r["count"]) for r in counts.filter(F.col("count") >= least).collect()]
    if share == 1 and left and (least is None or count < least):
        found += [(r.word, r["count"]) for r in counts.filter(F.col("count") == count).orderBy("word").limit(left).collect()] if steps else []
    return sorted(found, key=lambda x: (-x[1], x[0]))


def known_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The words with vectors of their own, commonest first; their number grows with that of the different words."""
    return [w for w, _ in commonest(word_counts(docs, text_col))]


def _train(known: list[str], start: np.ndarray, rate: float):
    def run(batches):
        flat, classes = start.copy(), classes_of(known)
        net, squares, seen, words = Network.of(flat, classes), Network.of(np.full(len(flat), 1e-6, np.float32), classes), 0, Words(known)
        for batch in batches:
            found, sizes = entries([_split(t or "") for t in batch.column(0).to_pylist()], words)
            (stream, at), target = stream_of(words.vector[found], sizes, classes), words.branch[found]
            for k in range(0, len(target), MINIBATCH):
                net.step(squares, stream, at[k : k + MINIBATCH], target[k : k + MINIBATCH], rate)
            seen += len(target)
        if seen:
            yield _blocks(flat * np.float32(seen), seen)

    def _blocks(sums, seen):
        import pyarrow as pa

        n = -(-len(sums) // BLOCK)
        raw = [sums[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in range(n)]
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([seen] * n, pa.int64()), pa.array(raw, pa.binary())], ["block", "seen", "sums"])

    return run


def _add(batches):
    """Adds up the sums of each block, a batch at a time."""
    import pyarrow as pa

    total: dict[int, list] = {}
    for batch in batches:
        for block, seen, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            x = np.frombuffer(raw, np.float32)
            if block in total:
                total[block][0] += seen
                total[block][1] += x
            else:
                total[block] = [seen, x.astype(np.float64)]
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1].astype(np.float32).tobytes() for t in total.values()], pa.binary())],
            ["block", "seen", "sums"],
        )


_SUMS = "block int, seen long, sums binary"


def train(docs: DataFrame, known: list[str], text_col: str = "text", rounds: int = 1, rate: float = RATE) -> np.ndarray:
    """Parameters of a network trained on every word of every text.

    Each task trains a copy on its own rows (one pass, Adagrad), then the copies are averaged by the number of
    words they saw, block by block: over salted keys first, then whole. The driver gets one network, whatever
    the number of tasks. The next round starts from the average.
    """
    arrow_limits(docs.sparkSession)
    flat = Network.start(classes_of(known))
    blocks = -(-len(flat) // BLOCK)
    for _ in range(rounds):
        own = docs.select(text_col).mapInArrow(_train(known, flat, rate), _SUMS)
        salted = own.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        part = salted.repartition(partitions(docs.sparkSession), "block", "salt").select("block", "seen", "sums").mapInArrow(_add, _SUMS)
        whole = part.repartition(min(blocks, partitions(docs.sparkSession)), "block").mapInArrow(_add, _SUMS)
        rows = sorted(staged(whole, "network").collect(), key=lambda r: r.block)
        if not rows:
            break
        flat = np.concatenate([np.frombuffer(r.sums, np.float32) / r.seen for r in rows]).astype(np.float32)
    return flat


def branch_totals(counts: DataFrame, known: list[str]) -> np.ndarray:
    """What smoothed counts add up to within each tail branch: those of its words, and as many unseen ones (one at least)."""
    spark = counts.sparkSession
    single = spark.createDataFrame([(w,) for w in known[:KNOWN]], "word string")
    words = counts.join(F.broadcast(single), "word", "left_anti")  # KNOWN words at most
    by_branch = words.groupBy((F.crc32(F.col("word").cast("binary")) % TAIL).cast("int").alias("k")).agg(F.count("*").alias("words"), F.sum("count").alias("tokens"))
    totals = np.full(TAIL, SMOOTH)
    for r in by_branch.collect():
        totals[r.k] = r.tokens + SMOOTH * 2 * r.words
    return totals


def _score(known: list[str], flat: np.ndarray, held: list[tuple[str, int]], totals: np.ndarray | None):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        classes, words = classes_of(known), Words(known, held, totals)
        net = Network.of(flat, classes)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs = [_split(t or "") for t in batch.column(1).to_pylist()]
            found, sizes = entries(docs, words)
            (stream, at), target = stream_of(words.vector[found], sizes, classes), words.branch[found]
            owner = np.repeat(np.arange(len(docs)), sizes)
            term = words.term[found]
            out, rare = np.zeros(len(docs)), [[] for _ in docs]
            out += np.bincount(owner, np.nan_to_num(term), len(docs))
            for k in range(0, len(target), MINIBATCH):
                part = slice(k, k + MINIBATCH)
                out += np.bincount(owner[part], net.log_probs(stream, at[part], target[part]), len(docs))
            starts = np.cumsum(sizes) - sizes
            for n in np.flatnonzero(np.isnan(term)).tolist():
                k = owner[n]
                rare[k].append(docs[k][n - starts[k]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(docs))), batch.column(0), pa.array(sizes), pa.array(out), pa.array(rare, pa.list_(pa.binary()))],
                ["row", "doc_id", "n_words", "log_prob", "rare"],
            )
            row += len(docs)

    return run


def score_texts(docs: DataFrame, known: list[str], flat: np.ndarray, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """id_col, n_words, log_prob (sum over all words of log p(word | words on both sides)), score (by word).

    p(word | context) = p(branch | context) * p(word | branch), the latter from the smoothed counts of word_counts();
    without counts, log_prob sums log p(branch | context) alone. A word that isn't counted gets the share of one
    unseen word of its branch.
    Null texts and texts without words get 0 and 0.0. Ids may be null or repeated, other columns are ignored,
    an empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "row long, doc_id long, n_words long, log_prob double, rare array<binary>"
    if counts is None:
        out = slim.mapInArrow(_score(known, flat, [], None), schema)
    else:
        held, totals = commonest(counts, HELD), branch_totals(counts, known)
        rows = staged(slim.mapInArrow(_score(known, flat, held, totals), schema), "scores")
        words = counts.select(F.col("word").cast("binary").alias("word"), "count").hint("shuffle_hash")
        by_branch = docs.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate(totals)], "k int, total double")
        rare = rows.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
        rare = rare.select("row", "count", (F.crc32("word") % TAIL).cast("int").alias("k")).join(F.broadcast(by_branch), "k")  # TAIL rows
        terms = rare.groupBy("row").agg(F.sum(F.log((F.coalesce("count", F.lit(0)) + SMOOTH) / F.col("total"))).alias("rest"))
        out = rows.drop("rare").join(terms, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("rest", F.lit(0.0)))
    return out.select(F.col("doc_id").alias(id_col), "n_words", "log_prob", (F.col("log_prob") / F.greatest("n_words", F.lit(1))).alias("score"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """Counts words, trains and scores, all over every row of docs."""
    counts = word_counts(docs, text_col)
    known = [w for w, _ in commonest(counts)]
    return score_texts(docs, known, train(docs, known, text_col, rounds), id_col, text_col, counts)


def op8_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
