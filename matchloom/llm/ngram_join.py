"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from matchloom.llm.common import arrow_limits, drop_staged, give_back, join_skewed, small, staged, table
from matchloom.operators.components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99
#: Hash functions, which longer bands may use up; a similarity so low that one-row bands need more gets more.
HASHES = 256
#: Sets that one task compares with each other, or with as many others: rows, and n-grams (8 bytes each).
BLOCK = 512
BLOCK_NGRAMS = 1 << 20
#: Columns of the incidence matrix that are multiplied at once.
_WIDE = 4096
SEED = 20240229


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows a band: the longest bands, within `hashes` values, for which texts at `similarity` share one with probability `recall`.

    One-row bands are as many as the recall takes, beyond `hashes` too: the recall holds for every similarity.
    """
    if not 0 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("similarity must be in (0, 1], recall in (0, 1)")
    need = lambda rows: math.ceil(math.log(1 - recall) / math.log1p(-min(similarity**rows, 1 - 1e-12)))
    best = (need(1), 1)
    for rows in range(2, hashes + 1):
        if need(rows) * rows > hashes:
            break
        best = (need(rows), rows)
    return best


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def ngram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different n-grams of [^\\x20\\x09-\\x0D]+; of fewer words, all of them are one."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").split()  # bytes are split at [\x20\x09-\x0D]
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(h))
    g = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):  # order counts: every step mixes what came before
        g = (g ^ (g >> np.uint64(29))) * _MIX[k % 5] + h[k : len(h) - n + 1 + k]
    g ^= g >> np.uint64(32)
    g *= _MIX[0]
    return np.unique(g ^ (g >> np.uint64(29)))


def _sign(bands: int, rows: int, words: int):
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    c = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keys, sizes, out = [], [], []
            for text in batch.column(1).to_pylist():
                g = ngram_set(text, words)
                sizes.append(len(g))
                keys.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                if not len(g):
                    out.append([])
                    continue
                x = (g >> np.uint64(32)).astype(np.uint32)
                low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), 1024):
                    low = np.minimum(low, (x[at : at + 1024, None] * a + b).min(axis=0))
                sig = low.astype(np.uint64).reshape(bands, rows)
                h = ((sig + np.uint64(1)) * c).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _MIX[1]
                out.append(((h ^ (h >> np.uint64(31))) * _MIX[0]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))],
                ["doc_id", "set_key", "n_ngrams", "bands"],
            )
        give_back()

    return run


def _sets(words: int, keys: bool = False):
    """N-gram sets by id, or by set_key."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [ngram_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            own = pa.array([xxhash.xxh3_128_digest(g) if g else None for g in sets], pa.binary()) if keys else batch.column(0)
            yield pa.RecordBatch.from_arrays([own, pa.array(sets, pa.binary())], ["set_key" if keys else "node", "ngrams"])
        give_back()

    return run


def _number(key: str):
    """What stands for the id of a set whose documents have none: 2 ** 62 or more, so that real ids are less."""
    return F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the common parts of every set on the left with every one on the right (None: the left ones themselves)."""
    sets = left if right is None else left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1  # an n-gram of one set alone is in no common part
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    n, m = len(left), len(sets) - len(left)
    out = np.zeros((n, n if right is None else m), np.float32)
    at = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + _WIDE, _WIDE))
    for low, high in zip(at[:-1], at[1:], strict=True):
        a = np.zeros((len(sets), _WIDE), np.float32)
        a[owner[low:high], column[low:high] % _WIDE] = 1
        out += a @ a.T if right is None else a[:n] @ a[n:].T
    return out


def _heads(links: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node of each one's component within a symmetric matrix of links."""
    order = np.argsort(nodes)
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    label = rank
    while True:
        new = np.minimum(label, np.where(links, label, len(nodes)).min(axis=1))
        new = np.minimum(new, new[order][new])
        if (new == label).all():
            return nodes[order][label]
        label = new


def _compare(similarity: float):
    """For one group of candidates: how many texts each links to, and the least node of its local component."""

    def links_of(sets, sizes, other=None, other_sizes=None):
        common = overlaps(sets, other)
        union = sizes[:, None] + (sizes if other is None else other_sizes)[None, :] - common
        return common / np.maximum(union, 1) >= similarity

    def decided(t):
        import pyarrow as pa

        node, first = np.unique(t.column("node").to_numpy(), return_index=True)
        group, block, copies, i, j = (t.column(c).to_numpy()[first] for c in ("comp", "block", "copies", "i", "j"))
        raw = t.column("ngrams").to_pylist()
        sets = [np.frombuffer(raw[k], np.uint64) for k in first]
        sizes = np.array([len(s) for s in sets], np.float32)
        degree, head = np.zeros(len(node), np.int64), node.copy()
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if i[part[0]] == j[part[0]]:
                if len(part) < 2:
                    continue
                links = links_of([sets[k] for k in part], sizes[part])
                np.fill_diagonal(links, False)
            else:
                a, b = part[block[part] == i[part[0]]], part[block[part] == j[part[0]]]
                if not len(a) or not len(b):
                    continue
                part, links = np.concatenate([a, b]), np.zeros((len(a) + len(b),) * 2, bool)
                links[: len(a), len(a) :] = links_of([sets[k] for k in a], sizes[a], [sets[k] for k in b], sizes[b])
                links |= links.T
            degree[part] = (links * copies[part][None, :]).sum(axis=1)
            head[part] = _heads(links, node[part])
        return pa.table({"node": node, "degree": degree, "head": head})

    def run(t):
        out = decided(t)
        give_back()
        return out

    return run


def ngram_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, keys: bool = False
) -> DataFrame:
    """Every row of docs with its class and its links.

    Two texts are linked if the Jaccard similarity of their sets of n-grams of words is `similarity` or more;
    a class is a connected set of linked texts, its id the least document id in it; n_links counts the other
    documents that a document is linked to. keys: with set_key, the digest of the row's n-gram set. Texts of 1 to words - 1 words have one n-gram, all their words.
    Texts without words, null ones too, have no links and are classes of their own. Ids are taken to be unique
    but for repeated rows, which are copies of each other. Rows without an id are linked like others; a class in which no
    row has an id gets a number of 2 ** 62 or more as its id, ids are to be below that. Other columns are ignored; empty tables give empty results.

    Plan: texts with equal sets are one node. Nodes are dealt by band hashes; a bucket gives each of its nodes one
    edge, to its least one, so buckets cost rows in proportion to their size. The components of these edges
    hold all candidates. A component is one block, or where it is large many: nodes go to blocks by the least node
    that they share a bucket with, those of a large such circle by their own number. A block is compared with itself
    and with the blocks that it shares a bucket with, each pair by one task, on full n-gram sets; a task returns
    one row a node, never pairs. So every pair that shares a band is decided, and others that meet in a block.
    Blocks are bounded by rows and by n-grams; a single larger set is a block of its own.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    bands, rows = bands_and_rows(similarity, recall)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = staged(slim.mapInArrow(_sign(bands, rows, words), "doc_id long, set_key binary, n_ngrams int, bands array<long>"), "signatures")
    reps = staged(
        sig.filter("set_key is not null")
        .groupBy("set_key")
        .agg(F.coalesce(F.min("doc_id"), F.min(_number("set_key"))).alias("node"), F.count("*").alias("copies"), F.first("n_ngrams").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    dealt = reps.select("node", F.explode("bands").alias("band"))
    buckets = dealt.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1").select("band", "v")
    near = staged(dealt.join(buckets, "band").select(F.col("node").alias("u"), "v", "band"), "buckets")
    label = components(near.select("u", "v"))
    home = near.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("home"))
    members = staged(label.withColumnRenamed("label", "comp").join(home, "node").join(reps.select("node", "copies", "n"), "node"), "members")
    tasks = staged(_tasks(members, near, block), "tasks")
    wanted = small(members.select(F.col("node").alias("doc_id")))
    sets = slim.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "node long, ngrams binary")
    unnamed = slim.filter("doc_id is null").mapInArrow(_sets(words, keys=True), "set_key binary, ngrams binary").filter("set_key is not null")
    sets = sets.unionByName(unnamed.select(_number("set_key").alias("node"), "ngrams"))
    found = staged(
        tasks.join(sets, "node").groupBy("task", "i", "j").applyInArrow(_compare(similarity), "node long, degree long, head long"),
        "links",
    )
    degree = found.groupBy("node").agg(F.sum("degree").alias("degree")).filter("degree > 0")
    label = components(found.select(F.col("node").alias("u"), F.col("head").alias("v")))
    node = (
        reps.select("set_key", "node", "copies")
        .join(degree, "node", "left")
        .join(label, "node", "left")
        .select("set_key", "copies", F.coalesce("label", "node").alias("class_id"), (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    rows_ = sig.select("doc_id", "set_key", "n_ngrams")
    classes = staged(node, "classes")
    for done in (near, tasks, found, members):
        drop_staged(done)
    out = join_skewed(rows_.filter("set_key is not null"), classes, ["set_key"], "copies", sig.count())
    empty = rows_.filter("set_key is null").select("set_key", "doc_id", "n_ngrams", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("n_links"))
    out = out.unionByName(empty)  # texts without words meet nothing, so they aren't shuffled
    return out.select(F.col("doc_id").alias(id_col), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_ngrams", *(["set_key"] if keys else []))


def _tasks(members: DataFrame, near: DataFrame, block: int) -> DataFrame:
    """What is compared: node, comp, copies, block by task, i and j. i = j = -1: whole components; else block i with block j of one."""
    size = members.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("weight") / BLOCK_NGRAMS)).cast("int")
    # components of several blocks: one for each block of rows or n-grams at most, so few that they are broadcast
    many = F.broadcast(staged(size.select("comp", parts.alias("g")).filter("g > 1"), "sizes"))
    total = members.agg(F.sum("n").alias("w"), F.count("*").alias("c")).first()
    bins = max(1, math.ceil((total.c or 0) / block), math.ceil((total.w or 0) / BLOCK_NGRAMS))
    one = members.join(many, "comp", "left_anti").select(
        "node", "comp", "copies", F.lit(0).alias("block"), F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j")
    )
    rest = members.join(many, "comp")
    circle = rest.groupBy("comp", "home").agg(F.count("*").alias("_c"), F.sum("n").alias("_w"))
    wide = circle.filter((F.col("_c") * 8 > block) | (F.col("_w") * 8 > BLOCK_NGRAMS)).select("comp", "home", F.lit(True).alias("_wide"))
    rest = rest.join(small(wide), ["comp", "home"], "left")
    at = F.pmod(F.when(F.col("_wide"), F.xxhash64("node")).otherwise(F.xxhash64("home")), F.col("g")).cast("int")
    placed = staged(rest.select("node", "comp", "copies", at.alias("block")), "blocks")
    shared = staged(near.join(placed.select(F.col("node").alias("u"), "comp", "block"), "u").select("comp", "band", "block").distinct(), "shared")
    pairs = shared.join(shared.withColumnRenamed("block", "other"), ["comp", "band"]).filter("block <= other")
    own = placed.select("comp", "block", F.col("block").alias("other"))
    pairs = staged(pairs.select("comp", "block", "other").unionByName(own).distinct().select("comp", F.col("block").alias("i"), F.col("other").alias("j")), "pairs")
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    cut = placed.join(small(ends), ["comp", "block"]).select("node", "comp", "copies", "block", F.col("comp").alias("task"), "i", "j")
    return one.unionByName(cut)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class, all columns as they came: that of the least id.

    Of repeated rows with the id that stays, all stay: ids are taken to be unique but for them. Rows without an id go
    where their class has a row with one; of a class in which no row has one, one row stays, of the texts with the
    least number the one that sorts first. Rows without words are classes of their own and stay, all of them.
    """
    linked = ngram_links(docs, id_col, text_col, keys=True, **options)
    links = staged(linked, "classes")
    named = links.filter(F.col(id_col).isNotNull())
    go = staged(named.filter(F.col(id_col) != F.col("class_id")).select(id_col).distinct(), "copies")
    rest = docs.join(small(go), id_col, "left_anti")
    unnamed = links.filter(F.col(id_col).isNull() & F.col("set_key").isNotNull())
    if not unnamed.limit(1).count():
        return rest
    arrow_limits(docs.sparkSession)
    stay = staged(unnamed.filter(F.col("class_id") == _number("set_key")).select("set_key").distinct(), "stay")
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    alone = docs.filter(F.col(id_col).isNull()).select(whole, F.col(text_col).alias("_text"))
    words = options.get("words", WORDS)

    def keys(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [ngram_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(g) if g else None for g in sets], pa.binary())], ["_row", "set_key"])

    schema = StructType([StructField("_row", docs.select(whole).schema["_row"].dataType), StructField("set_key", BinaryType())])
    keyed = alone.mapInArrow(keys, schema)
    first = keyed.join(small(stay), "set_key").groupBy("set_key").agg(F.min_by("_row", F.struct(F.col(f"_row.{text_col}"), F.xxhash64("_row"))).alias("_row"))
    none = keyed.filter("set_key is null")
    named_rows = docs.filter(F.col(id_col).isNotNull()).join(small(go), id_col, "left_anti").select(*docs.columns)
    return named_rows.unionByName(first.select("_row.*")).unionByName(none.select("_row.*"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_links(table(spark, sf_dir, "documents"))
