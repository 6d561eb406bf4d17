import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import (
    common,
    exact_dedup,
    mixing,
    ngram_join,
    packing,
    pseudo_likelihood,
    quality_rules,
    quality_zstd,
    queries,
    secrets_grammar,
    token_orc,
    toxicity_pu,
)
from matchloom.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string"
ODD = [
    (1, None, "en", "a", 1, 9, "x"), (2, "", "en", None, 1, 9, "x"), (3, " \n\t", None, "a", 1, 9, "x"), (4, "a b c d e f g", "en", "b", 1, 9, "x"),
    (5, "a  b c d e f g", "en", "b", 1, 9, "x"), (5, "a  b c d e f g", "en", "b", 1, 9, "x"), (None, "a b c", "de", "b", 1, 9, "x"),
    (7, "word " * 30000, "en", "c", 1, 9, "x"), (8, "日本 é x", "en", "c", 1, 9, "x"),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall())


def ids_of(text):
    return np.array(encoder().whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(cols).collect()), key=str) == sorted(want, key=str)


def test_chunks_like_the_tokenizer():
    r, e = random.Random(3), encoder()
    signs = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0abZé9'.,!?s_-", " ", "   ", "　", "'re", "'ll", "'LL", "A's", "I'M", "  ", "日本", "<|endoftext|>", "​", "ß", "½", "²", "µ", "ª", "÷", "×", "\xad", "\u024f", "\u0250", "Ǆ", "ʼ", "12", "\u0301", "\U0001f600"]
    for _ in range(6000):
        x = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert e.encode([x])[0] == ids_of(x)[:-1].tobytes(), repr(x)


def scanned(df):
    """Rows of the result, and rows that the scan gave."""
    n = len(df.collect())
    return n, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_token_files_skip(spark, tmp_path):
    import pyarrow.orc

    path = str(tmp_path / "t")
    docs = spark.range(0, 24000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    token_orc.write_tokens(docs, path, files=3)
    for name in (f for f in os.listdir(path) if f.endswith(".orc")):
        f = pyarrow.orc.ORCFile(f"{path}/{name}")
        assert f.nstripes >= 1 and f.file_version == "0.12" and f.row_index_stride == 1000  # 0.12: run-length encoding, version 2
    assert scanned(token_orc.read_tokens(spark, path)) == (12000, 12000)
    assert scanned(token_orc.read_tokens(spark, path, 100, 110)) == (6, 1000)  # one row group of its stripe
    assert scanned(token_orc.read_tokens(spark, path, ids=[300, 20000])) == (2, 2000)
    absent = [scanned(token_orc.read_tokens(spark, path, ids=[k])) for k in range(301, 341, 2)]  # between ids that are there: Bloom filters alone tell
    assert all(n == 0 for n, _ in absent) and sum(read == 0 for _, read in absent) >= 18


def test_borders(spark):
    for borders in ([], [5], [1, 4, 9], list(range(0, 400, 3))):
        df = spark.range(-2, 420).union(spark.createDataFrame([(None,)], "id long"))
        got = {r.id: r.k for r in df.select("id", token_orc._borders_below(F.col("id"), borders).alias("k")).collect()}
        assert got == {k: 0 if k is None else sum(b <= k for b in borders) for k in got}


def test_token_files(spark, docs, texts, tmp_path):
    path = str(tmp_path / "t")
    token_orc.write_tokens(docs, path, files=3)
    got = {r.doc_id: r for r in token_orc.token_digests(spark, path).collect()}
    start = 0
    for k, t in texts.items():
        ids = ids_of(t)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_orc.read_tokens(spark, path, 10, 12).orderBy("doc_id").collect()] == [k for k in texts if 10 <= k <= 12]
    files = sorted(f for f in os.listdir(path) if f.endswith(".orc"))
    ranges = [spark.read.orc(f"{path}/{f}").agg(F.min("doc_id"), F.max("doc_id")).first() for f in files]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_packing(spark, docs, texts):
    rows = packing.pack_documents(docs).toPandas().sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    total = 0
    for k, part in rows.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        ids = ids_of(texts[k])
        total += len(ids)
        assert part.length.sum() == len(ids) and (part.start.values == np.cumsum(part.length) - part.length).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(part.start, part.length, part.ids_crc32, strict=True))
        assert len(part) == 1 or (part.length.values[1:] == 2048).all()
    assert rows.sequence_id.nunique() <= -(-total // 2048) + 2


def test_configuration_program():
    r = np.random.default_rng(1)
    counts = np.bincount(r.integers(1, 65, 3000), minlength=65)[1:]
    groups = packing.solve(counts, 64, 200)
    covered = np.zeros(64, int)
    for pattern, n in groups:
        assert sum(a * b for a, b in pattern.items()) <= 64
        for a, b in pattern.items():
            covered[a - 1] += b * n
    used = sum(n for _, n in groups)
    assert (covered == counts).all() and used <= sum(n for _, n in packing.best_fit(counts.copy(), [], 64)) and used * 64 <= 1.01 * (counts * np.arange(1, 65)).sum()
    value = r.random(20)
    best = [0.0] * 31
    for c in range(1, 31):
        best[c] = max([best[c - 1], *(best[c - n] + value[n - 1] for n in range(1, min(c, 20) + 1))])
    assert abs((packing.knapsack(np.concatenate([value, np.zeros(10)]), 30) * np.concatenate([value, np.zeros(10)])).sum() - best[30]) < 1e-9


def brute_links(texts):
    sets = {k: ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for k, t in texts.items() for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")]}
    links, where = {k: set() for k in sets}, {}
    for k, s in sets.items():
        for j, n in Counter(j for g in s for j in where.get(g, ())).items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                links[k].add(j)
                links[j].add(k)
        for g in s:
            where.setdefault(g, []).append(k)
    label = {}
    for k in sorted(sets):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = k
                todo += links[x]
    return {k: (label[k], len(links[k])) for k in sets}


def test_ngram_join(spark, docs, texts):
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_links(docs).collect()} == brute_links(texts)


def test_ngram_join_in_blocks(spark):
    r = random.Random(2)
    base = [str(r.random()) for _ in range(120)]
    made = {k: " ".join([*base[: r.randint(95, 120)], f"x{k}"]) for k in range(1, 41)}
    df = spark.createDataFrame([(k, t) for k, t in made.items()], "doc_id long, text string")
    assert {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.ngram_links(df, block=7).collect()} == brute_links(made)


def test_recall(spark):
    """Links found on sf0.01, against all that there are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_links({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_links(docs).collect()}
    recall = sum(min(got[k][1], n) for k, (_, n) in want.items()) / sum(n for _, n in want.values())
    print(f"recall of links on sf0.01: {recall:.4f} of {sum(n for _, n in want.values())}")
    assert recall >= 0.99 and all(got[k][1] <= n for k, (_, n) in want.items())


def test_bands():
    for s in (0.01, 0.015, 0.2, 0.5, 0.8, 0.95, 1.0):
        for recall in (0.9, 0.99):
            bands, rows = ngram_join.bands_and_rows(s, recall)
            assert 1 - (1 - s**rows) ** bands >= recall - 1e-9 and (bands * rows <= ngram_join.HASHES or rows == 1)
    assert ngram_join.bands_and_rows() == (26, 8)
    for bad in ((0, 0.9), (0.8, 1), (1.1, 0.9)):
        with pytest.raises(ValueError):
            ngram_join.bands_and_rows(*bad)


def test_joined_at_low_similarity(spark):
    r = random.Random(3)
    made = {k: " ".join(r.choices([f"w{i}" for i in range(40)], k=30)) for k in range(30)}
    made |= {k + 100: " ".join([*made[k].split()[:22], *r.choices(["q", "z"], k=8)]) for k in range(30)}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    sets = {k: set(zip(*[t.split()[i:] for i in range(2)], strict=False)) for k, t in made.items()}
    pairs = sum(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3 for a in sets for b in sets if a != b)
    assert sum(x.n_links for x in ngram_join.ngram_links(df, words=2, similarity=0.3).collect()) >= 0.97 * pairs > 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t, scan):
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    base = sorted(spans, key=lambda x: (x[1], secrets_grammar.KINDS.index(x[0])))
    for m in re.finditer("[A-Za-z0-9+/_.=-]+", t):
        a = m.start() + len(m[0]) - len(m[0].lstrip("."))
        b = m.end() - len(m[0]) + len(m[0].rstrip("."))
        if a < b and scan.score(t[a:b]) >= scan.evidence:
            spans.append(("grammar", a, b))
        elif a < b and re.search("[/.=]", t[a:b]):
            spans += [("grammar", a + q.start(), a + q.end()) for q in re.finditer("[^/.=]+", t[a:b]) if scan.score(q[0]) >= scan.evidence]
    return base, sorted(spans, key=lambda x: (x[1], secrets_grammar.KINDS.index(x[0])))


def test_secrets(spark, docs, texts):
    scan = secrets_grammar.default_scanner()
    key = "ghp_" + "aB3dE6gH9" * 4
    more = {-1: f"see {key} now", -2: f"password = {key}", -3: f"https://x.y/{key[:36]}.", -4: "..." + key + "...", -5: "é日" + key, -6: ".", -7: "Pa55", -8: "AKIA" + "Q7" * 10}
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets_grammar.digests(secrets_grammar.scan_secrets(both)).collect()}
    for k, t in {**texts, **more}.items():
        base, all_ = brute_spans(t, scan)
        assert got[k].base_sha256 == hashlib.sha256(secrets_grammar.written(base).encode()).hexdigest()
        assert got[k].spans == secrets_grammar.written(all_)
        assert got[k].n_assign == sum(x[0] == "assign" for x in base)
    assert [got[-k].n_grammar for k in range(1, 8)] == [1, 1, 1, 1, 1, 0, 0]
    good, plain = secrets_grammar.labelled_credentials(40, 77)
    assert np.mean([scan.score(x) >= scan.evidence for x in good]) > 0.95 and np.mean([scan.score(x) >= scan.evidence for x in plain]) < 0.01


def test_candidates_of_any_length():
    scan, r = secrets_grammar.default_scanner(), random.Random(2)
    parts = ["ghp_", "aB3", "9x/", "/", ".", " ", "=", "é", "日", "\n", "Zz9Q", "-", "_", "0f3a9c", "word", "KEY", "\U0001f600"]
    for _ in range(200):
        made = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(4)]
        assert scan.spans(made) == [brute_spans(t, scan)[1] for t in made]
    short = [t for t in ("".join(r.choices("abXY019", k=15)) for _ in range(300)) if scan.score(t) >= scan.evidence]
    assert short and all(scan.spans([f"x {t} y"]) == [[("grammar", 2, 17)]] for t in short)
    assert len(scan.spans(["z" * 100_000 + " " + "Zq9" * 50])[0]) == 1
    # an automaton's probabilities sum to one over all that can follow, the end too
    a = secrets_grammar.Automaton(["hd", "hd", "u"])
    follow, gain, end = a.tables()
    assert np.allclose(np.exp(gain).sum(axis=1) + np.exp(end), 1)
    assert abs(a.log_likelihood("hd") - (gain[0][0] + gain[follow[0][0]][3] + end[follow[follow[0][0]][3]])) < 1e-12


@pytest.mark.parametrize("op, label, least", [(quality_zstd.op1_quality_zstd, "quality", 0.9), (toxicity_pu.op10_toxicity_pu, "toxic", 0.9)])
def test_held_out_accuracy(spark, op, label, least):
    sf = "/root/testdata/sf0.01"
    d = op(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = d[d.held_out]
    assert (held.predicted == held[label]).mean() > least and d.score.between(0, 1).all()


def test_quality_like_a_restatement(spark):
    """The registered query against windows compressed one by one with the model's dictionaries."""
    import zstandard as z

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality_zstd.fit_model(docs, labels)
    got = {r.doc_id: r for r in quality_zstd.op1_quality_zstd(spark, sf).collect()}
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    size = lambda part, d: len(z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(part))
    assert len(got) == len(text)
    for k, raw in text.items():
        cut = [raw[a : a + 2048] for a in range(0, len(raw), 2048)]
        sizes = [(size(p, m.good), size(p, m.bad)) for p in cut]
        g, b = sum(x for x, _ in sizes), sum(y for _, y in sizes)
        d = (b - g) / (b + g) if raw else 0.0
        low = min([1.0, *((y - x) / (y + x) for (x, y), p in zip(sizes, cut, strict=True) if len(p) >= 512 or p is cut[0])]) if raw else 0.0
        score = 1 / (1 + np.exp(-(m.weights[0] + m.weights[1] * d + m.weights[2] * low)))
        assert abs(got[k].difference - d) < 1e-12 and abs(got[k].score - score) < 1e-9
        assert got[k].predicted == (got[k].score >= 0.7) and got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)


LABELS = "doc_id long, quality int, toxic int"


def test_models_from_odd_tables(spark):
    none, odd = docs_of(spark, []), docs_of(spark, ODD)
    cases = [(none, [(k, 1, 0) for k in range(9)]), *((odd, rows) for rows in ([], [(1, 1, 1), (None, 0, 0), (99, 0, 0)], [(k, 1, 0) for k in range(9)], [(k, None, None) for k in range(9)]))]
    for docs, rows in cases:
        labels = spark.createDataFrame(rows, LABELS)
        m = quality_zstd.fit_model(docs, labels)
        n = len([1 for k, q, _ in rows if q is not None and k is not None and docs is odd and zlib.crc32(str(k).encode()) % 4 == 3 and k in {r[0] for r in ODD}])
        assert not m.trained and abs(m.score([(0.0, 0.0)])[0] - (n + 1) / (n + 2)) < 1e-9
        assert quality_zstd.keep_good(odd, m).count() == len(ODD)
        t = toxicity_pu.fit_model(docs, labels)
        assert t.weights == {} and t.scores(["a", ""]).tolist() == pytest.approx([0.1, 0.1])
    # repeated ids and labels: the greatest text and label, in every run
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 0)], LABELS)
    got = [quality_zstd.sample(twice, labels, F.col("quality"), F.lit(True), 9, 1) for _ in range(2)]
    assert got[0] == got[1] and sorted(x[:2] for x in got[0]) == [("", 1), ("b", 1)]


def test_keep_good_on_odd_rows(spark):
    m = quality_zstd.train(["a b c d e f g h"] * 9, ["x!! y!! z!!"] * 9, [("a b c", 1, 0), ("x!! y!!", 0, 0)] * 5)
    odd = docs_of(spark, ODD)
    scores = {r.doc_id: r.score for r in quality_zstd.score_quality(odd, m).collect()}
    want = Counter(r[0] for r in ODD if scores[r[0]] >= 0.7)
    out = quality_zstd.keep_good(odd, m)
    assert m.trained and out.columns == odd.columns and Counter(r.doc_id for r in out.collect()) == want
    assert quality_zstd.keep_good(docs_of(spark, []), m).count() == 0


def test_pu_risk():
    r = np.random.default_rng(0)
    pos = lambda n: (r.random((n, 3)) < [0.9, 0.5, 0.5]).astype(np.float32)
    neg = lambda n: (r.random((n, 3)) < [0.05, 0.5, 0.5]).astype(np.float32)
    w, c = toxicity_pu.nnpu(pos(400), np.concatenate([pos(100), neg(400)]), 0.2)
    assert w[0] > 2 > 1 > abs(w[1]) and c < 0
    for prior in (0.05, 0.3):
        n = int(4000 * prior)
        p = toxicity_pu.prior_of(r.normal(2, 1, 1000), np.concatenate([r.normal(2, 1, n), r.normal(-2, 1, 4000 - n)]))
        assert abs(p - prior) < 0.04


def test_pu_reads_unlabelled_text(spark, monkeypatch):
    """The unlabelled sample comes from all documents, labels of 0 are never read, the prior is estimated near the truth."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = {}
    train = toxicity_pu.train
    monkeypatch.setattr(toxicity_pu, "train", lambda t, u, prior=None: seen.update(t=t, u=u) or train(t, u, prior))
    m = toxicity_pu.fit_model(docs, labels, unlabelled_rows=2000)
    fewer = toxicity_pu.fit_model(docs, labels.filter("toxic = 1"), unlabelled_rows=2000)
    assert m == fewer and len(seen["u"]) == 2000
    have = {r.text for r in docs.join(labels, "doc_id").select("text").collect()}
    assert sum(t not in have for t in seen["u"]) > 800  # six of ten documents have no label
    share = labels.agg(F.avg("toxic")).first()[0]
    assert abs(m.prior - share) < 0.04
    texts = ["you idiot", "a fine day", ""]
    for t, s in zip(texts, m.scores(texts), strict=True):  # word by word
        z = m.constant + sum(m.weights.get(f, 0.0) for w in set(t.split()) for f in toxicity_pu.word_features(w))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12


def softmax_sum(net, words, classes, branch):
    """Sum of log p(branch | context), one word after the other. words: vectors' numbers."""
    padded, total = [classes] * 2 + list(words) + [classes] * 2, 0.0
    for i, target in enumerate(branch):
        h = np.tanh(sum(net.embed[padded[i + 2 + p]] * net.place[n] for n, p in enumerate((-2, -1, 1, 2))))
        c, j = divmod(int(target), 32)
        for z, at in ((h @ net.w1 + net.b1, c), (h @ net.w2[c] + net.b2[c], j)):
            total += float(z[at] - np.log(np.exp(z).sum()))
    return total


@pytest.mark.parametrize("classes", [1024, 1536])
def test_gradients(classes):
    P = pseudo_likelihood
    r = np.random.default_rng(0)
    flat = P.Network.start(classes).astype(float)
    sizes = np.array([30, 0, 1])
    vectors, target = r.integers(0, classes, 31).astype(np.int32), r.integers(0, 1024, 31).astype(np.int16)
    stream, at = P.stream_of(vectors, sizes, classes)
    assert stream[at].tolist() == vectors.tolist() and (np.delete(stream, at) == classes).all() and at[0] == 2 and at[30] == 36 and len(stream) == 39
    g = P.Network.of(flat, classes).gradient(stream, at, target)
    tail = len(flat) - P.Network.of(flat, classes).w2.size - 1024 - 32 - 16 * 32 - 64  # where the weights of the places begin
    for k in [*np.argsort(-np.abs(g))[[0, 50, 500]], *range(tail, tail + 64, 9)]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (P.Network.of(down, classes).log_probs(stream, at, target).mean() - P.Network.of(up, classes).log_probs(stream, at, target).mean()) / 2e-5
        assert abs(slope - g[k]) < 1e-5
    net = P.Network.of(flat, classes)
    mass = [net.log_probs(stream, at[5:6], np.array([t]))[0] for t in range(1024)]  # one context, every branch
    assert abs(np.exp(mass).sum() - 1) < 1e-6
    assert abs(net.log_probs(stream, at[:30], target[:30]).sum() - softmax_sum(net, vectors[:30], classes, target[:30])) < 1e-8
    assert np.allclose(net.log_probs(stream, at, target), np.concatenate([net.log_probs(stream, at[:7], target[:7]), net.log_probs(stream, at[7:], target[7:])]))


def test_pseudo_likelihood(spark, docs, texts):
    P = pseudo_likelihood
    known = P.known_words(docs)
    trained = P.train(docs, known)
    before = P.score_texts(docs, known, P.Network.start(P.classes_of(known))).agg(F.sum("log_prob")).first()[0]
    rows = {r.doc_id: r for r in P.score_texts(docs, known, trained).collect()}
    assert sum(r.log_prob for r in rows.values()) > before
    words, classes = P.Words(known), P.classes_of(known)
    for k in list(texts)[:20]:
        found = [words[w] for w in texts[k].encode().split()]
        want = softmax_sum(P.Network.of(trained, classes), words.vector[found], classes, words.branch[found])
        assert abs(want - rows[k].log_prob) < 1e-2 * max(1, len(found) / 100)


def test_word_vectors_grow(spark, docs):
    P = pseudo_likelihood
    words = [f"w{k}" for k in range(40000)]
    many = spark.createDataFrame([(k, " ".join(words[k::40] * 2)) for k in range(40)], "doc_id long, text string")
    known = P.known_words(many)
    assert len(known) == 900 > 768 and P.classes_of(known) > P.classes_of(P.known_words(docs)) == 1024
    w = P.Words(known)
    assert len({w.vector[w[x.encode()]] for x in known}) == 900 and max(w.vector) < P.classes_of(known)
    assert all(w.branch[w[x.encode()]] == P.branch_of(x.encode(), k) for k, x in enumerate(known))
    assert w.branch[w[b"never seen"]] == P.branch_of(b"never seen", None)
    got = P.pseudo_likelihood(many).agg(F.sum("n_words"), F.sum("log_prob")).first()
    assert got[0] == 80000 and np.isfinite(got[1]) and got[1] < 0


def test_probability_of_each_word(spark, docs, texts, monkeypatch):
    P = pseudo_likelihood
    counts = P.word_counts(docs)
    known = P.known_words(docs)
    flat = P.Network.start(P.classes_of(known))
    n = Counter(w for t in texts.values() for w in t.encode().split())
    rank = {w.encode(): k for k, w in enumerate(known)}
    branch = lambda w: P.branch_of(w, rank.get(w))
    inside = {}
    for w, m in n.items():
        if branch(w) >= 768:
            inside.setdefault(branch(w), []).append(m)
    log_p = lambda w: 0.0 if branch(w) < 768 else np.log((n[w] + 0.5) / (sum(inside[branch(w)]) + len(inside[branch(w)])))
    junk = next(x for x in (f"zq{k}xj" for k in range(9999)) if branch(x.encode()) in inside and x.encode() not in n)
    seen = next(w for w in n if branch(w) == branch(junk.encode()) and w not in rank).decode()
    all_ = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, f"the {seen} x"), (-2, f"the {junk} x"), (None, junk), (None, None)], "doc_id long, text string"))
    plain = {(r.doc_id, r.n_words): r.log_prob for r in P.score_texts(all_, known, flat).collect()}
    for held in (16, 1):
        monkeypatch.setattr(P, "HELD", held)
        got = P.score_texts(all_, known, flat, counts=counts).collect()
        assert len(got) == len(texts) + 4
        want = {**texts, -1: f"the {seen} x", -2: f"the {junk} x"}
        for r in got:
            text = want[r.doc_id] if r.doc_id is not None else junk if r.n_words else ""
            assert abs(r.log_prob - plain[r.doc_id, r.n_words] - sum(map(log_p, text.encode().split()))) < 1e-5 * max(1, r.n_words)
        by = {r.doc_id: r.log_prob for r in got}
        assert by[-2] < by[-1] - 0.9 and abs(plain[-1, 3] - plain[-2, 3]) < 1e-4


def test_mixing_targets(spark, docs):
    rows = mixing.mix(docs).toPandas()
    for _, part in rows.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() and (part.taken <= 3 * part["size"]).all()
    again = mixing.repeat_rows(docs).groupBy("doc_id").count()
    assert {r[0]: r[1] for r in again.collect()} == {k: n for k, n in zip(rows.doc_id, rows.copies, strict=True) if n}


def brute_mix(rows, copies, seed=17):
    """Copies by row for rows (id, source, size): certain ones, then the order sample, one source after the other."""
    out = Counter()
    sizes = Counter()
    for _, src, size in rows:
        sizes[src] += size
    names = sorted(sizes, key=lambda x: (x is None, x))
    w = {x: (5.0, 2.0, 1.0)[k % 3] for k, x in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        level = (sum(sizes.values()) - sum(target.values())) / sum(w[x] for x in open_)
        over = [x for x in open_ if w[x] * level >= 3 * sizes[x]]
        for x in over or list(open_):
            target[x] = 3.0 * sizes[x] if over else w[x] * level
            open_.discard(x)
    for src in names:
        own = [r for r in rows if r[1] == src]
        rate = target[src] / sizes[src] if sizes[src] else 0.0
        whole, part = int(rate), rate - int(rate)
        rest, done = target[src] - whole * sizes[src], 0
        ranked = []
        for k, (i, _, size) in enumerate(own):
            u = (int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            if size > 0 and part > 0:
                ranked.append(((u / (1 - u)) / (part / (1 - part) * (size * len(own) / sizes[src]) ** 0.5), -1 << 63 if i is None else i, size, k))
            out[i, src, size] += whole
        for _, _, _, k in sorted(ranked):
            i, _, size = own[k]
            more = done + size - rest <= rest - done
            done += size
            out[i, src, size] += more
    return Counter({k: n for k, n in out.items() if n})


def test_repeated_rows_are_mixed_one_by_one(spark):
    r = random.Random(6)
    made = [(k % 40 if k % 3 else None, r.choice(["a", "b", "c", None]), " ".join(["w"] * r.choice([3, 7, 12]))) for k in range(400)]
    df = spark.createDataFrame(made, "doc_id long, source string, text string")
    want = brute_mix([(i, s, len(t.split())) for i, s, t in made], None)
    for bins in (1, 4096):
        got = Counter((x.doc_id, x.source, len(x.text.split())) for x in mixing.repeat_rows(df, bins=bins).collect())
        assert got == want
        mixed = Counter()
        for x in mixing.mix(df, bins=bins).collect():
            mixed[x.doc_id, x.source, x["size"]] += x.copies
        assert Counter({k: n for k, n in mixed.items() if n}) == want


def test_rules_at_their_borders(spark):
    """No feature stops anywhere: long words are told from ordinary ones, and junk can't lift its group's limits."""
    text = lambda word, n=60: " ".join(f"{word}{k:03d}" for k in range(n))
    rows = [(k, text("abc"), "en", "s") for k in range(200)]
    rows += [(1000 + k, text("x" * 400), "en", "s") for k in range(3)] + [(1100, "y" * 60000, "en", "s"), (1101, " ".join("ab" for _ in range(60)), "en", "s")]
    rows += [(2000 + k, text("#####a"), "en", "junk") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert all(got[k].kept for k in range(200)) and not any(got[1000 + k].kept for k in range(3))
    assert got[1100].base_failed and got[1101].base_failed
    assert not any(got[2000 + k].kept or got[2000 + k].base_failed for k in range(60))
    short = [(3000, " ".join(chr(0x4E00 + k) for k in range(60)), "en", "s")]
    one = quality_rules.apply_rules(df.unionByName(spark.createDataFrame(short, df.schema))).filter("doc_id = 3000").first()
    assert not one.base_failed and not one.kept  # words of one character, far below the group's


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_odd_rows_one_by_one(spark):
    odd = docs_of(spark, ODD)
    got = by_id(exact_dedup.exact_groups(odd), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 1, True), (7, 7, 1, True), (8, 8, 1, True)], key=str)
    assert Counter(r.doc_id for r in exact_dedup.keep_one(odd).collect()) == Counter([3, 5, None, 7, 8])
    got = by_id(ngram_join.ngram_links(odd), "doc_id", "class_id", "n_links", "n_ngrams")
    number = next(x[1] for x in got if x[0] is None)
    assert number >= 1 << 62 and got == sorted([(1, 1, 0, 0), (2, 2, 0, 0), (3, 3, 0, 0), (4, 4, 2, 3), (5, 4, 2, 3), (5, 4, 2, 3), (None, number, 0, 1), (7, 7, 0, 1), (8, 8, 0, 1)], key=str)
    got = by_id(packing.pack_documents(odd, rounds=5), "doc_id", "piece", "length")
    want = []
    for r in ODD:
        n = len(ids_of(r[1]))
        sizes = [n] if n <= 2048 else [n % 2048 or 2048, *[2048] * ((n - 1) // 2048)]
        want += [(r[0], k, m) for k, m in enumerate(sizes)]
    assert got == sorted(want, key=str)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = [(r[0], r[3], words(r[1])) for r in ODD]
    assert Counter((x.doc_id, x.source, words(x.text)) for x in mixing.repeat_rows(odd).collect()) == brute_mix(sizes, None)
    got = by_id(quality_rules.apply_rules(odd), "doc_id", "n_words", "word_chars", "n_repeat_words", "base_failed", "kept")
    assert got == sorted([(k, n, c, 30000 if n == 30000 else 0, True, False) for k, n, c in ((1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 7, 7), (5, 7, 7), (5, 7, 7), (None, 3, 3), (7, 30000, 120000), (8, 2, 5))], key=str)
    got = by_id(pseudo_likelihood.pseudo_likelihood(odd), "doc_id", "n_words")
    assert got == sorted([(1, 0), (2, 0), (3, 0), (4, 7), (5, 7), (5, 7), (None, 3), (7, 30000), (8, 2)], key=str)
    assert all(r.log_prob == 0 if r.n_words == 0 else r.log_prob < 0 for r in pseudo_likelihood.pseudo_likelihood(odd).collect())
    assert {(len(r.spans)) for r in secrets_grammar.scan_secrets(odd).collect()} == {0}
    m = toxicity_pu.Model({"word": 3.0}, -1.0, 0.1)
    assert by_id(toxicity_pu.score_toxicity(odd, m).withColumn("s", F.round("score", 6)), "doc_id", "s") == sorted([(r[0], round(1 / (1 + np.exp(-(2.0 if r[0] == 7 else -1.0))), 6)) for r in ODD], key=str)


OPS = {
    "op1": lambda d: quality_zstd.score_quality(d, quality_zstd.train(["a b c"], ["x!! y!!"], [("a b", 1, 0), ("x!!", 0, 0)])),
    "op3": exact_dedup.exact_groups,
    "op3 keep": exact_dedup.keep_one,
    "op4": ngram_join.ngram_links,
    "op4 keep": ngram_join.keep_one,
    "op5": lambda d: packing.pack_documents(d, rounds=5),
    "op6": mixing.mix,
    "op6 rows": mixing.repeat_rows,
    "op7": quality_rules.apply_rules,
    "op8": pseudo_likelihood.pseudo_likelihood,
    "op9": secrets_grammar.scan_secrets,
    "op10": lambda d: toxicity_pu.score_toxicity(d, toxicity_pu.Model({"a": 1.0}, -1.0, 0.1)),
}


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, name):
    assert OPS[name](docs_of(spark, [])).count() == 0


def test_one_row_of_each_text_without_ids(spark):
    rows = [(None, "a b c d e f", "en", "s", 1, 1, "x"), (None, "a b  c d e f", "en", "s", 1, 2, "x"), (None, "abcdef", "en", "s", 1, 3, "x"), (None, None, "en", "s", 1, 4, "x"), (None, "", "en", "s", 1, 5, "x"), (None, " ", "en", "s", 1, 6, "x"), (3, "zz", "en", "s", 1, 7, "x"), (None, "z z", "en", "s", 1, 8, "x"), (4, "y  y", "en", "s", 1, 9, "x"), (None, "yy", "en", "s", 1, 10, "x")]
    df = docs_of(spark, rows)
    # of each text the longest row, whether it has an id or not
    assert sorted(r["size"] for r in exact_dedup.keep_one(df).collect()) == [2, 6, 8, 9]
    flags = exact_dedup.exact_groups(df)
    assert flags.filter("kept").count() == 4 and flags.count() == len(rows)
    near = [(None, "q " * 5 + " ".join(f"w{k}" for k in range(100)) + f" e{j}", "en", "s", 1, j, "x") for j in range(3)]
    near += [(5, " ".join(f"v{k}" for k in range(100)), "en", "s", 1, 10, "x"), (None, " ".join(f"v{k}" for k in range(101)), "en", "s", 1, 11, "x"), (None, None, "en", "s", 1, 12, "x"), (None, "", "en", "s", 1, 13, "x"), (None, near[0][1], "en", "s", 1, 14, "x")]
    got = [r["size"] for r in ngram_join.keep_one(docs_of(spark, near)).collect()]
    assert len(got) == 4 and {10, 12, 13} < set(got) and len(set(got) & {0, 1, 2, 14}) == 1


def test_odd_rows_as_token_files(spark, tmp_path):
    for k, rows in enumerate(([], ODD)):
        token_orc.write_tokens(docs_of(spark, rows), str(tmp_path / str(k)), files=2)
        assert token_orc.token_digests(spark, str(tmp_path / str(k))).count() == len(rows)


def test_pipeline(spark, texts):
    """Each stage against a plain restatement of its decision, on what its predecessor kept."""
    at = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        before, after = {r.doc_id: r for r in at.collect()}, out.collect()
        if name == "quality_classifier":
            model = quality_zstd.fit_model(at, spark.read.parquet(f"{SF}/labels.parquet"))
            c = model.compressors()
            want = {k for k, r in before.items() if model.score(model.features(r.text, c))[0] >= 0.7}
        elif name == "exact_dedup":
            best = {}
            for r in before.values():
                key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text), r.doc_id))
            want = {k for _, k in best.values()}
        elif name == "ngram_join":
            want = {c for c, _ in brute_links({k: r.text for k, r in before.items()}).values()}
        if name in ("quality_classifier", "exact_dedup", "ngram_join"):
            assert {r.doc_id for r in after} == want and len(after) == len(want)
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(at).collect()}
            assert Counter(r.doc_id for r in after) == Counter({k: n for k, n in copies.items() if n})
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            at = spark.createDataFrame(after, out.schema)
        else:
            n = at.count()
            assert sum(r.piece == 0 for r in after) == n
            assert sum(r.length for r in after) == sum(len(ids_of(r.text)) for r in at.collect())


def test_formats_left_out_of_training():
    good, plain = secrets_grammar.labelled_credentials()
    new, ordinary = secrets_grammar.labelled_credentials(40, 77)
    for k in range(9):  # credentials come format by format
        scan = secrets_grammar.Scanner([x for n, x in enumerate(good) if n % 9 != k], plain)
        assert sum(scan.score(x) >= scan.evidence for x in new[k::9]) >= 36
        assert np.mean([scan.score(x) >= scan.evidence for x in ordinary]) < 0.01
    r, scan = random.Random(5), secrets_grammar.default_scanner()
    of = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    for made in (lambda: "hf_" + of(34), lambda: "npm_" + of(36), lambda: "SG." + of(22) + "." + of(43), lambda: "sk-" + of(48)):  # formats of no training set
        assert sum(scan.score(made()) >= scan.evidence for _ in range(100)) >= 97


def test_near_copies_without_an_id(spark):
    base = [f"b{k}" for k in range(120)]
    other = [f"c{k}" for k in range(120)]
    rows = [(7, [*base, "x"]), (None, [*base, "y"]), (9, [*base, "z"]), (None, [*other, "x"]), (None, [*other, "y"]), (None, ["alone"] * 9)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.class_id, x.n_links) for x in ngram_join.ngram_links(df).collect())
    ids = {c for k, c, n in got if c != 7}
    assert [(k, n) for k, c, n in got if c == 7] == [(0, 2), (7, 2), (9, 2)]
    assert len(ids) == 2 and min(ids) >= 1 << 62
    assert sorted(n for _, c, n in got if c != 7) == [0, 1, 1]


def test_whole_pipeline(spark, texts):
    """run() against the stages one after the other, each held against brute force in test_pipeline()."""
    got = corpus_pipeline.run(spark, SF)
    rows = got.toPandas().sort_values(["sequence_id", "offset"])
    at = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
    copies = Counter(r.doc_id for r in at.select("doc_id").collect())
    want = Counter()
    for k, n in copies.items():
        ids = ids_of(texts[k])
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want[k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    assert Counter(zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32, strict=True)) == want
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all() and rows.groupby("sequence_id").length.sum().max() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 2


def test_staged_tables_can_be_deleted(spark):
    t = common.staged(spark.range(3), "x")
    kept = common.staged(spark.range(4), "y")
    common.drop_staged(t)
    assert kept.count() == 4
    with pytest.raises(Exception):
        t.count()


_WORKER = """
import random, re
import pyarrow as pa
from matchloom.llm import packing

def mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", f.read())[1]) / 1024

def batches(n):
    r = random.Random(5)
    for k in range(n):
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(5000)]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([" ".join(words)])], ["doc_id", "text"])

run = packing._cut(None, 2048, 0)
assert sum(len(x) for x in run(batches(1))) > 1
before = mb()
assert sum(len(x) for x in run(batches(180))) > 180
print(mb() - before)
"""


def test_worker_memory():
    """900,000 words that never come again: what a worker keeps of them, beside the JVM, is bounded well below 120 MB."""
    done = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, timeout=300, env=os.environ, check=True)
    assert 0 < float(done.stdout) < 120, done.stdout


_LONG_TEXTS = """
import sys
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from matchloom.llm import packing

folder, n = sys.argv[1], 4096
texts = (f"{k} " + ("x" * 63 + " ") * 1000 for k in range(n))
pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string())}), f"{folder}/documents.parquet", use_dictionary=False)
s = SparkSession.builder.master("local[1]").config("spark.driver.memory", "480m").config("spark.ui.enabled", "false").getOrCreate()
print(packing.cut_documents(s.read.parquet(f"{folder}/documents.parquet")).select("doc_id").distinct().count())
"""


def test_long_texts_in_a_small_heap(tmp_path):
    """4,096 texts of 64 KB: the reader never holds as many at once, in a heap of 480 MB."""
    done = subprocess.run([sys.executable, "-c", _LONG_TEXTS, str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ, check=False)
    assert done.stdout.split()[-1:] == ["4096"], done.stderr[-2000:]
