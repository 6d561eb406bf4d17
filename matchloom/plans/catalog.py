"""Registered queries of the engine over the driver's tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import hashing, paths, scoring, sizes
from matchloom.operators import actions, cache, cluster, interactive, keeper, materialize, ranking, report, similarity, verify
from matchloom.sources import caches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- table analogues: documents are files, embeddings carry fingerprints ---


def _files(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("checksum"), "doc_id")


_FILES = "files AS (SELECT '/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path, n_chars AS size, sha256(text) AS checksum, doc_id FROM documents)"


def _embedded(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    p = hashing.bits_of(F.col("embedding"), 64, lambda v, i: F.element_at(v, i + 1) > 0)
    d = hashing.bits_of(F.col("embedding"), 64, lambda v, i: F.element_at(v, (i + 1) % 64 + 1) > F.element_at(v, i + 1))
    return e.select("vec_id", p.alias("phash"), d.alias("dhash"))


#: Further versions of every picture: version j differs in up to 3 * j bits of one hash and 2 * j of the other.
_VERSIONS = 4
_FLIP_P, _FLIP_D = "(vec_id * 7 + j * 13 + {k} * 5) % 62", "(vec_id * 11 + j * 17 + {k} * 3) % 62"


def _hashes(spark, sf_dir):
    """Four versions of every embedding's hashes as files."""
    e = _embedded(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(_VERSIONS - 1))))

    def flipped(h: str, at: str, each: int):
        out = F.col(h)
        for k in range(each * (_VERSIONS - 1)):
            out = out.bitwiseXOR(F.expr(f"CASE WHEN {k} < {each} * j THEN shiftleft(1L, CAST({at.format(k=k)} AS INT)) ELSE 0L END"))
        return out

    size = F.col("vec_id") * _VERSIONS + F.col("j")
    return e.select(F.lpad(size.cast("string"), 9, "0").alias("path"), size.cast("long").alias("size"), flipped("phash", _FLIP_P, 3).alias("phash"), flipped("dhash", _FLIP_D, 2).alias("dhash"))


def _bits_sql(n: int, test: str) -> str:
    value = lambda i: -(1 << 63) if n - 1 - i == 63 else 1 << (n - 1 - i)
    bit = lambda i: f"CASE WHEN {test.format(i=i + 1, j=(i + 1) % 64 + 1)} THEN {f'(-{-value(i) - 1} - 1)' if value(i) < 0 else value(i)}::BIGINT ELSE 0 END"
    return "(" + " + ".join(bit(i) for i in range(n)) + ")::BIGINT"


def _flips_sql(h: str, at: str, each: int) -> str:
    out = h
    for k in range(each * (_VERSIONS - 1)):
        out = f"xor({out}, CASE WHEN {k} < {each} * j THEN 1::BIGINT << ({at.format(k=k)})::INT ELSE 0::BIGINT END)"
    return out


_EMBEDDED = f"embedded AS (SELECT vec_id, {_bits_sql(64, 'embedding[{i}] > 0')} AS p, {_bits_sql(64, 'embedding[{j}] > embedding[{i}]')} AS d FROM embeddings)"
_HASHES = f"""{_EMBEDDED}, hashes AS (SELECT lpad((vec_id * {_VERSIONS} + j)::VARCHAR, 9, '0') AS path, (vec_id * {_VERSIONS} + j)::BIGINT AS size,
{_flips_sql("p", _FLIP_P, 3)} AS phash, {_flips_sql("d", _FLIP_D, 2)} AS dhash FROM embedded, (SELECT unnest(range({_VERSIONS})) AS j))"""
_CLOSE = "bit_count(xor(x.phash, y.phash)) <= {t} AND bit_count(xor(x.dhash, y.dhash)) <= {t}"


def _groups(spark, sf_dir):
    """orders as groups by customer, sizes in cents."""
    o = _t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("group_id"), F.concat(F.lit("/"), "o_orderstatus", F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"))
    return ranking.ranked(rows)


_GROUPS = """g0 AS (SELECT o_custkey::VARCHAR AS group_id, '/' || o_orderstatus || '/' || lpad(o_orderkey::VARCHAR, 9, '0') AS path, round(o_totalprice * 100)::BIGINT AS size FROM orders),
members AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, path) - 1 AS ordinal, count(*) OVER (PARTITION BY group_id) AS group_size FROM g0 QUALIFY group_size >= 2)"""
_RANKS = "ranks AS (SELECT group_id, n, max_size, first_path, row_number() OVER (ORDER BY n DESC, max_size DESC, first_path) AS rank FROM (SELECT group_id, count(*) AS n, max(size) AS max_size, arg_min(path, ordinal) AS first_path FROM members GROUP BY group_id))"

_EXACT = f"""WITH {_FILES}, m AS (SELECT checksum AS group_id, path, size, row_number() OVER (PARTITION BY checksum ORDER BY size DESC, path) - 1 AS ordinal,
count(*) OVER (PARTITION BY checksum) AS group_size FROM files QUALIFY group_size >= 2)"""


@query(f"{_EXACT} SELECT * FROM m")
def exact_groups(spark, sf_dir):
    return cluster.exact_groups(_files(spark, sf_dir))


@query(f"{_EXACT} SELECT count(DISTINCT group_id) AS groups, count(*) AS files, coalesce(sum(size) FILTER (ordinal > 0), 0)::BIGINT AS recoverable FROM m")
def exact_group_summary(spark, sf_dir):
    return report.summary(cluster.exact_groups(_files(spark, sf_dir)))


@query("""WITH d AS (SELECT doc_id, encode(text) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n FROM d),
h AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda k: printf('%02x', (n >> (8 * k)) & 255)), '') AS le FROM n)
SELECT doc_id, sha256(unhex(le) || CASE WHEN n <= 3000 THEN b ELSE b[1:1000] || b[(n // 2 - 500 + 1):(n // 2 + 500)] || b[(n - 999):n] END) AS checksum FROM h""")
def sampled_checksum(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", hashing.sampled_checksum(F.encode("text", "UTF-8"), 3000, 1000).alias("checksum"))


@query(f"WITH {_HASHES} SELECT path, lpad(lower(to_hex(phash)), 16, '0') AS phash, lpad(lower(to_hex(dhash)), 16, '0') AS dhash FROM hashes")
def perceptual_hashes(spark, sf_dir):
    return _hashes(spark, sf_dir).select("path", hashing.bits_to_hex(F.col("phash")).alias("phash"), hashing.bits_to_hex(F.col("dhash")).alias("dhash"))


@query(f"WITH {_HASHES} SELECT x.path AS a, y.path AS b, bit_count(xor(x.phash, y.phash))::INT AS distance FROM hashes x JOIN hashes y ON x.path < y.path AND {_CLOSE.format(t=10)}")
def hamming_pairs(spark, sf_dir):
    return similarity.self_pairs(materialize.cut(_hashes(spark, sf_dir).select("path", "phash", "dhash")), 10)


#: A coarse hash of all 64 values: the signs of the sums of eight slices, and which of two neighbours is greater.
_SUM = "(" + " + ".join(f"embedding[{{at}} + {k}]::DOUBLE" for k in range(1, 9)) + ")"


def _coarse(spark, sf_dir):
    def total(at: int):
        out = F.element_at("embedding", at + 1).cast("double")
        for k in range(2, 9):
            out = out + F.element_at("embedding", at + k).cast("double")
        return out

    sums = F.array(*[total(8 * k) for k in range(8)])
    e = _t(spark, sf_dir, "embeddings").select("vec_id", sums.alias("s"))
    p = hashing.bits_of(F.col("s"), 8, lambda v, i: F.element_at(v, i + 1) > 0)
    d = hashing.bits_of(F.col("s"), 4, lambda v, i: F.element_at(v, 2 * i + 1) > F.element_at(v, 2 * i + 2))
    return e.select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("path"), F.col("vec_id").cast("long").alias("size"), p.alias("phash"), d.alias("dhash"))


@query(f"""WITH s AS (SELECT vec_id, [{", ".join(_SUM.format(at=8 * k) for k in range(8))}] AS s FROM embeddings),
e AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS path, vec_id::BIGINT AS size, {" || ".join(f"(s[{k}] > 0)::VARCHAR" for k in range(1, 9))} || {" || ".join(f"(s[{k}] > s[{k + 1}])::VARCHAR" for k in (1, 3, 5, 7))} AS p FROM s)
SELECT min(path) OVER (PARTITION BY p) AS group_id, path, size, row_number() OVER (PARTITION BY p ORDER BY size DESC, path) - 1 AS ordinal, count(*) OVER (PARTITION BY p) AS group_size FROM e QUALIFY group_size >= 2""")
def phash_groups(spark, sf_dir):
    return cluster.leader_groups(_coarse(spark, sf_dir), 0)


def _sequential(t: int) -> str:
    """The greedy loop as a recursive query over paths in order, with the leaders so far as its state."""
    return f"""WITH RECURSIVE {_HASHES}, o AS (SELECT path, size, phash, dhash, row_number() OVER (ORDER BY path) AS i FROM hashes),
e AS (SELECT x.i AS a, y.i AS b FROM o x JOIN o y ON y.i < x.i AND {_CLOSE.format(t=t)}), n AS (SELECT a, list(b) AS bs FROM e GROUP BY a),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS leads UNION ALL
SELECT r.i + 1, CASE WHEN n.bs IS NOT NULL AND list_has_any(n.bs, r.leads) THEN r.leads ELSE list_append(r.leads, r.i + 1) END FROM r LEFT JOIN n ON n.a = r.i + 1 WHERE r.i < (SELECT max(i) FROM o)),
l AS (SELECT leads FROM r ORDER BY i DESC LIMIT 1), m AS (SELECT o.*, CASE WHEN list_contains(l.leads, o.i) THEN o.i ELSE list_min(list_intersect(n.bs, l.leads)) END AS lead FROM o CROSS JOIN l LEFT JOIN n ON n.a = o.i)
SELECT p.path AS group_id, m.path, m.size, row_number() OVER (PARTITION BY lead ORDER BY m.size DESC, m.path) - 1 AS ordinal, count(*) OVER (PARTITION BY lead) AS group_size FROM m JOIN o p ON p.i = m.lead QUALIFY group_size >= 2"""


@query(_sequential(10))
def leader_groups(spark, sf_dir):
    return cluster.leader_groups(_hashes(spark, sf_dir), 10)


def _videos(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    frames = F.array(*[hashing.bits_of(F.slice("embedding", 8 * k + 1, 8), 8, lambda v, i: F.element_at(v, i + 1) > 0) for k in range(8)])
    return e.select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("path"), F.col("vec_id").alias("size"), (F.col("vec_id") % 97 * 5).cast("double").alias("duration"), frames.alias("frames"))


_VIDEOS = "videos AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS path, vec_id AS size, (vec_id % 97 * 5)::DOUBLE AS duration, [" + ", ".join(_bits_sql(8, f"embedding[{8 * k} + {{i}}] > 0") for k in range(8)) + "] AS frames FROM embeddings)"
_NEAR = """pairs AS (SELECT x.path AS a, y.path AS b, list_sum(list_transform(range(1, 9), lambda k: bit_count(xor(x.frames[k], y.frames[k]))))::DOUBLE / 8 AS distance
FROM videos x JOIN videos y ON x.path < y.path AND abs(x.duration - y.duration) <= greatest(10.0, 0.05 * greatest(x.duration, y.duration)))"""


@query(f"WITH {_VIDEOS}, {_NEAR} SELECT * FROM pairs WHERE distance <= 2.5")
def video_pairs(spark, sf_dir):
    v = materialize.cut(_videos(spark, sf_dir))
    return similarity.video_pairs(v, v, 2.5).filter("a < b")


@query(f"""WITH RECURSIVE {_VIDEOS}, {_NEAR}, e AS (SELECT a, b FROM pairs WHERE distance <= 2.5 UNION SELECT b, a FROM pairs WHERE distance <= 2.5),
c AS (SELECT a AS node, a AS seen FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen), l AS (SELECT node, min(seen) AS group_id FROM c GROUP BY node)
SELECT group_id, path, size, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, path) - 1 AS ordinal, count(*) OVER (PARTITION BY group_id) AS group_size FROM l JOIN videos ON path = node""")
def video_components(spark, sf_dir):
    return cluster.video_groups(_videos(spark, sf_dir), 2.5)


@query("""SELECT path, status, size FROM (SELECT d.doc_id AS path, d.n_chars AS size, CASE WHEN d.doc_id % 7 = 0 THEN 'new' WHEN d.doc_id % 7 = 1 OR d.doc_id % 7 >= 5 THEN 'stale' ELSE 'hit' END AS status FROM documents d)""")
def cache_status(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(1000.0).alias("mtime"))
    k = F.col("path") % 7
    old = d.filter(k != 0).withColumn("size", F.when(k == 1, F.col("size") + 1).otherwise(F.col("size"))).withColumn("mtime", F.col("mtime") + F.when(k == 4, 1.0).when(k == 5, 2.0).when(k == 6, 3.0).otherwise(0.0))
    return cache.cache_status(d, old).select("path", "status", "size")


@query("SELECT count(*) AS files, count(*) FILTER (doc_id % 7 BETWEEN 2 AND 4) AS hits, count(*) FILTER (doc_id % 7 = 0) AS new, count(*) FILTER (doc_id % 7 IN (1, 5, 6)) AS rehashed FROM documents")
def cache_counters(spark, sf_dir):
    return cache.counters(cache_status(spark, sf_dir))


_NAME = "regexp_replace({x}, '([^.])\\.[^.]+$', '\\1')"
_WORDS = "list_filter(regexp_split_to_array({x}, '[\\s_\\-\\d]+'), lambda t: NOT list_contains([{noise}], upper(t)))"
_SCORE = "length(regexp_replace(array_to_string(" + _WORDS + ", ''), '[^a-zA-Z]', '', 'g'))"


def _score_sql(x: str, noise) -> str:
    return _SCORE.format(x=x, noise=", ".join(f"'{w}'" for w in noise))


def _photos(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "IMG_").otherwise(""), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    path = F.concat(F.lit("/lib/"), F.when(F.col("p_partkey") % 4 == 0, "Photos 2023").otherwise(F.col("p_brand")), F.lit("/"), name)
    return ranking.ranked(p.select(F.col("p_size").alias("group_id"), path.alias("path"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size")))


_PHOTOS = f"""p0 AS (SELECT p_size AS group_id, CASE WHEN p_partkey % 4 = 0 THEN 'Photos 2023' ELSE p_brand END AS folder,
CASE WHEN p_partkey % 3 = 0 THEN 'IMG_' ELSE '' END || translate(p_name, ' ', '_') || '_' || p_partkey || '.jpg' AS name, round(p_retailprice * 100)::BIGINT AS size FROM part),
p1 AS (SELECT *, '/lib/' || folder || '/' || name AS path, '/lib/' || folder AS dir FROM p0),
photos AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, path) - 1 AS ordinal, count(*) OVER (PARTITION BY group_id) AS c,
{_score_sql(_NAME.format(x="name"), scoring.NAME_NOISE)} AS ns, {_score_sql("folder", scoring.FOLDER_NOISE)} AS fs FROM p1 QUALIFY c >= 2)"""


@query(f"WITH {_PHOTOS} SELECT path, ns::INT AS name_score, fs::INT AS folder_score FROM photos")
def name_and_folder_scores(spark, sf_dir):
    return keeper.scored(_photos(spark, sf_dir)).select("path", "name_score", "folder_score")


@query(f"""WITH {_PHOTOS}, k AS (SELECT group_id, path, ns, fs FROM photos WHERE ordinal = 0),
n AS (SELECT DISTINCT ON (group_id) group_id, path, ordinal FROM photos ORDER BY group_id, ns DESC, ordinal), f AS (SELECT DISTINCT ON (group_id) group_id, path, ordinal FROM photos ORDER BY group_id, fs DESC, ordinal)
SELECT group_id, k.path AS keep, CASE WHEN n.ordinal > 0 THEN n.path END AS rename_src, CASE WHEN f.ordinal > 0 THEN f.path END AS folder_src FROM k JOIN n USING (group_id) JOIN f USING (group_id)""")
def smart_defaults(spark, sf_dir):
    return keeper.smart_defaults(keeper.scored(_photos(spark, sf_dir)))


@query(f"""WITH {_PHOTOS}, k AS (SELECT DISTINCT ON (group_id) * FROM photos ORDER BY group_id, fs DESC, ns DESC, ordinal), n AS (SELECT DISTINCT ON (group_id) * FROM photos ORDER BY group_id, ns DESC, ordinal)
SELECT group_id, k.path AS keep, CASE WHEN n.ns > k.ns THEN k.dir || '/' || n.name ELSE k.path END AS final FROM k JOIN n USING (group_id)""")
def exact_keep(spark, sf_dir):
    return keeper.exact_keep(keeper.scored(_photos(spark, sf_dir)))


@query(f"WITH {_PHOTOS} SELECT DISTINCT ON (group_id) group_id, path AS keep FROM photos ORDER BY group_id, fs DESC, ns DESC, ordinal")
def pick_keeper(spark, sf_dir):
    return keeper.pick_keeper(keeper.scored(_photos(spark, sf_dir)))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 6 THEN NULL WHEN l_linenumber % 4 = 0 THEN l_quantity::BIGINT
ELSE ((l_quantity::BIGINT + l_orderkey % 4 * 0.25::DOUBLE) * CASE l_linenumber % 4 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END)::BIGINT END AS bytes FROM lineitem""")
def parse_sizes(spark, sf_dir):
    """Whole numbers without a unit, fractions with one, and what isn't a size."""
    part = F.element_at(F.array(*map(F.lit, ("", ".25", ".5", ".75"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    unit = F.element_at(F.array(F.lit(""), F.lit("kb"), F.lit(" MB"), F.lit("GB ")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(part), unit)
    text = F.when(F.col("l_linenumber") % 7 == 6, F.concat(F.lit("about "), text)).otherwise(text)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sizes.size_bytes(text).alias("bytes"))


@query(f"WITH {_GROUPS} SELECT group_id, path, size FROM members WHERE group_id IN (SELECT group_id FROM members GROUP BY group_id HAVING max(size) - min(size) >= 20000000)")
def delta_filter(spark, sf_dir):
    return report.spread_at_least(_groups(spark, sf_dir), 20_000_000).select("group_id", "path", "size")


@query(f"WITH {_GROUPS}, {_RANKS} SELECT group_id, path, size FROM members WHERE group_id IN (SELECT group_id FROM ranks WHERE rank <= 25)")
def limit_groups(spark, sf_dir):
    return report.first_groups(_groups(spark, sf_dir), 25).select("group_id", "path", "size")


@query(f"WITH {_GROUPS}, {_RANKS} SELECT group_id, rank, (rank - 1) // 20 AS page FROM ranks")
def pages_of_groups(spark, sf_dir):
    return report.pages(_groups(spark, sf_dir), 20)


@query(f"WITH {_GROUPS} SELECT group_id, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dirs, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) = 1 AS together FROM members GROUP BY group_id")
def same_folder_split(spark, sf_dir):
    return report.same_folder(_groups(spark, sf_dir))


@query(f"WITH {_GROUPS} SELECT group_id, path, 0 AS source_ordinal FROM members UNION ALL SELECT group_id, path, 1 FROM members WHERE ordinal = 0")
def union_sources(spark, sf_dir):
    g = _groups(spark, sf_dir).select("group_id", "path", "ordinal")
    return report.union_sources(g, g.filter("ordinal = 0")).select("group_id", "path", "source_ordinal")


def _kept(spark, sf_dir):
    return _groups(spark, sf_dir).filter(F.substring("path", 2, 1) == "F").select("path")


@query(f"WITH {_GROUPS} SELECT group_id, path FROM members WHERE path[2] <> 'F'")
def to_delete(spark, sf_dir):
    return actions.to_delete(_groups(spark, sf_dir), _kept(spark, sf_dir)).select("group_id", "path")


@query(f"WITH {_GROUPS} SELECT group_id FROM members GROUP BY group_id HAVING NOT bool_or(path[2] = 'F')")
def group_guard(spark, sf_dir):
    return actions.unguarded(_groups(spark, sf_dir), _kept(spark, sf_dir))


@query(f"WITH {_GROUPS} SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM members WHERE path[2] <> 'F'")
def recoverable(spark, sf_dir):
    return actions.recoverable(_groups(spark, sf_dir), _kept(spark, sf_dir))


@query(f"WITH {_HASHES} SELECT path FROM hashes x WHERE size % 5 = 0 AND NOT EXISTS (SELECT 1 FROM hashes y WHERE y.size % 5 <> 0 AND {_CLOSE.format(t=8)})")
def verify_images(spark, sf_dir):
    h = materialize.cut(_hashes(spark, sf_dir))
    return verify.unmatched_images(h.filter("size % 5 = 0"), h.filter("size % 5 != 0"), 8).select("path")


@query(f"WITH {_FILES} SELECT path FROM files WHERE doc_id % 5 = 0 AND checksum NOT IN (SELECT checksum FROM files WHERE doc_id % 5 <> 0)")
def verify_checksums(spark, sf_dir):
    f = _files(spark, sf_dir)
    return verify.unmatched_checksums(f.filter("doc_id % 5 = 0"), f.filter("doc_id % 5 != 0")).select("path")


_FRAMES_NEAR = """abs(x.duration - y.duration) <= greatest(10.0, 0.05 * greatest(x.duration, y.duration))
AND list_sum(list_transform(range(1, 9), lambda k: bit_count(xor(x.frames[k], y.frames[k]))))::DOUBLE / 8 <= 2.5"""


def _summed(spark, sf_dir):
    """Videos with checksums that some share: every third one has that of its neighbour."""
    return materialize.cut(_videos(spark, sf_dir).withColumn("checksum", F.sha2((F.col("size") - F.when(F.col("size") % 3 == 0, 1).otherwise(0)).cast("string"), 256)))


_SUMMED = f"{_VIDEOS}, summed AS (SELECT *, sha256((size - CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS checksum FROM videos)"


@query(f"""WITH {_VIDEOS} SELECT path FROM videos x WHERE size % 5 = 0 AND NOT EXISTS (SELECT 1 FROM videos y WHERE y.size % 5 <> 0 AND {_FRAMES_NEAR})""")
def verify_videos(spark, sf_dir):
    v = materialize.cut(_videos(spark, sf_dir).withColumn("checksum", F.col("path")))
    return verify.unmatched_videos(v.filter("size % 5 = 0"), v.filter("size % 5 != 0"), 2.5).select("path")


@query(f"""WITH {_SUMMED} SELECT path FROM summed x WHERE size % 5 = 0 AND NOT EXISTS (SELECT 1 FROM summed y WHERE y.size % 5 <> 0 AND (x.checksum = y.checksum OR {_FRAMES_NEAR}))""")
def verify_fallback(spark, sf_dir):
    v = _summed(spark, sf_dir)
    return verify.unmatched_videos(v.filter("size % 5 = 0"), v.filter("size % 5 != 0"), 2.5).select("path")


@query(f"""WITH {_SUMMED}, {_HASHES.replace("hashes AS", "pictures AS", 1)}, unread AS (SELECT *, size % 35 = 0 AS bad FROM pictures)
SELECT path, 'image' AS kind, CASE WHEN bad THEN 'unverifiable' ELSE 'unmatched' END AS status FROM unread x
WHERE size % 5 = 0 AND (bad OR NOT EXISTS (SELECT 1 FROM unread y WHERE y.size % 5 <> 0 AND {_CLOSE.format(t=2)}))
UNION ALL SELECT path, 'video', CASE WHEN size % 35 = 0 THEN 'unverifiable' ELSE 'unmatched' END FROM summed x
WHERE size % 5 = 0 AND (size % 35 = 0 OR NOT EXISTS (SELECT 1 FROM summed y WHERE y.size % 5 <> 0 AND (x.checksum = y.checksum OR {_FRAMES_NEAR.replace("2.5", "2")})))""")
def verify_whole_trash(spark, sf_dir):
    bad = F.col("size") % 35 == 0
    h = materialize.cut(_hashes(spark, sf_dir).withColumn("phash", F.when(~bad, F.col("phash"))))
    v = materialize.cut(_summed(spark, sf_dir).withColumn("checksum", F.when(~bad, F.col("checksum"))))
    split = lambda df: (df.filter("size % 5 = 0"), df.filter("size % 5 != 0"))
    return verify.verify_trash(split(h), split(v), 2)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1)")
def suffix_filter(spark, sf_dir):
    name = F.concat(F.lit("/a/x"), F.element_at(F.array(*map(F.lit, (".JPG", ".mp4", ".txt", "jpg"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return _t(spark, sf_dir, "documents").filter(paths.has_suffix(name, paths.MEDIA_SUFFIXES)).select("doc_id")


@query("""WITH m AS (SELECT p_partkey AS src, p_brand AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
t AS (SELECT p_brand AS n, list(DISTINCT p_size) AS used FROM part GROUP BY p_brand), c AS (SELECT n, count(*) AS c FROM m GROUP BY n),
f AS (SELECT t.n, list_filter(range(c + 60), lambda k: NOT list_contains(used, k) AND k > 0) AS free FROM t JOIN c USING (n))
SELECT src, '/t/' || n || '_' || free[i] || '.jpg' AS dst FROM m JOIN f USING (n)""")
def unique_targets(spark, sf_dir):
    """Names that clash with each other and with what is there: the plain name and the numbers of all sizes."""
    part = _t(spark, sf_dir, "part")
    moves = part.select(F.col("p_partkey").alias("src"), F.concat(F.lit("/t/"), "p_brand", F.lit(".jpg")).alias("dst"))
    taken = part.select(F.concat(F.lit("/t/"), "p_brand", F.lit(".jpg")).alias("path")).unionByName(part.select(F.concat(F.lit("/t/"), "p_brand", F.lit("_"), F.col("p_size").cast("string"), F.lit(".jpg")).alias("path")))
    return actions.unique_targets(moves, taken.distinct())


@query("""WITH c AS (SELECT c_custkey, substr(sha256(c_custkey::VARCHAR), 1, 16) AS good, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'xyz' WHEN 2 THEN '0x1f' ELSE substr(sha256(c_name), 1, 16) END AS dhash FROM customer)
SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE lpad(dhash, 16, '0') END AS dhash, lpad(good, 16, '0') AS phash, c_custkey::BIGINT AS size FROM c WHERE c_custkey % 6 NOT IN (1, 2) AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0""")
def dirty_cache_rows(spark, sf_dir):
    k = F.col("c_custkey")
    dhash = F.when(k % 6 == 0, "").when(k % 6 == 1, "xyz").when(k % 6 == 2, "0x1f").otherwise(F.substring(F.sha2("c_name", 256), 1, 16))
    raw = _t(spark, sf_dir, "customer").select(
        F.concat(F.lit("f"), k.cast("string")).alias("path"),
        F.when(k % 7 == 0, "many").otherwise(k.cast("string")).alias("size"),
        F.lit("12.5").alias("mtime"),
        F.when(k % 11 == 0, "").otherwise(F.substring(F.sha2(k.cast("string"), 256), 1, 16)).alias("phash"),
        dhash.alias("dhash"),
    )
    return caches.clean_images(raw).select("path", "size", hashing.bits_to_hex(F.col("phash")).alias("phash"), hashing.bits_to_hex(F.col("dhash")).alias("dhash"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n < 1024 THEN 'B' WHEN n < 1048576 THEN 'KB' WHEN n < 1073741824 THEN 'MB' WHEN n < 1099511627776 THEN 'GB' ELSE 'TB' END AS unit
FROM (SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT * (1024::BIGINT ** (l_linenumber % 5))::BIGINT) AS n FROM lineitem)""")
def fmt_size_unit(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("long") * F.pow(F.lit(1024), F.col("l_linenumber") % 5).cast("long")
    return li.select("l_orderkey", "l_linenumber", F.element_at(F.split(F.trim(sizes.size_text(n)), " "), -1).alias("unit"))


@query(f"""WITH {_GROUPS}, d AS (SELECT group_id, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name FROM members),
f AS (SELECT group_id, min(dir) AS first_dir FROM d GROUP BY group_id), n AS (SELECT f.group_id, first_dir, list_sort(list(name)) AS names FROM f JOIN d ON d.group_id = f.group_id AND d.dir = first_dir GROUP BY ALL)
SELECT group_id, first_dir, row_number() OVER (ORDER BY first_dir, names, group_id) - 1 AS place FROM n""")
def interactive_order(spark, sf_dir):
    return interactive.interactive_order(_groups(spark, sf_dir)).select("group_id", "first_dir", "place")


@query(f"""WITH {_GROUPS}, d AS (SELECT group_id, regexp_replace(path, '/[^/]*$', '') AS dir, min(ordinal) AS f FROM members GROUP BY ALL)
SELECT group_id, dir, row_number() OVER (PARTITION BY group_id ORDER BY f) - 1 AS choice FROM d""")
def folder_choices(spark, sf_dir):
    return interactive.folder_choices(_groups(spark, sf_dir))


@query(f"""WITH {_PHOTOS}, d AS (SELECT group_id, dir, row_number() OVER (PARTITION BY group_id ORDER BY min(ordinal)) AS i, count(*) OVER (PARTITION BY group_id) AS dirs FROM photos GROUP BY group_id, dir),
c AS (SELECT group_id, dir AS chosen FROM d WHERE i = group_id % 3 + 1 AND group_id % 5 <> 0), n AS (SELECT DISTINCT ON (group_id) group_id, name AS best FROM photos ORDER BY group_id, ns DESC, ordinal),
k AS (SELECT DISTINCT ON (group_id) p.group_id, path AS keep FROM photos p JOIN c ON c.group_id = p.group_id AND p.dir = chosen ORDER BY p.group_id, fs DESC, ns DESC, ordinal),
a AS (SELECT p.group_id, path, dir, name, best, CASE WHEN keep IS NULL THEN 'skip' WHEN dirs > 26 THEN 'refused' WHEN path <> keep THEN 'trash' WHEN name <> best THEN 'rename' ELSE 'keep' END AS action
FROM photos p LEFT JOIN k USING (group_id) JOIN n USING (group_id) JOIN (SELECT DISTINCT group_id, dirs FROM d) USING (group_id))
SELECT group_id, path, action, CASE action WHEN 'trash' THEN '/lib/{paths.TRASH}/' || path[6:] WHEN 'rename' THEN dir || '/' || best END AS dst FROM a""")
def interactive_choices(spark, sf_dir):
    members = _photos(spark, sf_dir)
    picked = members.select("group_id").distinct().filter("group_id % 5 != 0")
    letter = F.element_at(F.array(*map(F.lit, "abc")), (F.col("group_id") % 3 + 1).cast("int"))
    return interactive.decide(members, picked.withColumn("letter", letter), F.lit("/lib"))


@query(f"WITH {_GROUPS}, {_RANKS}, d AS (SELECT group_id, regexp_replace(first_path, '/[^/]*$', '') AS first_dir, rank FROM ranks) SELECT group_id, first_dir, row_number() OVER (ORDER BY first_dir, rank) - 1 AS place FROM d")
def review_order(spark, sf_dir):
    return report.review_order(_groups(spark, sf_dir))


@query(f"""WITH {_PHOTOS}, k AS (SELECT DISTINCT ON (group_id) * FROM photos ORDER BY group_id, fs DESC, ns DESC, ordinal)
SELECT p.group_id, p.path, p.path = k.path AS kept, (row_number() OVER (PARTITION BY p.group_id ORDER BY p.path = k.path, p.ordinal) - 1)::INT AS line FROM photos p JOIN k USING (group_id)""")
def report_lines(spark, sf_dir):
    return report.exact_report(_photos(spark, sf_dir)).select("group_id", "path", "kept", "line")


@query(f"""WITH {_GROUPS}, b AS (SELECT DISTINCT path, '/' || CASE WHEN ordinal % 2 = 0 THEN 'F/x' ELSE 'O' END AS base FROM members)
SELECT path, base, CASE WHEN starts_with(path, base || '/') THEN path[len(base) + 2:] WHEN base = '/O' THEN '..' || path WHEN path[2] = 'F' THEN '..' || path[3:] ELSE '../..' || path END AS rel FROM b""")
def relative_paths(spark, sf_dir):
    rows = _groups(spark, sf_dir).select("path", F.concat(F.lit("/"), F.when(F.col("ordinal") % 2 == 0, "F/x").otherwise("O")).alias("base")).distinct()
    return rows.withColumn("rel", paths.relative(F.col("path"), F.col("base")))


@query(f"""WITH {_PHOTOS}, n AS (SELECT DISTINCT ON (group_id) group_id, path AS src, name, ordinal AS i FROM photos ORDER BY group_id, ns DESC, ordinal),
f AS (SELECT DISTINCT ON (group_id) group_id, dir, ordinal AS j FROM photos ORDER BY group_id, fs DESC, ordinal), k AS (SELECT group_id, path FROM photos WHERE ordinal = 0)
SELECT path, CASE WHEN i > 0 THEN name END AS new_name, CASE WHEN j > 0 THEN dir END AS target_dir FROM k JOIN n USING (group_id) JOIN f USING (group_id) WHERE i > 0 OR j > 0""")
def review_requests(spark, sf_dir):
    members = _photos(spark, sf_dir)
    return interactive.transform_requests(members, *interactive.default_decision(members))


@query(f"""WITH {_GROUPS}, k AS (SELECT *, path[2] = 'F' AS kept FROM members), bad AS (SELECT group_id FROM k GROUP BY group_id HAVING NOT bool_or(kept))
SELECT 0 AS phase, group_id AS src, NULL AS dst, 'refused' AS status FROM bad
UNION ALL SELECT DISTINCT 1, path, '/{paths.TRASH}' || path, 'ok' FROM k WHERE NOT kept
UNION ALL SELECT DISTINCT 2, path, '/P' || path[3:], 'ok' FROM k WHERE kept AND ordinal = 0""")
def confirmed_plan(spark, sf_dir):
    """Everything not in folder F goes to the trash below '', the first of each group that stays moves to folder P."""
    g = _groups(spark, sf_dir)
    first = g.filter("ordinal = 0 and substring(path, 2, 1) = 'F'").select("path").distinct()
    ask = first.select("path", F.lit(None).cast("string").alias("new_name"), F.lit("/P").alias("target_dir"))
    dirs = spark.createDataFrame([("/P",)], "dir string")
    return actions.confirm_plan(g, _kept(spark, sf_dir), ask, g.select("path").distinct(), dirs, F.lit(""))


@query("""SELECT x.p_partkey, count(*) AS near FROM part x JOIN part y ON abs(x.p_retailprice - y.p_retailprice) <= greatest(10.0, 0.05 * greatest(x.p_retailprice, y.p_retailprice)) AND x.p_size = y.p_size AND x.p_brand = y.p_brand GROUP BY x.p_partkey""")
def range_join_price(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    a = p.withColumn("bucket", hashing.duration_bucket(F.col("p_retailprice")))
    near = F.explode(F.array(*[hashing.duration_bucket(F.col("p_retailprice")) + k for k in (-1, 0, 1)]))
    b = p.select("p_size", "p_brand", F.col("p_retailprice").alias("other"), near.alias("bucket"))
    return a.join(b, ["p_size", "p_brand", "bucket"]).filter(hashing.duration_close(F.col("p_retailprice"), F.col("other"))).groupBy("p_partkey").agg(F.count("*").alias("near"))
