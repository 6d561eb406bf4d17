import json
import os
import random
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom import cli
from matchloom.functions import hashing, paths, scoring, sizes
from matchloom.operators import actions, cache, cluster, components, interactive, keeper, ranking, report, similarity, verify
from matchloom.plans import catalog
from matchloom.sources import caches, media, scan
from matchloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    assert rows(df.select(cols)) == sorted(con.sql(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchall(), key=str)


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_name_scores(spark):
    names = {
        "beach_vacation.jpg": 13, "birthday_party_2023.jpg": 13, "new-year-eve.jpg": 10, "BeachSunset.jpg": 11, "20231015_birthday.jpg": 8,
        "family reunion.jpg": 13, "PXL_20231015_123456789.jpg": 0, "IMG_001.jpg": 0, "DSCN0099.JPG": 0, "WA0001234567-1.jpg": 0, "WhatsApp_Images_2023-10-15.jpg": 0,
    }
    assert column(spark, names, "string", scoring.name_score) == list(names.values())
    assert column(spark, ["beach_vacation"], "string", lambda v: scoring.name_score(v, ["vacation"])) == [5]
    assert column(spark, ["beach_vacation"], "string", lambda v: scoring.name_score(v, ["beach_vacation"])) == [0]


def test_folder_scores(spark):
    dirs = {"/Photos/2023-12-25": 0, "/Photos/Beach Vacation": 13, "/Photos/Christmas 2023": 9, "/Phone/Camera Roll": 10, "/DCIM": 4, "/camera/100MEDIA": 5, "": 0}
    assert column(spark, dirs, "string", scoring.folder_score) == list(dirs.values())
    assert column(spark, ["/Vacation", "/Beach Vacation"], "string", lambda v: scoring.folder_score(v, ["vacation"])) == [-1, 5]
    assert column(spark, ["/r/Beach/2023/Fun", "/r", "/x/Fun"], "string", lambda v: scoring.folder_score(v, (), F.lit("/r"))) == [8, 0, 3]


def test_sizes(spark):
    want = {"500": 500, "512b": 512, "50kb": 51200, "1.5kb": 1536, "2.5MB": 2621440, "1TB": 1 << 40, "  10kb": 10240}
    assert [sizes.parse_size(s) for s in want] == list(want.values())
    assert column(spark, [*want, "abc", "", "1.5"], "string", sizes.size_bytes) == [*want.values(), None, None, None]
    for bad in ("abc", "", "1.5"):
        with pytest.raises(ValueError):
            sizes.parse_size(bad)
    assert column(spark, [500, 1536], "long", sizes.size_text) == [" 500.0 B", "   1.5 KB"]


def test_hex_and_frames(spark):
    assert column(spark, ["ffffffffffffffff", "0f", "", "zz", "0x12", "1" * 17], "string", hashing.hex_to_bits) == [-1, 15, None, None, None, None]
    frames = spark.createDataFrame([([0, 0], [0, -1]), ([0, 0], [0]), ([], [])], "a array<long>, b array<long>")
    assert [r[0] for r in frames.select(hashing.frame_distance(F.col("a"), F.col("b"))).collect()] == [32.0, 0.0, float("inf")]


def test_paths(spark):
    assert column(spark, ["/a/b.JPG", "/a/.png", "/a/b", "/a/b.txt"], "string", lambda v: paths.has_suffix(v, paths.IMAGE_SUFFIXES)) == [True, False, False, False]
    assert column(spark, ["/r/a/b.jpg", "/x"], "string", lambda v: paths.trash_path(v, F.lit("/r"))) == [f"/r/{paths.TRASH}/a/b.jpg", None]
    assert column(spark, ["C:\\x", "\\\\srv\\share\\x", "/x"], "string", lambda v: paths.without_drive(v, True)) == ["\\x", "\\x", "/x"]


def sequential(items, t):
    """Leaders in path order, one after the other."""
    seen, out = set(), {}
    for p, ph, dh in sorted(items):
        if p in seen:
            continue
        near = [q for q, a, b in items if q not in seen and (a ^ ph).bit_count() <= t and (b ^ dh).bit_count() <= t]
        if len(near) > 1:
            seen |= set(near)
            out |= dict.fromkeys(near, p)
    return out


@pytest.mark.parametrize("t", [0, 2, 9])
def test_leaders_like_the_loop(spark, t):
    r = random.Random(t)
    base = [r.getrandbits(62) for _ in range(4)]
    items = []
    for k in range(40):
        h = r.choice(base)
        for _ in range(r.randint(0, t)):
            h ^= 1 << r.randrange(62)
        items.append((f"p{k:02d}", h, h if r.random() < 0.8 else h ^ 1))
    df = spark.createDataFrame([(p, a, b, 100) for p, a, b in items], "path string, phash long, dhash long, size long")
    assert {x.path: x.group_id for x in cluster.leader_groups(df, t).collect()} == sequential(items, t)


def test_chain(spark):
    """A near B, B near C, A not near C: one component of videos, a pair of images."""
    v = spark.createDataFrame([("a", 60.0, [0], 1), ("b", 60.0, [1], 1), ("c", 60.0, [3], 1)], "path string, duration double, frames array<long>, size long")
    assert {r.group_size for r in cluster.video_groups(v, 1).collect()} == {3}
    h = spark.createDataFrame([("a", 0, 0, 1), ("b", 1, 0, 1), ("c", 3, 0, 1)], "path string, phash long, dhash long, size long")
    assert [r.path for r in cluster.leader_groups(h, 1).orderBy("path").collect()] == ["a", "b"]


def test_durations(spark):
    cases = ((60, 67, 1), (5, 14, 1), (5, 16, 0), (60, 200, 0), (1000, 1050, 1))
    made = [(f"{k}{x}", float(t), [(1 << k) - 1, -(1 << (k + 1))], 1) for k, (a, b, _) in enumerate(cases) for x, t in (("a", a), ("b", b))]
    v = spark.createDataFrame(made, "path string, duration double, frames array<long>, size long")
    assert {r.path for r in cluster.video_groups(v, 0).collect()} == {f"{k}{x}" for k, (_, _, near) in enumerate(cases) if near for x in "ab"}


def test_freshness(spark):
    f = spark.createDataFrame([(p, 10, 100.0) for p in "abcde"], "path string, size long, mtime double")
    c = spark.createDataFrame([("a", 10, 101.0, 1), ("b", 10, 102.0, 2), ("c", 11, 100.0, 3), ("d", 10, 100.0, 4), ("z", 1, 1.0, 5)], "path string, size long, mtime double, phash long")
    assert {r.path: r.status for r in cache.cache_status(f, c).collect()} == {"a": "hit", "b": "stale", "c": "stale", "d": "hit", "e": "new"}
    new = cache.refresh(f, c, lambda todo: todo.withColumn("phash", F.lit(9).cast("long")))
    assert {r.path: r.phash for r in new.collect()} == {"a": 1, "b": 9, "c": 9, "d": 4, "e": 9}


def test_dirty_caches(spark, tmp_path):
    (tmp_path / "i.csv").write_text("path,size,mtime,phash,dhash\na,1,2.0,ff,0f\nb,x,2.0,ff,0f\nc,1,2.0,zz,0f\nd,1,2.0,ff,\n")
    assert rows(caches.load_images(spark, str(tmp_path / "i.csv")).select("path", "phash", "dhash")) == [("a", 255, 15), ("d", 255, None)]
    (tmp_path / "v.csv").write_text('path,size,mtime,duration,vhash\na,1,2.0,9.5,"ff,0f"\nb,1,2.0,9.5,"ff,xx"\nc,1,2.0,9.5,\n')
    assert [r.path for r in caches.load_videos(spark, str(tmp_path / "v.csv")).collect()] == ["a"]


def test_defaults(spark):
    m = spark.createDataFrame([(1, 0, "/a/PXL_001.jpg"), (1, 1, "/b/sunset.jpg"), (1, 2, "/c/beautiful_sunset_at_beach.jpg"), (2, 0, "/a/sunset.jpg"), (2, 1, "/a/clouds.jpg")], "group_id int, ordinal int, path string")
    got = {r.group_id: (r.keep, r.rename_src, r.folder_src) for r in keeper.smart_defaults(keeper.scored(m)).collect()}
    assert got == {1: ("/a/PXL_001.jpg", "/c/beautiful_sunset_at_beach.jpg", None), 2: ("/a/sunset.jpg", None, None)}
    assert {r.group_id: r.final for r in keeper.exact_keep(keeper.scored(m)).collect()}[1] == "/c/beautiful_sunset_at_beach.jpg"


def test_scan_checksum_and_trash(spark, tmp_path):
    for p in ("a/x.JPG", "a/b/y.png", "_h/z.gif", "n.txt", f"{paths.TRASH}/t.jpg", "a/clip.mp4"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"same" if p.endswith(("JPG", "png")) else p.encode())
    found = scan.scan_files(spark, str(tmp_path))
    assert sorted(os.path.relpath(r.path, tmp_path) for r in found.collect()) == ["_h/z.gif", "a/b/y.png", "a/clip.mp4", "a/x.JPG"]
    assert cluster.exact_groups(media.checksums(found)).count() == 2
    trash = media.checksums(scan.scan_files(spark, str(tmp_path / paths.TRASH)))
    assert verify.unmatched_checksums(trash, media.checksums(found)).count() == 1
    big = tmp_path / "big"
    big.write_bytes(bytes(range(40)))
    want = spark.createDataFrame([(bytearray(range(40)),)], "b binary").select(hashing.sampled_checksum(F.col("b"), 30, 10)).first()[0]
    assert media.file_checksum(str(big), 40, 30, 10) == want


def test_image_hashes_and_probe():
    import numpy as np

    r = np.random.default_rng(0)
    a = np.kron(r.random((8, 8)), np.ones((8, 8))) * 255
    assert (media.image_hashes(a)[0] ^ media.image_hashes(np.kron(a, np.ones((2, 2))))[0]).bit_count() <= 2
    assert media.parse_duration("x\n  Duration: 00:02:03.50, start") == 123.5 and media.parse_duration("Duration: N/A, start") is None is media.parse_duration("")
    assert media.frame_times(8.0, 4) == [1.0, 3.0, 5.0, 7.0]


def test_plans(spark, tmp_path):
    s = lambda *r: spark.createDataFrame(list(r), "path string")
    req = spark.createDataFrame([("/r/a.jpg", "../../evil.jpg", None), ("/r/b.jpg", None, None), ("/x/c.jpg", "n.jpg", None), ("/r/d.jpg", "/", None), ("/r/a.jpg", None, "/r/none"), ("/r/a.jpg", "b.jpg", None), ("/r/q.jpg", "z.jpg", None)], "path string, new_name string, target_dir string")
    keep = s(("/r/a.jpg",), ("/r/b.jpg",), ("/x/c.jpg",), ("/r/d.jpg",))
    got = actions.transform_plan(req, keep, s(("/r/a.jpg",), ("/r/b.jpg",), ("/x/c.jpg",), ("/r/d.jpg",)), spark.createDataFrame([("/r",)], "dir string"), F.lit("/r"))
    assert sorted((r.src, r.status) for r in got.collect()) == [("/r/a.jpg", "exists"), ("/r/a.jpg", "ok"), ("/r/a.jpg", "target missing"), ("/r/b.jpg", "noop"), ("/r/d.jpg", "no name"), ("/r/q.jpg", "not kept"), ("/x/c.jpg", "outside")]
    moves = spark.createDataFrame([("1", "/t/a.jpg"), ("2", "/t/a.jpg")], "src string, dst string")
    assert rows(actions.unique_targets(moves, s(("/t/a.jpg",), ("/t/a_1.jpg",)))) == [("1", "/t/a_2.jpg"), ("2", "/t/a_3.jpg")]
    src = tmp_path / "f"
    src.write_text("x")
    plan = spark.createDataFrame([(str(src), str(tmp_path / "g" / "f"), "ok")], "src string, dst string, status string")
    assert actions.carry_out(plan)["moved"] == 1 and src.exists()
    assert actions.carry_out(plan, dry_run=False)["moved"] == 1 and not src.exists()


def test_report(spark):
    m = ranking.ranked(spark.createDataFrame([("g", "/a/1", 5), ("g", "/a/2", 9), ("h", "/a/3", 7), ("h", "/b/4", 7), ("s", "/z", 1)], "group_id string, path string, size long"))
    assert tuple(report.summary(m).first()) == (2, 4, 12)
    assert {r.group_id for r in report.spread_at_least(m, 4).collect()} == {"g"}
    assert {r.group_id: r.together for r in report.same_folder(m).collect()} == {"g": True, "h": False}
    got = {r.group_id: json.loads(r.json) for r in report.groups_json(m, F.lit("/a")).collect()}
    assert [f["path"] for f in got["g"]["files"]] == ["/a/2", "/a/1"] and got["g"]["keep_default"] == "/a/2" and got["g"]["rename_src"] is None
    assert got["h"]["files"][1] == {"path": "/b/4", "rel": "../b/4", "name": "4", "dir": "/b", "dir_rel": "../b", "size": 7, "size_fmt": "7.0 B", "is_video": False}


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_ranks_of_hot_groups(spark, hot):
    r = random.Random(hot)
    made = [(r.choice("abcdeffff"), f"/p{k}", r.randrange(5)) for k in range(200)] + [("alone", "/x", 1)]
    want = {}
    for g in "abcdef":
        for k, (_, p, s) in enumerate(sorted((m for m in made if m[0] == g), key=lambda m: (-m[2], m[1]))):
            want[p] = (g, k, sum(m[0] == g for m in made))
    got = ranking.ranked(spark.createDataFrame(made, "group_id string, path string, size long").repartition(5), hot)
    assert {x.path: (x.group_id, x.ordinal, x.group_size) for x in got.collect()} == want
    ranks = [(x.n, x.max_size, x.first_path) for x in ranking.group_ranks(got).orderBy("rank").collect()]
    assert ranks == sorted(ranks, key=lambda x: (-x[0], -x[1], x[2])) and len(ranks) == 6
    assert [x["rank"] for x in ranking.group_ranks(got).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]
    assert {x.group_id for x in report.first_groups(got, 2).collect()} == {want[p][0] for _, _, p in ranks[:2]}


def test_pairs_by_every_blocking(spark):
    r = random.Random(8)
    base = [(r.getrandbits(64) - (1 << 63), r.getrandbits(64) - (1 << 63)) for _ in range(6)]

    def near(h):
        for _ in range(r.randint(0, 7)):
            k = r.randrange(64)
            h ^= -(1 << 63) if k == 63 else 1 << k
        return h

    made = [(f"p{k:03d}", *map(near, r.choice(base))) for k in range(60)]
    df = spark.createDataFrame([*made, ("none", None, 1)], "path string, phash long, dhash long")
    far = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    for t in (0, 4, 10):
        want = {(a[0], b[0], far(a[1], b[1])) for a in made for b in made if a[0] < b[0] and far(a[1], b[1]) <= t and far(a[2], b[2]) <= t}
        assert set(map(tuple, similarity.self_pairs(df, t).collect())) == want  # the loop
        both = {tuple(x) for x in similarity.hash_pairs(df, df, t).collect()}
        assert {x for x in both if x[0] < x[1]} == want and len(both) == 2 * len(want) + len(made)
        hashes = {x[1:] for x in made}
        pairs = {(x, y) for x in hashes for y in hashes if far(x[0], y[0]) <= t and far(x[1], y[1]) <= t}
        x, y = (df.filter("phash is not null").select(F.col("phash").alias(f"{k}_p"), F.col("dhash").alias(f"{k}_d")).distinct() for k in "xy")
        for plan in sorted(similarity.blockings(t, True), key=lambda b: b.probes)[:3]:
            got = [((c.x_p, c.x_d), (c.y_p, c.y_d)) for c in similarity.candidates(x, y, plan).collect()]
            assert len(got) == len(set(got)) and pairs <= set(got)


def test_blockings_are_selective():
    for t, n, most in ((2, 10**6, 2e-6), (4, 10**6, 1e-5), (10, 10**6, 0.007), (10, 10**8, 0.0014)):
        assert similarity.choose(t, n).share < most  # of n * n pairs, the loop compares half
    for t, n in ((10, 500), (18, 10**6), (64, 10**9)):  # where keys cost more than comparing
        assert similarity.choose(t, n) is None


def test_selective_in_fact(spark):
    """Candidates counted, on even hashes: far below the half of all pairs that a loop compares."""
    n = 4000
    h = spark.range(n).select(F.xxhash64("id").alias("x_p"), F.xxhash64("id", F.lit(1)).alias("x_d"))
    other = h.withColumnsRenamed({"x_p": "y_p", "x_d": "y_d"})
    for t, share in ((10, 0.007), (18, 0.13)):
        plan = min(similarity.blockings(t, True), key=lambda b: b.cost(10**6))
        assert similarity.candidates(h, other, plan).count() < 1.1 * share * n * n < n * n / 2


def test_keys_are_not_broadcast(spark):
    """Hashes that look small have hundreds of keys each: the driver gets the table of flips alone."""
    r = random.Random(8)
    values = [(r.getrandbits(63), r.getrandbits(63)) for _ in range(200)]
    values += [(p ^ 5, d ^ (1 << i % 60)) for i, (p, d) in enumerate(values[:50])]
    h = spark.createDataFrame(values, "phash long, dhash long")
    near = similarity.near_hashes(h.filter("phash % 3 = 0"), h.filter("phash % 3 != 0"), 8, loop_cost=1e9)
    close = lambda x, y: (x[0] ^ y[0]).bit_count() <= 8 and (x[1] ^ y[1]).bit_count() <= 8
    want = [(*x, *y, (x[0] ^ y[0]).bit_count()) for x in values if x[0] % 3 == 0 for y in values if y[0] % 3 and close(x, y)]
    assert rows(near) == sorted(want, key=str) and want
    plan = near._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin [v#" in plan


def test_long_chains_end(spark):
    """More rounds than allowed: the rest is decided by component."""
    n = 10
    items = [(f"p{k:02d}", (1 << (2 * k)) - 1, 0) for k in range(n)]  # neighbours are two bits apart
    items = [(p, h - (1 << 64) if h >> 63 else h, d) for p, h, d in items]
    df = spark.createDataFrame([(p, a, b, 1) for p, a, b in items], "path string, phash long, dhash long, size long")
    want = sequential([(p, a & ((1 << 64) - 1), b) for p, a, b in items], 2)
    for rounds in (1, 30):
        assert {x.path: x.group_id for x in cluster.leader_groups(df, 2, rounds).collect()} == want


def test_components_with_hubs(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 700)] + [(k, 900) for k in range(650, 800)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            if a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert {x.node: x.label for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} == label
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def free_names(moves, taken):
    """One after the other, as files would be moved."""
    taken, out = set(taken), {}
    for src, dst in sorted(moves):
        folder, name = dst.rsplit("/", 1)
        at = name.rfind(".")
        stem, ext = (name[:at], name[at:]) if 0 < at < len(name) - 1 else (name, "")
        n, free = 0, dst
        while free in taken:
            n += 1
            free = f"{folder}/{stem}_{n}{ext}"
        taken.add(free)
        out[src] = free
    return out


def test_free_names(spark):
    r = random.Random(9)
    names = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_5.jpg", "a_1_1.jpg", "a", "a_1", "b.c_1", "b_1.c_1", "b.c", ".x", ".x_1", "y.", "y._1", "IMG_7.jpg", "IMG_2023.jpg"]
    for seed in range(3):
        r.seed(seed)
        moves = [(f"{k:03d}", "/t/" + r.choice(names)) for k in range(25 if seed else 4)]
        taken = ["/t/" + x for x in r.sample(names, r.randint(0, 8))]
        df = spark.createDataFrame(moves, "src string, dst string")
        got = {x.src: x.dst for x in actions.unique_targets(df, spark.createDataFrame([(x,) for x in taken], "path string")).collect()}
        assert got == free_names(moves, taken)


def test_confirm(spark, tmp_path):
    for p in ("A/img.jpg", "B/img.jpg", "C/one.jpg", "C/two.jpg", f"{paths.TRASH}/B/img.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    at = lambda *names: spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names], "path string")
    members = spark.createDataFrame([("g", f"{tmp_path}/A/img.jpg", 1), ("g", f"{tmp_path}/B/img.jpg", 1)], "group_id string, path string, size long")
    ask = spark.createDataFrame([(f"{tmp_path}/A/img.jpg", None, f"{tmp_path}/B")], "path string, new_name string, target_dir string")
    dirs = spark.createDataFrame([(f"{tmp_path}/{d}",) for d in "ABC"], "dir string")
    there = at("A/img.jpg", "B/img.jpg", "C/one.jpg", "C/two.jpg", f"{paths.TRASH}/B/img.jpg")
    refused = actions.confirm_plan(members, at("C/one.jpg"), ask, there, dirs, F.lit(str(tmp_path)))
    assert actions.carry_out(refused, dry_run=False) == {"moved": 0, "skipped": 0, "errors": 0, "refused": 1}
    plan = actions.confirm_plan(members, at("A/img.jpg"), ask, there, dirs, F.lit(str(tmp_path)))
    assert rows(plan.select("phase", "dst", "status")) == [(1, f"{tmp_path}/{paths.TRASH}/B/img_1.jpg", "ok"), (2, f"{tmp_path}/B/img.jpg", "ok")]
    assert actions.carry_out(plan) == {"moved": 2, "skipped": 0, "errors": 0, "refused": 0} == actions.carry_out(plan, dry_run=False)
    assert (tmp_path / "B/img.jpg").read_text() == "A/img.jpg" and (tmp_path / paths.TRASH / "B/img_1.jpg").read_text() == "B/img.jpg"


def test_choices(spark):
    m = [("g", 0, "/r/a/IMG_1.jpg"), ("g", 1, "/r/b/sunset.jpg"), ("g", 2, "/r/a/x.jpg"), ("h", 0, "/r/a/k.jpg"), ("h", 1, "/r/b/k.jpg"), *[("many", k, f"/r/{k:02d}/f.jpg") for k in range(27)]]
    members = spark.createDataFrame(m, "group_id string, ordinal int, path string")
    offered = interactive.offered(members)
    assert offered.filter("group_id = 'many'").count() == 26 and rows(offered.filter("group_id = 'g'").select("dir", "letter")) == [("/r/a", "a"), ("/r/b", "b")]
    choices = spark.createDataFrame([("g", "a"), ("h", "z"), ("many", "b")], "group_id string, letter string")
    got = {x.path: (x.action, x.dst) for x in interactive.decide(members, choices, F.lit("/r")).collect()}
    assert got["/r/a/x.jpg"] == ("rename", "/r/a/sunset.jpg") and got["/r/a/IMG_1.jpg"] == ("trash", f"/r/{paths.TRASH}/a/IMG_1.jpg") and got["/r/b/sunset.jpg"][0] == "trash"
    assert got["/r/a/k.jpg"] == ("skip", None) and {v[0] for k, v in got.items() if k.endswith("f.jpg")} == {"refused"}


def test_null_prints_are_read_again(spark):
    f = spark.createDataFrame([(p, 1, 1.0) for p in "ab"] + [("c", None, None)], "path string, size long, mtime double")
    c = spark.createDataFrame([("a", 1, 1.0, 5, None), ("b", 1, 1.0, 5, 6), ("c", 1, 1.0, 7, 7), ("z", 1, 1.0, 1, 1)], "path string, size long, mtime double, phash long, dhash long")
    status = cache.cache_status(f, c)
    assert {r.path: r.status for r in status.collect()} == {"a": "stale", "b": "hit", "c": "unknown"}
    none = lambda todo: todo.filter("false").withColumns({"phash": F.lit(1).cast("long"), "dhash": F.lit(1).cast("long")})
    assert {r.path for r in cache.refresh(f, c, none).collect()} == {"b", "c"}
    assert {r.path for r in cache.refresh(f, c, none, keep_missing=True).collect()} == {"b", "c", "z"}
    assert tuple(cache.counters(status, f.filter("path = 'a'"), cache.pruned(c, f)).first()) == (3, 1, 0, 2, 1, 1)


def test_caches_on_disk(spark, tmp_path):
    (tmp_path / "i.csv").write_text("path,size,mtime,phash\na,1,2.0,ff\na,1,3.0,0f\nb,1,2.0,zz\na,x,4.0,aa\n")
    got = caches.load_images(spark, str(tmp_path / "i.csv"))  # no dhash; the last good row counts
    assert rows(got.select("path", "mtime", "phash", "dhash")) == [("a", 3.0, 15, None)]
    caches.export_csv(got, str(tmp_path / "out.csv"))
    caches.export_csv(got, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_text().splitlines()[0] == "path,size,mtime,phash,dhash" and sorted(os.listdir(tmp_path)) == [".out.csv.crc", "i.csv", "out.csv"] or (tmp_path / "out.csv").is_file()
    assert rows(caches.load_images(spark, str(tmp_path / "out.csv")).select("path", "phash")) == [("a", 15)]
    store = tmp_path / "db"
    store.mkdir()
    files = lambda *names: spark.createDataFrame([(n, 1, 1.0) for n in names], "path string, size long, mtime double")
    seen = []

    def compute(todo):
        seen.extend(r.path for r in todo.collect())
        bad = F.when(F.col("path") == "bad", "unreadable")
        return todo.withColumns({"phash": F.lit(1).cast("long"), "dhash": F.lit(2).cast("long"), "error": bad})

    n = caches.update_store(files("a", "b", "bad"), str(store), caches.IMAGES, compute, chunk=1)
    assert n == {"files": 3, "hits": 0, "new": 3, "rehashed": 0, "errors": 1, "pruned": 0} and sorted(seen) == ["a", "b", "bad"]
    n = caches.update_store(files("b", "c", "bad"), str(store), caches.IMAGES, compute)
    assert n == {"files": 3, "hits": 1, "new": 2, "rehashed": 0, "errors": 1, "pruned": 1} and sorted(seen[3:]) == ["bad", "c"]
    assert sorted(r.path for r in caches.read_store(spark, str(store), caches.IMAGES).collect()) == ["b", "c"]

    def fails(todo):
        raise RuntimeError("interrupted")

    with pytest.raises(RuntimeError):
        caches.update_store(files("b", "d"), str(store), caches.IMAGES, fails)
    assert sorted(r.path for r in caches.read_store(spark, str(store), caches.IMAGES).collect()) == ["b", "c"]


def test_stream_makes_its_cache(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0)], "path string, size long, mtime double")
    files.write.parquet(str(tmp_path / "in"))
    schema = "path string, size long, mtime double, phash long"
    for _ in range(2):
        stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
        q = incremental.refresh_stream(stream, str(tmp_path / "cache"), schema, lambda todo: todo.withColumn("phash", F.lit(3).cast("long")), str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "cache")).select("path", "phash")) == [("a", 3), ("b", 3)]


def png(path, gray):
    raw = b"".join(b"\0" + bytes(row) for row in gray.astype("uint8"))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_command_line(spark, tmp_path, capsys):
    import numpy as np

    r = np.random.default_rng(0)
    a, b = (np.kron(r.random((8, 8)), np.ones((8, 8))) * 255 for _ in range(2))
    for name in ("a.png", "b c.png", "_x.png", ".h.png", "sub/_d/e.png", "ü.png"):
        png(tmp_path / name, a)
    png(tmp_path / "big.png", np.kron(a, np.ones((2, 2))))
    png(tmp_path / "other.png", b)
    (tmp_path / "broken.png").write_bytes(b"no image")
    hashes, n = cli.image_hashes(scan.scan_files(spark, str(tmp_path), paths.IMAGE_SUFFIXES), caches.database_dir(str(tmp_path)))
    assert n == {"files": 9, "hits": 0, "new": 9, "rehashed": 0, "errors": 1, "pruned": 0} and hashes.count() == 8
    assert cli.main([str(tmp_path), "--threshold", "4"]) == 0
    said = capsys.readouterr().out
    assert "hits 8, new 1, rehashed 0, errors 1" in said and "groups 1, files 7" in said and "_x.png" in said and "b c.png" in said
    assert cli.main([str(tmp_path), "--exact"]) == 0
    said = capsys.readouterr().out
    assert "groups 1, files 6" in said and said.count("keep\t") == 1
    group = str(tmp_path / ".h.png")
    assert cli.main([str(tmp_path), "-t", "4", "--review"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1].split("\t", 2)[2])["keep_default"] == str(tmp_path / "big.png")
    assert cli.main([str(tmp_path), "-t", "4", "--interactive"]) == 0
    assert f"{group}\tb\t{tmp_path}" in capsys.readouterr().out  # the folder of the largest file first
    choices = tmp_path / "choices.csv"
    choices.write_text(f"group_id,letter\n{group},a\n")
    assert cli.main([str(tmp_path), "-t", "4", "--choices", str(choices), "--apply"]) == 0
    assert sum(len(f) for _, _, f in os.walk(tmp_path / paths.TRASH)) == 6
    assert cli.main([str(tmp_path), "-t", "4", "--verify-trash"]) == 0
    png(tmp_path / paths.TRASH / "lost.png", 255 - b)
    (tmp_path / paths.TRASH / "bad.png").write_bytes(b"x")
    (tmp_path / paths.TRASH / "clip.mp4").write_bytes(b"film")
    capsys.readouterr()
    assert cli.main([str(tmp_path), "-t", "4", "--verify-trash"]) == 1
    said = capsys.readouterr().out
    assert f"unmatched\timage\t{tmp_path / paths.TRASH / 'lost.png'}" in said and "unverifiable\timage" in said and "unmatched\tvideo" in said and "without a match: 3" in said
    (tmp_path / "copy.mp4").write_bytes(b"film")
    assert cli.main([str(tmp_path), "-t", "4", "--verify-trash", "--cache", str(tmp_path / "made" / "here")]) == 1
    assert "without a match: 2" in capsys.readouterr().out and (tmp_path / "made/here/images.parquet").exists()


def test_arguments(tmp_path):
    (tmp_path / "file").write_text("")
    for bad in (["--threshold", "-1"], ["--limit", "0"], ["--page-size", "501"], ["--delta", "much"], ["--cache", str(tmp_path / "file")], ["--review", "--interactive"]):
        with pytest.raises(SystemExit):
            cli.arguments([str(tmp_path), *bad])
    with pytest.raises(SystemExit):
        cli.arguments([str(tmp_path / "none")])
    a = cli.arguments([str(tmp_path), "-i", "x", "-i", "y", "-d", "2kb"])
    assert a.ignore == ["x", "y"] and a.delta == 2048 and a.threshold == 10


def test_videos_by_a_stand_in(tmp_path, monkeypatch):
    """ffmpeg is absent here: a script that answers like it."""
    tool = tmp_path / "ffmpeg"
    tool.write_text("#!/bin/sh\ncase \"$*\" in *rawvideo*) head -c 98304 /dev/zero;; *) echo '  Duration: 00:01:00.50, start: 0' >&2; exit 1;; esac\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert media.ffmpeg_available() and media.video_hashes("x.mp4") == (60.5, [0] * 8)
    (tmp_path / "ffprobe").write_text("#!/bin/sh\necho 9.5\n")
    (tmp_path / "ffprobe").chmod(0o755)
    assert media.video_duration("x.mp4") == 9.5
    tool.write_text("#!/bin/sh\nexit 3\n")
    with pytest.raises(ValueError):
        media.video_hashes("x.mp4")


def test_folders_for_intermediate_tables(spark, monkeypatch):
    from matchloom.operators import materialize

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        materialize.shared_dir(Cluster)


def test_scan_splits_folders(spark, tmp_path, monkeypatch):
    want = set()
    for k in range(6):
        for j in range(5):
            f = tmp_path / f"d{k}" / f"e{j}" / "f" / "x.jpg"
            f.parent.mkdir(parents=True)
            f.write_text("x")
            want.add(str(f))
    os.symlink(tmp_path / "d0", tmp_path / "link")
    for parts in (1, 4, 20, 500):
        monkeypatch.setattr(scan, "PARTS", parts)
        reader = scan._Reader(str(tmp_path))
        split = reader.partitions()
        assert len(split) >= min(parts, 60) and sorted(p for part in split for p, *_ in reader.read(part)) == sorted(want)
    assert [r.path for r in scan.scan_files(spark, str(tmp_path), ordered=True).collect()] == sorted(want)


def test_moves_stay_inside(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "else").mkdir()
    os.symlink(tmp_path / "else", tmp_path / "root" / "link")
    for f in ("root/a", "else/b", "root/c"):
        (tmp_path / f).write_text("x")
    root = str(tmp_path / "root")
    plan = spark.createDataFrame([(f"{root}/a", f"{root}/link/a", "ok"), (f"{root}/link/b", f"{root}/b", "ok"), (f"{root}/c", f"{root}/sub/c", "ok")], "src string, dst string, status string")
    assert actions.carry_out(plan, False, root) == {"moved": 1, "skipped": 0, "errors": 2, "refused": 0}
    assert (tmp_path / "else/b").exists() and (tmp_path / "root/sub/c").exists()


def test_keys_and_shown_paths(spark):
    rows_ = spark.createDataFrame([("\\a\\x.jpg",), ("\\b\\gone.jpg",)], "path string")
    there = spark.createDataFrame([("C:\\a\\x.jpg",)], "path string")
    assert [r.place for r in cache.on_disk(rows_, there, True).orderBy("path").collect()] == ["C:\\a\\x.jpg", "\\b\\gone.jpg"]
    assert [r.place for r in cache.on_disk(rows_, there).orderBy("path").collect()] == ["\\a\\x.jpg", "\\b\\gone.jpg"]
    assert column(spark, ["C:\\a\\x.jpg"], "string", lambda v: paths.shown(v, True)) == ["file:///C:/a/x.jpg"] and column(spark, ["/a"], "string", paths.shown) == ["/a"]
    assert column(spark, ["/r/a/b", "/r", "/x/y", "/r2/z", "/"], "string", lambda v: paths.relative(v, F.lit("/r"))) == ["a/b", ".", "../x/y", "../r2/z", ".."]


def test_requests_of_a_review(spark):
    m = spark.createDataFrame([("g", "/r/a/1.jpg"), ("g", "/r/b/2.jpg"), ("h", "/r/a/3.jpg"), ("h", "/r/b/4.jpg"), ("i", "/r/a/5.jpg"), ("i", "/r/b/6.jpg")], "group_id string, path string")
    payload = [json.dumps({"keep": ["/r/a/1.jpg", 5, None, ["x"], "/r/a/3.jpg", "/r/b/4.jpg"], "renames": [{"path": "/r/a/1.jpg", "new_name": 7, "target_dir": "/r/b"}, {"new_name": "x"}, "no", 3]}), "not json", "[]", '{"keep": "all", "renames": {}}']
    keep, asked = interactive.decisions_from_json(spark.createDataFrame([(x,) for x in payload], "json string"))
    assert rows(keep) == [("/r/a/1.jpg",), ("/r/a/3.jpg",), ("/r/b/4.jpg",)] and rows(asked) == [("/r/a/1.jpg", None, "/r/b")]
    keep = keep.unionByName(spark.createDataFrame([("/r/a/5.jpg",)], "path string"))
    sources = spark.createDataFrame([("g", "/r/b/2.jpg", "/r/b/2.jpg"), ("h", "/r/b/4.jpg", None), ("i", "/r/a/5.jpg", "/else/9.jpg")], "group_id string, rename_src string, folder_src string")
    assert rows(interactive.transform_requests(m, keep, sources)) == [("/r/a/1.jpg", "2.jpg", "/r/b")]


def test_resampling():
    import numpy as np

    flat = np.full((50, 70), 131.0)
    assert (media._shrink(flat, 8, 9) == 131).all() and media.image_hashes(flat)[1] == 0
    for size, out in ((64, 32), (37, 9), (8, 9), (3000, 32)):
        w = media._resampler(size, out)
        assert np.abs(w.sum(axis=1) / media._UNIT - 1).max() < 1e-3 and (w == np.rint(w)).all()
        k = out // 2  # one output value, weight by weight
        centre, wide = (k + 0.5) * size / out, max(size / out, 1)
        lobe = [max(0.0, 1.0) if (x := (i + 0.5 - centre) / wide) == 0 else 3 * np.sin(np.pi * x) * np.sin(np.pi * x / 3) / (np.pi * x) ** 2 if abs(x) < 3 else 0.0 for i in range(size)]
        assert np.abs(w[k] / media._UNIT - np.array(lobe) / sum(lobe)).max() < 1e-6
    ramp = np.tile(np.arange(0, 250, 2.0), (40, 1))
    assert media.image_hashes(ramp)[1] == -1 and media.image_hashes(ramp[:, ::-1])[1] == 0  # bright to the right: all bits
    assert media.luma(np.array([255.0, 0]), np.array([255.0, 128]), np.array([255.0, 0])).tolist() == [255, 75]
