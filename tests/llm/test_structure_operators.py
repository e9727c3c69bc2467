"""URL filter, neighbours, suffix dedup, the Jaccard join, the pipeline and the queries, with untidy tables."""

import hashlib
import importlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import jaccard_join, neighbours, rolling, suffix_dedup, url_filter
from quernstone.llm.common import Scratch
from quernstone.llm.queries import URL_RULES


def test_url_parts_and_rules(spark):
    rows = [
        (1, "HTTP://WWW.Example.NET/en/1?x", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "http://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
        (3, "http://net/", "net", "/", "net/", "block"),
        (4, "http://a.net", "a.net", "", None, "allow"),
        (5, "https://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"),
        (6, "https://x.org/fr/?a", "x.org", "/fr/", "org/fr/", "allow"),
        (7, "https://x.org?/fr/", "x.org", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme", "", "", None, "allow"),
        (10, "a://b://c/", "b:", "//c/", None, "allow"),
        (None, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], None, "h") for r in rows], "page_id long, url string, bad int, host string")
    out = url_filter.filter_urls(pages, URL_RULES)
    assert out.columns == ["page_id", "url", "bad", "host", "path", "rule", "verdict", "bad_low"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {r[0]: r[2:] for r in rows}
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_reputation(spark):
    rows = [(f"http://h{h}.{'bad' if h < 5 else 'good'}{h % 2}.info/{k}", int(h < 5)) for h in range(10) for k in range(30)]
    rows += [("http://new.bad0.info/", None), ("http://new.good1.info/", None), ("http://elsewhere.xyz/", None)]
    pages = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r.url: r.verdict for r in url_filter.filter_urls(pages, ()).collect()}
    assert got["http://h0.bad0.info/0"] == "block" and got["http://h7.good1.info/0"] == "allow"
    assert got["http://new.good1.info/"] == "allow" == got["http://elsewhere.xyz/"]
    low = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame([("a.x.com", 100, 90), ("b.x.com", 1, 1), ("c.y.com", 100, 5), ("d.y.com", 0, 0)], "host string, n long, k long")).collect()}
    assert low["a.x.com"].low > low["b.x.com"].low > low["d.y.com"].low > 0 or low["d.y.com"].low <= low["b.x.com"].low
    assert low["d.y.com"].mean < low["b.x.com"].mean < 1


def test_domains(spark):
    rows = [
        ("www.bbc.co.uk", "bbc.co.uk", "co.uk"), ("bbc.co.uk", "bbc.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("a.b.example.com", "example.com", "com"),
        ("user:pw@shop.example.de:8080", "example.de", "de"), ("co.com", "co.com", "com"), ("10.0.0.1", "10.0.0.1", ""), ("10.0.0.1:80", "10.0.0.1", ""), ("localhost", "localhost", "localhost"), ("", "", ""),
    ]
    df = spark.createDataFrame([r[:1] for r in rows], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", url_filter.registered_domain(F.col("host")).alias("d"), url_filter.host_suffix(F.col("host")).alias("s")).collect()}
    assert got == {h: (d, s) for h, d, s in rows}


def test_urls_of_untidy_tables(spark):
    rows = [("http://a.net/x", 1), ("http://a.net/x", 1), ("http://b.com/", None), (None, 0)]
    pages = spark.createDataFrame(rows, "url string, bad int").withColumns({c: F.lit(k) for k, c in enumerate(["__h", "__low", "__host", "__path", "__rule", "__c0", "a.b", "rule"])})
    rules = [("net", "/", "allow"), ("net", "/", "block"), ("b.com", "/", "block"), ("b.com", "/", "allow"), ("com", "", "allow")]
    out = url_filter.filter_urls(pages, rules)
    assert out.columns == ["url", "bad", "__h", "__low", "__host", "__path", "__rule", "__c0", "a.b", "host", "path", "rule", "verdict", "bad_low"]
    got = sorted((r.url or "", r.rule, r.verdict, r["__low"], r["a.b"]) for r in out.collect())
    assert got == [("", None, "allow", 1, 6), ("http://a.net/x", "net/", "block", 1, 6), ("http://a.net/x", "net/", "block", 1, 6), ("http://b.com/", "b.com/", "block", 1, 6)]


def nearest(rows, query, k=10):
    x = dict(rows)[query]
    return sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, v in rows if i != query)[:k]


def test_few_vectors_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.standard_normal(4).astype(np.float32)]) for k in range(7)] + [(100, [1.0, 0.0, 0.0, 0.0]), (101, [1.0, 0.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0])]
    bad = [(8, None), (9, [0.0] * 4), (10, [1.0, float("nan"), 0.0, 0.0]), (11, [float("inf")] + [0.0] * 3), (12, [1.0, None, 0.0, 0.0]), (13, [1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (300, None)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("part", F.lit("x"))
    got = {}
    for r in neighbours.search(df, "vec_id % 100 = 0").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        want = nearest(rows, q)
        assert [(n, v) for n, _, v in sorted(found)] == [(n + 1, v) for n, (_, v) in enumerate(want)]
        assert [s for _, s, _ in sorted(found)] == pytest.approx([s for s, _ in want])
    assert neighbours.search(df.limit(0), "vec_id % 100 = 0").count() == 0


def test_recall(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16)) * 2
    x = (centres[rng.integers(0, 30, 4000)] + rng.standard_normal((4000, 16))).astype(np.float32)
    x[1000:1600] = x[1000]  # one vector many times
    monkeypatch.setattr(neighbours, "SLICE_ROWS", 300)
    monkeypatch.setattr(neighbours, "SLICE_QUERIES", 3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(df, "vec_id % 100 = 0").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hit, y = 0, x.astype(np.float64)
    for q in range(0, 4000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(4000), d))[:10]
        found = sorted(got[q])
        assert [n for n, _, _ in found] == list(range(1, 11))
        assert [s for _, s, _ in found] == pytest.approx([d[v] for _, _, v in found])
        hit += len(set(want.tolist()) & {v for _, _, v in found})
    assert hit >= 0.9 * 400


def check_recall(df, x, condition, queries, spark_search, least):
    """Every query has its ten rows with exact scores; the share of the true ten that is found."""
    got, hit = {}, 0
    for r in spark_search(df, condition).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == set(queries)
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [n for n, _, _ in sorted(found)] == list(range(1, 11))
        assert [s for _, s, _ in sorted(found)] == pytest.approx([d[v] for _, _, v in sorted(found)])
        hit += len(set(np.lexsort((np.arange(len(x)), d))[:10].tolist()) & {v for _, _, v in found})
    assert hit >= least * 10 * len(got)


@pytest.mark.parametrize("copies,parts", [(1, 256), (13, 64)])
def test_the_router_runs_at_most_partitions(spark, monkeypatch, copies, parts):
    rng, n, asked = np.random.default_rng(3), 26_000, []
    centres = rng.standard_normal((200, 8)) * 2
    x = np.tile(centres[rng.integers(0, 200, n // copies)] + rng.standard_normal((n // copies, 8)), (copies, 1))
    learn = neighbours.learn
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    monkeypatch.setattr(neighbours, "learn", lambda x, parts, *a: asked.append((len(x), parts)) or learn(x, parts, *a))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    check_recall(df, x, "vec_id % 400 = 0", range(0, n, 400), neighbours.search, 0.9)
    assert [p for _, p in asked] == [parts] and asked[0][0] >= neighbours.EACH * parts


def test_partitions_of_partitions(spark, monkeypatch):
    rng, n, cells = np.random.default_rng(6), 8_000, []
    centres = rng.standard_normal((60, 8)) * 2
    x = centres[rng.integers(0, 60, n)] + rng.standard_normal((n, 8))
    x[3000:5500] = x[3000]  # one vector in a third of all rows
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    monkeypatch.setattr(neighbours, "MOST", 4)
    monkeypatch.setattr(neighbours, "LEAST", 4)
    monkeypatch.setattr(neighbours, "BATCH", 500)
    second = neighbours._second_level

    def seen(*a):
        out = second(*a)
        cells.extend(r["cell"] for r in out.select("cell").distinct().collect())
        return out

    monkeypatch.setattr(neighbours, "_second_level", seen)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    check_recall(df, x, "vec_id % 100 = 0", range(0, n, 100), neighbours.search, 0.9)
    assert len(cells) > 8 and max(cells) < 16


def test_repeated_and_lonely_queries(spark, monkeypatch):
    rng, asked = np.random.default_rng(8), []
    x = rng.standard_normal((300, 4)) + 20
    x[:3] = [[-50, 0, 0, 0], [-51, 0, 0, 0], [-52, 0, 0, 0]]  # a far corner with fewer than ten rows
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    learn = neighbours.learn
    monkeypatch.setattr(neighbours, "learn", lambda x, parts, k, target: asked.append(parts) or (learn(x, parts, k, target)[0], 1))
    df = spark.createDataFrame([*rows, rows[100], rows[100], rows[7], (200, [0.5] * 4), (9, rows[8][1])], "vec_id long, embedding array<double>").withColumn("h", F.lit(1))
    got = {}
    for r in neighbours.search(df, "vec_id % 100 = 0").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert asked and asked[0] > 1
    assert {q: len(found) for q, found in got.items()} == {0: 10, 100: 10, 200: 20}
    for found in got.values():
        assert len({(s, v) for _, s, v in found}) == len(found)
    assert [v for _, _, v in sorted(got[0])][:2] == [1, 2]
    two = [(v, n) for n, v in sorted((n, v) for n, _, v in got[200])]
    assert sorted(n for _, n in two) == sorted([*range(1, 11)] * 2)


def test_partitions_are_balanced():
    x = np.random.default_rng(2).standard_normal((800, 8))
    part = neighbours.partition_graph(neighbours.nearest(x, x, 8, True), 16)
    assert set(np.bincount(part, minlength=16)) == {50}


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = text.encode()
        cover, mine = bytearray(len(b)), []
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                cover[k : k + length] = b"\1" * length
            else:
                seen.add(s)
                mine.append(s)
        kept = bytes(c for c, m in zip(b, cover, strict=True) if not m)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), kept)
    return out


def test_suffix_sort_fuzz():
    rng = random.Random(3)
    for _ in range(40):
        length, alphabet = rng.choice([24, 30]), rng.choice([b"a", b"ab", b"abc"])
        data = np.frombuffer(bytes(rng.choice(alphabet) for _ in range(600)), np.uint8)
        at = np.array(sorted(rng.sample(range(600 - length), 300)))
        group = np.sort(np.array([rng.randrange(4) for _ in range(300)]))
        order = suffix_dedup._order(data, rolling.prefix_hashes(data), group, at, length)
        key = [(group[k], data[at[k] : at[k] + length].tobytes(), k) for k in range(300)]
        assert [key[k] for k in order] == sorted(key)
        seen, want = set(), []
        for g, s, _ in key:
            want.append((g, s) in seen)
            seen.add((g, s))
        assert suffix_dedup.repeated_suffixes(data, group, at, length).tolist() == want


def test_collisions_are_found(monkeypatch):
    data = np.frombuffer(b"abcdefgh" + b"x" * 30 + b"abcdefgh" + b"y" * 30, np.uint8)
    at, group = np.array([0, 38]), np.zeros(2, np.int64)
    monkeypatch.setattr(suffix_dedup, "ranges", lambda p, a, b: np.zeros(len(a), np.uint64))  # all hashes collide
    assert suffix_dedup.repeated_suffixes(data, group, at, 30).tolist() == [False, False]
    assert suffix_dedup.repeated_suffixes(data, group, at, 24).tolist() == [False, False]


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffix_dedup, "PART_SUFFIXES", 40)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdé ") for _ in range(150))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))) for k in range(25)]
    rows += [(100 + k, rows[k][1] + passage * rng.randint(0, 2) + rows[k + 3][1][:120]) for k in range(20)]
    rows += [(200, "a" * 1000), (201, "ab" * 400), (202, "a" * 500 + passage[:90]), (203, rows[30][1]), (204, ""), (-5, passage), (205, "é" * 300)]
    df = spark.createDataFrame([*rows, (300, None)], "doc_id long, text string").withColumn("part", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length=60).collect()}
    want = brute_repeats(rows, 60)
    assert sum(x[1] for x in want.values()) > 5000
    assert got == want | {300: (0, 0, 0, b"")}


def test_repeats_of_untidy_ids(spark):
    a, b = "abcdefghij" * 3 + "".join(map(chr, range(200, 400))), "".join(map(chr, range(300, 600)))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()]
    assert len(out) == 5
    la, lb = len(a.encode()), len(b.encode())
    assert sorted(x[1:] for x in out if x[0] is None) == sorted([(la, la), (lb, lb)])
    # Of the two texts of id 1 the later one, by a hash, loses what both hold; equal rows lose the same.
    same = [x for x in out if x[0] == 1 and x[1] == la]
    other = [x for x in out if x[0] == 1 and x[1] == lb]
    assert len(same) == 2 and same[0] == same[1] and sorted([same[0][2] > 0, other[0][2] > 0]) == [False, True]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_repeated_rows_are_one_document(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffix_dedup, "PART_SUFFIXES", 40)
    rng = random.Random(5)
    noise = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(8)]
    rows = [(1, noise[0] + noise[1]), (2, noise[1][:100] + noise[2]), (3, noise[3] + noise[2][40:] + noise[1]), (4, "ab" * 100), (5, noise[4])]
    df = spark.createDataFrame([*rows, *rows[:4], rows[0]], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length=60).collect()}
    assert got == {(i, *x) for i, x in brute_repeats(rows, 60).items()}


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(rolling._LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, n=150):
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(["x", "Y", "é", "w1"])
        if rng.random() < 0.2:
            words += ["w1", "w2"]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize("block,n", [(512, 150), (3, 400), (7, 1000)])
def test_components(spark, monkeypatch, block, n):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(random.Random(8), n) + [(1900, ""), (1901, " \n"), (1902, "one"), (1903, "ONE"), (1904, "one two")]
    assert n < 1000 or max(Counter(next(iter(sorted(shingles(t))), None) for _, t in rows).values()) > jaccard_join.SMALL
    chain = [f"c{k}" for k in range(60)]
    rows += [(2000 + k, " ".join(chain[2 * k : 2 * k + 40])) for k in range(10)]  # each like the next, not the last
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 40 and want[2009][1] == 2000
    df = spark.createDataFrame([*rows, (1950, None), (None, rows[0][1])], "doc_id long, text string").withColumn("c", F.lit(1)).repartition(3)
    out = jaccard_join.similar_groups(df).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None}
    assert got == want | {1950: (0, 1950)}
    assert [r.component_id for r in out if r.doc_id is None] == [None]


def test_components_of_untidy_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (5, "q r s t u"), (9, "q r s t u"), (None, "q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # The two texts of 5 are one document, so it links 3 and 9.
    groups = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(df).collect())
    assert groups == [(-1, 1, None), (3, 2, 3), (5, 1, 3), (5, 2, 3), (5, 2, 3), (9, 1, 3)]
    kept = jaccard_join.keep_one_of_each(df.withColumn("__stay", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "__stay"]
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "q r s t u"), (3, "A B C D E F"), (5, "q r s t u")]
    assert jaccard_join.similar_groups(df.limit(0)).count() == 0


def test_texts_of_one_id(spark):
    a, q, r = "a b c d e f", "q r s t u", "v w x y z"
    rows = [(3, a), (5, a), (5, q), (9, q), (7, r), (7, "one two"), (7, r), (8, r.upper()), (6, ""), (6, q), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = {(x.doc_id, x.component_id) for x in jaccard_join.similar_groups(df).collect()}
    assert groups == {(3, 3), (5, 3), (9, 3), (6, 3), (7, 7), (8, 7), (None, None)}
    kept = sorted(((x.doc_id or -1, x.text) for x in jaccard_join.keep_one_of_each(df).collect()))
    assert kept == sorted([(-1, a), (3, a), (5, q), (6, ""), (7, r), (7, "one two")])


def test_label_propagation(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(40)]
    parent = {x: x for e in links for x in e}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == parent


def test_r_tree_finds_all_that_the_bound_allows(monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 5, (300, jaccard_join.GROUPS)).astype(np.uint8)
    points[150:] = points[:150] + rng.integers(0, 2, (150, jaccard_join.GROUPS))
    sizes = points.sum(1).astype(np.int64)
    want = set()
    for k in range(300):
        fits = (9 * np.minimum(points, points[k]).sum(1) >= 4 * (sizes + sizes[k])) & (5 * sizes >= 4 * sizes[k]) & (5 * sizes[k] >= 4 * sizes)
        want |= {(k, j) for j in np.flatnonzero(fits).tolist()}
    for fan, at_once in ((4, 20_000), (16, 70), (2, 1)):
        monkeypatch.setattr(jaccard_join, "FAN", fan)
        monkeypatch.setattr(jaccard_join, "AT_ONCE", at_once)
        tree = jaccard_join.RTree(points, sizes)
        assert len(tree.levels) > 2
        for few in (slice(0, 300), slice(145, 150), slice(7, 7)):
            who, at = tree.near(points[few], sizes[few])
            assert sorted(zip((who + few.start).tolist(), at.tolist(), strict=True)) == sorted(x for x in want if few.start <= x[0] < few.stop)
    wide = [np.full(jaccard_join.GROUPS, x).astype(t).tobytes() for x, t in ((3, np.uint8), (300, np.uint16), (70_000, np.uint32))]
    assert jaccard_join._read_points(wide)[:, 0].tolist() == [3, 300, 70_000] and jaccard_join._read_points(wide[:1])[0, 5] == 3
    assert [len(x) for x in jaccard_join._points(np.zeros(300, np.uint64), np.array([0, 10, 300]))] == [jaccard_join.GROUPS, 2 * jaccard_join.GROUPS]


def test_pairs_of_a_bucket_that_spans_batches():
    """Buckets that leave few pairs give them all; those of near copies, and large ones, those with the first
    classes of each band, and stay open."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base, rows = rng.integers(0, 4, jaccard_join.GROUPS).astype(np.uint8), []
    apart = np.zeros((40, jaccard_join.GROUPS), np.uint8)
    for k in range(40):
        apart[k, 10 * k : 10 * k + 10] = 5
    for bucket, m in ((1, 5), (2, 90), (3, 1), (4, 13), (5, 14), (6, 40)):
        for k in range(m):
            point = apart[k] if bucket == 6 else base.copy()
            point[k % 7] += 1
            rows.append((bucket, m, 100 * bucket + k, int(point.sum()), k + 1000 * bucket, point.tobytes()))
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a:b], strict=True)], ["bucket", "m", "c", "n", "rep", "point"]) for a, b in ((0, 3), (3, 6), (6, 30), (30, len(rows)))]
    got, open_ = set(), []
    for batch in jaccard_join._first_pairs(iter(batches)):
        for a, c, b in zip(*(batch.column(k).to_pylist() for k in ("a", "ac", "b")), strict=True):
            got.add((a, b)) if a is not None else open_.append(c)
    every = {(1000 * g + i, 1000 * g + j) for g, m in ((1, 5), (4, 13)) for i in range(m) for j in range(i + 1, m)}
    assert {x for x in got if x[0] // 1000 in (1, 3, 4, 6)} == every and sorted(open_) == [2, 5]
    for g, m in ((2, 90), (5, 14)):
        large = {x for x in got if x[0] // 1000 == g}
        assert {i for x in large for i in x} == {1000 * g + k for k in range(m)} and len(large) <= m * jaccard_join.PIVOTS * 3


def test_range_hashes_do_not_depend_on_the_groups(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    start, stop = np.array([0, 5, 40, 900, 2950]), np.array([5, 40, 900, 2940, 3000])
    want = rolling.ranges(rolling.prefix_hashes(data), start, stop).tolist()
    for size in (1, 7, 64, 5000):
        monkeypatch.setattr(rolling, "CHUNK", size)
        assert rolling.range_hashes(data, start, stop).tolist() == want


def test_very_long_texts(spark, monkeypatch):
    """Texts of many times the size that is hashed at once."""
    rng = random.Random(12)
    monkeypatch.setattr(rolling, "CHUNK", 100)
    text = " ".join(f"w{rng.randrange(50)}" * rng.choice([1, 1, 1, 90]) for _ in range(300)).encode()
    small = [(x.tolist(), y.tolist()) for x, y in [rolling.shingle_sets([text, b"", b"a b"])]]
    monkeypatch.setattr(rolling, "CHUNK", 1 << 22)
    assert small == [(x.tolist(), y.tolist()) for x, y in [rolling.shingle_sets([text, b"", b"a b"])]]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(130)) for _ in range(12)]
    rows = [(k, "".join(rng.choices(words, k=40))) for k in range(6)] + [(9, "x" * 3000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows, 100)


def test_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(9)
    words = {"en": "the house and then they went there with this boat over sea".split(), "fr": "les maisons sont avec une petite rue dans ville grande mer sur".split()}
    item = " ".join(rng.choices(words["en"], k=20))
    rows = []
    for k in range(60):
        x = rng.choice(["en", "fr"])
        rows.append((k, " ".join(rng.choices(words[x], k=30)) + "\nCommon Footer\n", x, "src0", 0))
    rows += [(100 + k, rows[k][1].replace("Common Footer", "other"), "en", None, None) for k in range(5)]
    rows += [(200, "x y " + item, "en", "s", 1), (201, "123 456", "en", "s", 1), (202, None, "en", "s", 1), (203, "", None, None, None), (None, "the house and then", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()}

    texts = {i: t for i, t, *_ in rows if t and re.search("[a-z]", t)}
    for i, t in texts.items():
        texts[i] = "\n".join(x for x in t.split("\n") if x != "Common Footer")
    groups = brute_components([(i, t) for i, t in texts.items() if i is not None])
    texts = {i: t for i, t in texts.items() if i is None or groups[i][1] == i}
    del texts[200]
    assert set(got) == set(texts) and not set(got) & set(range(100, 105))
    for i, t in texts.items():
        assert got[i][1] == hashlib.sha256(t.encode()).hexdigest()
    first = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, first, str(tmp_path))
        assert out.count() == 0, name
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == first.columns, name


def test_pipeline_stages_on_untidy_tables(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    long = "the sea and the boat " * 30_000
    rows = [
        (1, "the house and then they went there", None, "s", 1, "x"), (1, "the house and then they went there", None, "s", 1, "x"), (1, "a boat over the wide sea again", "en", None, None, None),
        (None, "the house and then they went there", "en", "s", 1, "y"), (2, None, "en", "s", 1, "y"), (3, "", "en", "s", 1, "y"), (4, long, "en", "s", 1, "z"), (5, "THE house and then they went there", "en", "s", 1, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__c0` string").withColumns({"__text": F.lit(1), "__id": F.lit(2), "a.b": F.lit(3), "n_words": F.lit(4)})
    spark.createDataFrame([(1, None), (None, "the house and then they went there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {
        "language ID": [(1, 0), (1, 0), (1, 2), (None, 0), (4, 6), (5, 7)],
        "line dedup": [(i, k) for i, k in [(1, 0), (1, 0), (1, 2), (None, 0), (2, 4), (3, 5), (4, 6), (5, 7)]],
        "n-gram Jaccard join": [(1, 0), (1, 2), (None, 0), (2, 4), (3, 5), (4, 6)],
        "benchmark decontamination": [(1, 2), (2, 4), (3, 5), (4, 6)],
    }
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(rows[k][1])) for i, k in want[name]), name
        assert all((r["__text"], r["__id"], r["a.b"], r["n_words"]) == (1, 2, 3, 4) for r in got), name
        if name == "language ID":
            assert {r["lang"] for r in got} == {"en"}
        if name == "line dedup":
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    out = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) == len(rows) and sum(r.n_tokens == 0 for r in out) == 2


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
