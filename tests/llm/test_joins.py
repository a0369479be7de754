"""Embedding near-dedup, source audit and band join against brute force and SQL."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sheafline.llm import bandjoin, queries, sourceaudit, vectordedup

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["op11_vector_near_dedup", "op12_source_audit", "op13_band_join"])
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "items", "sale_lines"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    got = [tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, DATA).collect()]
    assert Counter(got) == Counter(found.fetchall()) and got


# --- 11


def slow_links(rows, threshold=0.93):
    """One row per vector, every pair of a label compared."""

    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, root = [0] * n, list(range(n))
    unit = [np.array(v, float) / np.abs(v).max() / np.linalg.norm(np.array(v, float) / np.abs(v).max()) if usable(v, x) else None for _, v, x in rows]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        have = least.get(find(k))
        least[find(k)] = i if have is None else have if i is None else min(i, have)
    return Counter((i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(rows))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("settings", [{}, {"home_rows": 3}, {"home_rows": 1, "n_projections": 6, "misses": 1}])
def test_vectors_against_brute_force(spark, settings):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(260):
        base = rng.normal(size=16) if k % 5 == 0 or not rows else np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])
        rows.append((k, (base * rng.choice([1, 3])).tolist(), [0, 1, None, 0, 0][k % 5 if k % 11 else 2]))
    rows += [(k, rows[3][1], 1) for k in range(1000, 1060)]  # a group of copies
    got = Counter(tuple(r) for r in vectordedup.vector_links(vectors(spark, rows), vectordedup.Projections(**settings)).collect())
    assert got == slow_links(rows) and sum(k[1] for k in got) > 3000


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold: the calibrated share of these is found, and nothing below it."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(1500):
        x, y = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        cosine = 0.9301 if k % 3 else 0.9299
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (cosine * x + math.sqrt(1 - cosine**2) * y).tolist(), 0)]
    got = {r["vec_id"]: r["n_links"] for r in vectordedup.vector_links(vectors(spark, rows)).collect()}
    above = [got[2 * k] for k in range(1500) if k % 3]
    assert sum(above) / len(above) >= 0.98 and max(above) == 1
    assert not any(got[2 * k] for k in range(0, 1500, 3))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, -0.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (10, [1e200, 1e190], 2), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 0), (13, [1.0, 0.0], 1), (14, [5e-324, 0.0], 1)]
    df = vectors(spark, rows).selectExpr("*", "1L AS node", "2 AS n", "'x' AS key", "3 AS cell")
    got = Counter(tuple(r) for r in vectordedup.vector_links(df).collect())
    assert got == slow_links(rows)
    assert got[(1, 3, 1, True)] == 2 and got[(None, 1, None, True)] == 2 and got[(None, 3, 1, False)] == 1 and got[(6, 0, 6, True)] == 1
    assert vectordedup.vector_links(vectors(spark, [])).collect() == []


def test_windows_follow_the_recall():
    for dim in (2, 16, 64, 768):
        w = [vectordedup.half_width(vectordedup.Projections(recall=r), dim) for r in (0.5, 0.9, 0.99)]
        assert w == sorted(w) and w[0] < w[2]
    x = vectordedup.directions(vectordedup.Projections(n_projections=40), 16)
    assert x.shape == (16, 40) and np.allclose(x[:, :16].T @ x[:, :16], np.eye(16))


# --- 12


def slow_audit(rows, min_docs, most):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        total = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:most]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("broadcast", [8 << 20, 0])
def test_audit_against_brute_force(spark, broadcast):
    rng = random.Random(3)
    words = ["Alpha", "alpha", "BETA", "ünder", "Ünder", "straße", "don", "t", "x", "Ω", "ω", "日本", "é", "emoji😀", "zeta", "", "\U00010000"]
    rows = [(rng.choice([" ", "-", "1", "\n", "\x00"]).join(rng.choices(words, [17 - k for k in range(17)], k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None])) for _ in range(150)]
    rows += [(None, "en", "a"), ("", "xx", "only"), ("Alpha", "yy", "one"), ("Alpha", "yy", "two")] + [rows[0]] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS v", "4 AS p", "'q' AS q")
    got = [tuple(r) for r in sourceaudit.source_audit(df, min_docs=10, most_terms=4, broadcast_bytes=broadcast).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_audit(rows, 10, 4)
    assert {("yy", "one", "pair", "two", 0, 1)} <= set(got)


def test_shares_are_exact(spark):
    n, total, v = 10**13 + 7, 10**15 + 3, 12_345_678
    got = spark.range(1).select(sourceaudit.share(*(sourceaudit.F.lit(x).cast("long") for x in (n, total, v)))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_no_documents_no_audit(spark):
    assert sourceaudit.source_audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


# --- 13

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double"


def slow_pairs(items, lines, k=10):
    def cents(x):
        return None if x is None or not math.isfinite(x) or abs(100 * x + 0.5) >= 2**60 else math.floor(100 * x + 0.5)

    priced = []
    for sale, number, item, q, amount in lines:
        if None not in (sale, item, q, cents(amount)) and q:
            text = f"{sale},{'' if number is None else number},{item}"
            priced.append(((2 * cents(amount) + q) // (2 * q), sale, number, item, zlib.crc32(text.encode())))
    out = Counter()
    for item, price in items:
        p, found = cents(price), []
        if p is not None and item is not None:
            found = [(abs(u - p), u, s, n is not None, n, x, c) for u, s, n, x, c in priced if x != item and (abs(u - p) <= 50 or 1000 * abs(u - p) <= 5 * min(u, p))]
        found.sort(key=lambda r: (*r[:4], r[4] or 0, r[5]))
        sums = (len(found), sum(r[0] for r in found), sum(r[6] for r in found))
        for rank, (gap, u, s, _, n, x, _) in enumerate(found[:k], 1):
            out[(item, rank, gap, u, s, n, x, *sums)] += 1
        if not found:
            out[(item, 0, None, None, None, None, None, 0, 0, 0)] += 1
    return out


@pytest.mark.parametrize(("seed", "settings"), [(1, {}), (2, {"range_prices": 5, "fold_rows": 1}), (3, {"range_prices": 1, "k": 2}), (4, {"range_prices": 7, "most_ranges": 3, "k": 1})])
def test_pairs_against_brute_force(spark, seed, settings):
    rng = random.Random(seed)
    top = [3, 40, 400, 400_00][seed - 1]
    lines = []
    for _ in range(900):
        item = 0 if rng.random() < 0.4 else rng.randrange(12)
        price = 2.5 if rng.random() < 0.3 else rng.uniform(0.01, top)
        q = rng.randint(1, 4)
        row = (rng.randrange(40), rng.choice([1, 2, 3, None]), item, q, round(price * q, 2) if rng.random() < 0.9 else price * q)
        lines += [row] * rng.choice([1, 1, 1, 3])
    lines += [(None, 1, 1, 1, 2.5), (1, 1, None, 1, 2.5), (1, 1, 1, None, 2.5), (1, 1, 1, 0, 2.5), (1, 1, 1, 1, None), (1, 1, 1, 1, float("nan")), (1, 1, 1, 1, float("inf")), (1, 1, 1, -2, -5.01), (1, 2, 3, 1, -2.5), (1, 2, 3, 1, 1e30)]
    items = [(k, rng.choice([2.5, round(rng.uniform(0.01, top), 2), rng.uniform(0.01, top)])) for k in range(14)] + [(0, 2.5), (0, 2.5), (1, None), (None, 2.5), (99, 1e12), (98, -2.5), (97, float("nan")), (96, 0.0)]
    left = spark.createDataFrame(items, "item_id long, price double").selectExpr("*", "1 AS p", "2 AS part", "'x' AS u")
    right = spark.createDataFrame(lines, LINES).selectExpr("*", "1 AS p", "2 AS u", "3 AS crc", "4 AS cents").repartition(3)
    got = Counter(tuple(r) for r in bandjoin.band_join(left, right, **settings).collect())
    assert got == slow_pairs(items, lines, settings.get("k", 10))


def test_empty_sides(spark):
    items, lines = spark.createDataFrame([(1, 2.0)], "item_id long, price double"), spark.createDataFrame([], LINES)
    assert [tuple(r) for r in bandjoin.band_join(items, lines).collect()] == [(1, 0, None, None, None, None, None, 0, 0, 0)]
    assert bandjoin.band_join(items.limit(0), lines).collect() == []


def test_first_lines_hold_those_of_all_other_items():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, k = 200, 3
        u, sale, line, item = (rng.integers(0, m, n) for m in (4, 9, 3, 3))
        at = bandjoin.first_lines(u, sale, line, item, k)
        assert all(np.sum(u[at] == x) <= 2 * k for x in range(4))
        order = np.lexsort((item, line, sale, u))
        for own in range(3):
            for x in range(4):
                want = [tuple(y[j] for y in (sale, line, item)) for j in order if u[j] == x and item[j] != own][:k]
                assert [tuple(y[j] for y in (sale, line, item)) for j in at if u[j] == x and item[j] != own][:k] == want
