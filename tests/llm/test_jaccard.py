import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecscore.llm import graph, jaccard as J
from vecscore.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, node string, label int, n_shingles string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def sets(rows, words):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    return out


def brute(rows, words=4, percent=85):
    s = sets(rows, words)
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    post = defaultdict(list)
    for i in sorted(s):
        for j, n in Counter(j for x in s[i] for j in post[x]).items():
            if 100 * n >= percent * (len(s[i]) + len(s[j]) - n):
                up[root(i)] = root(j)
        for x in s[i]:
            post[x].append(i)
    low = {}
    for i in s:
        low[root(i)] = min(low.get(root(i), i), i)
    return {i: (len(s[i]), low[root(i)]) for i in s}


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(45)]
    rows, i = [], 0
    while i < n:
        size = r.choice([1, 2, 3, 5, 8, 12, 20, 60, 150, 400])
        w = [word() for _ in range(size)]
        if r.random() < 0.4:
            w = passage + w
        for _ in range(r.choice([1, 1, 2, 6])):
            v = list(w)
            for _ in range(r.choice([0, 0, 1, max(1, len(v) // 60), max(1, len(v) // 30)])):
                v[r.randrange(len(v))] = word()
            if r.random() < 0.3:
                v = v + [word()]
            rows.append((i, " ".join(v).upper() if r.random() < 0.1 else " \t".join(v)))
            i += 1
    return rows


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed, words, percent", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_like_brute_force(spark, seed, words, percent):
    rows = corpus(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two")]
    assert got(J.join(docs(spark, rows), words, percent)) == brute(rows, words, percent)


@pytest.mark.parametrize("few, rounds, sample", [(1, 1, 256), (0, 0, 40)])
def test_common_subsets_and_almost_linked_groups(spark, monkeypatch, few, rounds, sample):
    """Every path: subsets common to unlike documents, the further levels, groups compared to the end."""
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "SAMPLE", sample)
    monkeypatch.setattr(J, "SMALL", sample)
    ended = []
    finish = J.Merger.finish
    monkeypatch.setattr(J.Merger, "finish", lambda self, left, bands: (ended.append(1), finish(self, left, bands)))
    r = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(60):  # each pair is close to the threshold, some above
        v = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            v[r.randrange(len(v))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    short = " ".join(f"c{k}" for k in range(14))
    rows += [(100 + i, f"{short} {' '.join(f'z{i}{k}' for k in range(i % 5))}") for i in range(40)]
    assert got(J.join(docs(spark, rows))) == brute(rows)
    assert ended or rounds  # with no round at all, the end is reached


def test_levels_lose_no_link():
    """At each level a linked pair shares hashes in more segments than either has to spare, or one has too few that tell anything."""
    r = np.random.default_rng(4)
    bands = J.Bands(80)
    for n in (8, 20, 60, 150, 700):
        for _ in range(20):
            x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            g = next(bands.of(len(x)))
            away = int(r.integers(0, bands.differ[g] + 1))
            y = np.sort(np.concatenate((x[away // 2 :], r.integers(0, 2**63, away - away // 2, dtype=np.uint64))))
            if not (bands.lo[g] <= len(y) <= bands.partner[g]):
                continue
            for level in (0, 1):
                (sx, hx, ox), (sy, hy, oy) = (J.level_hashes(t, bands, g, level) for t in (x, y))
                met = set(ox[np.isin(hx, hy)].tolist())
                assert len(met) > max(sx, sy) or sx < 0 or sy < 0, (n, level)


def test_differences_from_any_base_lose_no_link():
    """Linked sets share one of their first differences, or both link with the member of least cost."""
    r = np.random.default_rng(9)
    bands = J.Bands(85)
    linked = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    shared = alone = 0
    for _ in range(200):
        full = set(range(100))
        base = full - set(r.choice(100, int(r.integers(0, 30)), replace=False).tolist())
        group = []
        for i in range(12):
            gone = r.choice(100, int(r.integers(0, 9)), replace=False).tolist()
            group.append((full - set(gone)) | {1000 + int(x) for x in r.choice(40, int(r.integers(0, 9)), replace=False)})
        cost = [2 * 85 * len(x - base) + 200 * len(base - x) for x in group]
        least = group[int(np.argmin(cost))]
        for x in group:
            for y in group:
                if linked(x, y):
                    g = max(k for k in range(len(bands.lo)) if bands.lo[k] <= min(len(x), len(y)))
                    first = [set(sorted(z ^ base)[: bands.differ[g] + 1]) for z in (x, y)]
                    shared += bool(first[0] & first[1])
                    if not first[0] & first[1]:
                        alone += 1
                        assert linked(x, least) and linked(y, least)
    assert shared and alone


def test_groups_in_a_task():
    h = np.repeat(np.array([5, 9, 7], np.uint64), [20, 3, 8])
    n = np.arange(31, dtype=np.uint64)[::-1].copy()
    stay, centres, (own, to) = J.gathered(h, n)
    assert sorted(h[stay]) == [9, 9, 9] and sorted(zip(h[centres], n[centres])) == [(5, 11), (7, 0)]
    assert len(own) == 28 and set(zip(h[own], n[to])) == {(5, 11), (7, 0)}
    assert [len(x) for x in J.gathered(h[:0], n[:0])[:2]] == [0, 0]
    # What a range sees of a group that tasks joined goes on with all members, its centre too.
    x, centre, hash_, member = J.star(np.array([5, 5, 9, 9], np.uint64), np.array([3, 11, 1, 2]), np.array([5], np.uint64))
    assert list(zip(x, centre)) == [(2, 1), (11, 3)] and sorted(zip(hash_, member)) == [(5, 3), (5, 11)]


def test_a_text_and_a_subset_that_most_rows_share(spark, monkeypatch):
    """Hot keys are dealt over parts; ids may be texts; texts of equal hash are told apart."""
    from vecscore.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    monkeypatch.setattr(J, "ONE_TASK", 0)
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    monkeypatch.setattr(J, "_first_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    t = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(t)) for i in range(40)] + [(100 + i, " ".join(t[:i] + [f"x{i}"] + t[i + 1 :])) for i in range(40)] + [(200 + i, " ".join(t[:20] + [f"y{i}{k}" for k in range(40)])) for i in range(20)]
    want = brute(rows)
    assert got(J.join(docs(spark, rows))) == want
    named = spark.createDataFrame([(f"id{i:04}", t) for i, t in rows], "doc_id string, text string")
    assert got(J.join(named)) == {f"id{i:04}": (n, f"id{c:04}") for i, (n, c) in want.items()}


def test_kept_rows_are_the_same_in_every_layout(spark):
    t = " ".join(f"w{k}" for k in range(30))
    rows = [(1, t, f"s{k}", k) for k in range(6)] + [(1, t + " z", "s", 9), (2, "", "a", 1), (2, "", "b", 2)]
    schema = "doc_id bigint, text string, _row string, _tie int"
    d = spark.createDataFrame(rows, schema)
    kept = [sorted(map(tuple, J.keep_first(d.repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 3 and kept[0][1:] == [(2, "", "a", 1), (2, "", "b", 2)]


def test_rows(spark):
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(5, t), (5, t), (None, t), (7, t + " x"), (None, "alone here"), (9, None), (9, None)]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(docs(spark, rows)).collect()), key=str)
    assert out == sorted([(5, 37, 5), (5, 37, 5), (None, 37, 5), (7, 38, 5), (None, 1, None), (9, 0, 9), (9, 0, 9)], key=str)
    kept = J.keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, t), (None, "alone here"), (9, None), (9, None)], key=str)
    assert J.join(docs(spark, [])).collect() == [] and J.keep_first(docs(spark, [])).collect() == []


def test_groups_are_components_not_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "pqr")
    rows = [(5, one), (6, one + " x"), (5, two), (7, two + " x"), (None, three), (None, three + " x")]
    kept = sorted((str(r.doc_id), r.text[0]) for r in J.keep_first(docs(spark, rows)).collect())
    assert kept == [("5", "p"), ("5", "q"), ("None", "r")]


def test_bands_cover_all_pairs():
    for percent in (80, 85):
        b = J.Bands(percent)
        for n in list(range(1, 300)) + [1000, 50_000]:
            for m in range(n, n * 100 // percent + 1, max(1, n // 40)):
                both = set(b.of(n)) & set(b.of(m))
                assert both
                differ = max(d for d in range(n + m + 1) if (100 + percent) * d <= (100 - percent) * (n + m))
                assert max(b.differ[g] for g in both) >= differ


def test_parities_never_overstate():
    r = np.random.default_rng(1)
    for n, m, same in ((10, 10, 9), (500, 480, 450), (700, 300, 100), (5, 4000, 3)):
        x = np.unique(r.integers(0, 2**63, n + m, dtype=np.uint64))
        p, q = np.sort(x[:n]), np.sort(np.concatenate((x[:same], x[n : n + m - same])))
        both = [pa.array([J.parity(x), J.parity(p)], pa.binary()) for x in (p, q)]
        assert J.differ(both[0], pa.array([J.parity(q), J.parity(p)], pa.binary())).tolist()[1] == 0
        assert (J.differ(*both) <= len(np.setxor1d(p, q))).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    scratch = Scratch(spark)
    out = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert out == {**dict.fromkeys(range(31), 0), 100: 0, 200: 200, 201: 200, 202: 200}
    scratch.close()


def test_bitmaps_hold_all_hashes_and_few_others(spark, monkeypatch):
    """Common hashes reach the tasks as a bitmap of bounded size, not as a row for each member of each group."""
    r = np.random.default_rng(1)
    own, other = (r.integers(-(1 << 63), 1 << 63, 5000) for _ in range(2))
    table = spark.createDataFrame([(int(h),) for h in own], "hash long")
    bits = J._bitmap(table, 5000)
    assert J._in_bitmap(bits, own).all() and J._in_bitmap(bits, other).mean() < 0.1
    rows = spark.createDataFrame([(int(h), i) for i, h in enumerate([*own[:50], *other[:50]])], "hash long, node long")
    kept = {x.node for x in J._those_in(rows, bits).collect()}
    assert kept >= set(range(50)) and len(kept) < 70
    assert {(x.node, x.g) for x in J._members(rows, bits).collect()} >= {(i, int(h) & 255) for i, h in enumerate(own[:50])}
    monkeypatch.setattr(J, "PARTS", 1)  # a bitmap that is too small tells less, and loses none
    assert J._in_bitmap(J._bitmap(table, 1 << 40), own).all() and not J._in_bitmap(J._bitmap(table.limit(0), 0), own).any()
