"""SimHash components, hard negatives, spelling variants: brute force and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import hard_negatives, simhash, spelling

# SimHash.


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def sets_by_hand(items, linked):
    """For each item the smallest index that links reach."""
    root = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def gray_by_hand(p):
    rank = 0
    while p:
        rank, p = rank ^ p, p >> 1
    return rank


def near_prints(n, seed):
    """Random fingerprints, with chains and dense groups of neighbours."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    centre = rng.getrandbits(64)
    return list(dict.fromkeys([*out, *(centre ^ 1 << b for b in range(40)), 0, 3, (1 << 64) - 1]))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 300])
def test_gray_tree_finds_all_neighbours(n):
    prints = near_prints(n, n)
    prints.sort(key=gray_by_hand)
    array = np.array(prints, np.uint64)
    got = {(int(a), int(b)) for q, leaf in simhash.GrayTree(array).near(array, after=np.arange(len(array))) for a, b in zip(q, leaf)}
    assert got == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2}


@pytest.mark.parametrize("block", [65_536, 64])
def test_links_join_what_brute_force_joins(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints = near_prints(300, 5)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at = {x: i for i, x in enumerate(signed)}
    root = list(range(len(signed)))
    for e in edges:
        a, b = sorted((root[at[e.a]], root[at[e.b]]))
        root = [a if r == b else r for r in root]
    assert root == sets_by_hand(prints, lambda x, y: (x ^ y).bit_count() <= 2)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ALPHA beta Gamma delta été über nation x".split(), k=rng.randint(0, 400))) for _ in range(120)]
    for t in texts[:60]:
        words = t.split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        texts.append("\t".join(words))
    texts += [None, "", "one", "one two", " ", "one"]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = [print_by_hand(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: 1000 - i)
    root = sets_by_hand([prints[i] for i in order], lambda x, y: (x ^ y).bit_count() <= 2)
    want = {1000 - i: (f"{prints[i]:016x}", 1000 - order[r]) for i, r in zip(order, root)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()} == want


def test_simhash_on_odd_rows(spark, odd_docs, no_docs):
    got = simhash.simhash_components(odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_docs.collect())
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 2, 4: 4, None: None, 5: 2, 6: 6, 7: 7}
    assert simhash.simhash_components(no_docs).count() == 0


# Hard negatives.


def negatives_by_hand(rows, is_anchor):
    """rows: id -> (label, whole numbers)."""
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    out = set()
    for a in filter(is_anchor, rows):
        same = sorted(((-score(a, x), x) for x in rows if x != a and rows[x][0] == rows[a][0]))[:5]
        for s, p in same:
            fit = sorted((-score(a, x), x) for x in rows if rows[x][0] != rows[a][0] and 50 * -s <= 100 * score(a, x) <= 95 * -s)[:3]
            out |= {(a, p, i + 1, x, -s, -t) for i, (t, x) in enumerate(fit)}
    return out


@pytest.mark.parametrize("bucket, block", [(4096, 4096), (7, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    rng = np.random.default_rng(bucket)
    rows = {}
    for i in range(260):
        size = [1, 0.2, 3][i % 3] if i % 5 else 0  # lengths that differ, and zero vectors
        v = rng.normal(size=4 if i % 11 else 3) * size
        rows[i] = (int(rng.integers(3)), v.tolist())
    for i in range(260, 400):  # copies of a few vectors, under several labels
        rows[i] = (int(rng.integers(3)), rows[i % 4 + 1][1])
    rows[400] = (9, [1.0, 0.0, 0.0, 0.0])  # alone under its label
    df = spark.createDataFrame([(i, v, k, "x") for i, (k, v) in rows.items()], "vec_id long, embedding array<double>, label int, score string")
    df = df.union(df.where("vec_id < 10"))
    got = {tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()}
    whole = {i: (k, [int(np.floor(256 * x)) for x in v]) for i, (k, v) in rows.items()}
    assert got == negatives_by_hand(whole, lambda i: i % 5 == 0)


def test_long_anchors_leave_short_buckets_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 50)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * (20 if i < 100 else 0.1)).tolist(), i % 2) for i in range(3000)]
    seen = []
    count = hard_negatives.search

    def spy(asked, windows, rows, bounds, k, same_label):
        last = hard_negatives.reach(bounds)
        found = count(asked, windows, rows, bounds, k, same_label)
        seen.append(found.groupBy("a", "lo", "hi").agg(F.min("score").alias("s")).join(asked, "a").agg(F.max(last("norm", F.col("s").cast("double")))).first()[0])
        return found

    monkeypatch.setattr(hard_negatives, "search", spy)
    got = {tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id").isin(0, 1, 2)).collect()}
    assert got == negatives_by_hand({i: (k, [int(np.floor(256 * x)) for x in v]) for i, v, k in rows}, lambda i: i < 3)
    assert seen[0] < 10  # of 60 buckets


def test_hard_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.0], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (None, [9.0, 9.0], 2), (7, [3.0, 3.0], None), (8, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "'x' as v", "'y' as a", "2 as windows")
    got = {tuple(r) for r in hard_negatives.hard_negatives(df.unionByName(df), F.lit(True)).collect()}
    assert got == {(0, 1, 1, 2, 327680, 196608), (1, 0, 1, 2, 327680, 196608)}
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


# Spelling variants.


def variants_by_hand(docs, noise):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def distance_one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if distance_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("letters, at_once, rows", [(2_000_000, 4, 65_536), (600, 2, 64)])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, letters, at_once, rows):
    for name, value in (("SHARD_LETTERS", letters), ("SHARDS_AT_ONCE", at_once), ("WALK_ROWS", rows), ("HELD_WORDS", 20 if rows == 64 else 10**6)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(11)
    base = ["nation", "nations", "aaaaaa", "aaaaaaa", "aaaaa", "abcabc", "Élève", "élève", "àéîõü", "xyzzy", "house", "mouse", "horse", "ÿÿÿÿÿ", "×÷ab×"]
    words = list(base)
    for _ in range(140):
        w = list(rng.choice(words))
        i, c = rng.randrange(len(w)), rng.choice("abcdé")
        w = [w[:i] + w[i + 1 :], w[:i] + [c] + w[i:], w[:i] + [c] + w[i + 1 :]][rng.randrange(3)]
        words.append("".join(w) or "a")
    weights = [1 / (1 + i % 17) ** 2 for i in range(len(words))]
    docs = [(d, rng.choice([" ", "-", "1", "\n"]).join(rng.choices(words, weights, k=60))) for d in range(60)]
    docs += [(60, None), (61, ""), (None, "house " * 5 + "houses houses houses"), (62, "q" * 20_000 + " " + "q" * 20_000 + "1" + "q" * 20_000 + " " + "q" * 19_999), (63, "q" * 19_999 + "_" + "q" * 19_999)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string").selectExpr("*", "1 as n", "2 as root", "3 as id")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, noise=7).collect()}
    assert got == variants_by_hand(docs, 7)


def test_spelling_on_empty_tables(spark, odd_docs, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    assert spelling.spelling_variants(odd_docs.where("doc_id = 2")).count() == 0
    assert spelling.spelling_variants(odd_docs, noise=97).columns == ["word", "form", "root", "n", "n_near", "form_n"]
