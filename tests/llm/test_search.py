"""The trie and the two searches against brute force, and sketches merged in two levels."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import conversation_trie, exact_search, lexical_search, ngram_join, shared, substring_dedup

TURNS = "conv_id long, turn long, role string, text string, depth string, n_convs string"


def brute_trie(rows, family):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest())
    convs = {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in convs.items()}
    if family:
        h = lambda c: zlib.crc32(str(c).encode()) % 4
        origin = lambda c: c - int(math.fmod(c, family))
        convs = {c: convs.get(origin(c), [])[: h(c)] + ts[h(c) :] for c, ts in convs.items()}
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = {}
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in members if len(n) == len(node) + 1 and n[:-1] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(own), len(node)] = (parent, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def collected_trie(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("family,piece", [(20, 512), (None, 3)])
def test_trie_against_brute_force(spark, monkeypatch, family, piece):
    monkeypatch.setattr(conversation_trie, "PIECE_TURNS", piece)
    monkeypatch.setattr(conversation_trie, "PIECE_IDS_LOG2", 1)
    rng = random.Random(3)
    rows = [(None, 0, "user", "of none", "x", "y"), (-3, None, None, None, "x", "y"), (-3, 1, "user", "a", "x", "y"), (-40, 2, "user", "b c", "x", "y")]
    for c in range(60):
        rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", "c", "", None]), "x", "y") for k in range(rng.choice([1, 1, 2, 3, 5, 9]))]
    rows += [(c, k, "user", f"line {k % 7}", "x", "y") for c in (100, 101, 120) for k in range(37 - (c == 101))]  # long chains
    rows += [(7, 0, "user", "twice", "x", "y")] * 2 + [(c, 0, "user", "same", "x", "y") for c in range(200, 230)]
    df = spark.createDataFrame(rows, TURNS)
    assert collected_trie(conversation_trie.conversation_trie(df, family)) == brute_trie(rows, family)


def test_trie_of_nothing(spark):
    assert conversation_trie.conversation_trie(spark.createDataFrame([], TURNS), 20).collect() == []
    none = spark.createDataFrame([(None, 1, "user", "a", "", "")], TURNS)
    assert conversation_trie.conversation_trie(none).collect() == []


def test_contraction_of_chains_combs_and_stars(spark):
    rng = np.random.default_rng(5)
    parents = {(0, 0): None}
    for k in range(1, 41):  # a chain with a comb of leaves on every third node
        parents[0, k] = (0, k - 1)
        if k % 3 == 0:
            parents[k, k] = (0, k - 1)
    for k in range(100, 160):  # a star
        parents[k, 1] = (0, 0)
    for k in range(200, 230):  # a random tree
        up = list(parents)[rng.integers(len(parents))]
        parents[k, up[1] + 1] = up
    kids = {n: sum(p == n for p in parents.values()) for n in parents}
    value = {n: int(rng.integers(0, 100)) for n in parents}
    rows = [(n[0], n[1], p and p[0], kids[n], value[n], int(kids[n] == 0)) for n, p in parents.items()]
    nodes = spark.createDataFrame(rows, "conv_id long, depth int, parent_conv_id long, n_children long, v long, leaf long")
    want = {n: [0, 0] for n in parents}
    for n in parents:
        at = n
        while at is not None:
            want[at][0] += value[n]
            want[at][1] += kids[n] == 0
            at = parents[at]
    got = {(r["conv_id"], r["depth"]): [r["v"], r["leaf"]] for r in conversation_trie.subtree_sums(nodes, ["v", "leaf"]).collect()}
    assert got == want


def brute_ranked(docs, items, k):
    low = lambda t: lexical_search.terms_of((t or "").encode())
    held = [(i, low(t)) for i, t in docs if i is not None and low(t)]
    total = sum(len(w) for _, w in held)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(low(t))
    out = {}
    for item, terms in asked.items():
        rows = []
        for doc, own in held:
            m, score = 100 - 90 + (90 * len(own) * len(held)) // total, 0
            for t in terms:
                tf, df = own.count(t), sum(t in w for _, w in held)
                if tf:
                    score += math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                rows.append((-score, doc))
        out[item] = [(n + 1, doc, -score) for n, (score, doc) in enumerate(sorted(rows)[:k])]
    return {i: r for i, r in out.items() if r}


@pytest.mark.parametrize("limits", [(16_384, 2_000_000, 8 << 20, 16_384, 1024), (7, 40, 150, 8, 1)])
def test_ranked_search_against_brute_force(spark, monkeypatch, limits):
    for name, v in zip(("TREAP_DOCS", "TREAP_CELLS", "ITEM_BYTES", "STEP_CELLS", "MANY_TERMS"), limits):
        monkeypatch.setattr(lexical_search, name, v)
    rng = np.random.default_rng(8)
    word = lambda n: [f"W{v}" if v % 3 else f"é{v}É" for v in np.minimum(rng.geometric(0.06, n), 60)]
    texts = [" ".join(word(rng.integers(1, 40))) for _ in range(60)] + [None, "", "...", "w1,w2;W1 w4"] + ["same W5 W50 copy"] * 30 + [" ".join(word(4000))]
    docs = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts)] + [(None, "W50 W51"), (3, "W50 W1"), (3, "W50 W1")]
    items = [(k, " ".join(word(n))) for k, n in enumerate((1, 5, 12, 30))] + [(9, None), (10, ""), (11, "nowhere"), (None, "W1"), (12, "same copy"), (12, "W50"), (13, "W50 W50 w50")]
    found = lexical_search.ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3),
        spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")),
        k=6,
        item_bytes=limits[2],
    )
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert got == brute_ranked(docs, items, 6)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    assert lexical_search.ranked_search(docs.where("false"), items).collect() == []
    assert lexical_search.ranked_search(docs, items.where("false")).collect() == []


def brute_products(rows, asked, k):
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 2**22 for x in v)}
    queries = {}
    for i, v in sorted(fine):
        if i % asked == 0:
            queries.setdefault((i, len(v)), v)
    out = {}
    for (i, n), q in queries.items():
        out.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == n)
    return {i: [(n + 1, j, -s) for n, (s, j) in enumerate(sorted(r)[:k])] for i, r in out.items() if r}


@pytest.mark.parametrize("shape,shard_rows", [("even", 30), ("steep", 30), ("copies", 10_000), ("few", 10_000)])
def test_largest_products_against_brute_force(spark, monkeypatch, shape, shard_rows):
    for name, v in (("HEAD_ROWS", 20), ("BLOCK_QUERIES", 7), ("RUN_ROWS", 16), ("STEP_PAIRS", 64)):
        monkeypatch.setattr(exact_search, name, v)
    rng = np.random.default_rng(4)
    dim = 9
    x = rng.normal(size=(200, dim)) @ np.diag(np.geomspace(1, 0.01, dim))
    if shape == "steep":
        x *= np.exp(rng.normal(size=(200, 1)) * 2)
    if shape == "copies":
        x[50:150] = x[7]
    x = x[:4] if shape == "few" else x
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(500, None), (505, []), (510, [0.0] * dim), (515, [None] * dim), (520, [float("nan")] * dim), (525, [float("inf")] * dim), (530, [1e300] * dim), (None, [1.0] * dim)]
    rows += [(k, rng.normal(size=3).tolist()) for k in range(600, 620)] + [rows[0]] * 8 + [(10, (-x[3]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit("x"))
    got = {}
    for r in sorted(exact_search.largest_products(df, F.col("vec_id") % 5 == 0, shard_rows=shard_rows).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == brute_products(rows, 5, 5)
    assert exact_search.largest_products(df.where("false"), F.col("vec_id") % 5 == 0).collect() == []


def test_bounds_rule_out_pairs_but_lose_none():
    rng = np.random.default_rng(2)
    numbers = np.floor(256 * rng.normal(size=(400, 16)) * np.geomspace(1, 0.02, 16)).astype(np.int64)
    numbers = numbers[np.argsort(-np.square(numbers).sum(axis=1))]
    turn = np.ascontiguousarray(np.linalg.eigh((numbers.T @ numbers).astype(float))[1][:, ::-1])
    shard = exact_search.Shard(numbers.astype("<i4").tobytes(), np.arange(400, dtype="<i8").tobytes(), np.ones(400, dtype="<i4").tobytes(), turn)
    i, ids, scores = shard.search(np.arange(40), numbers[:40], np.full(40, exact_search.NO_BAR), 3)
    full = numbers[:40] @ numbers.T
    full[np.arange(40), np.arange(40)] = exact_search.NO_BAR
    assert sorted(zip(i.tolist(), scores.tolist())) == sorted((q, s) for q in range(40) for s in np.sort(full[q])[-3:].tolist())


@pytest.mark.parametrize("merged", [1, 256])
def test_sketches_merge_in_one_level_or_two(spark, monkeypatch, merged):
    for module in (substring_dedup, ngram_join):
        monkeypatch.setattr(module, "MERGED_SKETCHES", merged)
    rng = np.random.default_rng(merged)
    base = [f"w{v}" for v in rng.integers(0, 4000, 60)]
    texts = [" ".join(base), " ".join(base[10:50]), " ".join(f"v{v}" for v in rng.integers(0, 4000, 90)), " ".join(base)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs, sketches=6).collect()}
    assert cut == {k: 0 if k in (0, 2) else len(t.split()) for k, t in enumerate(texts)}
    linked = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, sketches=6).collect()}
    assert linked == {k: (0, 1, 2, 0)[k % 4] for k in range(12)}


def test_sketch_tasks_follow_the_text(spark):
    few = 8 * spark.sparkContext.defaultParallelism
    assert shared.sketch_tasks(spark, 0) == few and shared.sketch_tasks(spark, 1000 << 30) == 1000
