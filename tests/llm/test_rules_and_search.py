"""Rule ensemble by held-out accuracy, KD-tree search by brute force."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import kdtree, rules

DOCS = "doc_id long, text string, score string, source string, m map<string,int>"


def docs_and_labels(spark, n=900, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "and", "stone", "river", "light", "under", "cloud", "seven", "paper"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(8, 80))]
        good = rng.random() < 0.8
        if not good:
            w = rng.choice([[x + "###" for x in w], [x.upper() + "!!" for x in w], [w[0]] * len(w)])
        docs.append((i, " ".join(w), "x", "s", {"a": 1}))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_rules_predict_held_out_rows(spark):
    docs, labels, known = docs_and_labels(spark)
    model = rules.fit(docs, labels, trees=8)
    assert 0 < len(model.rules) < 100 and all(1 <= len(r) <= 2 * rules.TREE_DEPTH for r, _ in model.rules)
    odd = spark.createDataFrame([(5000, None, "x", "s", None), (5001, "", "x", "s", None), (None, "a b", "x", "s", None),
                                 (5002, "the stone " * 50_000, "x", "s", None), (5002, "dup", "x", None, None)], DOCS)
    out = rules.score(docs.unionByName(odd), model)
    assert out.columns == ["doc_id", "text", "source", "m", "held_out", "score", "predicted"]
    rows = out.collect()
    truth = {i: q for i, q, _ in known}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows) and len(rows) == 905
    kept = rules.keep(docs, model)
    assert kept.columns == docs.columns


def test_held_out_labels_do_not_matter(spark):
    docs, labels, known = docs_and_labels(spark, 300, 2)
    flipped = labels.withColumn("quality", F.when(rules.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert rules.fit(docs, labels, trees=4) == rules.fit(docs, flipped, trees=4)


def test_compiled_rules_equal_plain_evaluation(spark):
    docs, labels, _ = docs_and_labels(spark, 200, 3)
    model = rules.RuleModel(0.3, [((("marks", True, 0.1), ("log_words", False, 2.0)), 1.5), ((("upper", False, 0.5),), -2.0)])
    rows = rules.with_statistics(docs).withColumn("got", model.score()).collect()
    for r in rows:
        z = 0.3 + 1.5 * (r["_s_marks"] <= 0.1 and r["_s_log_words"] > 2.0) - 2.0 * (r["_s_upper"] > 0.5)
        assert r.got == pytest.approx(1 / (1 + math.exp(-z)))


def test_one_kind_of_label_and_none(spark):
    docs, labels, _ = docs_and_labels(spark, 60, 4)
    ones = labels.withColumn("quality", F.lit(1))
    assert rules.score(docs, rules.fit(docs, ones)).filter("predicted = 1").count() == 60
    zeros = labels.withColumn("quality", F.lit(0))
    assert rules.score(docs, rules.fit(docs, zeros)).filter("predicted = 1").count() == 0
    none = labels.filter("false")
    assert rules.score(docs, rules.fit(docs, none)).filter("predicted = 1").count() == 60
    assert rules.score(docs.filter("false"), rules.fit(docs.filter("false"), labels)).count() == 0


VECTORS = "vec_id long, embedding array<float>, score long, row string"


def brute(rows, k, asked):
    q = [(n, i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for n, (i, v, *_) in enumerate(rows)
         if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, a in q:
        if asked(i):
            found = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, j, b in q if m != n and len(a) == len(b))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    same = rng.normal(size=6).round(2)
    rows = [(int(i), (same if rng.random() < 0.3 else rng.normal(size=6)).tolist(), 1, "r") for i in rng.permutation(300)]
    rows += [(300, None, 1, "r"), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "r"), (302, [float("nan")] * 6, 1, "r"),
             (303, [float("inf")] * 6, 1, "r"), (None, [1.0] * 6, 1, "r"), (310, [1.0, 2.0], 1, "r"), (311, [3.0, 1.0], 1, "r"),
             (320, [], 1, "r"), (330, [5.0, 5.0, 5.0], 1, "r")] + [(10, same.tolist(), 1, "r"), (10, same.tolist(), 1, "r")]
    df = spark.createDataFrame(rows, VECTORS)
    out = kdtree.top_k(df, F.col("vec_id") % 10 == 0, k=4, shard_rows=30, cells=8)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute(rows, 4, lambda i: i % 10 == 0)


def test_top_k_large_numbers_and_no_rows(spark):
    # beyond 2^53, where doubles are no longer exact
    rows = [(1, [1.0e5, 2.0e9], 1, "r"), (2, [-1.0e7, 5.0], 1, "r"), (3, [-1.0e7, 5.5], 1, "r")]
    df = spark.createDataFrame(rows, VECTORS)
    out = kdtree.top_k(df, F.col("vec_id") == 1)
    assert sorted(map(tuple, out.collect())) == brute(rows, 5, lambda i: i == 1)
    assert kdtree.top_k(df.filter("false"), F.lit(True)).collect() == []


def test_cells_rule_out_shards(spark):
    """Clustered vectors: a query reaches the cells near its own only, and
    nothing of the answer is lost; every vector is in a cell and its box."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(16, 8)) * 4
    rows = [(i, (centres[i % 16] + rng.normal(size=8) * 0.1).tolist(), 1, "r") for i in range(1600)]
    df = spark.createDataFrame(rows, VECTORS)
    out = kdtree.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=100)
    assert sorted(map(tuple, out.collect())) == brute(rows, 5, lambda i: i % 50 == 0)

    codes = kdtree.quantised(df)
    cells = kdtree._cut(codes, 100, 4096)
    placed = kdtree._placed(codes, cells)
    found = {b["cell"]: b for b in kdtree._boxes(placed).collect()}
    assert sum(b["n"] for b in found.values()) == 1600 and len(found) == 16
    whole = np.floor(np.array([r[1] for r in rows]) * 256).astype(np.int64)
    of = cells[8].of(whole)
    for cell, box in found.items():
        lo, hi = (np.frombuffer(bytes(box[c]), dtype="<i8") for c in ("lo", "hi"))
        assert (whole[of == cell].min(axis=0) == lo).all() and (whole[of == cell].max(axis=0) == hi).all()
    own = [found[c] for c in sorted(found)]
    ends = [np.array([np.frombuffer(bytes(b[c]), dtype="<i8") for b in own]) for c in ("lo", "hi")]
    boxes = {8: (np.array(sorted(found), dtype=np.int32), *ends)}
    scores = whole @ whole.T
    np.fill_diagonal(scores, np.iinfo(np.int64).min)
    at = np.arange(0, 1600, 50)
    queries = placed.filter(F.col("vec_id") % 50 == 0).select(
        "row", "vec_id", "dim", "code", F.lit(0).cast("bigint").alias("home"), F.lit(None).cast("bigint").alias("_score"),
        F.lit(None).cast("bigint").alias("_minus"))
    kth = spark.createDataFrame([(int(i), int(np.sort(scores[i])[-5])) for i in at], "vec_id bigint, fifth bigint")
    queries = queries.join(kth, "vec_id").withColumn("_score", F.col("fifth")).select(*queries.columns)
    reached = {r["vec_id"]: set(r["cells"]) for r in kdtree._reached(queries, boxes).collect()}
    assert sum(map(len, reached.values())) < len(at) * 16 / 2
    for i in at:
        assert {int(c) for c in of[scores[i] >= np.sort(scores[i])[-5]]} <= reached[i]


def test_box_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (500, 7))
    tree = kdtree.Tree(np.arange(500), np.arange(500), v, leaf_rows=16)
    q = rng.integers(-50, 50, (20, 7))
    bounds = tree.bounds(q)
    for node, (a, b) in enumerate(tree.spans):
        assert (tree.vectors[a:b] @ q.T <= bounds[node]).all()
