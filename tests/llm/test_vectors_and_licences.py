"""Whitening and hard negatives by brute force, licence scans by hand."""

import math

import numpy as np
import pytest

from mensura.llm import licences, negatives, whitening
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, dim string, code string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "d", "c", "r")
                                  for i, v, y in rows], VECTORS)


ODD = [(900, None, 1), (901, [1.0, None, 2.0, 0.5, 1.0], 1), (902, [1.0, math.nan, 2.0, 0.5, 1.0], 1),
       (903, [math.inf, 0.0, 2.0, 0.5, 1.0], 1)]


def brute_whitening(x, k=4):
    fit = np.unique(x, axis=0)
    n, centred = len(fit), fit - fit.mean(axis=0)
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, e, (x - fit.mean(axis=0)) @ q / np.sqrt(e), e / np.trace(v), ((n * x - fit.sum(axis=0)) ** 2).sum(axis=1)


def check_whitening(spark, rows, x, ids, k=4):
    out = whitening.whiten(frame(spark, rows)).toPandas()
    n, e, z, share, deviation = brute_whitening(x, k)
    assert len(out) == len(x) * k and set(out["component"]) == set(range(1, k + 1))
    assert (out["n"] == n).all() and (out["identity_error"] < 1e-9).all()
    for c in range(k):
        got = out[out["component"] == c + 1].sort_values(["vec_id", "deviation", "whitened"])
        want = sorted(zip(ids, deviation.tolist(), z[:, c]))
        np.testing.assert_allclose(got["eigenvalue"], e[c], rtol=1e-11)
        np.testing.assert_allclose(got["explained"], share[c], rtol=1e-11)
        assert got["vec_id"].tolist() == [w[0] for w in want] and got["deviation"].tolist() == [int(w[1]) for w in want]
        np.testing.assert_allclose(np.abs(got["whitened"]).sort_values(), np.sort(np.abs([w[2] for w in want])), atol=1e-8)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.standard_normal((300, 12)) * np.linspace(3, 0.5, 12)).astype("f4").astype(float))
    rows = [(i, v / 256, 0) for i, v in enumerate(x)]
    check_whitening(spark, rows + rows[:40] + ODD, np.vstack([x, x[:40]]), list(range(300)) + list(range(40)))


def test_whitening_finds_repeated_deviations(spark):
    # plus and minus axes: all deviations but the first two are equal, and one direction is empty
    axes = np.eye(8)[:7] * np.array([[40, 40, 9, 9, 9, 9, 9]]).T
    x = np.vstack([axes, -axes])
    out = whitening.whiten(frame(spark, [(i, v / 256, 0) for i, v in enumerate(x)])).toPandas()
    got = out.groupby("component")["eigenvalue"].first().to_numpy()
    np.testing.assert_allclose(got, np.array([1600, 1600, 81, 81]) * 2 / 14, rtol=1e-12)
    assert out["identity_error"].max() < 1e-12


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [], 0)])).count() == 0
    out = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0), (None, [3.0, 2.0], 0)])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 12), round(r.explained, 12)) for r in out) == [
        (i, 1, 2, 1.0, 1.0) for i in (0, 1, 2)]


def brute_negatives(rows, is_anchor):
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e], y) for i, e, y in rows if i is not None and y is not None
         and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, x, y) in enumerate(v):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, w)), j, b, z) for b, (j, w, z) in enumerate(v) if b != a and len(w) == len(x))
        for s, j, b, _ in [r for r in scored if r[3] == y][:5]:
            s = -s
            fit = [(-t, m) for t, m, _, z in scored if z != y and 50 * s <= -100 * t <= 95 * s]
            out += [(i, j, k + 1, m, s, t) for k, (t, m) in enumerate(fit[:3])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [7, 4096])
def test_hard_negatives_equal_brute_force(spark, shard_rows):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 20))
    rows = []
    for i in range(260):
        label = 0 if i % 3 == 0 else int(rng.integers(1, 9))  # a third of all rows have one label
        rows.append((i, (centres[i % 6] + 0.6 * rng.standard_normal(20)).astype("f4").tolist(), label))
    rows += [rows[0], rows[50], (10, [0.0] * 20, 3), (20, [1.0, 2.0], 1), (40, [2.0, 2.0], 2), (100, [], 1), (None, [1.0] * 20, 1),
             (901, [1.0] * 20, None)] + ODD
    out = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, shard_rows=shard_rows)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, ODD + [(0, [1.0], 1)]), F.col("vec_id") % 10 == 0).count() == 0


def test_intervals_hold_and_prune():
    import pandas as pd
    rng = np.random.default_rng(9)
    for dim in (1, 63, 64, 65, 200):
        centre = rng.standard_normal(dim)
        x = np.floor(256 * np.vstack([centre + 0.1 * rng.standard_normal((50, dim)), rng.standard_normal((300, dim)),
                                      np.zeros((1, dim))])).astype("<i8")
        bits, length, align = negatives.one_bit(x)
        shard = negatives.Shard(pd.DataFrame({
            "row": range(351), "vec_id": range(351), "label": 0, "dim": dim, "code": [r.tobytes() for r in x],
            "bits": [b.tobytes() for b in bits], "length": length, "align": align}))
        estimate, low, high = shard.intervals(x[:20])
        exact = x[:20] @ x.T
        assert (low <= exact).all() and (exact <= high).all() and (low <= estimate).all() and (estimate <= high).all()
        if dim == 200:  # what is far from a near neighbour goes by its interval alone
            assert (high[:, 50:350] < np.sort(exact, axis=1)[:, -5:-4]).mean() > 0.9


def words(text):
    out, word = [], ""
    for c in (text or "").translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})) + " ":
        if "0" <= c <= "9" or "a" <= c <= "z" or c >= "\x80":
            word += c
        else:
            out, word = out + ([word] if word else []), ""
    return out


def brute_licences(text):
    w = words(text)
    base, labels, score, places = [], set(), 0.0, 0
    for number in range(len(licences.BASE) + len(licences.TEMPLATES)):
        t = [r for r in licences.places(licences.TEMPLATES, licences.BASE) if r[0] == number]
        for start in range(-len(t), len(w)):
            there = [0 <= start + r[3] < len(w) and w[start + r[3]] == r[4] for r in t]
            if all(h for h, r in zip(there, t) if r[5]):
                places += 1
                labels.add(t[0][1])
                score = max(score, sum(there) / len(t))
                if t[0][2]:
                    base.append((start, t[0][1]))
    starts = [s for s, _ in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score, places)


TEXTS = [
    None, "", "  \n", "nothing here", "MIT License", "x mit\n--license, Mit LICENSE mit license.", "mit licenses", "smit license",
    "Licensed under CC BY-NC 4.0. Then CC BY, cc-by 4.0", "ccK by", "gnu general public", "GNU General Public License, version 3!",
    "this work is licensed under the GNU General Public License, version 30", "é mit license é", "mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of that software",
    "permission is hereby given, free of charge, to any person obtaining a copy of this software",
    "[Apache] \\License'; Version 2.0", "the " * 500 + "apache license " * 400 + "cc by",
    "redistribute it and/or modify it under the terms of the GNU General Public License",
]


def test_licences_equal_plain_reading(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(TEXTS + TEXTS[4:6])],
                                 "doc_id long, text string, marks string, row long")
    out = licences.scan(docs)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_places"]
    got = sorted(((r[0] or 0, *r[1:]) for r in out.collect()), key=str)
    assert got == sorted(((i, *brute_licences(t)) for i, t in enumerate(TEXTS + TEXTS[4:6])), key=str)
    assert licences.scan(docs.limit(0)).count() == 0


def test_licences_stay_native(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "MapInArrow" not in plan


def test_index_takes_the_rarest_words_of_key_phrases():
    rows = licences.places([("a", "some [very common rare word] here")])
    assert licences.rare_words(rows, {"very": 9, "common": 8, "rare": 1, "here": 0, "word": 1}, 2) == {0: ["rare", "word"]}
