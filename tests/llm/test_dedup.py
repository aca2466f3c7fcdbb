"""Exact and near copies against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from mensura.llm import forest, naming
from mensura.llm.common import keep_rows
from mensura.llm.graph import components

SCHEMA = "doc_id long, text string, key int, rank string, m map<string,int>"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", {"a": 1}) for i, t in rows], SCHEMA)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("bits", [64, 2])  # two bits: most keys clash, names must still tell blocks apart
def test_exact_groups_match_brute_force(spark, bits):
    rng = random.Random(bits)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = [(i, rng.choice(base)) for i in range(200)]
    rows += [(i, rng.choice(base).replace(" ", "\t ")) for i in range(200, 240)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, base[0]), (None, base[0]), (7, base[3]), (7, base[3])]
    out = naming.exact_groups(table(spark, rows), block_bytes=8, key_bits=bits).collect()
    want = brute_exact(rows)
    assert len(out) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in out:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in out) == len(want)


def test_exact_groups_long_texts_and_no_rows(spark):
    a = "x" * 100_000
    rows = [(1, a), (2, a[:-1] + "y"), (3, a), (4, "y" + a[1:]), (5, a + " ")]
    out = {r.doc_id: r for r in naming.exact_groups(table(spark, rows), block_bytes=64).collect()}
    assert {i: r.keep_id for i, r in out.items()} == {1: 5, 2: 2, 3: 5, 4: 4, 5: 5}
    assert naming.exact_groups(table(spark, [])).collect() == []


def test_keep_rows_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (None, "d")]
    docs = table(spark, rows)
    g = naming.exact_groups(docs)
    kept = keep_rows(docs, g.selectExpr("doc_id", "row_key", "int(kept) AS copies"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "d"), (1, "a b"), (3, "c")]


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_near(rows, n, least):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 40, 90, 300]))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = [x.upper() for x in w]
        rows.append((i * 3 % (n + 1 if (n + 1) % 3 else n + 2), " ".join(w)))
    return rows


@pytest.mark.parametrize("words,least", [(3, 85), (5, 80)])
def test_near_groups_match_brute_force(spark, words, least):
    rows = corpus(words, 400) + [(1001, None), (1002, ""), (1003, " \t"), (1004, "one"), (1005, "ONE"), (1006, "É"),
                                 (1007, "é")]
    out = forest.near_groups(table(spark, rows), words=words, least=least).collect()
    component, size = brute_near(rows, words, least)
    assert len(out) == len(rows)
    for r in out:
        assert (r.component_id, r.n_shingles) == (component[r.doc_id], size[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_one_large_group_and_small_regions(spark):
    """A chain of near copies far larger than a region, across many partitions."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"u{i}"] + base[60:])) for i in range(300)] + [(1000 + i, f"lone {i} x y") for i in range(50)]
    rng.shuffle(rows)
    docs = table(spark, rows)
    out = forest.near_groups(docs.repartition(20), region=8).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: 0 if i < 1000 else i for i, _ in rows}


def family(pages, planted, body=122, own=18, less=10):
    """Pages with a common body, at 0.77 to each other; the ``planted`` ones have less of their own and are at 0.857."""
    base = " ".join(f"b{i}" for i in range(body))
    return [(i, " ".join([base, *(f"u{i}x{k}" for k in range(less if i in planted else own))])) for i in range(pages)]


def test_links_in_a_large_family_below_the_threshold(spark):
    rows = family(2500, {600, 1900})
    out = forest.near_groups(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: 600 if i == 1900 else i for i, _ in rows}


def test_region_pairs_leave_room_for_chance(spark):
    """Two labels of a region, far apart, that agree in seven of ten values are a pair."""
    labels = [[1, 2, 3, 0, 0, 0, 9, 9, 9, 9], [1, 2, 3, 90, 90, 90, 9, 9, 9, 9]]
    labels += [[1, 2, 3, k] + [100 + k] * 6 for k in range(1, 20)]
    rows = [(i, 100, bytearray(np.array(x, dtype=">u2").tobytes()), i) for i, x in enumerate(labels)]
    pairs, left = forest.candidates(spark.createDataFrame(rows, "id long, n long, labels binary, part long"), trees=1)
    assert (0, 1) in {(r.a, r.b) for r in pairs.collect()} and left.isEmpty()


@pytest.mark.parametrize("held", [20, forest.HELD])
def test_long_runs_across_batches_and_partitions(spark, held):
    """Labels of one run, nearly all of one part: the others meet all of it, wherever batches and partitions end."""
    start = np.array([1, 2, 3], dtype=">u2").tobytes()
    rest = np.random.default_rng(0).integers(5, 9, (600, 1)).repeat(7, axis=1).astype(">u2")
    rows = [(i, 100, bytearray(start + rest[i].tobytes()), 7 if i % 200 else 1000 + i) for i in range(600)]
    sets = spark.createDataFrame(rows, "id long, n long, labels binary, part long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        pairs, left = forest.candidates(sets, trees=1, held=held)
        pairs, left = {(r.a, r.b) for r in pairs.collect()}, {r.id for r in left.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(min(a, b), max(a, b)) for a in (0, 200, 400) for b in range(600)
            if a != b and (rest[a] == rest[b]).all()}
    assert all((a, b) in pairs or {a, b} <= left for a, b in want)
    assert bool(left) == (held == 20)


@pytest.mark.parametrize("words,least", [(3, 85), (5, 80)])
def test_rarest_pairs_leave_no_link_out(spark, words, least):
    rows = corpus(words + 10, 240) + [(10_000 + i, t) for i, t in family(30, {3, 20})]
    sets = {i: shingles(t, words) for i, t in rows}
    part = {i: i % 50 for i in sets}
    left = spark.createDataFrame([(i, part[i]) for i in sets if sets[i]], "id long, part long")
    got = {(r.a, r.b): (r.pa, r.pb) for r in forest.rarest_pairs(table(spark, rows), left, words, least).collect()}
    assert all(a < b and parts == (part[a], part[b]) and parts[0] != parts[1] for (a, b), parts in got.items())
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and part[a] != part[b]
             and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    assert links and links <= set(got)


def test_near_groups_repeated_rows_and_no_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (9, "A B C D"), (9, "x y z"), (11, "x y z")]
    docs = table(spark, rows)
    g = forest.near_groups(docs)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in g.collect())
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (9, 5, False), (9, 9, True), (11, 9, False)]
    kept = keep_rows(docs, forest.one_of_each(g), once=True)
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "a b c d"), (5, "a b c d"), (9, "x y z")]
    assert forest.near_groups(table(spark, [])).collect() == []


def test_neighbours_of_different_parts():
    rng = np.random.default_rng(0)
    labels = np.array(sorted(map(tuple, rng.integers(0, 3, (80, 4)))), dtype=np.uint16)
    parts = rng.integers(0, 30, 80)
    zones = (np.arange(80) >= 40).astype(int)
    labels = np.concatenate([np.array(sorted(map(tuple, half))) for half in (labels[:40], labels[40:])])
    common = {(a, b) for a in range(80) for b in range(a + 1, 80)
              if zones[a] == zones[b] and (labels[a, :2] == labels[b, :2]).all() and parts[a] != parts[b]}
    i, j = forest.neighbours(zones, labels, parts, prefix=2, region=80)
    assert {(min(x), max(x)) for x in zip(i.tolist(), j.tolist())} == common
    i, j = forest.neighbours(zones, labels, parts, prefix=2, region=0)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in common if b == a + 1}
    i, j = forest.neighbours(zones, labels, parts, prefix=2, region=1, near=3)
    near = {(min(x), max(x)) for x in zip(i.tolist(), j.tolist())}
    assert {(a, b) for a, b in common if b - a <= 3} <= near <= common


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 3), (None, 4), (20, 19)] + [(100 + i, 101 + i) for i in range(60)] + [(160, 7)]
    out = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 19: 19, 20: 19, 7: 7} | {100 + i: 7 for i in range(61)}
    assert out == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_parities_rule_out_no_link_and_most_other_pairs(spark):
    """Sets differ in at most as many parity bits as shingles are in one of
    them only; pairs far from the similarity are gone before their sets move."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 40, 300, 5000)]
    for s in sets:
        for gone in (0, 1, len(s) // 12, len(s) // 3, len(s)):
            other = np.concatenate([s[gone:], rng.integers(0, 2**63, gone // 2).astype(np.uint64)])
            x, y = forest.parities([s, other]).view(np.uint64)
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(s, other))
    words = [f"w{i}" for i in range(300)]
    texts = {1: words, 2: words[:290] + ["new"] * 3, 3: words[:220] + [f"x{i}" for i in range(80)], 4: []}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    a, b, c = (forest.parities([forest.shingle_set(" ".join(texts[i]))]).view(np.uint64) for i in (1, 2, 3))
    most = 15 * 2 * 298 / 185
    assert np.bitwise_count(a ^ b).sum() <= most < np.bitwise_count(a ^ c).sum()
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "a long, b long")
    assert [(r.a, r.b) for r in forest.confirmed(docs, pairs).collect()] == [(1, 2)]


def test_named_texts_are_all_there_with_few_others(spark):
    ids = [-2**63, -7, 0, 1, 2**63 - 1] + [i * 1_000_003 for i in range(1, 400)]
    texts = spark.createDataFrame([(i, "x") for i in ids + list(range(10_000, 20_000))] + [(None, "x"), (0, "y")],
                                  "id long, text string")
    out = forest._named(texts, spark.createDataFrame([(i,) for i in ids], "id long"))
    got = sorted((r.id, r.text) for r in out.filter("id IS NOT NULL").collect())
    assert {(i, "x") for i in ids} | {(0, "y")} <= set(got) and len(got) < len(ids) + 20
    assert out.columns == ["id", "text"]
    assert forest._named(texts, spark.createDataFrame([], "id long")).isEmpty()


def test_whole_texts_are_not_shuffled(spark, monkeypatch):
    """However many sets are compared in full, texts are read where they are;
    labels are not written again once they have done their work."""
    written, stage = [], forest.stage_table

    def seen(df, name, *more):
        written.append((name, df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, name, *more)

    monkeypatch.setattr(forest, "stage_table", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for more sets than can be sent to all
        rows = family(300, {60, 190})
        out = forest.near_groups(table(spark, rows), region=1).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id: r.component_id for r in out} == {i: 60 if i == 190 else i for i, _ in rows}
    plans = [plan for name, _, plan in written if name == "shingles"]
    assert len(plans) == 4
    for plan in plans:
        assert "hashpartitioning(id" not in plan and "SortMergeJoin" not in plan
    for name, columns, _ in written:
        assert name not in ("more_parts", "last_parts") or "labels" not in columns
