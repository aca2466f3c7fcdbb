"""Every query on the smallest tables, against its SQL or a brute-force
version; the pipeline stage by stage."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from mensura.llm import catalog
from mensura.llm.common import read, stage_table
from mensura.llm.tokens import Encoder, vocabulary_path
from tests.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_has_them_all():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(catalog.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(catalog.ORACLES[name])
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
    assert digest(df.columns, rows) == digest(cols, want)


def encoded(duck):
    lib = Encoder.of(vocabulary_path()).library
    rows = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    return {i: lib.encode(t, add_special_tokens=False).ids + [0] for i, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_codes(spark, duck):
    want, start = [], 0
    for i, ids in encoded(duck).items():
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, catalog.op1(spark, SF).collect())) == want


def test_packing(spark, duck):
    ids = encoded(duck)
    out = catalog.op10(spark, SF).collect()
    for r in out:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length])
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
    used = {}
    for r in out:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_pages(spark, duck):
    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    for r in catalog.op2(spark, SF).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        import html
        plain = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h\d)>", " ", inside))).split())
        assert (r.text, r.n_chars) == (plain, len(plain))


def test_near_copies(spark, duck):
    from tests.llm.test_dedup import brute_near
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    component, size = brute_near(rows, 3, 85)
    out = catalog.op3(spark, SF).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in out} == {
        i: (component[i], size[i], component[i] == i) for i in size}


def test_pipeline_stage_by_stage(spark):
    from tests.llm.test_dedup import WHITE, brute_near
    docs = read(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["keep_quality", "drop_copies", "drop_near_copies", "mix_sources", "pack_sequences"]

    def step(name, before):
        out = stage_table(stages[name](spark, before, SF), name)
        return out, [tuple(r) for r in out.collect()]

    quality, good = step("keep_quality", docs)
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    kept = {r[0] for r in good}
    assert quality.columns == columns
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.9 * len(labels)

    exact, unique = step("drop_copies", quality)
    groups = {}
    for r in good:
        groups.setdefault(WHITE.sub("", r[1] or ""), []).append((-len(r[1] or ""), r[0]))
    assert exact.columns == columns and sorted(r[0] for r in unique) == sorted(min(g)[1] for g in groups.values())

    near, apart = step("drop_near_copies", exact)
    component, _ = brute_near([(r[0], r[1]) for r in unique], 5, 80)
    assert near.columns == columns and sorted(r[0] for r in apart) == sorted(set(component.values()))

    mixed, taken = step("mix_sources", near)
    assert mixed.columns == columns and set(taken) <= set(apart)
    words = sum(len((r[1] or "").split()) for r in apart)
    assert sum(len((r[1] or "").split()) for r in taken) == pytest.approx(1.5 * words, rel=0.1)

    _, packed = step("pack_sequences", mixed)
    assert {r[0] for r in packed} == {r[0] for r in taken}


def odd_documents(spark):
    """The smallest table with nulls, empty and long texts, repeats, one
    doc_id for two texts, and columns named as the operators' own."""
    docs = read(spark, SF, "documents")
    first = docs.filter("n_chars > 400").orderBy("doc_id").limit(3).collect()
    a, b, c = (r.text for r in first)
    rows = [(None, None), (None, ""), (None, " \n"), (None, a + " more"), (None, b), (None, b), (7_000_001, a), (7_000_001, c),
            (7_000_001, c), (7_000_002, c + " end"), (7_000_003, (a + " ") * 300), (7_000_004, "ok")]
    odd = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows],
                                "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.unionByName(odd.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema.fields]))
    for name in ("_text", "_words", "_score", "_s_upper", "_row_key", "_doc", "_key", "_copies", "_number", "x_key", "_content",
                 "copies", "kept", "row_key", "size", "label", "id"):
        every = every.withColumn(name, F.concat(F.lit(name), F.coalesce("text", F.lit(""))))
    return every.withColumn("a.b", F.lit(1))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stage_on_odd_rows(spark, name):
    from collections import Counter

    from tests.llm.test_dedup import WHITE, brute_near
    docs = stage_table(odd_documents(spark), "odd")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == out.columns and none.collect() == []
    before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
    if name == "pack_sequences":
        pieces = Counter((r[0], r[2]) for r in after if r[1] == 0)
        assert sum(pieces.values()) == len(before) and all(0 < r.length <= 2048 for r in out.collect())
        return
    assert out.columns == docs.columns
    had, has = Counter(before), Counter(after)
    assert all(n <= had[r] * (2 if name == "mix_sources" else 1) for r, n in has.items())
    if name == "keep_quality":
        assert all(n == had[r] for r, n in has.items()) and len(has) > 0.5 * len(had)
    elif name == "drop_copies":
        assert Counter(WHITE.sub("", r[1] or "") for r in after) == Counter({WHITE.sub("", r[1] or "") for r in before})
    elif name == "drop_near_copies":
        rows = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
        component, _ = brute_near([(i, r[1]) for i, r in enumerate(rows)], 5, 80)
        of = {r: component[i] for i, r in enumerate(rows)}
        assert len(after) == len(set(component.values()))
        assert Counter(of[r] for r in after if (r[1] or "").split()) == Counter(
            {component[i] for i, r in enumerate(rows) if (r[1] or "").split()})
    else:
        assert all((r[1] or "").split() for r in after)
        words = [len((r[1] or "").split()) for r in before]  # whole documents: the cut falls before one
        assert 0 <= 1.5 * sum(words) - sum(len((r[1] or "").split()) for r in after) <= max(words)


def test_guard_hides_only_the_missing_package():
    text = open(entry.__file__).read()
    assert 'ex.name not in ("corpus_pipeline", "mensura.llm")' in text
