"""Token ids against the library, codes and packing against exact round trips."""

import math
import random
import zlib

import numpy as np
import pytest

from mensura.llm import dac, packing
from mensura.llm.common import stage_table
from mensura.llm.tokens import Encoder, encode_slices, vocabulary_path
from mensura.session import scratch_dir

ODD = ["", " ", "  a   b \n c  ", "a  b", "a \n b", " a", "a ", "it's <|endoftext|> x", "\t a\n\n b", " " * 7,
       "\n \n", "Ünïcode 日本語 😀", "x" * 5000, "word " * 4000, "a\x85 \x85b", "a\xa0 \xa0b", "a　 b"]


def plain(texts):
    lib = Encoder.of(vocabulary_path()).library
    return [e.ids for e in lib.encode_batch(list(texts), add_special_tokens=False)]


def test_encoder_equals_library():
    rng = random.Random(3)
    letters = " \n\tab'.  é\U0001F600 1\xa0　\x0b\x85\x1c"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    got = [ids.tolist() for _, ids in encode_slices(vocabulary_path(), texts, None, size=997)]
    assert got == plain(texts)


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr("mensura.llm.tokens.REMEMBER", 50)
    texts = [f"alpha{i} beta{i % 7} gamma" for i in range(400)]
    got = [ids.tolist() for _, ids in encode_slices(vocabulary_path(), texts, None, size=200)]
    assert got == plain(texts)


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32 - 1])
def test_codes_random_access(top):
    rng = np.random.default_rng(top)
    ids = (rng.random(5000) ** 4 * top).astype(np.uint32)
    lengths = [0, 1, 700, 0, 4299]
    s = dac.Segment(dac.pack(ids, [3, None, 5, 6, 7], lengths))
    assert s.n == 5000 and s.docs == [3, None, 5, 6, 7]
    for i in [0, 1, 511, 512, 513, 1023, 4999, *rng.integers(0, 5000, 200).tolist()]:
        assert s.access(int(i)) == ids[i]
    for a, b in [(0, 0), (0, 5000), (7, 9), (510, 514), (4990, 5000), (1024, 3000)]:
        assert s.slice(a, b).tolist() == ids[a:b].tolist()
    assert s.document(2).tolist() == ids[1:701].tolist()


def test_codes_of_nothing():
    s = dac.Segment(dac.pack(np.empty(0, np.uint32), [1], [0]))
    assert s.document(0).tolist() == []


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, part int, ids_crc32 string")


def test_write_and_read_tokens(spark):
    rows = [(i * 7 % 101, t, 1, "x") for i, t in enumerate(ODD * 3)] + [(5, None, 2, "y"), (None, "null id", 3, "z")]
    path = scratch_dir(spark, "codes")
    dac.write_tokens(docs(spark, rows), path, segment_tokens=500)
    out = dac.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert len(out) == len(rows)
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(r.ids)) and ids[-1] == 0
        start += len(ids)
    want = sorted((r[0] or -1, x + [0]) for r, x in zip(rows, plain(r[1] or "" for r in rows)))
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in out) == want


def test_write_tokens_empty_table(spark):
    path = scratch_dir(spark, "codes")
    dac.write_tokens(docs(spark, []), path)
    assert dac.read_tokens(spark, path).collect() == []


def test_fullest_is_the_fullest():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert all(0 < m <= counts[x] for x, m in got)
        assert sum(x * m for x, m in got) == max(s for s in sums if s <= room)


def test_plan_places_every_piece():
    rng = random.Random(6)
    counts = {x: rng.randint(1, 40) for x in rng.sample(range(1, 101), 60)}
    used = dict.fromkeys(counts, 0)
    for times, mixed in packing.plan(counts, 100):
        assert sum(x * m for x, m in mixed) <= 100
        for x, m in mixed:
            used[x] += m * times
    assert used == counts
    room = []  # best fit decreasing, for comparison
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=room.__getitem__)] -= x
        else:
            room.append(100 - x)
    assert sum(t for t, _ in packing.plan(counts, 100)) <= len(room)


def test_pack_round_trip(spark):
    rows = [(i % 40, t, 1, "x") for i, t in enumerate(ODD * 6)] + [(None, None, 0, None), (1, "a b", 0, None)] * 5
    packed = stage_table(packing.pack(docs(spark, rows), capacity=64, with_ids=True), "packed")
    out = packed.collect()
    by_sequence = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in out)
    assert sorted(by_sequence) == list(range(len(by_sequence))) and len(by_sequence) <= math.ceil(total / 64) + 1
    # pieces put a document together again; only the first may be short
    assert all(r.length == 64 for r in out if r.piece > 0)
    want = sorted(len(x) + 1 for x in plain(r[1] or "" for r in rows))
    assert total == sum(want)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in out:
        assert whole[r.sequence_id][r.offset:r.offset + r.length].tobytes() == bytes(r.ids)


def test_pack_empty_table(spark):
    assert packing.pack(docs(spark, [])).collect() == []


def test_strings_of_added_tokens_as_in_the_library():
    from tokenizers import Tokenizer
    path = vocabulary_path()
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z", "plain text", "<|endoftext", ""]
    fresh = Tokenizer.from_file(path)
    assert any(t.content == "<|endoftext|>" for t in fresh.get_added_tokens_decoder().values())
    got = [ids.tolist() for _, ids in encode_slices(path, texts, end_id=None)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
