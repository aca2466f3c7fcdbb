"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary splits text before single spaces, so the ids of a text are the
ids of its space-separated words strung together, and words recur. Each slice
of texts is split and its distinct words found in Arrow; words not met lately
go through the ``tokenizers`` library many at a time and are remembered, up to
a bound per Python worker; the ids of all words are then gathered in NumPy.
Texts with runs of white space that the vocabulary does not split this way, or
with strings of its added tokens, go through the library whole. The result equals
``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Words remembered per Python worker, in two generations (about 200 bytes each).
REMEMBER = 800_000
#: Characters encoded together.
SLICE = 4 << 20
#: A space inside or at the end of a run of white space: not a word boundary.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_RUN = rf"{_SPACE} {_SPACE}|{_SPACE} \z|\A \z"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes slices of texts; one per vocabulary file and worker."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's core, not the machine's
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ordinary = Tokenizer.from_file(path)  # for words: strings of special tokens are ordinary text
        self.ordinary.encode_special_tokens = True
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        for library in (self.library, self.ordinary):
            if hasattr(library.model, "_resize_cache"):
                library.model._resize_cache(0)  # words are remembered here
        size = self.library.get_vocab_size()
        #: Ids whose token begins with a space.
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.young: dict[str, bytes] = {}  # ids of " " + word
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, texts: Sequence[str], library=None) -> list[bytes]:
        if not texts:
            return []
        out = (library or self.ordinary).encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in out]

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        for at in range(0, len(plain), 1024):
            some = plain[at:at + 1024]
            ids = np.frombuffer(self.whole([" " + " ".join(some)])[0], dtype="<u4")
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(some):
                raw, ends = ids.tobytes(), [*(cuts[1:] * 4).tolist(), len(ids) * 4]
                for w, a, b in zip(some, (cuts * 4).tolist(), ends):
                    self.young[w] = raw[a:b]
            else:
                self.young.update(zip(some, self.whole([" " + w for w in some])))
        odd = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]
        self.young.update(zip(odd, self.whole([" " + w for w in odd])))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each with a space before it."""
        if len(self.young) > REMEMBER // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, words))
        absent = [i for i, ids in enumerate(found) if ids is None]
        if absent:
            known = {w: ids for w in (words[i] for i in absent) if (ids := old.get(w)) is not None}
            young.update(known)
            self._learn([words[i] for i in absent if words[i] not in known])
            for i in absent:
                found[i] = young[words[i]]
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (no nulls)."""
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()
        starts = starts - starts[0]
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy().copy()
        # a text's first word has no space before it: an entry of its own behind the others
        firsts = coded.dictionary.take(pa.array(index[starts[:-1]]))
        firsts = firsts.dictionary_encode()
        entries = self._words(coded.dictionary.to_pylist()) + self.whole(firsts.dictionary.to_pylist())
        index[starts[:-1]] = firsts.indices.to_numpy() + len(coded.dictionary)

        # an Arrow string array has less than 2^31 bytes, and so fewer ids
        size = np.fromiter(map(len, entries), dtype=np.int32, count=len(entries)) // 4
        flat = np.frombuffer(b"".join(entries), dtype="<u4")
        where = np.cumsum(size, dtype=np.int32) - size
        each = size[index]
        ends = np.cumsum(each, dtype=np.int32)
        place = np.repeat(where[index] - (ends - each), each)
        place += np.arange(len(place), dtype=np.int32)
        ids = flat[place]
        bounds = np.concatenate([[0], ends])[starts]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        runs = np.flatnonzero(pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False))
        if len(runs):
            for i, raw in zip(runs.tolist(), self.whole(texts.take(pa.array(runs)).to_pylist())):
                out[i] = np.frombuffer(raw, dtype="<u4")
        for string in self.added:
            special = np.flatnonzero(pc.match_substring(texts, string).to_numpy(zero_copy_only=False))
            if len(special):
                for i, raw in zip(special.tolist(), self.whole(texts.take(pa.array(special)).to_pylist(), self.library)):
                    out[i] = np.frombuffer(raw, dtype="<u4")
        return out


def encode_slices(path: str, texts: pa.Array | Sequence[str | None], end_id: int | None = END_ID,
                  size: int = SLICE) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (position, ids) for each text, encoding about ``size`` bytes at a
    time. A null text is empty."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    texts = pc.fill_null(texts.cast(pa.string()), "")
    coder = Encoder.of(path)
    end = np.array([] if end_id is None else [end_id], dtype="<u4")
    lengths = pc.binary_length(texts).to_numpy()
    at = 0
    while at < len(texts):
        upto = np.cumsum(lengths[at:], dtype=np.int64)
        n = max(1, int(np.searchsorted(upto, size, side="right")))
        for i, ids in enumerate(coder.encode(texts.slice(at, n))):
            yield at + i, np.concatenate([ids, end])
        at += n
