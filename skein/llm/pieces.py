"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass over a segment.

At each end position the automaton's outputs (its longest match and those along the output links) are the pieces that
end there; each relaxes the state of that position from the state of its start. For a unigram model the state is the
best sum of scores (Viterbi). The scores of a BPE model are ranks of merges, and the best sum of them is not what the
model means by its encoding; there, a piece relaxes a position if it can follow the piece before it, that is if merging
by rank leaves the two apart. Exactly one does, so the pass gives the encoding by merges.

Texts are split where no piece can cross: between two characters that are neighbours in no piece. Segments repeat, so
their ids are kept in a bounded cache. White space becomes U+2581 and characters without a piece become bytes.

Defined results. Null or empty text: no ids. U+2581 in a text decodes as a space, as with the public library, so such
a text does not round-trip and is reported so. Repeated rows are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from skein.llm.arrow import map_rows
from skein.llm.wordcache import WordCache
from skein.sources.tables import table

SPACE = "▁"
CACHE_WORDS = 400_000
CACHE_PAIRS = 1_000_000
#: Fixed value: how much less than the least score a character without a piece has in a unigram model.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """An encoder and decoder from a model file."""

    def __init__(self, model: str) -> None:
        import ahocorasick

        raw = open(model, "rb").read()  # noqa: SIM115  a file of every machine, named by a parameter
        top = list(_fields(raw))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        normalizer = dict(_fields(next(v for k, v in top if k == 3)))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise NotImplementedError("only models whose normaliser leaves texts as they are")
        self.unigram, self.prefix = trainer.get(3, 1) == 1, bool(normalizer.get(3, 1))
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        self.unknown = 0
        for i, piece in enumerate(v for k, v in top if k == 1):
            own = dict(_fields(piece))
            text, kind = own[1].decode(), own.get(3, 1)
            self.scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
            if kind == 6:
                self.bytes[int(text[3:5], 16)] = i
                self.surface.append(bytes([int(text[3:5], 16)]))
            elif kind in (1, 4):
                self.ids[text] = i
                self.surface.append(text.replace(SPACE, " ").encode())
            else:
                self.unknown = i if kind == 2 else self.unknown
                self.surface.append(b"")
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.texts = {i: t for t, i in self.ids.items()}
        self.neighbours = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        # Words, with the spaces before them, if no piece has a space after anything else; lines likewise.
        crossing = any(b == SPACE != a for a, b in self.neighbours)
        alone = not any("\n" in pair for pair in self.neighbours) and "\n" not in self.ids
        self.word = None if crossing else re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs = WordCache(self._apart, CACHE_PAIRS)
        self.segments = WordCache(self._segment, CACHE_WORDS)
        self.cache = WordCache(self._word, CACHE_WORDS)

    def merged(self, text: str) -> list[str]:
        """The encoding by merges: the pair whose union has the highest score first, then the leftmost. Pairs wait in a
        heap, so n characters cost n log n."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def propose(k: int) -> None:
            if k >= 0 and after[k] < len(parts):
                union = parts[k] + parts[after[k]]
                i = self.ids.get(union)
                if i is not None:
                    heappush(heap, (-self.scores[i], k, union))

        for k in range(len(parts) - 1):
            propose(k)
        while heap:
            _, k, union = heappop(heap)
            other = after[k]
            if parts[k] is None or other == len(parts) or parts[k] + parts[other] != union:
                continue  # one of the two has been merged since
            parts[k], parts[other] = union, None
            after[k] = after[other]
            if after[k] < len(parts):
                before[after[k]] = k
            propose(before[k])
            propose(k)
        return [x for x in parts if x is not None]

    def _unknown(self, text: str) -> bytes:
        """Ids of a character that is no piece."""
        return b"".join(self.bytes[x].to_bytes(4, "little") for x in text.encode()) if any(self.bytes) else self.unknown.to_bytes(4, "little")

    def _by_merges(self, text: str) -> bytes:
        return b"".join(self.ids[x].to_bytes(4, "little") if x in self.ids else self._unknown(x) for x in self.merged(text))

    def _apart(self, pair: tuple[int, int]) -> bool:
        a, b = self.texts[pair[0]], self.texts[pair[1]]
        return self.merged(a + b) == [a, b]

    def _segment(self, text: str) -> bytes:
        """Ids of a string that may be one piece throughout."""
        if text not in self.ids and len(text) == 1:
            return self._unknown(text)
        if not self.unigram and text.startswith(SPACE * 2):
            return self._by_merges(text)  # in runs of spaces merges tie, so two neighbours do not tell whether they merge
        n = len(text)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, (size, i) in self.automaton.iter(text):
            ends[end + 1].append((size, i))
        state: list = [(0.0, -1, 0)] + [None] * n  # best score or 0, id (-1: none), start
        for end in range(1, n + 1):
            for size, i in ends[end]:
                before, now = state[end - size], state[end]
                if before is None:
                    continue
                if self.unigram:
                    score = before[0] + self.scores[i]
                    if now is None or score > now[0]:
                        state[end] = (score, i, end - size)
                elif now is None and (before[1] < 0 or self.pairs[before[1], i]):
                    state[end] = (0.0, i, end - size)
            if self.unigram and state[end - 1] and not any(size == 1 for size, _ in ends[end]):
                score = state[end - 1][0] + self.least - UNKNOWN_PENALTY
                if state[end] is None or score > state[end][0]:
                    state[end] = (score, -1, end - 1)
        if state[n] is None:  # a character that is a piece in unions only
            return self._by_merges(text)
        out = []
        while n:
            _, i, start = state[n]
            out.append(i.to_bytes(4, "little") if i >= 0 else self._unknown(text[start:n]))
            n = start
        return b"".join(reversed(out))

    def _word(self, word: str) -> bytes:
        start, parts = 0, []
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.neighbours:
                parts.append(self.segments[word[start:k]])
                start = k
        parts.append(self.segments[word[start:]])
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids, each as four bytes, little end first."""
        if not text:
            return b""
        marked = (" " * self.prefix + text).replace(" ", SPACE)
        return b"".join(map(self.cache.__getitem__, self.word.findall(marked))) if self.word else self._word(marked)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    """One a worker process."""
    return Pieces(model)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids (array of integers) and decoded."""
    path = model or default_model()

    def make():
        coder = pieces(path)

        def run(rows):
            ids = [coder.encode(t or "") for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "ids": [np.frombuffer(x, "<u4").astype("i4") for x in ids], "decoded": [coder.decode(x) for x in ids]}

        return run

    return map_rows(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), make, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Like ``encode``, with counts and digests in place of ids and texts."""
    path = model or default_model()

    def make():
        coder = pieces(path)

        def run(rows):
            texts = [t or "" for t in rows["text"]]
            ids = [coder.encode(t) for t in texts]
            back = [coder.decode(x) for x in ids]
            return {
                "doc_id": rows["doc_id"],
                "n_ids": [len(x) // 4 for x in ids],
                "ids_crc32": [zlib.crc32(x) for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                "round_trip": [a == b for a, b in zip(texts, back, strict=True)],
            }

        return run

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_ids long, ids_crc32 long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
