"""Packing token streams into windows by Karmarkar-Karp multiway differencing.

Documents are taken in the order of a partition, in groups of a bounded number of tokens and documents. What fills
whole windows is cut off a document and needs no partner. The remainders of a group are split into k parts of nearly
equal sums: partial partitions, each a vector of k sums, are kept by their imbalance; the two most imbalanced are
merged, the largest sum of one with the smallest of the other, until one is left. k starts at the least number of
windows that the group's tokens need and rises whenever a part exceeds the capacity.

Each group is packed inside one task, so nothing is shuffled, memory is bounded by the group, and a lost task gives the
same rows again. Sequence ids are the task's partition and a counter.

Defined results. Null text: empty. An empty text is its end mark alone. Rows that repeat an id are documents of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from skein.llm.arrow import map_rows
from skein.llm.wordcache import WordCache
from skein.sources.tables import table

WINDOW = 4096
END_ID = 2
CACHE_WORDS = 600_000
#: A group ends at whichever comes first.
GROUP_DOCS, GROUP_TOKENS = 1024, 4_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of a text by its words. This tokenizer drops white space before it forms tokens, so the ids of a text are
    those of its words in turn; words repeat, and a bounded cache spares most of them."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache = WordCache(self._word, CACHE_WORDS)
        self.letters = WordCache(self._letters, CACHE_WORDS)
        self.marks = WordCache(self._whole, 10_000)
        # Bytes that are printable stand for themselves, the others for the characters from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.shown = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """Letters are one unit of this tokenizer, so its model alone gives their ids."""
        text = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])

    def _word(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?")
        # Of Western letters, normalisation changes the case alone; marks after them are a unit of their own.
        if core.isalpha() and max(core) <= "ÿ":
            return self.letters[core.lower()] + (self.marks[word[len(core) :]] if len(core) < len(word) else b"")
        return self._whole(word)

    def encode(self, text: str) -> bytes:
        """Ids, each as four bytes, little end first."""
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One a worker process."""
    return WordTokenizer(path)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in k parts of nearly equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, size in enumerate(sizes):
        sums, slots = np.zeros(k, np.int64), np.empty(k, object)
        sums[-1], slots[-1] = size, i  # ascending
        heap.append((-size, i, sums, slots))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        slots = np.empty(k, object)
        for j, (p, q) in enumerate(zip(x.tolist(), y[::-1].tolist(), strict=True)):
            slots[j] = q if p is None else p if q is None else (p, q)
        order = np.argsort(sums, kind="stable")
        sums, slots = sums[order], slots[order]
        count += 1
        heapq.heappush(heap, (int(sums[0] - sums[-1]), count, sums, slots))
    parts = []
    for slot in heap[0][3] if heap else [None] * k:
        part, todo = [], [slot]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += node
            elif node is not None:
                part.append(node)
        parts.append(sorted(part))
    return parts


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts none of which exceeds the capacity. Their number starts at the least possible one (of sizes over a j+1-th
    of the capacity at most j go together) and rises while a part exceeds it, by as much as its excess over the mean
    asks for and by twice as much each turn at least; the numbers passed over are searched by halves to a hundredth."""
    if not sizes:
        return []
    total = sum(sizes)
    least = [-(-sum((j + 1) * size > capacity for size in sizes) // j) for j in range(1, 9)]
    k, step, failed, found = max(1, -(-total // capacity), *least), 1, 0, []
    while not found or k > failed + 1 + k // 100:
        at = (failed + k) // 2 if found else k
        parts = differencing(sizes, at)
        most = max(sum(sizes[i] for i in part) for part in parts)
        if most <= capacity:
            k, found = at, [part for part in parts if part]
        else:
            failed = at
            if not found:
                k, step = max(k + step, int(total / max(1, capacity - (most - total / k)))), 2 * step
        if found and not failed:
            break
    return found


class _Packer:
    """Gathers documents and gives the pieces of each full group."""

    def __init__(self, path: str, window: int, keep_ids: bool) -> None:
        self.tokenizer, self.window, self.keep_ids = tokenizer(path), window, keep_ids
        self.task = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
        self.sequences = 0
        self._new()

    def _new(self) -> None:
        self.docs: list[tuple] = []
        self.tokens = 0

    def __call__(self, rows: dict[str, list]) -> dict[str, list] | None:
        out: dict[str, list] | None = None
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            ids = self.tokenizer.encode(text or "") + END_ID.to_bytes(4, "little")
            self.docs.append((doc_id, ids))
            self.tokens += len(ids) // 4
            if len(self.docs) >= GROUP_DOCS or self.tokens >= GROUP_TOKENS:
                more = self.finish()
                out = {c: out[c] + more[c] for c in more} if out else more
        return out

    def _sequence(self) -> int:
        self.sequences += 1
        return self.task + self.sequences - 1

    def finish(self) -> dict[str, list] | None:
        if not self.docs:
            return None
        rest, pieces = [], []  # pieces: document, start, length, sequence, offset
        for d, (_, ids) in enumerate(self.docs):
            n = len(ids) // 4
            pieces += [(d, at, self.window, self._sequence(), 0) for at in range(0, n - n % self.window, self.window)]
            if n % self.window:
                rest.append((d, n - n % self.window, n % self.window))
        for part in balanced([x[2] for x in rest], self.window) if rest else []:
            sequence, offset = self._sequence(), 0
            for i in part:
                pieces.append((*rest[i], sequence, offset))
                offset += rest[i][2]
        cut = [self.docs[d][1][4 * at : 4 * (at + n)] for d, at, n, _, _ in pieces]
        out = {
            "doc_id": [self.docs[p[0]][0] for p in pieces],
            "start": [p[1] for p in pieces],
            "length": [p[2] for p in pieces],
            "ids_crc32": [zlib.crc32(x) for x in cut],
            "doc_tokens": [len(self.docs[p[0]][1]) // 4 for p in pieces],
            "sequence_id": [p[3] for p in pieces],
            "offset": [p[4] for p in pieces],
        }
        if self.keep_ids:
            out["ids"] = [np.frombuffer(x, "<u4").astype("i4") for x in cut]
        self._new()
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of a document; with ``keep_ids`` its token ids too."""
    file = path or default_tokenizer()
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return map_rows(rows, lambda: _Packer(file, window, keep_ids), SCHEMA + ", ids array<int>" * keep_ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, with their token ids."""
    return pack(docs, keep_ids=True)
