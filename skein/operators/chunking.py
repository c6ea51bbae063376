"""Chunkers: units of a document packed into chunks of a target size.

Packing depends on what was packed before, so a document's text is read by one function call; documents are independent
and go through tasks in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"\w+|[^\w\s]")
SENTENCE = re.compile(r"(?<=[.!?।॥])\s+")


@dataclass(frozen=True)
class Sizes:
    """Tokens: aimed at, at most, merged or dropped under; taken over from the chunk before."""

    target: int
    most: int
    least: int
    overlap: int = 0
    drop: bool = False


# Sizes of the two kinds of chunks.
SCIENTIFIC = Sizes(target=320, most=450, least=120, overlap=40, drop=True)
CLASSICAL = Sizes(target=180, most=300, least=90)


def count(text: str) -> int:
    return len(TOKEN.findall(text))


def split_words(text: str, most: int, overlap: int = 0) -> list[str]:
    """Pieces of at most ``most`` tokens at word ends, each starting with the last ``overlap`` tokens' words."""
    words, out, start = text.split(), [], 0
    sizes = [max(1, count(w)) for w in words]
    while start < len(words):
        end, size = start, 0
        while end < len(words) and (size + sizes[end] <= most or end == start):
            size += sizes[end]
            end += 1
        out.append(" ".join(words[start:end]))
        if end == len(words):
            break
        back, kept = end, 0
        while back > start + 1 and kept + sizes[back - 1] <= overlap:
            back -= 1
            kept += sizes[back]
        start = back
    return out


def units(text: str, sizes: Sizes) -> list[str]:
    """Paragraphs; those over the limit by sentences, and sentences over it by words."""
    out = []
    for paragraph in re.split(r"\n+", text):
        if not paragraph.strip():
            continue
        parts = [paragraph] if count(paragraph) <= sizes.most else SENTENCE.split(paragraph)
        for part in parts:
            out += [part.strip()] if count(part) <= sizes.most else split_words(part, sizes.most, sizes.overlap)
    return out


def chunk(text: str, sizes: Sizes) -> list[str]:
    """Units in order up to the target; a small last chunk is joined with the one before if both fit, else dropped if
    the kind drops."""
    chunks: list[list[str]] = []
    size = 0
    for unit in units(text, sizes):
        n = count(unit)
        if chunks and size < sizes.target and size + n <= sizes.most:
            chunks[-1].append(unit)
            size += n
        else:
            chunks.append([unit])
            size = n
    joined = ["\n".join(c) for c in chunks]
    out: list[str] = []
    for c in joined:
        if out and count(c) < sizes.least and count(out[-1]) + count(c) <= sizes.most:
            out[-1] += "\n" + c
        else:
            out.append(c)
    return [c for c in out if not sizes.drop or count(c) >= sizes.least]


#: By domain and type of source.
CHUNKERS: dict[tuple[str, str], Callable[[str], list[str]]] = {}
# Which domains and types of sources each kind of chunker is for.
KINDS = {"scientific": (("science",), ("paper", "article", "report")), "classical": (("advaita", "samkhya"), ("scripture", "commentary", "treatise"))}
FUNCTIONS: dict[str, Callable[[str], list[str]]] = {"scientific": lambda text: chunk(text, SCIENTIFIC), "classical": lambda text: chunk(text, CLASSICAL)}


def register(function: Callable[[str], list[str]], domains: Iterable[str], types: Iterable[str]) -> None:
    """For all combinations, none of which may be taken."""
    for key in ((d, t) for d in domains for t in types):
        if key in CHUNKERS:
            raise ValueError(f"a chunker for {key} is registered already")
        CHUNKERS[key] = function


for _kind, (_domains, _types) in KINDS.items():
    register(FUNCTIONS[_kind], _domains, _types)


def resolve(domain: str, source_type: str) -> Callable[[str], list[str]]:
    try:
        return CHUNKERS[domain, source_type]
    except KeyError:
        raise ValueError(f"no chunker is registered for {domain}, {source_type}") from None


def _chunked(rows: DataFrame, choose: Callable[..., Callable[[str], list[str]]], keys: list[str]) -> DataFrame:
    def run(frames):
        for frame in frames:
            columns = zip(frame["doc_id"], frame["text"], *(frame[k] for k in keys), strict=True)
            out = [(d, k, c, count(c)) for d, t, *key in columns for k, c in enumerate(choose(*key)(t or ""))]
            yield pd.DataFrame(out, columns=["doc_id", "number", "text", "tokens"])

    return rows.select("doc_id", "text", *keys).mapInPandas(run, "doc_id long, number int, text string, tokens int")


def chunked(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, number, text, tokens of the chunks."""
    function = FUNCTIONS[kind]
    return _chunked(docs, lambda: function, [])


def dispatched(docs: DataFrame) -> DataFrame:
    """The same, each row (with domain and source_type) by the chunker registered for it; without one it is an error."""
    return _chunked(docs, resolve, ["domain", "source_type"])
