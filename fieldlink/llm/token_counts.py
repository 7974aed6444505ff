"""Operator 2: token counts without tokens.

Aho-Corasick lists the vocabulary pieces in a segment by their ends; dynamic
programming carries the best score and its number of pieces, nothing else. Ties
follow the tokenizers library's Unigram model: a later candidate must be strictly
better, and candidates come by ascending start. A character that no piece covers
counts one token for each of its UTF-8 bytes.

A null or empty text has 0 tokens; very long texts and words are counted whole; repeated rows each get a row, an empty table none.
Further columns pass through; one that is named like a result comes back as doc_<name>.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from . import common, unigram

CACHE_SEGMENTS = 400_000


class Counter:
    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary = unigram.load(path)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.vocabulary.ids.items():
            self.automaton.add_word(piece, (len(piece), self.vocabulary.scores[i]))
        self.automaton.make_automaton()
        self.seen: dict[str, int] = {}
        self.chars = 0

    def count(self, segment: str) -> int:
        """Pieces of the best segmentation."""
        unknown, done, single = self.vocabulary.unknown, 0, False
        best, pieces = [0.0], [0]

        def close(end: int, covered: bool) -> None:
            """The unknown character that ends here comes last."""
            if not covered:
                score = best[end - 1] + unknown
                if best[end] is None or score > best[end]:
                    best[end], pieces[end] = score, pieces[end - 1] + len(segment[end - 1].encode("utf-8", "surrogatepass"))

        for at, (length, score) in self.automaton.iter(segment):
            end = at + 1
            while done < end:  # the next end begins; at each, longer pieces come first
                if done:
                    close(done, single)
                done, single = done + 1, False
                best.append(None)
                pieces.append(0)
            score += best[end - length]
            single |= length == 1
            if best[end] is None or score > best[end]:
                best[end], pieces[end] = score, pieces[end - length] + 1
        while done < len(segment):
            if done:
                close(done, single)
            done, single = done + 1, False
            best.append(None)
            pieces.append(0)
        if done:
            close(done, single)
        return pieces[-1]

    def counts(self, segments: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE_SEGMENTS or self.chars > common.MEMORY_CHARS:
            self.seen, self.chars = {}, 0
        seen = self.seen
        for s in segments:
            if s not in seen:
                seen[s] = self.count(unigram.MARK + s)
                self.chars += len(s)
        return np.array([seen[s] for s in segments], dtype=np.int64)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def segments(texts: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
    """The segments of texts, without their marks; an empty text has none."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), unigram.MARK, " ")
    codes, words, counts = common.flat(pc.split_pattern(texts, " "))
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        codes, counts = codes[~np.repeat(empty, counts)], np.where(empty, 0, counts)
    return codes, words, counts


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with n_tokens and n_segments."""
    path = vocabulary or unigram.default_path()
    docs, text = common.beside(docs, text, ("n_tokens", "n_segments"))
    schema, keep = docs.schema, docs.columns

    def count(batches):
        for batch in batches:
            for part in common.slices(batch, text):
                codes, words, counts = segments(part.column(text))
                doc = np.repeat(np.arange(len(counts)), counts)
                n = np.bincount(doc, counter(path).counts(words)[codes], minlength=len(counts)) if len(codes) else np.zeros(len(counts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n.astype(np.int64)), pa.array(counts)], names=[*keep, "n_tokens", "n_segments"])

    return docs.mapInArrow(count, StructType([*schema]).add("n_tokens", LongType()).add("n_segments", LongType()))
