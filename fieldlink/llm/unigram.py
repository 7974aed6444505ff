"""A unigram reading of a public SentencePiece vocabulary.

The pieces come from the model file; a piece of merge rank r has probability
proportional to 1 / (r + 1) (Zipf). Spaces become the word mark, a mark is put
before each text, and a segment starts at every mark, as the tokenizers library
does with Prepend, Replace and Split(merged_with_next). Characters that no
piece covers fall back to their UTF-8 bytes.
"""

from __future__ import annotations

import functools
import math

MARK = "▁"
#: Below the worst piece, as the library has it.
UNKNOWN_PENALTY = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        special = set(self.byte_ids.values()) | {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i)}
        self.normal = [i for i in range(len(self.pieces)) if i not in special]
        norm = math.log(sum(1.0 / (r + 1) for r in range(len(self.normal))))
        self.scores = {i: -math.log(r + 1) - norm for r, i in enumerate(self.normal)}
        self.ids = {self.pieces[i]: i for i in self.normal}
        self.characters = {p for p in self.ids if len(p) == 1}
        self.longest = max(len(self.pieces[i]) for i in self.normal)
        self.unknown_id = next(i for i in range(len(self.pieces)) if model.is_unknown(i))
        self.least = min([*self.scores.values(), 0.0])
        self.unknown = self.least - UNKNOWN_PENALTY

    def library_vocabulary(self) -> list[tuple[str, float]]:
        """What the tokenizers library's Unigram model takes for the same result. Specials get its lowest score."""
        return [(p, self.scores.get(i, self.least)) for i, p in enumerate(self.pieces)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
