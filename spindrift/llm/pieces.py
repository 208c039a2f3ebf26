"""The fixed public piece vocabulary, read from a tokenizer file that stays where it is."""

from __future__ import annotations

from dataclasses import dataclass

#: Where the public vocabulary lies; every user of it takes another path as a parameter.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands for a space in pieces.
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that can match text, with their scores; and what an unknown character costs.

    An unknown character is written as its UTF-8 bytes where the file has a piece for
    every byte, as one piece otherwise.
    """

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    unknown_score: float
    bytes_known: bool


def read_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read on the driver; the result (some 32,000 pieces, half a MB) is what tasks get."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    scores = tuple(model.get_score(i) for i in plain)
    return Vocabulary(tuple(model.id_to_piece(i) for i in plain), scores, min(scores) - 10.0, sum(map(model.is_byte, ids)) == 256)
