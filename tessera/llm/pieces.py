"""A SentencePiece model's vocabulary, and cutting text where no piece can reach across.

In these models every space becomes U+2581 and one more is put in front of the
text.  No piece has U+2581 after another character and none of several
characters has a line break, which is checked on loading; so a text can be cut
before each run of U+2581 and around line breaks, and the segments are encoded
on their own.
"""

from __future__ import annotations

import re
from functools import lru_cache

BAR = "\u2581"
SEGMENTS = re.compile(f"{BAR}*[^{BAR}\n]+|{BAR}+|\n")


class Pieces:
    def __init__(self, name: str):
        from public_tokenizers import path
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path(name))
        self.size = sp.get_piece_size()
        self.score, self.id, self.byte_id = {}, {}, [0] * 256
        self.surface: list[bytes] = [b""] * self.size
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.surface[i] = i, bytes([value])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                self.score[piece], self.id[piece] = sp.get_score(i), i
                self.surface[i] = piece.replace(BAR, " ").encode()
        if any(BAR in p.lstrip(BAR) or len(p) > 1 and "\n" in p for p in self.score) or sp.encode("a  b") != sp.encode("a" + BAR * 2 + "b"):
            raise ValueError(f"{name}: its pieces reach across words")
        self.longest = max(map(len, self.score))


@lru_cache(4)
def load(name: str) -> Pieces:
    """The model at ``public_tokenizers.path(name)`` of the machine that runs the task."""
    return Pieces(name)
