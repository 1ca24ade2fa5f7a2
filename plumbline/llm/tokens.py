"""Token ids of whole texts with a public vocabulary, exactly those of one call per text.

The pre-tokenizer never joins characters across white space, so a text's ids are the ids of its pieces
between ASCII white space, one after another.  Each task keeps bounded tables of the pieces and of the
letter runs it has seen.  A piece of plain letters and trailing ASCII marks is put together from the
vocabulary model's ids of both parts; any other unseen piece goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

WORD_VOCABULARY = "word_bpe_49k.json"
#: Letters that lower-case one to one and stay as they are under NFC, then ASCII marks without the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)\Z").match
#: A full stop or comma between a letter and white space always is a piece of its own.
_STOPS = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D])").sub
_SPECIAL = b"<|"
#: The tokenizer composes characters before it folds case, so a capital and a mark behind it may stay apart.
_MARKED_CAPITAL = re.compile(rb"[A-Z][\x80-\xff]").search


_LETTERS = b"abcdefghijklmnopqrstuvwxyz,. \n"
_PAIRS = (b"..", b",,", b".,", b",.")


def _pieces(text: bytes) -> list[bytes]:
    """White-space pieces; ASCII capitals are folded as the tokenizer does.

    They stay as they are where a special token may be spelt out or a combining mark may follow one.
    """
    if _SPECIAL in text or not text.isascii() and _MARKED_CAPITAL(text):
        return text.split()
    text = text.lower()
    if not text.isascii() or text.translate(None, _LETTERS) or any(x in text for x in _PAIRS):
        return _STOPS(rb" \1", text).split()
    # letters, single stops and commas only: the same split by plain replacement
    return (text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b",\n", b" ,\n").replace(b".\n", b" .\n")
            .split())


def vocabulary_path(name: str = WORD_VOCABULARY) -> str:
    """Where the installed public vocabulary file is, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class PieceEncoder:
    """bytes -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str | None = None, remembered: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary or vocabulary_path())
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}

    def run_ids(self, run: str) -> bytes:
        raw = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return packed([x.id for x in self.model.tokenize(raw)])

    def learn(self, pieces: set[bytes]) -> None:
        known, hard = self.known, []
        new = [x for x in pieces if x not in known]
        if len(known) + len(new) > self.remembered:  # what this batch needs stays, so frequent pieces do
            known = self.known = {x: known[x] for x in pieces if x in known}
        tokenize = self.model.tokenize
        for piece in new:
            if piece.isalpha() and piece.islower():  # ASCII letters
                known[piece] = packed([x.id for x in tokenize(piece.decode())])
                continue
            text = piece.decode("utf-8", "replace")
            if plain := _PLAIN(text):
                word, marks = plain.groups()
                known[piece] = (self.run_ids(word.lower()) if word else b"") + (self.run_ids(marks) if marks else b"")
            else:
                hard.append((piece, text))
        found = self.tokenizer.encode_batch_fast([x for _, x in hard], add_special_tokens=False)
        known.update((piece, packed(x.ids)) for (piece, _), x in zip(hard, found, strict=True))

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text; None counts as an empty text."""
        split = [_pieces(x) if x else [] for x in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in split]
