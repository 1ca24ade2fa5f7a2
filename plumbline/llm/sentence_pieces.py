"""Encoding and decoding with a merge-type SentencePiece model, by backtracking over longest matches.

A text's pieces are the result of merging its characters pair by pair, best score first, leftmost among equals.
The same pieces follow without replaying those merges over the text: a row of pieces is the result exactly when
every piece merges to itself and every two neighbours merge to these two again.  So the encoder takes, from left to
right, the longest piece (one Aho-Corasick pass gives it for every place), asks whether the last piece and it are
compatible (by merging the two anew along their border; answers are remembered), else tries the next shorter piece,
and when none is left marks the place as failed in a bitfield and steps back.  A failed place is no border of the
result whatever follows, so each place fails once and the work is linear in the text but for the lengths of pieces.

Texts are cut into units before that, only between characters that stand side by side in no piece: no merge can cross
such a border.  Units come back often, so each task keeps a bounded table of their ids.

Rows: a null text is an empty text and has the begin and end ids alone; its decoded text is empty.  U+2581 is the
blank's own sign and decodes as a blank, as in the library.  Repeated rows are encoded alike; every input column stays
in the struct ``row``, so no name can clash.  An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.llm.common import annotate
from plumbline.llm.tokens import packed, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"
#: Letters behind which no common vocabulary joins a mark on; ``_unit_pattern`` checks it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters that any normaliser but the identity would change.
_PROBE = "a  ﬁ é Ⅳ\tb "


class MergeEncoder:
    """str -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model_file: str, remembered: int = 300_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        if model.normalize(_PROBE) != BLANK + _PROBE.replace(" ", BLANK):
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        every = range(model.get_piece_size())
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self.ids = {model.id_to_piece(i): i for i in every
                    if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
        self.score = {x: model.get_score(i) for x, i in self.ids.items()}
        self.reachable: set[str] = set()
        self.halves: dict[str, tuple[str, str]] = {}    # the last merge of a reachable piece
        for x in self.ids:
            halves: list[tuple[str, str]] = []
            if self.merged(x, halves) == [x]:
                self.reachable.add(x)
                if halves:
                    self.halves[x] = halves[-1]
        self.matches = ahocorasick.Automaton()
        for x in self.reachable:
            self.matches.add_word(x, len(x))
        if self.reachable:
            self.matches.make_automaton()
        self.shorter: dict[str, str] = {}       # a piece's next shorter beginning that is a piece or one character
        for x in self.reachable:
            ends = (x[:n] for n in range(len(x) - 1, 0, -1))
            if found := next((y for y in ends if len(y) == 1 or y in self.reachable), None):
                self.shorter[x] = found
        self.orderly: dict[str, bool] = {}      # every merge scores less than those that made its halves
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.remembered = remembered
        self.units = self._unit_pattern()

    def _unit_pattern(self) -> re.Pattern[str]:
        """Runs that no merge crosses.

        Borders are: before a row of blanks, around ASCII characters that are in no longer piece, and between a
        letter and an ASCII mark that follows a letter in no piece.
        """
        longer = [x for x in self.ids if len(x) > 1]
        if any(BLANK in x.lstrip(BLANK) for x in longer):
            return re.compile(r"(?s).+")        # blanks inside pieces: the text is one unit
        joined = set().union(*longer)
        behind = {b for x in longer for a, b in zip(x, x[1:]) if a.isalpha()}
        ascii_rest = [chr(c) for c in range(128) if c != 0x20 and not chr(c).isalpha()]
        alone = "".join(re.escape(c) for c in ascii_rest if c not in joined)
        marks = "".join(re.escape(c) for c in ascii_rest if c in joined and c not in behind)
        other, between = f"[^ {alone}{_LETTERS}]", f"[^ {alone}{_LETTERS}{marks}]"
        words = f"(?:[{_LETTERS}]+(?:{between}{other}*)?)"
        return re.compile(f" *{other}+{words}*| *{words}+" + (f"|[{alone}]" if alone else "") + "| +")

    def merged(self, text: str, log: list[tuple[str, str]] | None = None) -> list[str]:
        """Merges of a short text, replayed: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            pairs = [score(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in pairs if s is not None), default=None)
            if best is None:
                break
            at = pairs.index(best)
            if log is not None:
                log.append((parts[at], parts[at + 1]))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) >= self.remembered // 2:
                self.compatible.clear()
            found = self.compatible[key] = self._stay_apart(left, right)
        return found

    def _in_order(self, piece: str) -> bool:
        found = self.orderly.get(piece)
        if found is None:
            found = len(piece) == 1
            if not found and piece in self.halves:
                found = all(self._in_order(x) and (len(x) == 1 or self.score[x] > self.score[piece])
                            for x in self.halves[piece])
            self.orderly[piece] = found
        return found

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether merging ``left`` + ``right`` gives these two.

        Where every merge scores less than those before it, merges come in the order of their scores, so only what
        touches the border matters: the parts that end ``left`` and begin ``right``, from one character on.  They
        stay apart if no pair of parts that exist together scores more than the next merge of either.
        """
        if not (self._in_order(left) and self._in_order(right)):
            return self.merged(left + right) == [left, right]
        ends, begins = [left], [right]
        while len(ends[-1]) > 1:
            ends.append(self.halves[ends[-1]][1])
        while len(begins[-1]) > 1:
            begins.append(self.halves[begins[-1]][0])
        score, never = self.score.get, float("-inf")
        a, b = ends.pop(), begins.pop()
        while True:
            grow_a = self.score[ends[-1]] if ends else never
            grow_b = self.score[begins[-1]] if begins else never
            cross = score(a + b)
            if cross is not None and cross > grow_a and cross >= grow_b:  # of equals the leftmost goes first
                return False
            if not ends and not begins:
                return True
            if grow_a >= grow_b:
                a = ends.pop()
            else:
                b = begins.pop()

    def split(self, text: str) -> list[str]:
        """Pieces (or single characters outside the vocabulary) of a text whose blanks are written as U+2581."""
        size = len(text)
        longest = [1] * size
        for last, length in self.matches.iter(text):
            if length > longest[last - length + 1]:
                longest[last - length + 1] = length
        failed = bytearray(size // 8 + 1)
        out: list[str] = []
        place, piece = 0, text[:longest[0]] if size else ""
        while place < size:
            to = place + len(piece)
            if not failed[to >> 3] >> (to & 7) & 1 and (not out or self.fits(out[-1], piece)):
                out.append(piece)
                place = to
                piece = text[to:to + longest[to]] if to < size else ""
            elif piece in self.shorter:
                piece = self.shorter[piece]
            else:
                failed[place >> 3] |= 1 << (place & 7)
                piece = out.pop()               # taken again: the place behind it has failed, so it gets shorter
                place -= len(piece)
        return out

    def _ids(self, unit: str) -> bytes:
        out: list[int] = []
        for piece in self.split(unit.replace(" ", BLANK)):
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return packed(out)

    def encode(self, text: str | None) -> bytes:
        """Ids without begin and end."""
        if not text:
            return b""
        known = self.known
        units = self.units.findall(" " + text.replace(BLANK, " "))
        try:
            return b"".join([known[x] for x in units])
        except KeyError:
            pass
        own = {}
        for x in set(units):
            found = known.get(x) or self.earlier.get(x) or self._ids(x)
            own[x] = found
            if len(x) <= 64:
                known[x] = found
        if len(known) > self.remembered // 2:  # what comes back is taken over from the older half
            self.earlier, self.known = known, {}
        return b"".join([own[x] for x in units])


class PieceDecoder:
    """Ids -> text."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.bytes_of: list[bytes] = []
        self.hidden, self.raw, self.led = set(), set(), set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i):
                self.hidden.add(i)
                self.bytes_of.append(b"")
            elif model.is_byte(i):
                self.raw.add(i)
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i):
                self.bytes_of.append(model.decode([i]).encode())
            else:
                if piece.startswith(BLANK):
                    self.led.add(i)
                self.bytes_of.append(piece.replace(BLANK, " ").encode())

    def decode(self, ids: bytes | None) -> str:
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        try:
            if not self.hidden.isdisjoint(numbers[1:-1]):
                raise ValueError
            text = b"".join(map(self.bytes_of.__getitem__, numbers)).decode()
        except ValueError:  # bytes make up characters within an unbroken run of byte ids only
            text = "".join(self._runs(numbers))
        first = next((x for x in numbers if x not in self.hidden), None)
        return text[1:] if first in self.led else text

    def _runs(self, numbers: list[int]) -> Iterator[str]:
        for _, run in groupby(numbers, self.raw.__contains__):
            found = b"".join(map(self.bytes_of.__getitem__, run)).decode("utf-8", "surrogateescape")
            yield re.sub("[\udc80-\udcff]", "\ufffd", found)  # each byte of no character becomes U+FFFD


@lru_cache(maxsize=4)
def _encoder(model_file: str) -> MergeEncoder:
    return MergeEncoder(model_file)


@lru_cache(maxsize=4)
def _decoder(model_file: str) -> PieceDecoder:
    return PieceDecoder(model_file)


def encode_pieces(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY,
                  begin: bool = True, end: bool = True) -> DataFrame:
    """``docs`` as the struct ``row`` with ``ids`` (little-endian unsigned 32-bit integers); no shuffle."""
    def prepare():
        encoder = _encoder(vocabulary_path(vocabulary))
        head = packed([encoder.begin]) if begin else b""
        tail = packed([encoder.end]) if end else b""

        def work(texts: pa.Array) -> dict[str, pa.Array]:
            ids = [head + encoder.encode(x.as_py()) + tail for x in texts]
            return {"ids": pa.array(ids, pa.binary())}
        return work

    return annotate(docs, prepare, "ids binary", text_col)


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` as the struct ``row`` with the ``decoded`` text of its ids (null ids: empty); no shuffle."""
    place = encoded.columns.index(ids_col)
    boxed = encoded.select(F.struct(*[F.col(f"`{x}`") for x in encoded.columns]).alias("row"))

    def run(batches):
        decoder = _decoder(vocabulary_path(vocabulary))
        for batch in batches:
            rows = batch.column(0)
            texts = [decoder.decode(x.as_py()) for x in rows.field(place)]
            yield pa.record_batch({"row": rows, "decoded": pa.array(texts, pa.string())})

    return boxed.mapInArrow(run, StructType([boxed.schema["row"], StructField("decoded", StringType())]))


def piece_table(docs: DataFrame) -> DataFrame:
    """op12: per document doc_id, n_tokens, ids_sha256, decoded_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = encode_pieces(texts).select(F.col("row.doc_id").alias("doc_id"), "ids")
    return decode_pieces(ids).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length("row.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("row.ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
