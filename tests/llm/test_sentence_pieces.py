"""Backtracking encoder and decoder against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.common import import_path
from plumbline.llm.sentence_pieces import MergeEncoder, PieceDecoder, VOCABULARY, decode_pieces, encode_pieces, piece_table
from plumbline.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(VOCABULARY))


@pytest.fixture(scope="module")
def encoder():
    return MergeEncoder(vocabulary_path(VOCABULARY), remembered=2000)  # small, so that tables are renewed


def words(n, rnd, library):
    pieces = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    marks = "abcdefghij  ▁\n\t.,'\"-0123éßЖ日本😀\u0000‍<s>"
    for i in range(n):
        if i % 4 == 0:
            yield "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40)))
        elif i % 4 == 1:
            yield "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))).replace("▁", " ")
        elif i % 4 == 2:
            yield "".join(chr(rnd.choice([rnd.randint(0, 0x250), rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)]))
                          for _ in range(rnd.randint(0, 20)))
        else:
            yield "".join(rnd.choice("  aehts") for _ in range(rnd.randint(0, 60)))


def test_random_texts(library, encoder):
    decoder = PieceDecoder(vocabulary_path(VOCABULARY))
    for text in words(20_000, random.Random(5), library):
        want = library.encode(text)
        got = encoder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert decoder.decode(got) == library.decode(want)


def test_borders_and_remerging_agree(library, encoder):
    rnd = random.Random(6)
    pieces = sorted(encoder.reachable)
    for _ in range(20_000):
        left, right = rnd.choice(pieces), rnd.choice(pieces)
        assert encoder.fits(left, right) == (encoder.merged(left + right) == [left, right])


def test_any_ids_decode_as_the_library_does(library):
    rnd, decoder = random.Random(7), PieceDecoder(vocabulary_path(VOCABULARY))
    for _ in range(10_000):
        ids = [rnd.choice([rnd.randint(0, 300), rnd.randint(0, 31999), rnd.randint(3, 258)]) for _ in range(rnd.randint(0, 12))]
        assert decoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_long_runs_without_borders(library, encoder):
    rnd = random.Random(8)
    for text in ("a" * 100_000, "ab" * 40_000, "".join(rnd.choices("abcdefgh", k=60_000)), " " * 50_000, "é́" * 9_000):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text)


def test_table(spark, library):
    import_path(spark)
    rnd = random.Random(9)
    texts = [None, "", " ", "\n", "<s> </s> <unk> <0x41>", "x" * 5000, *words(200, rnd, library)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "same id"), (None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in piece_table(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clash = df.select("*", *[F.lit(1).alias(x) for x in ("row", "ids", "decoded", "n_tokens")])
    assert sorted((tuple(r) for r in piece_table(clash).collect()), key=repr) == sorted(want, key=repr)
    both = decode_pieces(encode_pieces(clash)).first()
    assert both["row"]["row"]["ids"] == 1 and isinstance(both["decoded"], str)
    assert piece_table(df.limit(0)).count() == 0
