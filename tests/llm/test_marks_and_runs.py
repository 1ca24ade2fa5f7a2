"""Token ids of decomposed capitals; base spans of personal data against the plain patterns, and on long runs."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from plumbline.llm.common import import_path
from plumbline.llm.personal_data import KINDS, base_spans, luhn, personal_data_table
from plumbline.llm.tokens import PieceEncoder, vocabulary_path

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind in KINDS[:4]:
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def test_ids_of_marked_capitals():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(vocabulary_path()), PieceEncoder()
    rnd = random.Random(3)
    marks = "ABJTWYHKZabjtwyhk  ̧̱̌̈̊́ÀÖßéİıǰẖΣσς.,'0<|日\n"
    texts = ["J̌", "T̈", "W̊", "Y̊", "H̱", "I̊ J̌. x", *("".join(rnd.choices(marks, k=rnd.randint(1, 14))) for _ in range(50_000))]
    got = encoder.encode_all([x.encode() for x in texts])
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_base_spans_are_those_of_the_plain_patterns():
    rnd = random.Random(4)
    alphabet = ["a", "Z", "1", "0", "25", "255", "256", "00255", ".", "..", "@", "-", " ", "+", "(", "%", "_", "x@y.z", "10.0.0.1",
                "4111111111111111", "+1 555 010 9999", "é"]
    for _ in range(40_000):
        text = "".join(rnd.choices(alphabet, k=rnd.randint(0, 16)))
        assert base_spans(text) == plain_spans(text), text


def test_long_runs_take_little_time():
    begun = time.perf_counter()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "1" * 5000 + ".1.1.1", "1." * 300_000, "a@" * 300_000, "+1" * 300_000):
        base_spans(text)
    assert base_spans("0" * 5000 + "1.1.1.1") == [("ip", 0, 5007)]
    assert time.perf_counter() - begun < 10


@pytest.mark.parametrize("seed", [5])
def test_base_columns(spark, seed):
    import_path(spark)
    rnd = random.Random(seed)
    parts = ["mail me at a.b@c.de", "10.1.2.3", "4111 1111 1111 1111", "+49 30 1234567", "password=hunter2", "x", "\n", "9" * 4400 + ".1.2.3"]
    rows = [(i, " ".join(rnd.choices(parts, k=rnd.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "")]
    found = personal_data_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        want = plain_spans(texts[r["doc_id"]] or "") if "9" * 4400 not in (texts[r["doc_id"]] or "") else base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS[:4]] == [sum(x[0] == k for x in want) for k in KINDS[:4]]
