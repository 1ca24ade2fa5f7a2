"""Line dedup by overlapping runs of lines: short passages at any offset, against a plain loop."""

import collections
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import line_dedup
from plumbline.llm.common import import_path


def foreign(rnd, n):
    return [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(rnd.randint(3, 9))) for _ in range(n)]


def plain(texts):
    """doc_id -> (number of lines, removed line numbers) of texts without blank lines, in order of doc_id."""
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        gone = set()
        for a in range(len(lines) - 1):
            if (pair := (lines[a], lines[a + 1])) in seen:
                gone |= {a, a + 1}
            seen.add(pair)
        out[i] = (len(lines), gone)
    return out


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(11)
    texts, expected = {}, {}
    for size in (2, 3, 6, 20):
        for _ in range(12):
            passage = foreign(rnd, size)
            for again in range(3):
                before, after = foreign(rnd, rnd.randint(0, 9)), foreign(rnd, rnd.randint(0, 9))
                i = len(texts)
                texts[i] = "\n".join(before + passage + after)
                expected[i] = set(range(len(before), len(before) + size)) if again else set()
    return texts, expected


def test_short_passages_go_whole_at_any_offset(spark, passages):
    texts, expected = passages
    import_path(spark)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in line_dedup.line_table(docs, line_dedup.WIDTH).collect()}
    want = plain(texts)
    assert {i: gone for i, (_, gone) in want.items()} == expected
    for i, (n, gone) in want.items():
        kept = "\n".join(x for no, x in enumerate(texts[i].split("\n")) if no not in gone)
        assert (got[i]["n_lines"], got[i]["n_removed_lines"]) == (n, len(gone)), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest(), i


def test_no_line_is_lost(spark):
    """Overlapping, nested and self-repeating passages: what goes elsewhere stays somewhere."""
    import_path(spark)
    rnd = random.Random(5)
    texts = {i: "\n".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 12))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, (_, gone) in plain(texts).items():
        if len(texts[i]) > 1:
            assert rows[i]["n_removed_lines"] == len(gone), i
            assert rows[i]["kept_text"] == "\n".join(x for no, x in enumerate(texts[i].split("\n")) if no not in gone)
    kept = collections.Counter(x for r in rows.values() for x in r["kept_text"].split("\n"))
    assert set("abcdef") <= set(kept)


def test_no_chunk_of_one_line_is_left():
    rnd = np.random.default_rng(3)
    for n in range(1, 60):
        bounds = line_dedup.chunk_bounds(rnd.integers(0, 2**63, n, dtype=np.uint64))
        assert (bounds[0], bounds[-1]) == (0, n) and (n == 1 or np.diff(bounds).min() >= 2)


@pytest.mark.parametrize("width", [line_dedup.WIDTH, None])
def test_exact_copies_go_whole(spark, tmp_path, width):
    rnd, texts, group = random.Random(2), [], {}
    for size in range(1, 11):
        for _ in range(6):
            text = "\n".join(foreign(rnd, size))
            for _ in range(3):
                group[len(texts)] = text
                texts.append((len(texts), text, "en", "src", len(text)))
    import_path(spark)
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    first = {text: min(i for i, t in group.items() if t == text) for text in group.values()}
    rows = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs, width=width).collect()}
    for i, text in group.items():
        assert rows[i]["kept_text"] == (text if first[text] == i else ""), i
    if width:
        assert sorted(r["doc_id"] for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()) == sorted(first.values())
