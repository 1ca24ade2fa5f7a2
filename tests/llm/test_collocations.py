"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm.collocations import collocations, compact, flows, longest_grams
from plumbline.llm.common import import_path

LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def pieces(rows):
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            yield lang if lang is not None else "und", tuple(words)


def plain(rows, least, best):
    n, f = Counter(), defaultdict(Counter)
    for lang, words in pieces(rows):
        n[lang] += len(words)
        for k in range(1, 6):
            for i in range(len(words) - k + 1):
                f[lang][words[i:i + k]] += 1
    out = []
    for lang, count in f.items():
        frequent = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        inside = set()
        for h, b in frequent.items():
            for k in range(2, len(h)):
                for i in range(len(h) - k + 1):
                    if b >= frequent[h[i:i + k]]:
                        inside.add(h[i:i + k])
        found = []
        for g, a in frequent.items():
            if g in inside:
                continue
            score, k = min((1000 * a * n[lang] // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]], n[lang]))
        for rank, (s, a, g, left, right, total) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, g.decode(), -a, left, right, total, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    vocabulary = ["a", "B", "c", "é", "É", "word", "日本", "x y", "z" * 300]
    passage = "one two three four five six seven eight nine ten"
    out = []
    for i in range(300):
        words = rnd.choices(vocabulary, weights=range(9, 0, -1), k=rnd.randint(0, 25))
        text = "".join(w + rnd.choice([" ", "  ", "\t", " ", ". ", ",", "\n", " "]) for w in words)
        if i % 3 == 0:
            text += rnd.choice(["", "! "]) + passage + rnd.choice(["", " more", "; end"])
        out.append((text, rnd.choice(["en", "de", None])))
    return out + [(None, "en"), ("", None), (" \t\n", "en"), ("a " * 3000, "en"), ("a", "xx"), ("same Row", "en"), ("same Row", "en")]


@pytest.mark.parametrize("least,best", [(3, 2000), (10, 7), (30, 2000), (10**6, 5)])
def test_against_plain_counting(spark, rows, least, best):
    import_path(spark)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = sorted(tuple(r) for r in collocations(df, min_count=least, best=best).collect())
    assert got == plain(rows, least, best)


def test_graph(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    grams = longest_grams(df, 10)
    assert sum(r["c"] for r in grams.collect()) == sum(len(w) for _, w in pieces(rows))  # one gram a word
    counts = flows(grams, 10)
    paths = [r.asDict() for r in compact(counts).collect()]
    edges = {(r["lang"], r["phrase"]): r["f"] for r in counts.where("words = 5").collect()}
    seen = {}
    for p in paths:
        words = p["path"].split(" ")
        assert len(words) == p["words"]
        for i in range(len(words) - 4):
            key = (p["lang"], " ".join(words[i:i + 5]))
            assert key not in seen and edges[key] == p["f"]
            seen[key] = p["f"]
    assert seen == edges
    assert max(p["words"] for p in paths) >= 10  # the passage is one path


def test_clashing_names_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    clash = df.select("*", *[F.lit(1).alias(x) for x in ("phrase", "words", "c", "f", "n", "rank", "pair")])
    assert sorted(tuple(r) for r in collocations(clash, 10).collect()) == plain(rows, 10, 2000)
    assert collocations(df.limit(0)).count() == 0
