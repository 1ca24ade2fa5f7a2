"""Near copies just over and under the threshold: exact through rounds and blocks, few rows between the steps."""

import os
import random

import pytest

from plumbline.llm import jaccard_join


def near_copies(n: int, edits: tuple[int, int], seed: int) -> list[str]:
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(n):
        copy = list(words)
        for at in draw.sample(range(150), draw.randint(*edits)):
            copy[at] = f"x{draw.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def brute_components(texts: list[str], k: int, num: int, den: int) -> list[int]:
    sets = [{tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for w in (x.split() for x in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds,block", [(0, 16), (1, 24)])
def test_components_of_near_copies(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_copies(120, (1, 4), 5) + [f"{x} tail" for x in near_copies(40, (0, 9), 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked_components(docs, 3, (90, 100)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 3, 90, 100)
    assert 1 < len(set(got.values())) < len(texts)


def test_rows_between_steps_do_not_grow_with_the_square(spark, monkeypatch):
    """Copies whose pairs mostly lie just under the threshold: pairs that leave the blocks, per text, stay few."""
    counted = {}
    kept = jaccard_join.keep

    def counting(df, name):
        out = kept(df, name)
        counted[name] = max(counted.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "keep", counting)
    texts = near_copies(2000, (3, 3), 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    jaccard_join.linked_components(docs, 3, (90, 100)).collect()
    assert all(counted[x] <= 2 * len(texts) for x in ("near-pairs", "crossing-pairs") if x in counted), counted


def test_keys_of_two_nodes_are_kept_once_per_pair(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:395]), " ".join(f"x{i}" for i in range(300)), " ".join([f"x{i}" for i in range(150)] + [f"y{i}" for i in range(150)])]
    rows = {}
    real = jaccard_join.keep

    def counted(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "keep", counted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.linked_components(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3}
    assert rows["shared-keys"] > 20 and rows["large-keys"] == 0 and rows["near-duos"] == 2


def test_sets_of_a_round_go_and_keys_are_written_once(spark, monkeypatch):
    """Every round's shingle sets are deleted when its links are known; texts give their keys in one pass."""
    written = []
    real = jaccard_join.keep

    def noted(df, name):
        out = real(df, name)
        written.append((name, out._kept_at))
        return out

    monkeypatch.setattr(jaccard_join, "keep", noted)
    texts = near_copies(60, (1, 3), 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard_join.linked_components(docs, 3, (90, 100), turns=3)
    names = [name for name, _ in written]
    assert names.count("part-keys") == 1 and names.count("wide-sketches") == 1 and "shingle-sets" in names
    left = {name for name, path in written if os.path.exists(path.removeprefix("file:"))}
    assert not left & {"part-keys", "shingle-sets", "likely-pairs", "open-keys", "mixed-keys", "unequal-keys", "wide-sketches"}, left
    assert len({r.component_id for r in found.collect()}) > 0


def test_of_keys_with_the_same_nodes_one_is_left(spark):
    rows = [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 12), (3, 10), (3, 11), (3, 13), (4, 10), (4, 11)]
    left = jaccard_join._one_of_equal(spark.createDataFrame(rows, "key long, node long"))
    assert sorted(map(tuple, left.collect())) == [r for r in rows if r[0] != 2]


def test_wide_blocks_go_in_shares(spark, monkeypatch):
    """Wide sketches of one share of the keys at a time are shuffled; the components are the same."""
    steps = []
    real = jaccard_join.keep
    monkeypatch.setattr(jaccard_join, "keep", lambda df, name: steps.append(name) or real(df, name))
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    texts = near_copies(60, (1, 4), 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked_components(docs, 3, (90, 100), turns=3).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 3, 90, 100)
    assert steps.count("crossing-pairs") == 3
