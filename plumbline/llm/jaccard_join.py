"""Jaccard join of word shingles by parity sketches.

A document's set holds its distinct ``k``-word shingles (A-Z folded; fewer words: the whole sequence as one).  Sets
with J >= num/den differ in at most ``(den - num) (a + b) / (den + num)`` shingles, a and b their sizes.  Each shingle
toggles one bit of a sketch, so the Hamming distance of two sketches is a lower bound of the symmetric difference.
Sizes fall into bands (a linked partner is in the same or a neighbouring band).  For each band the sketch has one
part more than sets of that band may differ in (and some to spare), so linked sets agree in a whole part (pigeonhole):
filled parts are the join keys.  A set that fills no more parts than it may differ in could agree with a partner in empty
parts alone; that partner then is such a set too, so both also give the keys of another division into parts, and so on,
``ATTEMPTS`` times, the last time with empty parts as keys.  No link is lost, and hardly a set comes that far.

Candidates are never all pairs of a key's group:

1. equal sets are one node; keys held by one node only go (counted on 44-bit digests, partial counts in every task).
   Keys are written once and counted in ``turns`` shares by their residue, one after another, so that a share's
   shuffles are gone before the next one's begin.  A key of two nodes is a pair: it goes if the folded sketches are too
   far apart, and of all such keys of a near pair one is left.  Of larger keys that hold the same nodes one is left;
2. in up to ``ROUNDS`` rounds, every node of a key whose nodes lie in several components meets one node of another
   component per key (drawn anew each round), by folded 512-bit sketches whose Hamming distance must not exceed the
   bound; the nearest that was not tried before is judged by sketches as wide as its size needs, worked out once, and
   if it passes verified on the shingle sets; links join components.  Keys whose nodes have come into one component
   are done and no later round reads them;
3. what is left goes through blocks: a key's nodes are dealt to blocks of about ``BLOCK``, every two blocks of a key
   meet in one task, and only nodes with a partner of another component within the bound leave it.  These meet again
   in the same way by the wide sketches, a share of the keys at a time; the pairs that pass are verified and joined in.

The blocks see every pair of different components of every key, so the rounds only spare work: components are exact
up to 64-bit hash collisions of shingles and sets, and 128-bit ones of the nodes of a key.

Rows: texts without words (null, empty) have no shingles, link with nothing and are components of their own.
Repeated rows and rows with equal sets share a component.  A null doc_id takes part in links; component ids are the
least non-null id of the component, or null.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import (
    SPACES, U64, WordBlock, byte_table, components, keep, mix, ngrams, release, signed, text_buffers,
    word_blocks,
)

SHINGLE = 5
THRESHOLD = (80, 100)
FOLDED_WORDS = 8
WIDE_WORDS = 64
PART_WORDS = 4
ATTEMPTS = 6
ROUNDS = 4
BLOCK = 1024
JUDGED_WORDS = 1 << 18
TURNS = 3
_LEVEL, _PART, _FOLD = 0xA24BAED4963EE407, U64(0x9FB21C651E98DF25), U64(0x3C79AC492BA7B653)
_PLACES = mix(np.arange(1, PART_WORDS + 1, dtype=np.uint64) * _PART)  # words of a part count by their place
SEEN_IN_TASK = 200_000


def band_tops(threshold: tuple[int, int], most: int) -> list[int]:
    """Largest size of each band, up to the band after the one of size ``most``."""
    num, den = threshold
    tops, low = [], 1
    while len(tops) < 2 or tops[-2] < most:
        tops.append(low * den // num)
        low = tops[-1] + 1
    return tops


def shingle_sets(block: WordBlock, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words = np.diff(block.first)
    grams = mix(ngrams(block.hash, k) + U64(k))
    out = []
    for r, n in enumerate(words.tolist()):
        first = int(block.first[r])
        if n >= k:
            out.append(np.unique(grams[first:first + n - k + 1]))
        elif n:
            out.append(mix(ngrams(block.hash[first:first + n], n) + U64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_id(shingles: np.ndarray) -> int:
    """64-bit id of a set, never of the empty one."""
    total = np.array([mix(shingles).sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles), len(shingles)], np.uint64)
    return int(signed(mix(total[:1] + mix(total[1:2] * _FOLD + total[2:])))[0])


def folded_sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch of the whole set in ``words`` (a power of two) times 64 bits."""
    bits = np.zeros(words, np.uint64)
    spread = mix(shingles ^ _FOLD)
    np.bitwise_xor.at(bits, ((spread >> U64(32)) % U64(words)).astype(np.int64), U64(1) << (spread & U64(63)))
    return signed(bits)


@functools.cache
def part_count(threshold: tuple[int, int], level: int) -> tuple[int, int]:
    """(differences linked sets of this level may have, parts): the number of parts that makes fewest keys in all."""
    num, den = threshold
    tops = band_tops_to(threshold, level)
    differ = (den - num) * 2 * tops[level] // (den + num)
    below = [0, 0, *tops]
    sizes = [(below[level] + below[level + 1]) / 2, (below[level + 1] + below[level + 2]) / 2]  # of both bands that meet here
    best = (math.inf, 0)
    for parts in range(differ + 1, differ + differ // 2 + 3):
        cost = 0.0
        for size in sizes:
            mean = parts * math.exp(-size / parts)  # empty parts, about Poisson
            term = enough = math.exp(-mean)
            for i in range(1, parts - differ):
                term *= mean / i
                enough += term
            cost += parts / max(enough, 1e-3)
        best = min(best, (cost, parts))
    return differ, best[1]


def band_tops_to(threshold: tuple[int, int], level: int) -> list[int]:
    most, tops = 1, band_tops(threshold, 1)
    while len(tops) <= level:
        most *= 2
        tops = band_tops(threshold, most)
    return tops


def part_keys(shingles: np.ndarray, threshold: tuple[int, int], tops: list[int]) -> np.ndarray:
    """Join keys of a set: one per filled part of its sketch, for its own band and the next one."""
    band = bisect.bisect_left(tops, len(shingles))
    keys = []
    for level in (band, band + 1):
        differ, parts = part_count(threshold, level)
        for attempt in range(ATTEMPTS):
            seed = U64(_LEVEL * ((level + 1) * ATTEMPTS + attempt) % 2**64)
            spread = mix(shingles ^ seed)
            part = ((spread >> U64(32)) * U64(parts)) >> U64(32)
            sketch = np.zeros(parts * PART_WORDS, np.uint64)
            slot = (part * U64(PART_WORDS) + (spread & U64(PART_WORDS - 1))).astype(np.int64)
            np.bitwise_xor.at(sketch, slot, U64(1) << ((spread >> U64(8)) & U64(63)))
            filled = np.bincount(part.astype(np.int64), minlength=parts) > 0
            enough = int(filled.sum()) > differ
            at = np.arange(parts) if attempt == ATTEMPTS - 1 and not enough else np.flatnonzero(filled)
            words = sketch.reshape(parts, PART_WORDS)[at]
            inside = mix(words + _PLACES).sum(axis=1, dtype=np.uint64)
            keys.append(mix(inside + at.astype(np.uint64) * _PART + seed))
            if enough:
                break
    return np.concatenate(keys)


# --- passes over the texts -----------------------------------------------------------------------
def _nodes(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(SPACES, fold_case=True)
        for batch in batches:
            size, node, sketch = [], [], []
            for block in word_blocks(batch.column("text"), table):
                for shingles in shingle_sets(block, k):
                    size.append(len(shingles))
                    node.append(node_id(shingles) if len(shingles) else None)
                    sketch.append(folded_sketch(shingles, FOLDED_WORDS))
            flat = np.concatenate(sketch) if sketch else np.empty(0, np.int64)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "h": batch.column("h"), "n_shingles": pa.array(size, pa.int64()),
                "node": pa.array(node, pa.int64()),
                "sketch": pa.ListArray.from_arrays(
                    pa.array(np.arange(len(size) + 1, dtype=np.int32) * FOLDED_WORDS), pa.array(flat))})
    return run


def _keys(k: int, threshold: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tops, seen = byte_table(SPACES, fold_case=True), band_tops(threshold, 1 << 12), set()
        for batch in batches:
            for block in word_blocks(batch.column("text"), table):
                keys, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for shingles in shingle_sets(block, k):
                    if not len(shingles):
                        continue
                    node = node_id(shingles)
                    if node in seen:  # an equal set of this task has given the same rows
                        continue
                    if len(seen) >= SEEN_IN_TASK:
                        seen = set()
                    seen.add(node)
                    if len(shingles) > tops[-2]:
                        tops = band_tops(threshold, 2 * len(shingles))
                    found = part_keys(shingles, threshold, tops)
                    keys.append(found)
                    nodes.append(np.full(len(found), node))
                yield pa.record_batch({"key": pa.array(signed(np.concatenate(keys))),
                                       "node": pa.array(np.concatenate(nodes))})
    return run


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = byte_table(SPACES, fold_case=True), set()
        for batch in batches:
            for block in word_blocks(batch.column("text"), table):
                nodes = batch.column("node").slice(block.row0, block.row1 - block.row0).to_pylist()
                new = [i for i, x in enumerate(nodes) if not (x in seen or seen.add(x))]  # rows may repeat
                sets = shingle_sets(block, k)
                yield pa.record_batch({"node": pa.array([nodes[i] for i in new], pa.int64()),
                                       "shingles": pa.array([sets[i].tobytes() for i in new], pa.binary())})
    return run


def _wide_sketches(k: int) -> Callable:
    """node, n, wide: sketches of ``WIDE_WORDS`` words or more, about four bits a shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(SPACES, fold_case=True)
        for batch in batches:
            for block in word_blocks(batch.column("text"), table):
                sets = shingle_sets(block, k)
                wide = [folded_sketch(x, max(WIDE_WORDS, 1 << (len(x) // 16).bit_length())).tobytes() for x in sets]
                yield pa.record_batch({"node": batch.column("node").slice(block.row0, len(sets)),
                                       "n": pa.array([len(x) for x in sets], pa.int64()),
                                       "sketch": pa.array(wide, pa.binary())})
    return run


def _folded(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sketches of one width, from their 64-bit words: wider ones are folded to the least, as their words are dealt by residue."""
    widths = np.diff(bounds)
    words = int(widths.min())
    if (widths == words).all():
        return raw[bounds[0]:bounds[-1]].reshape(-1, words)
    return np.stack([np.bitwise_xor.reduce(raw[lo:hi].reshape(-1, words)) for lo, hi in zip(bounds, bounds[1:])])


def _partners(threshold: tuple[int, int], emit_pairs: bool) -> Callable:
    """Rows sorted by key, b0, b1 -> key, node of rows with a partner in their group, or the pairs a < b themselves."""
    num, den = threshold

    def pairs(node: np.ndarray, component: np.ndarray, n: np.ndarray, block: np.ndarray, sketch: np.ndarray,
              crossing: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places i < j of the pairs of a group, some rows against all others at a time."""
        step = max(1, JUDGED_WORDS // sketch.size)
        for lo in range(0, len(node) - 1, step):
            i, j = slice(lo, lo + step), slice(lo + 1, None)
            far = np.bitwise_count(sketch[i, None] ^ sketch[None, j]).sum(axis=2, dtype=np.int64)
            least, most = np.minimum(n[i, None], n[None, j]), np.maximum(n[i, None], n[None, j])
            ok = ((component[i, None] != component[None, j]) & (den * least >= num * most)
                  & (far * (den + num) <= (den - num) * (least + most)))
            if crossing:
                ok &= block[i, None] != block[None, j]
            x, y = np.nonzero(np.triu(ok))
            if len(x):
                yield x + lo, y + lo + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            """Whole groups."""
            table = pa.Table.from_batches(rows).combine_chunks()
            key, b0, b1, node, component, n, block = (
                table.column(x).to_numpy() for x in ("key", "b0", "b1", "node", "component", "n", "block"))
            raw, bounds = text_buffers(table.column("sketch").combine_chunks())
            raw, bounds = raw[bounds[0]:bounds[-1]].view(np.uint64), (bounds - bounds[0]) // 8
            places = np.stack([key, b0, b1], axis=1)
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            found, a, b = np.zeros(len(key), bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lo, hi in zip(cuts, cuts[1:]):
                g = slice(lo, hi)
                for x, y in pairs(node[g], component[g], n[g], block[g], _folded(raw, bounds[lo:hi + 1]), b0[lo] != b1[lo]):
                    if emit_pairs:
                        a.append(np.minimum(node[g][x], node[g][y]))
                        b.append(np.maximum(node[g][x], node[g][y]))
                    else:
                        found[lo + x] = found[lo + y] = True
            if emit_pairs:
                return pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})
            return pa.record_batch({"key": key[found], "node": node[found]})

        held: list[pa.RecordBatch] = []  # rows whose last group may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(x).to_numpy() for x in ("key", "b0", "b1")], axis=1)
            turns = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
            if last is not None and last != tuple(places[0]):
                yield judged(held)
                held = []
            if len(turns):
                cut = int(turns[-1])
                yield judged([*held, batch.slice(0, cut)])
                held = []
                batch = batch.slice(cut)
            held.append(batch)
            last = tuple(places[-1])
        if held:
            yield judged(held)
    return run


def _pass(threshold: tuple[int, int]) -> Callable:
    """Pairs a, b whose wide sketches (ka, kb) and sizes (na, nb) allow a link."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            ok = []
            for (na, nb), a, b in zip(sizes, batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True):
                x, y = _folded(np.frombuffer(a + b, np.uint64), np.array([0, len(a) // 8, (len(a) + len(b)) // 8]))
                far = int(np.bitwise_count(x ^ y).sum(dtype=np.int64))
                ok.append(den * min(na, nb) >= num * max(na, nb) and far * (den + num) <= (den - num) * (na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _verify(threshold: tuple[int, int]) -> Callable:
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
    return run


# --- join ----------------------------------------------------------------------------------------
def _distance(sa: Column, sb: Column) -> Column:
    """Hamming distance of two folded sketches."""
    words = [F.bit_count(F.get(sa, F.lit(i)).bitwiseXOR(F.get(sb, F.lit(i)))) for i in range(FOLDED_WORDS)]
    return functools.reduce(lambda x, y: x + y, words)


def _may_link(na: Column, nb: Column, sa: Column, sb: Column, threshold: tuple[int, int]) -> Column:
    """Size ratio and Hamming distance of the folded sketches allow a link."""
    num, den = threshold
    return ((den * F.least(na, nb) >= num * F.greatest(na, nb))
            & (_distance(sa, sb) * (den + num) <= (den - num) * (na + nb)))


def _near(pairs: DataFrame, facts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs a, b that may link, with the sizes and sketches of both nodes."""
    for x in "ab":
        pairs = pairs.join(facts.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")), x)
    return pairs.where(_may_link(F.col("na"), F.col("nb"), F.col("ka"), F.col("kb"), threshold))


def _texts_of(wanted: DataFrame, thin: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of one document of each node wanted (rows that repeat the document may stand twice)."""
    chosen = (thin.select("node", "doc_id", "h").join(wanted, "node", "left_semi")
              .groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r")).select("node", "r.doc_id", "r.h"))
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.h") == F.col("c.h"))
    return texts.alias("t").join(chosen.alias("c"), same).select("c.node", "t.text")


def _blocks(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows (key, node, component, n, sketch) once for every two blocks of their key that they belong to, side by side.

    Rows are dealt while they are thin; each one's sketch is shuffled once, with its group.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = dealt.withColumn("other", other).select(
        "key", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block", "node", "component")
    held = paired.join(sketches, "node").select("key", "b0", "b1", "block", "node", "component", "n", "sketch")
    return held.repartition("key", "b0", "b1").sortWithinPartitions("key", "b0", "b1")


def _one_of_equal(rows: DataFrame) -> DataFrame:
    """Rows key, node of one key of all those that hold the same nodes (told by their number and two 64-bit digests)."""
    digest = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"d{i}") for i in range(2)]
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *digest)
    return rows.join(groups.groupBy("c", "d0", "d1").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _mixed(shared: DataFrame, label: DataFrame | None, least_and_most: Column) -> DataFrame:
    """key, node, component, ends of the keys whose nodes lie in several components."""
    own = F.col("node").alias("component")
    labelled = shared.select("key", "node", own) if label is None else shared.join(label, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    ends = labelled.groupBy("key").agg(F.min(least_and_most).alias("lo"), F.max(least_and_most).alias("hi"))
    return labelled.join(ends.where("lo.component <> hi.component"), "key")


def _likely(pairs: DataFrame, wide: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs a, b that may link by their wide sketches: the sets of unlike pairs stay at home."""
    for x in "ab":
        pairs = pairs.join(wide.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")), x)
    return pairs.mapInArrow(_pass(threshold), "a long, b long")


def _verified(pairs: DataFrame, thin: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int], name: str) -> DataFrame:
    """Pairs a, b of nodes whose shingle sets reach the threshold; only their texts are shuffled again."""
    spark = texts.sparkSession
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = keep(_texts_of(wanted, thin, texts).mapInArrow(_sets(k), "node long, shingles binary"), "shingle-sets")
    release(spark)
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    found = keep(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(
        _verify(threshold), "a long, b long").distinct(), name)
    release(spark, sets)
    return found


def linked_components(docs: DataFrame, k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD,
                      id_col: str = "doc_id", text_col: str = "text", turns: int = TURNS) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_shingles, node, component_id of every row.

    ``node`` is shared by equal sets (null for empty ones); ``component_id`` is the least doc_id of the component.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    thin = keep(texts.mapInArrow(_nodes(k), "doc_id long, h long, n_shingles long, node long, sketch array<bigint>"),
                "nodes")
    nodes = keep(thin.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")), "sets")

    spark = docs.sparkSession
    facts = nodes.select("node", "n", "sketch")
    short = F.col("key").bitwiseAND((1 << 44) - 1)
    every = keep(texts.mapInArrow(_keys(k, threshold), "key long, node long"), "part-keys")
    release(spark)
    shares, duos = [], []
    for turn in range(turns):
        keys = every.where(F.pmod("key", F.lit(turns)) == turn)
        common = keep(keys.groupBy(short.alias("short")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
                      .select("short"), "repeated-keys")
        release(spark)
        share = keys.join(common, short == F.col("short"), "left_semi").groupBy("key", "node").agg(F.lit(1))
        share = keep(share.select("key", "node"), "shared-keys")
        release(spark, common, *[every] * (turn == turns - 1))
        # a key of two nodes is one pair: those too far apart go, and a pair of many keys keeps one
        sizes = share.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("a"), F.max("node").alias("b"))
        sizes = keep(sizes.where("c > 1"), "key-sizes")
        duos.append(keep(sizes.where("c = 2").select("a", "b").distinct(), "pairs"))
        shares.append(keep(share.join(sizes.where("c > 2").select("key"), "key", "left_semi"), "large-keys"))
        release(spark, share, sizes)
    several = keep(_one_of_equal(functools.reduce(DataFrame.unionByName, shares)), "unequal-keys")
    duo = keep(_near(functools.reduce(DataFrame.unionByName, duos).distinct(), facts, threshold).select(
        F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("node")), "near-duos")
    release(spark, *duos, *shares)
    shares = [several, duo]
    shared = several.unionByName(duo)
    wide = keep(_texts_of(shared.select("node").distinct(), thin, texts).mapInArrow(
        _wide_sketches(k), "node long, n long, sketch binary").dropDuplicates(["node"]), "wide-sketches")
    release(spark)

    label, tried, links, held = None, [], [], shares
    for turn in range(ROUNDS):
        drawn = F.struct(F.xxhash64("component", F.lit(turn)).alias("c"), "component",
                         F.xxhash64("node", F.lit(turn)).alias("d"), "node")
        other = F.when(F.col("component") != F.col("lo.component"), F.col("lo")).otherwise(F.col("hi"))
        mixed = _mixed(shared, label, drawn)
        if label is not None:  # components only grow: a key that lies in one component now is settled
            mixed = keep(mixed, "open-keys")
            release(spark, *held)
            shared, held = mixed.select("key", "node"), [mixed]
        met = (mixed.select(other["node"].alias("a"), F.col("node").alias("b"))
               .groupBy("a", "b").agg(F.lit(1)).select("a", "b"))
        near = _near(met, facts, threshold)
        for old in tried:
            near = near.join(old, (F.least(near["a"], near["b"]) == old["x"])
                             & (F.greatest(near["a"], near["b"]) == old["y"]), "left_anti")
        score = F.struct(_distance(F.col("ka"), F.col("kb")) / (F.col("na") + F.col("nb")), "a")
        close = keep(near.groupBy("b").agg(F.min_by("a", score).alias("a"))
                     .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        release(spark)
        if close.isEmpty():
            break
        tried.append(close.select(F.col("a").alias("x"), F.col("b").alias("y")))
        likely = keep(_likely(close, wide, threshold), "likely-pairs")
        release(spark)
        found = _verified(likely, thin, texts, k, threshold, "near-links")
        release(spark, likely)
        if found.isEmpty():
            break
        links.append(found)
        label = components(functools.reduce(DataFrame.unionByName, links))

    least = F.struct("component")
    mixed = keep(_mixed(shared, label, least).select("key", "node", "component"), "mixed-keys")
    release(spark, *held)
    as_bytes = F.concat(*[F.unhex(F.lpad(F.hex(F.col("sketch")[i]), 16, "0")) for i in range(FOLDED_WORDS)])
    left = keep(_blocks(mixed, facts.withColumn("sketch", as_bytes)).mapInArrow(
        _partners(threshold, False), "key long, node long").distinct(), "left-nodes")
    release(spark, mixed)
    if not left.isEmpty():
        rest = keep(_one_of_equal(left), "left-keys")
        known = rest if label is None else rest.join(label, "node", "left")
        component = F.col("node") if label is None else F.coalesce("component", "node")
        members = known.select("key", "node", component.alias("component"))
        # rows carry a wide sketch each: the keys go in shares, one after another, so that their shuffles do not coexist
        met = []
        for turn in range(turns):
            share = members.where(F.pmod("key", F.lit(turns)) == turn)
            met.append(keep(_blocks(share, wide).mapInArrow(_partners(threshold, True), "a long, b long").distinct(),
                            "crossing-pairs"))
            release(spark)
        crossing = functools.reduce(DataFrame.unionByName, met).distinct()
        release(spark, rest)
        more = _verified(crossing, thin, texts, k, threshold, "crossing-links")
        if not more.isEmpty():
            links.append(more)
            label = components(functools.reduce(DataFrame.unionByName, links))
        release(spark, *met)
    release(spark, left, wide)
    if label is None:
        label = nodes.select("node", F.col("node").alias("component")).limit(0)

    owner = nodes.select("node", "doc_id").join(label, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = owner.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    owner = keep(owner.join(least, "component").select("node", "component_id"), "owners")
    release(spark, nodes)
    linked = thin.join(owner, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return linked.select("doc_id", "h", "n_shingles", "node", own.alias("component_id"))


def component_table(docs: DataFrame) -> DataFrame:
    """op4: doc_id, n_shingles, component_id with 3-word shingles and J >= 0.9."""
    return linked_components(docs, k=3, threshold=(90, 100), turns=1).select("doc_id", "n_shingles", "component_id")


def one_per_component(docs: DataFrame, k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) but one of each component: the least doc_id, then the least text hash.

    Wordless rows stay; of rows repeating the chosen doc_id and text one stays.
    """
    found = linked_components(docs, k, threshold)
    worded = found.where(F.col("node").isNotNull())
    chosen = worded.groupBy("component_id").agg(F.min(F.struct("doc_id", "h")).alias("r")).select("r.doc_id", "r.h")
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.h") == F.col("c.h"))
    bare = found.where(F.col("node").isNull()).select("doc_id", "h").distinct()
    boxed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"),
                        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    kept = boxed.alias("t").join(chosen.withColumn("worded", F.lit(True)).unionByName(bare.withColumn(
        "worded", F.lit(False))).alias("c"), same).select("t.row", "t.doc_id", "t.h", "c.worded")
    # wordless rows all stay; the chosen one of a component may stand in the table more than once
    copies = kept.where("worded").dropDuplicates(["doc_id", "h"])
    return copies.unionByName(kept.where("NOT worded")).select("row.*")
