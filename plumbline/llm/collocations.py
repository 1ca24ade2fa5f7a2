"""Collocations from a weighted de Bruijn graph of words, per language.

A word's longest gram is the run of up to five words that starts with it and ends within its piece.  Five-word grams
are the graph's edges, from the node of their first four words to that of their last four; shorter grams are the
corrections for piece ends, where a node's flow leaves the graph.  Only these longest grams are counted, one per word.

1. Pairs of neighbouring words are counted; no phrase spans a pair below ``min_count``, so pieces may be cut there.
   Tasks get the frequent pairs as a bit table of fixed size: a pair that shares a bit only cuts less.
2. Every word gives its longest gram between cuts; grams are summed in blocks, in tasks and then by their text.
3. A phrase's count is the flow through it: each gram passes its weight to all of its beginnings, and piece ends are
   already in the sum.
4. A node whose whole flow runs through one edge on a side is unary there.  Edges joined by nodes that are unary on
   both sides are compacted into paths by doubling; five-word candidates are read off the paths.  A shorter candidate
   stays only if it is unary on neither side, that is if no longer phrase around it occurs as often.
5. Candidates are scored at every cut in whole-number arithmetic.

Words are compared by their text; only the pair filter and the sums within a block of text go by 64-bit hashes.

Rows: a null text is empty, a null language is ``und``.  A row without words adds nothing; repeated rows count each
time.  Texts are taken whole, a longer one as a block of its own.  Ties follow the stated orders.  Further columns are
ignored, whatever their names.  An empty table gives no phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import (
    U64, WordBlock, byte_table, joined, keep, mix, release, row_of_word, signed, word_blocks,
)

LONGEST = 5
MIN_COUNT = 100
BEST = 2000
#: Size of the table of frequent pairs, in bits: 8 MB in every task, whatever the input.
PAIR_BITS = 1 << 26
BLOCK_BYTES = 1 << 20

_SPACES = b"\x20\x09"
_STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))


def _language_hashes(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Code of each row's language, the languages, and a hash of each."""
    coded = column.cast(pa.string()).fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names]
    return coded.indices.to_numpy(zero_copy_only=False), names, np.array(hashes, np.uint64)


def _linked(block: WordBlock) -> np.ndarray:
    """Whether each word but the last has its successor in the same piece of the same row."""
    stop = np.zeros(256, bool)
    stop[np.frombuffer(_STOPS, np.uint8)] = True
    piece = np.cumsum(stop[block.data])[block.start]
    row = row_of_word(block)
    return (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])


def _pair_hashes(block: WordBlock, salt: np.ndarray) -> np.ndarray:
    return mix(joined(block.hash[:-1], block.hash[1:], 1) ^ salt[:-1])


def _scan(each_block: Callable) -> Callable:
    table = byte_table(_SPACES + _STOPS, fold_case=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, names, hashes = _language_hashes(batch.column(0))
            for block in word_blocks(batch.column(1).cast(pa.string()), table, BLOCK_BYTES):
                if len(block.hash):
                    own = code[block.row0 + row_of_word(block)]
                    yield each_block(block, own, names, mix(hashes)[own])
    return run


def _count_pairs(block: WordBlock, code: np.ndarray, names: list[str], salt: np.ndarray) -> pa.RecordBatch:
    pairs, count = np.unique(_pair_hashes(block, salt)[_linked(block)], return_counts=True)
    return pa.record_batch({"pair": pa.array(signed(pairs)), "c": pa.array(count)})


def _grams(longest: int, bits) -> Callable:
    def work(block: WordBlock, code: np.ndarray, names: list[str], salt: np.ndarray) -> pa.RecordBatch:
        n = len(block.hash)
        place = _pair_hashes(block, salt) & U64(PAIR_BITS - 1)
        frequent = bits.value[place >> U64(6)] >> (place & U64(63)) & U64(1)
        link = _linked(block) & (frequent > 0)
        cuts = np.append(np.flatnonzero(~link), n - 1)
        more = np.minimum(cuts[np.searchsorted(cuts, np.arange(n))] - np.arange(n), longest - 1)
        key = block.hash.copy()
        for k in range(1, longest):
            at = np.flatnonzero(more >= k)
            key[at] = joined(key[at], block.hash[at + k], 1)
        key = mix(key ^ salt) + more.astype(np.uint64)
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        more = more[first]
        # phrases as they stand, where single blanks part their words; else put together
        data = block.data.tobytes().translate(_FOLD)
        single = np.append((block.start[1:] - block.end[:-1] == 1) & (block.data[block.end[:-1]] == 0x20), False)
        odd = np.append(0, np.cumsum(~single))
        plain = odd[first + more] == odd[first]
        start, end = block.start.tolist(), block.end.tolist()
        phrases = [data[start[i]:end[i + m]] if p else b" ".join([data[start[j]:end[j]] for j in range(i, i + m + 1)])
                   for i, m, p in zip(first.tolist(), more.tolist(), plain.tolist())]
        lang = pa.DictionaryArray.from_arrays(pa.array(code[first], pa.int32()), pa.array(names, pa.string()))
        return pa.record_batch({
            "lang": lang.cast(pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
            "words": pa.array(more + 1, pa.int32()), "c": pa.array(count)})
    return work


def _pair_table(texts: DataFrame, min_count: int):
    """Bit table of the pairs that occur ``min_count`` times, as a broadcast of fixed size."""
    pairs = texts.mapInArrow(_scan(_count_pairs), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    place = F.col("pair").bitwiseAND(PAIR_BITS - 1)
    cells = (pairs.where(F.col("c") >= min_count)
             .groupBy(F.shiftright(place, 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(pair & 63 AS INT))")).alias("bits")))
    found = cells.toArrow()  # at most PAIR_BITS / 64 rows
    table = np.zeros(PAIR_BITS // 64, np.uint64)
    table[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return texts.sparkSession.sparkContext.broadcast(table)


def longest_grams(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """lang, phrase, words, c: how many words have ``phrase`` as their longest gram; written.

    Grams of ``longest`` words are the graph's edges, shorter ones end at a piece's end or at a rare pair.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    bits = _pair_table(texts, min_count)
    grams = texts.mapInArrow(_scan(_grams(longest, bits)), "lang string, phrase string, words int, c long")
    return keep(grams.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("c")), "grams")


def flows(grams: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, words, f of all phrases that occur ``min_count`` times: the weight of all grams that start so."""
    starts = grams.select("lang", "phrase", "c", F.explode(F.sequence(F.lit(1), F.col("words"))).alias("words"))
    return (starts.groupBy("lang", F.expr("substring_index(phrase, ' ', words)").alias("phrase"), "words")
            .agg(F.sum("c").alias("f")).where(F.col("f") >= min_count))


def _part(first: int | Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def compact(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, path, words, f: edges joined over nodes that are unary on both sides, as whole phrases.

    All edges of a path have its weight f.  An edge without such a neighbour is a path of its own.  A path lies in
    one piece wherever it occurs, so it is never longer than a piece.
    """
    spark = counts.sparkSession
    edges = counts.where(F.col("words") == longest).select("lang", "phrase", "f")
    inner = F.lit(longest - 1)
    nodes = counts.where(F.col("words") == longest - 1).select("lang", F.col("phrase").alias("node"), "f")
    ahead = edges.select("lang", _part(2, inner).alias("node"), "f", F.col("phrase").alias("before"))
    behind = edges.select("lang", _part(1, inner).alias("node"), "f", "phrase")
    keys = ["lang", "node", "f"]  # equal weights: all of the node's flow comes in and goes out here
    step = ahead.join(nodes, keys).join(behind, keys).select("lang", "phrase", "before")
    state = keep(edges.join(step, ["lang", "phrase"], "left").select(
        "lang", "phrase", "f", F.coalesce("before", "phrase").alias("head"),
        F.col("before").isNotNull().cast("long").alias("place")), "paths")
    while True:
        far = state.select("lang", F.col("phrase").alias("head"), F.col("head").alias("further"),
                           F.col("place").alias("more"))
        old, state = state, keep(state.join(far, ["lang", "head"]).select(
            "lang", "phrase", "f", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"),
            (F.col("more") > 0).alias("moved")), "paths")
        release(spark, old)
        if not state.where("moved").limit(1).count():
            break
    last = F.element_at(F.split("phrase", " "), -1)
    tails = state.where("place > 0").groupBy("lang", "head", "f").agg(
        F.sort_array(F.collect_list(F.struct("place", last.alias("word")))).alias("tail"))
    heads = state.where("place = 0").select("lang", F.col("phrase").alias("head"), "f")
    path = F.array_join(F.concat(F.array("head"), F.coalesce(F.col("tail.word"), F.array().cast("array<string>"))), " ")
    return heads.join(tails, ["lang", "head", "f"], "left").select(
        "lang", path.alias("path"), (F.lit(longest) + F.coalesce(F.size("tail"), F.lit(0))).alias("words"), "f")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, best: int = BEST,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``best`` phrases: lang, rank, phrase, a, l, r, n, score."""
    grams = longest_grams(docs, min_count, longest, text_col, lang_col)
    totals = grams.groupBy("lang").agg(F.sum("c").alias("n"))
    counts = keep(flows(grams, min_count, longest), "flows")
    paths = compact(counts, longest)
    words = F.split("path", " ")
    on_paths = paths.select("lang", "f", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(words) - longest + 1),
        lambda i: F.array_join(F.slice(words, i, longest), " "))).alias("phrase"))
    shorter = counts.where(F.col("words").between(2, longest - 1))
    sides = counts.where("words > 2").select("lang", "f", F.explode(F.array(
        _part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("phrase"))
    branching = shorter.join(sides, ["lang", "phrase", "f"], "left_anti")
    kept = on_paths.select("lang", "phrase", F.lit(longest).alias("words"), "f").unionByName(branching)
    cuts = kept.select("lang", "phrase", "words", F.col("f").alias("a"),
                       F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f"))
    scored = (cuts.withColumn("left_part", _part(1, F.col("k")))
              .withColumn("right_part", _part(F.col("k") + 1, F.col("words") - F.col("k")))
              .join(parts.withColumnsRenamed({"part": "left_part", "f": "l"}), ["lang", "left_part"])
              .join(parts.withColumnsRenamed({"part": "right_part", "f": "r"}), ["lang", "right_part"])
              .join(totals, "lang")
              .withColumn("score", F.expr("CAST(1000 AS DECIMAL(38,0)) * a * n div (CAST(l AS DECIMAL(38,0)) * r)")))
    least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (least.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
