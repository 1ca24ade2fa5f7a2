"""Quality rules with a hashed n-gram classifier.

Base measures come from whole texts.  Rows that pass the base rules are judged by a logistic regression over
hashed word and character n-grams (relative frequencies, one hash table for each kind), fitted on at most
``TRAIN_ROWS`` labelled rows, calibrated on at most ``CALIBRATION_ROWS`` others (Platt scaling), and applied to
every row in Arrow batches; a row is kept if its calibrated probability of good quality reaches ``KEEP_AT``.

The labelled rows are those with the least hash of their id, so the sample does not depend on partitions; both
bounds are parameters, and the sample's n-gram counts are all that the driver sees.

Rows: a null text has no words and fails the base rules.  Labels that are null or point to no document are
ignored, repeated labels of one id are averaged (half and more is good).  Without both classes there is no model:
``probability`` is null and every row that passes the base rules is kept.  Documents that repeat get the same
verdict each.  Other columns, whatever their names, travel inside ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import (
    SPACES, U64, WordBlock, annotate, byte_table, covered, mix, ngrams, row_of_word, text_buffers, row_blocks, words_of,
)

TRAIN_ROWS = 2000
CALIBRATION_ROWS = 1000
KEEP_AT = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WORDS = 8
SYMBOLS = b"#*$%&|<>"
WORD_GRAMS = (1, 2)
CHAR_GRAMS = (3, 4)
BITS = 17
SCALE = 30.0  # keeps weights near one for relative frequencies
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")


def _rows_of(bounds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Number of marked places in each run of ``bounds``."""
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])


def _word_gram_slots(block: WordBlock) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash slot, row) of each word n-gram, rows ascending."""
    row = row_of_word(block)
    for k in WORD_GRAMS:
        count = len(row) - k + 1
        if count > 0:
            inside = row[:count] == row[k - 1:]
            slots = (mix(ngrams(block.hash, k) + U64(k)) >> U64(64 - BITS)).astype(np.int32)
            yield slots[inside], row[:count][inside]


def _char_gram_slots(block: WordBlock) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash slot, bounds of rows) of each byte n-gram inside a row; the last places of a row hold slot -1."""
    data = block.data.astype(np.uint32)
    for k in CHAR_GRAMS:
        count = len(data) - k + 1
        slots = np.full(len(data), -1, np.int32)
        if count > 0:
            h = np.full(count, k, np.uint32)
            for j in range(k):
                h = h * np.uint32(0x01000193) + data[j:j + count]
                h ^= h >> np.uint32(15)
            slots[:count] = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            ends = block.text[1:]
            for j in range(1, k):  # n-grams that would reach into the next row
                at = ends - j
                slots[at[(at >= block.text[:-1])]] = -1
        yield slots, block.text


def _blocks(texts: pa.Array, table: np.ndarray) -> Iterator[WordBlock]:
    data, bounds = text_buffers(texts)
    for row0, row1 in row_blocks(bounds, 1 << 20):
        lo, hi = int(bounds[row0]), int(bounds[row1])
        yield words_of(data[lo:hi], bounds[row0:row1 + 1] - lo, table, row0)


def base_measures(block: WordBlock, lines: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of each row of the block; ``lines`` is the byte table that separates at line ends only."""
    rows = block.row1 - block.row0
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": np.diff(block.first),
           "word_chars": _rows_of(block.text, ~space[block.data] & ((block.data & 0xC0) != 0x80)),
           "n_symbols": _rows_of(block.text, symbol[block.data])}
    line = words_of(block.data, block.text, lines)
    line_row = row_of_word(line)
    worded = np.searchsorted(block.start, line.end) > np.searchsorted(block.start, line.start)
    key = mix(line.hash + mix(line_row.astype(np.uint64)))[worded]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    out["n_dup_lines"] = np.bincount(line_row[worded][order][again], minlength=rows)
    row = row_of_word(block)
    count = len(row) - REPEAT_WORDS + 1
    repeat = np.zeros(len(row), bool)
    if count > 0:
        at = np.flatnonzero(row[:count] == row[REPEAT_WORDS - 1:])
        key = mix(ngrams(block.hash, REPEAT_WORDS)[at] + mix(row[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.append(same, False) | np.append(False, same)]]
        repeat = covered(twice, REPEAT_WORDS, len(row))
    out["n_repeat_words"] = _rows_of(block.first, repeat)
    return out


# --- model ---------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    """Weights of word and character slots, and the calibrated intercept and slope."""

    words: np.ndarray
    chars: np.ndarray
    intercept: float
    slope: float

    def scores(self, block: WordBlock) -> np.ndarray:
        rows = block.row1 - block.row0
        total = np.zeros(rows)
        found, seen = np.zeros(rows), np.zeros(rows)
        for slots, row in _word_gram_slots(block):
            found += np.bincount(row, self.words[slots], rows)
            seen += np.bincount(row, minlength=rows)
        total += found / np.maximum(seen, 1)
        found, seen = np.zeros(rows), np.zeros(rows)
        weights = np.append(self.chars, 0).astype(np.float32)  # slot -1 is the last
        full = np.flatnonzero(np.diff(block.text) > 0)
        for slots, bounds in _char_gram_slots(block):
            if len(full):
                found[full] += np.add.reduceat(weights[slots], bounds[full], dtype=np.float64)
                seen[full] += np.add.reduceat((slots >= 0).astype(np.int32), bounds[full])
        return total + found / np.maximum(seen, 1)


def _count_grams() -> Callable[[pa.Array], dict[str, pa.Array]]:
    table = byte_table(SPACES, fold_case=False)

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        out: dict[str, list] = {"word_slots": [], "word_values": [], "char_slots": [], "char_values": []}
        for block in _blocks(texts, table):
            rows = block.row1 - block.row0
            words = [[] for _ in range(rows)]
            for slots, row in _word_gram_slots(block):
                for r, part in enumerate(np.split(slots, np.searchsorted(row, np.arange(1, rows)))):
                    words[r].append(part)
            chars = [[] for _ in range(rows)]
            for slots, bounds in _char_gram_slots(block):
                for r in range(rows):
                    part = slots[bounds[r]:bounds[r + 1]]
                    chars[r].append(part[part >= 0])
            for kind, lists in (("word", words), ("char", chars)):
                for parts in lists:
                    every = np.concatenate(parts) if parts else np.empty(0, np.int32)
                    slots, n = np.unique(every, return_counts=True)
                    out[f"{kind}_slots"].append(slots.astype(np.int32))
                    out[f"{kind}_values"].append((n / max(1, len(every))).astype(np.float32))
        return {k: pa.array(v, pa.list_(pa.int32() if "slots" in k else pa.float32())) for k, v in out.items()}
    return work


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(rows: pa.Table, steps: int = 120, rate: float = 0.3, shrink: float = 1e-4) -> Model | None:
    """Full-batch logistic regression (Adam), then Platt scaling on the rows kept apart."""
    if rows.num_rows == 0:
        return None
    good = rows.column("good").to_numpy().astype(float)
    apart = rows.column("apart").to_numpy()
    if len(set(good[~apart].tolist())) < 2:
        return None
    size = 1 << BITS
    slots, values, owner = [], [], []
    for kind, offset in (("word", 0), ("char", size)):
        lists = rows.column(f"{kind}_slots").combine_chunks()
        slots.append(lists.flatten().to_numpy() + offset)
        values.append(rows.column(f"{kind}_values").combine_chunks().flatten().to_numpy() * SCALE)
        owner.append(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())))
    slots, values, owner = (np.concatenate(x) for x in (slots, values, owner))
    mine = ~apart[owner]
    s, v, o = slots[mine], values[mine], owner[mine]
    used, s = np.unique(s, return_inverse=True)  # only slots that occur
    weight, bias = np.zeros(len(used)), 0.0
    m, m2, b, b2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    n = int((~apart).sum())
    for step in range(1, steps + 1):
        error = (_sigmoid(np.bincount(o, weight[s] * v, len(good)) + bias) - good) * ~apart
        grad = np.bincount(s, v * error[o], len(used)) / n + shrink * weight
        m, m2 = 0.9 * m + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        weight = weight - rate * (m / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-6)
        gb = error.sum() / n
        b, b2 = 0.9 * b + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        bias -= rate * (b / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-6)
    every = np.zeros(2 * size)
    every[used] = weight
    score = np.bincount(owner, every[slots] * values, len(good))
    slope, shift = _platt(score[apart], good[apart], bias)
    return Model((every[:size] * SCALE).astype(np.float32), (every[size:] * SCALE).astype(np.float32), shift, slope)


def _platt(score: np.ndarray, good: np.ndarray, bias: float) -> tuple[float, float]:
    """Slope and intercept of the calibrated log-odds; the fitted ones if the rows kept apart lack a class."""
    if len(set(good.tolist())) < 2:
        return 1.0, bias
    many, few = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (many + 1) / (many + 2), 1 / (few + 2))
    x, beta = np.column_stack([score, np.ones(len(score))]), np.array([1.0, bias])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (p - target))
        beta = beta - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on a bounded sample of labelled documents."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).alias("good")))
    # the sample is bounded by the two parameters, so it may go to every task
    sample = known.orderBy(F.xxhash64("id"), "id").limit(train_rows + calibration_rows).withColumn(
        "apart", F.pmod(F.xxhash64("id", F.lit("apart")), F.lit(train_rows + calibration_rows)) >= train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "id").dropDuplicates(["id"]).select("text", "good", "apart")
    counted = annotate(chosen, _count_grams, "word_slots array<int>, word_values array<float>, "
                                             "char_slots array<int>, char_values array<float>")
    return _fit(counted.select("row.good", "row.apart", "word_slots", "word_values", "char_slots", "char_values").toArrow())


def _judge(model_of: Callable[[], Model | None]) -> Callable:
    def prepare() -> Callable[[pa.Array], dict[str, pa.Array]]:
        model, table = model_of(), byte_table(SPACES, fold_case=False)
        lines = byte_table(b"\n", fold_case=False)

        def work(texts: pa.Array) -> dict[str, pa.Array]:
            names = [x.split()[0] for x in FIELDS.split(", ")]
            out: dict[str, list[np.ndarray]] = {k: [np.empty(0, np.int64)] for k in names[:-1]}
            score = [np.empty(0)]
            for block in _blocks(texts, table):
                for k, v in base_measures(block, lines).items():
                    out[k].append(v)
                if model is not None:
                    score.append(model.scores(block))
            columns = {k: pa.array(np.concatenate(v).astype(np.int64)) for k, v in out.items()}
            none = pa.nulls(len(texts), pa.float64())
            return columns | {"score": none if model is None else pa.array(np.concatenate(score))}
        return work
    return prepare


def judged(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **sample: int) -> DataFrame:
    """row, the base measures, score, probability, base_failed, kept."""
    model = train(docs, labels, **sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2 ** BITS floats
    found = annotate(docs, _judge(lambda: shared.value), FIELDS)
    odds = F.col("score") * F.lit(model.slope if model else 1.0) + F.lit(model.intercept if model else 0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (found.withColumn("probability", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("probability") >= keep_at, F.lit(True))))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op6: doc_id, the base measures, base_failed, kept, and the probability (rounded)."""
    return judged(docs.select("doc_id", "text"), labels).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("probability", 6).alias("probability"))
