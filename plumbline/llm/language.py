"""Language identification by fusing evidence.

For every row the posterior of a language adds up, in logarithms,

* the text: byte trigrams of letter words under per-language tables counted over all declared texts (whole texts;
  overlapping trigrams are not independent, so their sum is tempered to at most ``FULL_TEXT`` trigrams' worth),
* the declared markup language and the address suffix, each with the likelihoods P(value | language) that grouped
  counts over the whole table give, smoothed,
* a prior of the host, smoothed towards its domain's, which is smoothed towards the whole table's.

Tables of counts are grouped aggregates with partial sums in every task; the per-value tables are written and
joined back, so they are broadcast only where their files are small and are otherwise a (skew-splittable) join.
Only per-language totals and the trigram tables (languages times 2 ** ``BITS`` numbers, at most ``MAX_LANGUAGES``
languages) reach the driver.

A row is accepted if its best language has at least ``MIN_PROBABILITY``, is one of ``languages`` when given, and
the text does not fit every language worse than noise would.  Rows with null, empty or letterless text are judged
by the other evidence; with none at all the language is ``und`` and the row is rejected.  Declared values are
folded to their primary subtag and count only if they are codes of two or three letters.  Equal probabilities go
to the alphabetically first language.  Repeated rows get equal results.  Without any declared text the language
is ``und`` throughout.  Other columns, whatever their names, travel inside ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import annotate, keep, row_blocks, text_buffers

BITS = 14
SLOTS = 1 << BITS
FULL_TEXT = 300.0
MIN_PROBABILITY = 0.5
MAX_LANGUAGES = 1000
VALUE_SMOOTHING = 1.0
DOMAIN_WEIGHT = 20.0
HOST_WEIGHT = 10.0

_LETTER = np.zeros(256, np.uint32)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, slots, bounds of rows in them) of the trigrams around every letter byte."""
    data, bounds = text_buffers(texts)
    for row0, row1 in row_blocks(bounds, 1 << 20):
        lo, hi = int(bounds[row0]), int(bounds[row1])
        text = bounds[row0:row1 + 1] - lo
        here = _LETTER[data[lo:hi]]
        before, after = np.zeros_like(here), np.zeros_like(here)
        before[1:], after[:-1] = here[:-1], here[1:]
        full = np.diff(text) > 0
        before[text[:-1][full]] = 0
        after[text[1:][full] - 1] = 0
        inside = here > 0
        h = (before << np.uint32(16)) | (here << np.uint32(8)) | after
        slots = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))[inside]
        yield row0, row1, slots, np.concatenate([[0], np.cumsum(inside)])[text]


def primary_subtag(value: Column) -> Column:
    """``en-US`` -> ``en``; null unless it is a code of two or three letters."""
    code = F.lower(F.regexp_extract(F.trim(value.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(code != "", code)


def address_suffix(url: Column) -> Column:
    """Language code in the address: the first path segment if it is two letters, else a two-letter top domain."""
    url = url.cast("string")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:]*\.([A-Za-z]{2})(?:[:/?#]|$)", 1)
    return F.when(path != "", F.lower(path)).when(top != "", F.lower(top))


def address_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_domain(host: Column) -> Column:
    """The last two labels."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1)


# --- text model ----------------------------------------------------------------------------------
def _count(languages: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {x: i for i, x in enumerate(languages)}
        counts = np.zeros(len(languages) * SLOTS, np.int64)
        for batch in batches:
            of = np.array([code.get(x, -1) for x in batch.column("declared").to_pylist()], np.int64)
            for row0, row1, slots, bounds in _grams(batch.column("text")):
                owner = np.repeat(of[row0:row1], np.diff(bounds))
                known = owner >= 0
                counts += np.bincount(owner[known] * SLOTS + slots[known], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch({"language": pa.array((at // SLOTS).astype(np.int32)),
                               "slot": pa.array((at % SLOTS).astype(np.int32)), "n": pa.array(counts[at])})
    return run


def trigram_tables(texts: DataFrame, languages: list[str]) -> np.ndarray:
    """log P(slot | language), languages x SLOTS, from all rows of ``texts`` (text, declared)."""
    total = (texts.select("text", "declared").where(F.col("declared").isNotNull())
             .mapInArrow(_count(languages), "language int, slot int, n long")
             .groupBy("language", "slot").agg(F.sum("n").alias("n")).toArrow())
    counts = np.full((len(languages), SLOTS), 0.1)
    counts[total.column("language").to_numpy(), total.column("slot").to_numpy()] += total.column("n").to_numpy()
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _text_evidence(tables_of: Callable[[], np.ndarray]) -> Callable:
    def prepare() -> Callable[[pa.Array], dict[str, pa.Array]]:
        tables = tables_of().astype(np.float32)
        noise = float(np.log(1.0 / SLOTS))

        def work(texts: pa.Array) -> dict[str, pa.Array]:
            found = np.zeros((len(texts), len(tables)))
            grams = np.zeros(len(texts), np.int64)
            for row0, row1, slots, bounds in _grams(texts):
                n = np.diff(bounds)
                grams[row0:row1] = n
                full = np.flatnonzero(n)
                for k, table in enumerate(tables):
                    if len(full):
                        found[row0 + full, k] = np.add.reduceat(table[slots], bounds[:-1][full], dtype=np.float64)
            mean = found / np.maximum(grams, 1)[:, None]
            fits = (grams == 0) | (mean.max(axis=1) > noise)
            evidence = found / (1.0 + grams / FULL_TEXT)[:, None]
            evidence -= evidence.max(axis=1, keepdims=True)
            flat = pa.array(evidence.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(tables)), flat)
            return {"text_evidence": lists, "grams": pa.array(grams), "fits": pa.array(fits)}
        return work
    return prepare


# --- fusion --------------------------------------------------------------------------------------
def _logs(counts: list[Column], totals: list[float], values: int) -> Column:
    """log P(value | language) of each language."""
    return F.array(*[F.log((n + VALUE_SMOOTHING) / F.lit(t + VALUE_SMOOTHING * (values + 1)))
                     for n, t in zip(counts, totals, strict=True)])


def _per_value(labelled: DataFrame, value: str, languages: list[str], totals: list[float]) -> DataFrame:
    """value -> evidence of a categorical value, from counts of (value, label) over the whole table."""
    counted = keep(labelled.where(F.col(value).isNotNull()).groupBy(value).agg(
        *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(len(languages))]), f"by-{value}")
    return keep(counted.select(value, _logs([F.col(f"n{k}") for k in range(len(languages))], totals,
                                            counted.count()).alias(f"{value}_evidence")), f"{value}-evidence")


def _host_priors(labelled: DataFrame, languages: list[str], totals: list[float]) -> DataFrame:
    """host -> log prior: host counts smoothed towards the domain's shares, those towards the table's."""
    every = sum(totals)
    share = [(t + 1.0) / (every + len(languages)) for t in totals]
    hosts = labelled.where(F.col("host").isNotNull()).groupBy("host", "domain").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(len(languages))])
    hosts = keep(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("d"),
                                          *[F.sum(f"n{k}").alias(f"d{k}") for k in range(len(languages))])
    prior = [F.log((F.col(f"n{k}") + HOST_WEIGHT * (F.col(f"d{k}") + DOMAIN_WEIGHT * share[k])
                    / (F.col("d") + DOMAIN_WEIGHT)) / (F.col("n") + HOST_WEIGHT)) for k in range(len(languages))]
    return keep(hosts.join(domains, "domain").select("host", F.array(*prior).alias("host_evidence")), "host-evidence")


def identify(docs: DataFrame, declared: Column | None = None, address: Column | None = None,
             host: Column | None = None, text_col: str = "text", languages: list[str] | None = None,
             min_probability: float = MIN_PROBABILITY, id_cols: list[str] | None = None) -> DataFrame:
    """row, language, probability, accepted of every row of ``docs``.

    ``declared``, ``address`` and ``host`` are columns of ``docs``; the host defaults to the address's.  With
    ``id_cols`` only those columns travel in ``row`` (a table of results needs no second copy of the texts).
    """
    none = F.lit(None).cast("string")
    host = host if host is not None else address_host(address) if address is not None else none
    carried = [F.col(f"`{x}`") for x in (id_cols or docs.columns)]
    given = docs.select(
        F.struct(*carried).alias("row"), F.col(text_col).cast("string").alias("text"),
        (primary_subtag(declared) if declared is not None else none).alias("declared"),
        (address_suffix(address) if address is not None else none).alias("suffix"),
        host.cast("string").alias("host"))
    known = sorted(r["declared"] for r in given.where(F.col("declared").isNotNull()).select("declared").distinct()
                   .limit(MAX_LANGUAGES + 1).collect())
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} declared languages")
    if not known:
        return given.select("row", F.lit("und").alias("language"), F.lit(0.0).alias("probability"),
                            F.lit(False).alias("accepted"))
    tables = docs.sparkSession.sparkContext.broadcast(trigram_tables(given, known))

    def scored_rows(rows: DataFrame) -> DataFrame:
        found = annotate(rows, _text_evidence(lambda: tables.value),
                         "text_evidence array<double>, grams long, fits boolean")
        return found.select("row.*", "text_evidence", "grams", "fits")

    # counts need the label and the other evidence of each row, not the row: texts are scored again at the end
    thin = scored_rows(given.select("text", "declared", "suffix", "host"))
    by_text = F.array_position("text_evidence", F.array_max("text_evidence")).cast("int") - 1
    by_name = F.array_position(F.array(*[F.lit(x) for x in known]), F.col("declared")).cast("int") - 1
    scored = keep(thin.select("declared", "suffix", "host", F.when(F.col("grams") > 0, by_text).otherwise(by_name)
                              .alias("label"), host_domain(F.col("host")).alias("domain")), "labels")

    counts = {r["label"]: float(r["n"]) for r in scored.where(F.col("label").isNotNull()).groupBy("label")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [counts.get(k, 0.0) for k in range(len(known))]
    fused = scored_rows(given).drop("text")
    evidence = ["text_evidence"]
    for value in ("declared", "suffix"):
        fused = fused.join(_per_value(scored, value, known, totals), value, "left")
        evidence.append(f"{value}_evidence")
    fused = fused.join(_host_priors(scored, known, totals), "host", "left")
    every = sum(totals)
    table_prior = F.array(*[F.lit(float(np.log((t + 1.0) / (every + len(known))))) for t in totals])
    fused = fused.withColumn("host_evidence", F.coalesce("host_evidence", table_prior))
    evidence.append("host_evidence")
    flat = F.array(*[F.lit(0.0)] * len(known))
    total = flat
    for part in evidence:
        total = F.zip_with(total, F.coalesce(F.col(part), flat), lambda a, b: a + b)
    fused = fused.withColumn("total", total).withColumn("best", F.array_max("total"))
    mass = F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    names = F.array(*[F.lit(x) for x in known])
    judged_by_something = (F.col("grams") > 0) | F.col("declared").isNotNull() | F.col("suffix").isNotNull()
    sure = judged_by_something & F.col("fits")
    language = F.when(sure, F.element_at(names, F.array_position("total", F.col("best")).cast("int"))).otherwise("und")
    probability = F.when(sure, 1.0 / mass).otherwise(0.0)
    out = fused.select("row", language.alias("language"), probability.alias("probability"))
    accepted = (F.col("language") != "und") & (F.col("probability") >= min_probability)
    if languages is not None:
        accepted = accepted & F.col("language").isin(*languages)
    return out.withColumn("accepted", accepted)


def language_table(docs: DataFrame) -> DataFrame:
    """op10: doc_id, language, probability (rounded), accepted; ``source`` stands in for the host."""
    return identify(docs, declared=F.col("lang"), host=F.col("source"), id_cols=["doc_id"]).select(
        "row.doc_id", "language", F.round("probability", 6).alias("probability"), "accepted")


def page_language_table(pages: DataFrame) -> DataFrame:
    """The same for raw pages: markup language, address suffix and host prior; tags are blanked before counting."""
    html = F.col("html")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    plain = pages.select("page_id", "url", text.alias("text"), declared.alias("declared"))
    return identify(plain, declared=F.col("declared"), address=F.col("url"), id_cols=["page_id"]).select(
        "row.page_id", "language", F.round("probability", 6).alias("probability"), "accepted")
