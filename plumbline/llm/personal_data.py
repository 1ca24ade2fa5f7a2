"""Personal data: fixed detectors, then bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from fixed patterns over whole texts; counts and ``base`` cover only those.
The method then looks for further identifiers:

* occurrences that overlap no base span: whole values behind a cue with ``=`` or ``:`` (up to the closing quote, or to
  the next blank or ``&name=`` without closing punctuation) of any characters, and tokens without such a cue that look
  like identifiers (``MIN_LENGTH`` characters, ``MIN_DIGITS`` digits).  Each has two lexical patterns: the cue to its
  left (``word=``, ``word = "`` or the word before) and its shape (runs of digits, hex, capitals ... with their
  lengths).  Values that do not look like identifiers have no shape, as equal words without a cue are not counted;
  values above ``MAX_VALUE`` characters are no values, so that nested cues of one long run cost bounded time;
* seeds: base spans, tokens of a seed shape, and the seed cues, which start with full confidence;
* the graph of patterns and instances (distinct strings) is scored in ``ROUNDS`` rounds by grouped sums: a pattern's
  confidence is its instances' mean score, smoothed so that a few instances prove nothing; an instance's score is
  the chance that at least one of its patterns is right; seeds keep theirs;
* occurrences with a pattern of at least ``MIN_CONFIDENCE`` are added as ``secret`` spans, but for those inside another.

Edges are aggregated before each shuffle and the graph is never collected.  Offsets are code points, ends exclusive;
spans are ordered by start, then kind.  Null and empty texts have no spans.  Rows that repeat are separate documents
with equal spans.  Without seeds or candidates nothing is added.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import annotate, keep

KINDS = ("email", "ip", "card", "phone", "secret")
#: A whole run of address characters, with the rest of the address if it is one: one pass over any text.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
#: Whole chains of dotted numbers; every four parts from the left are an address's.
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MIN_LENGTH = 8
MIN_DIGITS = 3
MAX_VALUE = 4096
ROUNDS = 3
SMOOTHING = 3.0
MIN_CONFIDENCE = 0.6
SEED_CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key")
SEED_SHAPES = re.compile(r"AKIA[0-9A-Z]{16}")

_DIGIT = re.compile(r"[0-9]")
_CANDIDATE = re.compile(r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*")
_CUE = re.compile(r"([A-Za-z_]{2,30})\s{0,2}[=:]\s{0,2}[\"']?\Z")
_MARK = re.compile(r"[=:]\s{0,2}")
_QUOTED = re.compile(r"\"([^\"\n]{1,%d})\"|'([^'\n]{1,%d})'" % (MAX_VALUE, MAX_VALUE))
_PLAIN = re.compile(r"[\"']?((?:(?![&,;][A-Za-z_]{2,30}[=:]|[\"'](?:[\s>,;)}\]]|\Z))\S){1,%d})" % (MAX_VALUE + 1))
_WORD_BEFORE = re.compile(r"([^\s]{1,30})\s\Z")
_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|.", re.S)
FIELDS = ("base array<struct<kind:string,start:int,end:int>>, "
          "seen array<struct<start:int,end:int,instance:string,cue:string,shape:string,seed:double,base:boolean>>")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in CHAIN.finditer(text):
        parts = chain[0].split(".")
        ends = list(accumulate((len(x) + 1 for x in parts), initial=chain.start() - 1))
        for i in range(0, len(parts) - 3, 4):
            # the length first: a number may have any number of digits
            if all(len(x) <= 3 or len(x.lstrip("0")) <= 3 for x in parts[i:i + 4]) and all(
                    int(x[-3:]) <= 255 for x in parts[i:i + 4]):
                yield ends[i] + 1, ends[i + 4]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text) if m[1]]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", a, b) for a, b in _addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def shape(token: str) -> str:
    """Character classes with lengths; long hexadecimal tokens count as one run."""
    if re.fullmatch(r"(?=.*[a-f])[0-9a-f]{12,}", token):
        return f"h{len(token)}"
    if re.fullmatch(r"(?=.*[A-Z])(?=.*[0-9])[0-9A-Z]{12,}", token):
        return f"{token[:4] if token[:4].isalpha() else ''}U{len(token)}"
    return "".join(f"{'9' if x[0].isdigit() else 'a' if x[0].islower() else 'A' if x[0].isupper() else x[0]}"
                   f"{len(x) if x[0].isalnum() else ''}" for x in _RUNS.findall(token))


def cue(text: str, start: int) -> str:
    before = text[max(0, start - 40):start]
    if m := _CUE.search(before):
        return f"{m[1].lower()}="
    if m := _WORD_BEFORE.search(before):
        return f"{m[1].lower()} "
    return ""


def _identifier_like(token: str) -> bool:
    return len(token) >= MIN_LENGTH and len(_digits(token)) >= MIN_DIGITS and _CANDIDATE.fullmatch(token) is not None


def values(text: str) -> list[tuple[int, int]]:
    """Places of the whole values behind cues with ``=`` or ``:``, by start."""
    out = []
    for mark in _MARK.finditer(text):
        if m := _QUOTED.match(text, mark.end()):
            a, b = m.span(m.lastindex)
        elif m := _PLAIN.match(text, mark.end()):
            a, b = m.start(1), m.start(1) + len(m[1].rstrip(".,;:)]}>\"'"))
        else:
            continue
        if a < b <= a + MAX_VALUE and cue(text, a).endswith("="):
            out.append((a, b))
    return out


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Base spans, values behind cues and identifier-like tokens beside them, with patterns and seed scores."""
    out = [{"start": a, "end": b, "instance": text[a:b], "cue": cue(text, a), "shape": shape(text[a:b]),
            "seed": 1.0, "base": True} for _, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    places = [(a, b) for a, b in values(text) if not any(x < b and a < y for x, y in taken)]
    begun = {a for a, _ in places}
    if _DIGIT.search(text):
        places += [m.span() for m in _CANDIDATE.finditer(text) if m.start() not in begun and _identifier_like(m[0])
                   and not any(x < m.end() and m.start() < y for x, y in taken)]
    for a, b in sorted(places):
        token = text[a:b]
        known = _identifier_like(token)
        out.append({"start": a, "end": b, "instance": token, "cue": cue(text, a), "shape": shape(token) if known else "",
                    "seed": 1.0 if SEED_SHAPES.fullmatch(token) else 0.0, "base": False})
    return out


def _scan() -> Callable[[pa.Array], dict[str, pa.Array]]:
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    seen = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()),
                               ("cue", pa.string()), ("shape", pa.string()), ("seed", pa.float64()),
                               ("base", pa.bool_())]))

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        found, every = [], []
        for scalar in texts:
            text = scalar.as_py() or ""
            base = base_spans(text)
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            # a digest stands for the string in every table that is written
            every.append([x | {"instance": hashlib.blake2b(x["instance"].encode("utf-8", "surrogatepass"),
                                                           digest_size=12).hexdigest()}
                          for x in occurrences(text, base)])
        return {"base": pa.array(found, spans), "seen": pa.array(every, seen)}
    return work


def confident_patterns(seen: DataFrame, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> DataFrame:
    """pattern, confidence from occurrences (instance, cue, shape, seed)."""
    edges = seen.select("instance", "seed", F.explode(F.array(
        F.concat(F.lit("cue:"), "cue"), F.concat(F.lit("shape:"), "shape"))).alias("pattern"))
    edges = keep(edges.where("pattern NOT IN ('cue:', 'shape:')").groupBy("instance", "pattern").agg(F.max("seed").alias("seed")), "edges")
    given = F.col("pattern").isin(*[f"cue:{x}=" for x in SEED_CUES])
    score = edges.groupBy("instance").agg(F.max("seed").alias("score"))
    for _ in range(rounds):
        patterns = keep(edges.join(score, "instance").groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + smoothing)).alias("confidence"))
            .withColumn("confidence", F.when(given, F.lit(1.0)).otherwise(F.col("confidence"))), "patterns")
        wrong = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        score = edges.join(patterns, "pattern").groupBy("instance").agg(
            F.greatest(F.max("seed"), 1 - F.exp(wrong)).alias("score"))
    return patterns


def find_personal_data(docs: DataFrame, text_col: str = "text", id_cols: list[str] | None = None,
                       min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """row, base, spans: arrays of (kind, start, end) of every row; ``row`` holds ``id_cols`` (default: all columns)."""
    carried = F.struct(*[F.col(f"`{x}`") for x in (id_cols or docs.columns)]).alias("row")
    boxed = docs.select(carried, F.col(text_col).cast("string").alias("text"))
    found = annotate(boxed, _scan, FIELDS).select("row.row", "base", "seen").withColumn(
        "uid", F.monotonically_increasing_id())
    found = keep(found, "occurrences")
    seen = found.select("uid", F.explode("seen").alias("s")).select("uid", "s.*")
    patterns = confident_patterns(seen).where(F.col("confidence") >= min_confidence).select("pattern")
    patterns = keep(patterns, "confident-patterns")
    new = seen.where("NOT base").select("uid", "start", "end", F.explode(F.array(
        F.concat(F.lit("cue:"), "cue"), F.concat(F.lit("shape:"), "shape"))).alias("pattern"))
    added = new.join(patterns, "pattern", "left_semi").select("uid", "start", "end").distinct()
    before = Window.partitionBy("uid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    added = (added.withColumn("reached", F.max("end").over(before)).where("reached IS NULL OR reached < end").groupBy("uid")
             .agg(F.collect_set(F.struct(F.lit("secret").alias("kind"), "start", "end")).alias("added")))
    merged = found.join(added, "uid", "left").withColumn(
        "all", F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))))
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform("all", lambda x: F.struct(
        x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["kind"].alias("kind"),
        x["end"].alias("end"))))
    return merged.select("row", "base", F.transform(ranked, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def _listed(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")


def personal_data_table(docs: DataFrame) -> DataFrame:
    """op5: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    found = find_personal_data(docs, id_cols=["doc_id"])

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("row.doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_listed("base"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))
