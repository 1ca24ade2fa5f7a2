"""Operators against brute force, round trips and held-out accuracy on a small planted corpus."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (
    common, decontamination, jaccard_join, language, line_dedup, packing, personal_data, quality, substring_dedup,
    token_files, tokens, warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "é eau oi ai le que ou aux en ç".split(),
             "de": "sch ei ung ü ver ich en keit ge ß".split()}


SECRETS = range(10, 20)


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))


def corpus():
    rnd = random.Random(7)
    docs = []
    for i in range(90):
        lang = rnd.choice(list(SYLLABLES))
        lines = [sentence(rnd, lang, rnd.randint(4, 14)) + "." for _ in range(rnd.randint(2, 16))]
        docs.append([i, "\n".join(lines), lang])
    passage = "\n".join(sentence(rnd, "en", 12) for _ in range(40))
    for i in range(90, 100):  # exact and near copies, a shared passage, junk
        text = docs[i - 90][1]
        if i % 2:
            words = text.split(" ")
            words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        docs.append([i, text, docs[i - 90][2]])
    for i in range(100, 106):
        docs.append([i, f"{sentence(rnd, 'en', 9)}\n{passage}\n{sentence(rnd, 'en', 9)}", "en"])
    for i in range(106, 130):
        docs.append([i, " ".join(w + "###" for w in sentence(rnd, "en", 40).split()), "en"])
    docs[3][1] += " mail bob.1@mail.example.com or +1 (555) 123-4567, 10.0.0.255 and 4111 1111 1111 1111 300.1.1.1"
    for i in SECRETS:
        docs[i][1] += f' token = "{hashlib.sha1(b"%d" % i).hexdigest()}" tail'
    docs[30][1] += " loose " + hashlib.sha1(b"loose").hexdigest() + " end"
    return [(i, t, lang, f"src{i % 3}", len(t)) for i, t, lang in docs]


ROWS = corpus()
TEXTS = {r[0]: r[1] for r in ROWS}
BENCH = [(1, " ".join(TEXTS[5].split()[3:18])), (2, "no such words anywhere at all in any of these texts"),
         (3, TEXTS[6].split()[0] + " " + TEXTS[6].split()[1]), (4, "single-unseen")]


@pytest.fixture(scope="module")
def docs(spark):
    common.import_path(spark)
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- tokens, files, packing ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "It's DON'T 'S x'y", "É̈ é ﬁ Ⅷ ½ İ ß ẞ ΑΣ", "a,b. c.. d,. e., f.\ng,\th. 1.5, é, ü.", "<|endoftext|> x<|ENDOFTEXT|>",
    "tab\x0bvt\x0cff\x1cfs\x85nel\xa0nbsp ls　", "😀👍🏽 日本語 العربية हिन्दी", "a\x00b �", "ABC.DEF,ghi !?#$ _-_ ++",
])
def test_pieces_give_the_tokenizers_ids(ids, text):
    assert np.frombuffer(tokens.PieceEncoder().encode_all([text.encode()])[0], "<u4").tolist() == ids(text)


def test_small_memory_changes_nothing(ids):
    encoder = tokens.PieceEncoder(remembered=50)
    texts = list(TEXTS.values())
    for at in range(0, len(texts), 7):
        for text, got in zip(texts[at:], encoder.encode_all([t.encode() for t in texts[at:at + 7]]), strict=False):
            assert np.frombuffer(got, "<u4").tolist() == ids(text)


def test_token_files_round_trip(spark, docs, ids, tmp_path):
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t")
    start = 0
    got = by_id(token_files.read_token_files(manifest))
    for i in sorted(TEXTS):
        want = tokens.packed(ids(TEXTS[i]) + [2])
        assert (got[i]["start"], got[i]["n_tokens"], bytes(got[i]["ids"])) == (start, len(want) // 4, want)
        start += len(want) // 4
    some = spark.createDataFrame([(3,), (3,), (77,), (5000,)], "doc_id long")
    assert by_id(token_files.read_documents(manifest, some)) == {i: got[i] for i in (3, 77)}
    import zstandard
    stream = b"".join(zstandard.ZstdDecompressor().stream_reader(open(r["path"].removeprefix("file://"), "rb"),
                                                                 read_across_frames=True).read()
                      for r in manifest.orderBy("shard").collect())
    assert stream == b"".join(bytes(got[i]["ids"]) for i in sorted(TEXTS))  # any zstandard reader sees the ids


def test_only_wanted_frames_are_read_and_damage_is_found(tmp_path):
    path = tmp_path / "one"
    with open(path, "wb") as f:
        writer = token_files.ShardWriter(f, frame_bytes=64)
        for i in range(50):
            writer.add(i, bytes(range(i % 40)) * 4)
        writer.close()
    shard = token_files.ShardReader(open(path, "rb"))
    seen = []
    whole = shard.frame
    shard.frame = lambda k: seen.append(k) or whole(k)
    assert shard.ids(39) == bytes(range(39)) * 4 and len(set(seen)) <= 4 < len(shard.frames)
    data = bytearray(path.read_bytes())
    data[int(shard.at[seen[0]]) + 12] ^= 0xFF
    path.write_bytes(data)
    with pytest.raises((ValueError, __import__("zstandard").ZstdError)):
        token_files.ShardReader(open(path, "rb")).ids(39)


def check_packing(rows, ids, size=2048):
    bins = collections.defaultdict(list)
    for r in rows:
        want = (ids(TEXTS[r["doc_id"]]) + [0])[r["start"]:r["start"] + size]
        assert r["length"] == len(want) and r["ids_crc32"] == zlib.crc32(tokens.packed(want)) and r["start"] == size * r["piece"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return bins


def test_packed_documents(docs, ids):
    rows = packing.packed_documents(docs).collect()
    bins = check_packing(rows, ids)
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert len(rows) == sum(-(-(len(ids(t)) + 1) // 2048) for t in TEXTS.values())


def one_by_one(lengths, capacity, score):
    """Vector best fit, piece by piece; residuals of the bins."""
    full = capacity.vector()
    weight = 1 / full
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [i for i, r in enumerate(bins) if (r >= need).all()]
        if not fits:
            bins.append(full - need)
            continue
        if score == "norm":
            best = min(fits, key=lambda i: round(float((((bins[i] - need) * weight) ** 2).sum()), 12))
        else:
            best = max(fits, key=lambda i: round(float((bins[i] * weight) @ (need * weight)), 12))
        bins[best] = bins[best] - need
    return sorted(tuple(int(x) for x in r) for r in bins)


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(64), packing.Capacity(64, documents=3),
                                      packing.Capacity(64, documents=5, attention=1500)])
def test_groups_of_equal_bins_fill_as_single_pieces_do(capacity, score):
    rnd = random.Random(3)
    most = int(min(64, (capacity.attention or 4096) ** 0.5))
    lengths = [rnd.randint(1, most) for _ in range(300)]
    runs = packing.place(collections.Counter(lengths), capacity, score)
    room = collections.defaultdict(lambda: capacity.vector().copy())
    placed = collections.Counter()
    for length, first, n, start, per, offset in runs.tolist():
        for r in range(n):
            b = start + r // per
            assert capacity.tokens - room[b][0] == offset + (r % per) * length
            room[b] -= np.array([length, 1, length * length])
            placed[length, first + r] += 1
    assert all(v == 1 for v in placed.values()) and len(placed) == len(lengths)
    assert all((r >= 0).all() for r in room.values())
    want = one_by_one(lengths, capacity, score)
    assert len(room) <= len(want) + 1  # ties between equal scores may fall differently


# --- words, lines, shingles ------------------------------------------------------------------------
def test_words_and_hashes():
    table = common.byte_table(common.SPACES, fold_case=True)
    texts = ["", None, "A b\tA", " é\x0b\x0c ", "x" * 5000 + " y"]
    blocks = list(common.word_blocks(pa.array(texts), table, limit=8))
    words = [w for b in blocks for r in range(b.row1 - b.row0)
             for w in (bytes(b.data[s:e]) for s, e in zip(b.start[b.first[r]:b.first[r + 1]], b.end[b.first[r]:b.first[r + 1]], strict=True))]
    assert words == [w for t in texts if t for w in t.encode().split()]
    a, b, a2 = blocks[[i for i, x in enumerate(blocks) if len(x.hash) == 3][0]].hash
    assert a == a2 != b
    h = np.arange(20, dtype=np.uint64)
    for k in (1, 3, 7, 20):
        assert len(common.ngrams(h, k)) == 21 - k and len(set(common.ngrams(h, k).tolist())) == 21 - k


def test_line_dedup_matches_a_plain_loop(docs):
    table = common.byte_table(b"\n", fold_case=False)
    got, seen = by_id(line_dedup.line_table(docs)), set()
    for i in sorted(TEXTS):
        text = TEXTS[i].encode()
        lines, at = [], 0
        for line in text.split(b"\n"):
            if line:
                lines.append((at, at + len(line)))
            at += len(line) + 1
        bounds = line_dedup.chunk_bounds(next(common.word_blocks(pa.array([TEXTS[i]]), table)).hash)
        cut, removed = [], 0
        for a, b in itertools.pairwise(bounds):
            piece = text[lines[a][0]:lines[b - 1][1]]
            if b - a > 1 and piece in seen:
                cut.append((lines[a][0], len(piece)))
                removed += b - a
            if b - a > 1:
                seen.add(piece)
        kept = line_dedup.cut_text(text, cut)
        assert got[i] == {"doc_id": i, "n_lines": len(lines), "n_removed_lines": removed,
                          "kept_sha256": hashlib.sha256(kept).hexdigest()}
    assert sum(r["n_removed_lines"] for r in got.values()) > 40
    assert all(got[i]["n_removed_lines"] >= 6 for i in range(101, 106))  # the passage was found at another offset


def brute_components(k, num, den):
    sets = {}
    for i, t in TEXTS.items():
        w = WORD.findall(fold(t))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {i: lo if v == hi else v for i, v in label.items()}
    return sets, label


@pytest.mark.parametrize(("k", "threshold"), [(3, (90, 100)), (5, (80, 100)), (1, (50, 100))])
def test_components_are_exact(docs, k, threshold):
    sets, label = brute_components(k, *threshold)
    got = by_id(jaccard_join.linked_components(docs, k, threshold))
    assert {i: (len(sets[i]), label[i]) for i in sets} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}
    assert len(set(label.values())) < len(label)


def test_linked_sets_share_a_part_key():
    rnd = random.Random(5)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        tops = jaccard_join.band_tops((num, den), 4096)
        for _ in range(150):
            n = rnd.choice((1, 2, 5, 9, 10, 11, 20, 60, 300))
            a = {rnd.getrandbits(63) for _ in range(n)}
            b = set(a)
            while True:  # as different as the threshold allows
                c = set(b)
                if rnd.random() < 0.5 and len(c) > 1:
                    c.remove(next(iter(c)))
                else:
                    c.add(rnd.getrandbits(63))
                if den * len(a & c) < num * len(a | c):
                    break
                b = c
            keys = [set(jaccard_join.part_keys(np.array(sorted(x), np.uint64), (num, den), tops).tolist()) for x in (a, b)]
            assert keys[0] & keys[1], (n, len(b))


# --- repeats, benchmark, personal data, quality, language --------------------------------------------
@pytest.mark.parametrize("group_rows", [200_000, 2, 1])
def test_repeated_windows_match_a_plain_loop(docs, group_rows):
    words = {i: t.encode().split() for i, t in TEXTS.items()}
    for window, gram in ((35, 8), (12, 4)):
        seen = collections.Counter(tuple(w[j:j + window]) for w in words.values() for j in range(len(w) - window + 1))
        got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, window, gram, group_rows).select(
            "row.doc_id", "n_words", "n_removed", "kept_text").collect()}
        for i, w in words.items():
            gone = {p for j in range(len(w) - window + 1) if seen[tuple(w[j:j + window])] > 1 for p in range(j, j + window)}
            left = b" ".join(x for p, x in enumerate(w) if p not in gone).decode()
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), len(gone), left), (window, i)
        assert got[102]["n_removed"] >= 100


def test_contamination_both_ways(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = {}
    for item, text in BENCH:
        w = pattern.findall(fold(text))
        k = min(10, len(w))
        for j in range(len(w) - k + 1):
            items.setdefault(tuple(w[j:j + k]), set()).add(str(item))
    want = {}
    for i, t in TEXTS.items():
        w, hit, found = pattern.findall(fold(t)), set(), set()
        for k in {len(x) for x in items}:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in items:
                    hit |= set(range(j, j + k))
                    found |= items[tuple(w[j:j + k])]
        want[i] = (len(w), len(hit), sorted(found))
    for limit in (1_000_000, 0):
        got = decontamination.contamination(docs, bench, broadcast_windows=limit).select(
            "row.doc_id", "n_words", "n_hit", "items").collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    assert sum(n > 0 for _, n, _ in want.values()) >= 2


def test_personal_data(docs):
    got = by_id(personal_data.personal_data_table(docs))
    three = got[3]
    assert (three["n_email"], three["n_ip"], three["n_card"], three["n_phone"]) == (1, 1, 1, 1)
    text = TEXTS[3]
    at = [("email", "bob.1@mail.example.com"), ("phone", "+1 (555) 123-4567"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111 300")]
    listed = ",".join(f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in at[:3])
    assert three["spans"].startswith(listed)
    for i in SECRETS:  # cue and shape of the seed cue
        (kind, a, b), = [s.split(":") for s in got[i]["spans"].split(",")]
        assert kind == "secret" and len(TEXTS[i][int(a):int(b)]) == 40
    assert got[30]["spans"].startswith("secret:")  # same shape, no cue: the pattern was learnt
    assert all(not r["spans"] for i, r in got.items() if i not in (3, 30, *SECRETS))
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")


def test_quality_base_and_held_out_accuracy(spark, docs):
    good = {i: int(i < 106) for i in TEXTS}
    labels = spark.createDataFrame([(i, v, 0) for i, v in good.items() if i % 2], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_table(docs, labels))
    for i, t in TEXTS.items():
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        again = {p for j in range(len(w) - 7) if grams[tuple(w[j:j + 8])] > 1 for p in range(j, j + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
                "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
                "base_failed": len(w) < 20 or 100 * len(again) > 30 * len(w)}
        assert {k: got[i][k] for k in want} == want
    held = [(good[i], got[i]["kept"]) for i in TEXTS if not i % 2 and not got[i]["base_failed"]]
    assert all(bool(a) == b for a, b in held) and len({a for a, _ in held}) == 2


def test_language_held_out_and_wrong_declarations(spark, docs):
    # a fifth of the rows declare nothing, another tenth the wrong language
    wrong = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 10 == 1, "fr").otherwise(F.col("lang"))
    declared = docs.where("doc_id < 106").withColumn("said", wrong)
    found = language.identify(declared, declared=F.col("said"), host=F.col("source")).select("row.doc_id", "row.lang", "language", "accepted").collect()
    assert sum(r["lang"] == r["language"] for r in found) >= 0.97 * len(found) and all(r["accepted"] for r in found)
    url = spark.createDataFrame([("https://a.example.com/FR/x", "fr"), ("http://u@www.b.de:80/page", "de"), ("http://x.org/english", None),
                                 ("nonsense", None), (None, None)], "u string, want string")
    assert all(r["got"] == r["want"] for r in url.withColumn("got", language.address_suffix(F.col("u"))).collect())


def test_warc_round_trip(spark, tmp_path):
    common.import_path(spark)
    pages = [(i, f"http://h/{i}", "<p>" + "é" * (60 + i % 4) + "</p>") for i in range(40)]
    resolved = warc.resolve(spark.createDataFrame(pages, "page_id long, url string, html string"))
    manifest = warc.write_warc(resolved, f"file://{tmp_path}/w", file_bytes=500)
    records = {r["page_id"]: r for r in warc.read_warc(manifest).collect()}
    assert len(records) == 40 and sum(r["n_records"] for r in manifest.collect()) == 40 and manifest.count() > 4
    for i, url, html in pages:
        r = records[i]
        assert r["url"] == url and r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i < 4 else ("revisit", i % 4))
        assert (bytes(r["payload"]).decode() == html) if i < 4 else (r["payload"] is None and r["refers_to_record"] == records[i % 4]["record_id"])


# --- pipeline ------------------------------------------------------------------------------------------
def test_pipeline_against_brute_force(spark, docs, ids, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder, global_texts = str(tmp_path), dict(TEXTS)
    kept = {r["doc_id"] for r in corpus_pipeline.language_identification(spark, docs, folder).collect()}
    assert kept == set(TEXTS)  # every row has a language
    lines = corpus_pipeline.line_dedup(spark, docs, folder)
    plain = {r["row"]["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t for i, t in plain.items() if t.strip()}
    final = {r["doc_id"]: r["text"] for r in lines.collect()}
    try:
        TEXTS.clear()
        TEXTS.update(final)
        _, label = brute_components(5, 80, 100)
        one = {r["doc_id"] for r in corpus_pipeline.jaccard_join(spark, lines, folder).collect()}
        assert one == {min(i for i in label if label[i] == v) for v in set(label.values())}
        hit = {r["row"]["doc_id"] for r in decontamination.contamination(
            docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect() if r["contaminated"]}
        assert hit
        rows = corpus_pipeline.run(spark, folder).collect()
        check_packing(rows, ids)
        assert {r["doc_id"] for r in rows} <= one and {r["doc_id"] for r in rows} >= one - hit
    finally:
        TEXTS.clear()
        TEXTS.update(global_texts)
