"""The corpus operators on small fixtures: odd rows, empty tables, and brute-force versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import _tokens, exact, langid, lines, media, mixing, packing, sharding, simhash, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` int, _lf_key string, n int, `a.b` int"
random.seed(4)
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(random.choices(WORDS, k=70))
LINE = "the very same line of more than thirty characters"


def prose(k, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=k))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text) if text is not None else None, 1, "x", 2, 3)


@pytest.fixture(scope="module")
def rows():
    near = prose(300, 9)
    return [
        row(1, prose(200, 1)), row(2, prose(200, 1)), row(2, prose(200, 1)), row(3, None, None, None), row(4, ""), row(5, "   \n"), row(None, prose(50, 2), None), row(6, near), row(7, near + " w1", source="b"),
        row(8, prose(40, 3) + " " + PASSAGE + " " + prose(40, 4)), row(9, prose(30, 5) + " " + PASSAGE + " " + prose(60, 6), "de", "b"), row(10, f"one\n{LINE}\ntwo"), row(11, f"three\n{LINE}\nfour\n{LINE}"),
        row(12, " ".join(["long"] * 30000)), row(13, "x" * 200000, "de", "c"), row(14, "\n".join(["a", "b", "a", "b", "c"])),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups_are_those_of_equal_texts(docs, empty, rows):
    got = sorted(((r["doc_id"], r["keep_id"], r["copies"]) for r in exact.exact_groups(docs).collect()), key=repr)
    same = lambda t: [r[0] for r in rows if r[1] == t]
    want = sorted(((r[0], min((i for i in same(r[1]) if i is not None), default=None), len(same(r[1]))) for r in rows), key=repr)
    assert got == want and exact.exact_groups(empty).count() == 0


def test_line_runs_and_what_is_left(docs, empty):
    got = {(r["doc_id"], r["start_line"], r["n_lines"]) for r in lines.repeated_runs(docs).collect()}
    assert {(11, 1, 1), (11, 3, 1), (14, 2, 2)} <= got and not any(r[0] in (10, 8, 9) for r in got)
    left = lines.drop_repeated_lines(docs, chars_col="n_chars")
    assert left.columns == docs.columns
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    assert text[11] == ("three\nfour", 10) and text[14] == ("a\nb\nc", 5) and text[10][0] == f"one\n{LINE}\ntwo" and 3 in text
    assert lines.repeated_runs(empty).count() == 0 and lines.drop_repeated_lines(empty).count() == 0


def test_near_groups(docs, empty):
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_groups(docs).collect()}
    assert got[2] == 1 and got[7] == 6 and got[8] == 8 and got[3] == 3 and got[4] == 4
    assert simhash.drop_near_copies(docs).count() == 13 and simhash.near_groups(empty).count() == 0


def test_deletion_variants_are_shared_where_a_segment_differs_by_one_bit(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 12, dtype=np.int64)
    rows = []
    for i, x in enumerate(base):
        other = int(np.uint64(x))
        for b in rng.choice(64, int(rng.integers(1, 7)), False):
            other ^= 1 << int(b)
        rows += [(2 * i, int(x)), (2 * i + 1, int(np.int64(np.uint64(other))))]
    prints = spark.createDataFrame([(i, s, *(int(t) for t in rng.integers(0, 2**62, simhash.TABLES - 1))) for i, s in rows], ["sid", *(f"s{t}" for t in range(simhash.TABLES))])
    keys = {}
    for r in simhash.variants(prints, "sid").collect():
        keys.setdefault(r["key"], set()).add(r["sid"])
    assert sum(map(len, keys.values())) == 24 * 64 * simhash.TABLES
    met = {(a, b) for s in keys.values() for a in s for b in s if a < b}
    sign = dict(rows)
    parts = lambda a, b: [((sign[a] ^ sign[b]) >> s & 0xFFFFFFFF).bit_count() for s in (0, 32)]
    assert met == {(a, b) for a in sign for b in sign if a < b and min(parts(a, b)) <= 1}


def test_mixing_keeps_to_weights_and_budget(spark, docs, empty):
    many = spark.createDataFrame([row(i, "w " * 10, source="ab"[i % 2]) for i in range(400)], SCHEMA)
    got = mixing.mix_plan(many, {"a": 3.0, "b": 1.0}, budget=2000).collect()
    assert sum(r["n_tokens"] for r in got) == 2000 and sum(r["source"] == "a" for r in got) == pytest.approx(150, abs=1)
    assert mixing.mix(docs, budget=10**9).count() == docs.count() and mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(empty).count() == 0


def test_packing_places_every_token_once(docs, empty, rows):
    got = packing.pack_windows(docs).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((r[1] or "").split()) for r in rows)
    used = {}
    for r in got:
        assert r["window_offset"] + r["n_tokens"] <= r["tier"]
        spot = used.setdefault((r["tier"], r["shard"], r["window"]), [])
        assert all(r["window_offset"] >= e or r["window_offset"] + r["n_tokens"] <= s for s, e in spot)
        spot.append((r["window_offset"], r["window_offset"] + r["n_tokens"]))
    assert packing.pack_windows(empty).count() == 0


def test_passages_are_those_of_all_windows(docs, empty, rows):
    got = substring.repeated_passages(docs.filter("doc_id in (8, 9)")).collect()
    a, b = (next(r[1] for r in rows if r[0] == i).split() for i in (8, 9))
    assert [(r["doc_id"], r["source_doc_id"]) for r in got] == [(9, 8)]
    r = got[0]
    assert r["n_tokens"] >= 70 and b[r["start_token"] :][: r["n_tokens"]] == a[r["source_start_token"] :][: r["n_tokens"]]
    assert substring.repeated_passages(docs).count() > 0 and substring.repeated_passages(empty).count() == 0


def test_passages_of_edited_copies_are_those_of_all_windows(spark):
    r = random.Random(5)
    texts = []
    for g in range(4):
        base = [f"g{g}t{i}" for i in range(300)]
        texts += [[f"e{g}c{c}t{i}" if r.random() < 0.03 else w for i, w in enumerate(base)] for c in range(30)]
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            window = tuple(t[i : i + 50])
            if window in seen:
                want |= {(d, x) for x in range(i, i + 50)}
            seen.add(window)
    got = set()
    for x in substring.repeated_passages(spark.createDataFrame([row(d, " ".join(t)) for d, t in enumerate(texts)], SCHEMA)).collect():
        a, b, n = x["start_token"], x["source_start_token"], x["n_tokens"]
        assert n >= 50 and texts[x["doc_id"]][a : a + n] == texts[x["source_doc_id"]][b : b + n]
        got |= {(x["doc_id"], i) for i in range(a, a + n)}
    assert len(want - got) == 0, (len(want), len(want - got))
    assert not got - want


def test_languages(spark, docs, empty):
    words = {"x": "alpha bravo charlie delta", "y": "uno dos tres cuatro"}
    known = spark.createDataFrame([row(i, " ".join(random.Random(i).choices(words[lang].split(), k=80)), lang) for lang in words for i in range(20)], SCHEMA)
    model = langid.fit(known)
    asked = spark.createDataFrame([row(1, "bravo alpha delta charlie " * 9), row(2, "tres uno dos cuatro " * 9), row(3, None), row(4, " ")], SCHEMA)
    got = {r["doc_id"]: (r["predicted"], r["accepted"]) for r in langid.identify(asked, model).collect()}
    assert got == {1: ("x", True), 2: ("y", True), 3: (None, False), 4: (None, False)}
    assert langid.keep_identified(asked, model).count() == 2 and langid.fit(empty) == {}
    assert langid.identify(docs, langid.fit(docs)).count() == docs.count() and langid.identify(docs, {}).filter("accepted").count() == 0


def test_languages_of_long_texts(spark):
    r = random.Random(8)
    words = {lang: ["".join(r.choices(letters, k=r.randint(3, 9))) for _ in range(3000)] for lang, letters in (("x", "abcdefghijkl"), ("y", "hijklmnopqrstuvw"))}
    known = spark.createDataFrame([row(i, " ".join(random.Random(i).choices(words[lang], k=300)), lang) for lang in words for i in range(30)], SCHEMA)
    model = langid.fit(known)
    long = {lang: " ".join(random.Random(77).choices(words[lang], k=200000)) for lang in words}
    assert all(len(t) > 1 << 20 for t in long.values())
    got = {r["doc_id"]: (r["predicted"], r["accepted"], r["margin"]) for r in langid.identify(spark.createDataFrame([row(i, long[lang][:n]) for lang in words for i, n in ((ord(lang), None), (-ord(lang), 10000))], SCHEMA), model).collect()}
    for lang in words:
        assert got[ord(lang)][:2] == (lang, True) and got[ord(lang)][2] > got[-ord(lang)][2] / 2


def test_toxicity_neighbours_are_exact_and_scores_hold_out(spark, docs, empty):
    texts = [f"{prose(40, i)} {'vile slur ' * (i % 3 + 1) if i % 4 == 0 else ''}" for i in range(160)]
    corpus = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    said = {r["doc_id"]: r["toxic"] for r in toxicity.score(corpus, toxicity.fit(corpus, labels)).collect()}
    assert all(said[i] == (i % 4 == 0) for i in range(120, 160))
    index = toxicity.fit(corpus, labels)
    assert all(len(r["evidence"]) == 5 for r in toxicity.score(corpus, index, k=5).collect())
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("toxic").count() == 0 and toxicity.score(empty, index).count() == 0


def test_shards_are_even_and_cut_less(spark, docs, empty):
    linked = spark.createDataFrame([row(i, f"a\nthis line joins group {i // 5} and no other one\n{i}") for i in range(200)], SCHEMA)
    got = sharding.shard(linked, shards=4, rounds=6).collect()
    sizes = np.bincount([r["shard"] for r in got], minlength=4)
    assert len(got) == 200 and sizes.max() <= 52
    where = {r["doc_id"]: r["shard"] for r in got}
    cut = sum(where[i] != where[i - i % 5] for i in range(200))
    assert cut < 90  # 120 of 160 links are cut by chance
    assert sharding.shard(docs, shards=3, rounds=2).count() == docs.count() and sharding.shard(empty).count() == 0


@pytest.mark.parametrize("group", [2, 5])
def test_small_groups_come_together(spark, group):
    n = 120 * group
    linked = spark.createDataFrame([row(i, f"a\nthis line joins group {i // group} and no other one\n{i}") for i in range(n)], SCHEMA)
    where = {r["doc_id"]: r["shard"] for r in sharding.shard(linked, shards=4).collect()}
    assert np.bincount(list(where.values()), minlength=4).max() <= int(1.05 * n / 4)
    cut = sum(where[i] != where[i - i % group] for i in range(n))
    assert cut <= 0.05 * (n - n // group)  # 75 % by chance


def _one_block(block):
    predictor, at = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [predictor]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[at])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            predictor = max(-32768, min(32767, predictor - change if code & 8 else predictor + change))
            at = max(0, min(88, at + int(media.MOVES[code])))
            out.append(predictor)
    return out


def test_audio(spark, docs, empty):
    assert media.MULAW[0] == -32124 and media.MULAW[128] == 32124 and media.MULAW[255] == 0 and media.ALAW[0xD5] == 8 and media.ALAW[0x55] == -8 and media.ALAW[0x2A] == -32256
    data = np.random.default_rng(3).integers(0, 256, 256 + 100 + 2, dtype=np.uint8)
    got, at = media.decode("adpcm", data, np.array([0, 356, 356, 358]))
    assert at.tolist() == [0, 505 + 193, 698, 698] and got.tolist() == _one_block(data[:256].tolist()) + _one_block(data[256:356].tolist())
    t = np.arange(4000)
    tone = np.rint(8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    for to in (16000, 22050, 8000):
        out, _ = media.resample(tone, np.array([0, 4000]), 8000, to)
        want = 8000 * np.sin(2 * np.pi * 440 * np.arange(len(out)) / to)
        assert abs(out - want)[200:-200].max() < 60
    rows = {r["doc_id"]: r for r in media.store_pcm(docs, F.col("text"), media.as_calls()).collect()}
    assert rows[3]["pcm"] is None and rows[4]["n_samples"] == 0 and len(rows[13]["pcm"]) == 2 * rows[13]["n_samples"] == 4 * 200000
    assert media.store_pcm(empty, F.col("text"), media.as_calls()).count() == 0


def test_words_hash_alike_wherever_they_stand():
    word, at = _tokens.words(pa.array(["one two", None, "two  one"]))
    assert at.tolist() == [0, 2, 2, 4] and word[0] == word[3] and word[1] == word[2] and word[0] != word[1]
