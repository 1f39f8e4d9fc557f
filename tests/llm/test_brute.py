"""The corpus operators against plain versions of themselves, on rows with nulls, copies, ties, clashing columns and hot groups."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import _tokens, langid, lines, media, mixing, packing, sharding, simhash, substring, toxicity
from lumenframe.llm._common import discard, keyed, materialize

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `KEY` int, _lf_key string, `a.b` int"


def frame(spark, rows):
    """Rows of (id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, 1, "x", 2) for i, t, lang, s in rows], SCHEMA)


def words_of(seed, k, vocabulary=500):
    r = random.Random(seed)
    return [f"w{min(int(r.paretovariate(0.6)), vocabulary)}q{seed % 7}" if r.random() < 0.4 else f"t{r.randrange(10**6)}" for _ in range(k)]


def edited(words, seed, share):
    r = random.Random(seed)
    return [f"e{r.randrange(10**6)}" if r.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    """(id, text, lang, source): a hot source, edited and exact copies, shared lines and passages, nulls, empty and very long texts."""
    syllables = {"xx": ["ka", "lo", "mi", "ten", "ra", "vos"], "yy": ["üb", "ersch", "nach", "gen", "tz", "orm"]}
    r = random.Random(3)
    say = {lang: ["".join(r.choices(s, k=r.randint(2, 5))) for _ in range(400)] for lang, s in syllables.items()}
    prose = lambda lang, k, seed: " ".join(random.Random(seed).choices(say[lang], k=k))
    rows = [(i, prose("xx" if i % 3 else "yy", 60 + i, i), "xx" if i % 3 else "yy", "hot" if i % 2 else f"src{i % 4}") for i in range(40)]
    base = prose("xx", 300, 777).split()
    rows += [(100 + i, " ".join(edited(base, i, 0.02 * (i % 3))), "xx", "hot") for i in range(8)]
    shared = prose("xx", 12, 5)
    rows += [(200 + i, f"{prose('xx', 30, 900 + i)}\n{shared}\n{prose('xx', 20, 950 + i)}\nab\ncd", "xx", "src1") for i in range(6)]
    rows += [(300, None, "xx", "src1"), (301, "", "xx", "src2"), (302, " \n\t", None, None), (303, shared + "\n" + shared, "xx", "src3"), (304, prose("yy", 40000, 31), "yy", "src2")]
    rows += [(305, "!!! ??? ...", "xx", "src3"), (306, "\n".join(["same short"] * 9), "yy", "src0")]
    return rows


def test_language_is_that_of_the_smallest_compression(spark, corpus):
    docs = frame(spark, corpus)
    model = langid.fit(docs)
    assert sorted(model) == ["xx", "yy"]
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for i, text, *_ in corpus:
        lang, margin = brute.language(text, model)
        assert (got[i]["predicted"], got[i]["accepted"]) == (lang, lang is not None and margin >= langid.MARGIN) and got[i]["margin"] == pytest.approx(margin)
    tie = langid.identify(docs, {"a": model["xx"], "b": model["xx"]}).filter("predicted is not null").collect()
    assert all(r["predicted"] == "a" and r["margin"] == 0 and not r["accepted"] for r in tie)
    twice = langid.identify(docs.filter("doc_id = 1").unionAll(docs.filter("doc_id = 1")), model).collect()
    assert twice[0] == twice[1]


def test_pipeline_stages_are_their_plain_versions(spark, corpus):
    import corpus_pipeline

    docs = materialize(frame(spark, corpus).coalesce(2), "fixture")
    text = {i: t for i, t, *_ in corpus}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    run = lambda name, docs: materialize(stages[name](spark, docs, ""), name)
    held = lambda docs: sorted((r["doc_id"], r["text"]) for r in docs.collect())

    kept = run("language_id", docs)
    model = langid.fit(docs)
    fine = [i for i in text if (x := brute.language(text[i], model))[0] and x[1] >= langid.MARGIN]
    assert [i for i, _ in held(kept)] == sorted(fine) and 304 in fine and len(fine) > 50

    after = run("line_dedup", kept)
    assert held(after) == [(i, t) for i, t in zip(sorted(fine), brute.without_lines([text[i] for i in sorted(fine)])) if t is not None]
    rows = held(after)

    near = run("near_dedup", after)
    root = brute.roots(len(rows), brute.near_pairs([t for _, t in rows]))
    assert held(near) == [x for k, x in enumerate(rows) if root[k] == k] and near.count() < after.count()

    mix = run("mixing", near)
    left = [(r["doc_id"], r["source"], r["text"]) for r in near.collect()]
    assert [r["doc_id"] for r in stages["mixing"](spark, near, "").collect()] == brute.mixed(left, mixing.TARGETS)
    assert all(d.columns == docs.columns for d in (kept, after, near, mix))
    assert all(r["n_chars"] == len(r["text"]) for r in mix.collect())

    got = run("packing", mix).collect()
    pieces = sorted((i, at, min(8192, n - at)) for i, t in held(mix) for n in [len(t.split())] for at in range(0, n, 8192))
    assert sorted((r["doc_id"], r["start_token"], r["n_tokens"]) for r in got) == pieces
    want = {p: x for p, x in zip(pieces, brute.packed([p[2] for p in pieces]))}
    assert {(r["doc_id"], r["start_token"], r["n_tokens"]): (r["tier"], r["window"], r["window_offset"]) for r in got} == want
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_derived_rows_have_keys_of_their_own(spark, tmp_path):
    rows = [(i, " ".join(words_of(i, 120)), "en", "a") for i in range(12)]
    path = str(tmp_path / "d.parquet")
    frame(spark, rows).write.parquet(path)
    docs = spark.read.parquet(path)
    exploded = docs.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    joined = docs.join(spark.createDataFrame([(i,) for i in range(12)] * 2, "doc_id long"), "doc_id").select(*map(lambda c: f"`{c}`", docs.columns))
    for twice in (exploded, joined, docs.unionAll(docs), spark.read.parquet(path, path)):
        k = keyed(twice, "k")
        assert k.select("k").distinct().count() == k.count() == 24
    assert keyed(docs.filter("doc_id > 3").select("doc_id"), "k").select("k").distinct().count() == 8
    assert mixing.mix(exploded, budget=10**9).count() == 24
    assert {(r["doc_id"], r["copies"]) for r in simhash.near_groups(exploded).collect()} == {(i, 2) for i in range(12)}
    assert {(r["doc_id"], r["n_tokens"]) for r in substring.repeated_passages(exploded).collect()} == {(i, 120) for i in range(12)}
    assert sharding.shard(exploded, shards=2, rounds=1).count() == 24
    assert lines.drop_repeated_lines(exploded).count() == 12
    table = materialize(docs, "gone")
    discard(table)
    with pytest.raises(Exception):
        table.count()


def test_near_groups_are_those_of_all_pairs(spark):
    base = [words_of(b, 150) for b in range(4)]
    texts = [" ".join(edited(base[i % 4], i, (i // 4) % 9 / 70)) for i in range(150)]  # up to 11 % edited: loose groups
    texts += [" ".join(words_of(1000 + i, 90)) for i in range(30)] + ["", None, "?", texts[0], texts[0]]
    chain = words_of(55, 200)
    for i in range(9):  # each near the one before, the last far from the first
        texts.append(" ".join(chain))
        chain = edited(chain, 70 + i, 0.03)
    got = {r["doc_id"]: r for r in simhash.near_groups(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    pairs = brute.near_pairs(texts)
    root = brute.roots(len(texts), pairs)
    assert [got[i]["keep_id"] for i in range(len(texts))] == root
    assert all(got[i]["copies"] == root.count(root[i]) for i in range(len(texts)))
    linked = {x for p in pairs for x in p}
    assert all((got[i]["links"] > 0) == (i in linked) for i in range(len(texts)))
    assert len(set(root)) < 100


def test_fingerprints_are_signs_of_weighted_sums():
    texts = ["a b c a", "", None, "word " * 5000 + "other", " ".join(words_of(4, 3000)), "x"]
    prints, n = simhash.fingerprints(pa.array(texts))
    for t, text in enumerate(texts):
        seen = {}
        for w in (text or "").split():
            seen[w] = seen.get(w, 0) + 1
        assert n[t] == sum(seen.values())
        for k, seed in enumerate(simhash._SEEDS[: simhash.TABLES + 2]):
            sums = [0] * 64
            for w, count in seen.items():
                h = int.from_bytes(_tokens.mix(_tokens.words(pa.array([w]))[0] ^ seed).tobytes(), "big")
                weight = round(16 * count**simhash.POWER) if k < simhash.TABLES else 1
                for b in range(64):
                    sums[b] += weight if h >> (63 - b) & 1 else -weight
            bits = sum(1 << (63 - b) for b in range(64) if sums[b] > 0)
            assert int.from_bytes(prints[k][t].tobytes(), "big") == bits


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 400)]
    got = {r["sid"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 400, 400: 400}


def test_passages_are_found_though_their_parts_occur_earlier_elsewhere(spark):
    r = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(46):  # scraps of the passage, none long enough
        texts.append([f"s{i}a{j}" for j in range(20)] + passage[i : i + 15] + [f"s{i}b{j}" for j in range(20)])
    texts += [[f"u{k}v{j}" for j in range(30)] + passage + [f"u{k}z{j}" for j in range(30)] for k in range(2)]
    texts += [["long"] * 3000, [r.choice("ab") for _ in range(400)], [], ["one"] * 49, ["one"] * 49]
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)] + [(99, None, "en", "a")]
    got = set()
    for x in substring.repeated_passages(frame(spark, rows)).collect():
        a, b, n = x["start_token"], x["source_start_token"], x["n_tokens"]
        assert n >= 50 and texts[x["doc_id"]][a : a + n] == texts[x["source_doc_id"]][b : b + n]
        got |= {(x["doc_id"], i) for i in range(a, a + n)}
    assert got == brute.windows([t for _, t, *_ in rows])
    assert {i for i, _ in got} == {47, 48}


def test_line_runs_are_those_of_a_plain_search(spark):
    r = random.Random(6)
    for least in (1, 3):
        texts = ["\n".join(r.choice(["a", "b", "c", "d", "", "a line that is quite long, of more than thirty"]) for _ in range(r.randint(1, 25))) for _ in range(40)]
        texts += [None, "", "a"]
        docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
        got = {(x["doc_id"], i) for x in lines.repeated_runs(docs, min_chars=least).collect() for i in range(x["start_line"], x["start_line"] + x["n_lines"])}
        assert got == brute.deleted_lines(texts, least)
    left = {x["doc_id"]: x["text"] for x in lines.drop_repeated_lines(docs).collect()}
    assert [left.get(i, None) for i in range(len(texts))] == brute.without_lines(texts)


def test_a_document_of_many_lines_takes_seconds(spark):
    text = "\n".join(f"{i} " + "x" * 30 if i % 2 else "the same line of more than thirty characters" for i in range(200000))
    docs = materialize(frame(spark, [(1, text, "en", "a")]), "lines")
    lines.drop_repeated_lines(docs).count()
    began = time.time()
    left = lines.drop_repeated_lines(docs).first()["text"].split("\n")
    assert len(left) == 100001 and time.time() - began < 60


def test_mixing_by_weight_is_the_plain_queue(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 30), "en", "hot" if i % 3 else r.choice(["src1", "src2", "src3", None])) for i in range(300)]
    docs = frame(spark, rows + [(300, None, "en", "src1")])
    rows.append((300, None, "en", "src1"))
    got = mixing.mix_plan(docs, {"hot": 0.7, "src1": 5.0, "src2": 2.0})
    assert [x["doc_id"] for x in got.collect()] == brute.mixed([(i, s, t) for i, t, _, s in rows], {"hot": 0.7, "src1": 5.0, "src2": 2.0})
    with pytest.raises(ValueError):
        mixing.mix_plan(docs, {"hot": 0.0})


def test_shards_come_near_the_best_cut(spark):
    texts = [f"a\nthis line joins group {i // 8} and no other one\n{i}" for i in range(320)] + [None, "", "x", "x"]
    docs = frame(spark, [(i % 330, t, "en", "a") for i, t in enumerate(texts)])
    own = materialize(keyed(docs, "k").select("k", "doc_id", "text"), "own")
    links = sharding.line_links(own, "k", "text")
    assert links.count() == 280 and links.agg(F.sum("w")).first()[0] == 280
    where = sharding.shard(docs, shards=4).collect()
    sizes = np.bincount([x["shard"] for x in where], minlength=4)
    assert sizes.sum() == 324 and sizes.max() <= int(1.05 * 324 / 4)
    at = {x["doc_id"]: x["shard"] for x in where if x["doc_id"] < 320}
    assert sum(at[i] != at[i - i % 8] for i in range(320)) <= 14  # of 280 links; 210 by chance, 0 at best


def test_shard_moves_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED", 7)
    docs = frame(spark, [(i, f"a\nthis line joins group {i // 5} and no other one\n{i}", "en", "a") for i in range(200)])
    where = {x["doc_id"]: x["shard"] for x in sharding.shard(docs, shards=4).collect()}
    assert len(where) == 200 and np.bincount(list(where.values()), minlength=4).max() <= 52
    assert sum(where[i] != where[i - i % 5] for i in range(200)) <= 30


def test_windows_are_packed_best_fit_and_steps_are_even(spark):
    for s in range(60):
        r = random.Random(s)
        sizes = [r.choice([r.randint(1, 16), r.randint(1, 4), 16, 8]) for _ in range(r.randint(0, 40))]
        assert packing.pack(sizes, (4, 8, 16)) == brute.packed(sizes, (4, 8, 16))
    r = random.Random(9)
    rows = [(i if i % 11 else None, "w " * r.randint(1, 9), "en", "a") for i in range(400)] + [(7, "w " * 100, "en", "a"), (7, None, "en", "a")]
    got = packing.pack_windows(frame(spark, rows), tiers=(4, 8, 16), step_tokens=64, shard_tokens=500).collect()
    used, steps = {}, {}
    for x in got:
        w = x["tier"], x["shard"], x["window"]
        used[w] = used.get(w, 0) + x["n_tokens"]
        steps.setdefault((x["tier"], x["shard"], x["step"]), set()).add(w)
    assert sum(used.values()) == sum(len((t or "").split()) for _, t, *_ in rows) and len({x["shard"] for x in got}) > 2
    assert sum(used.values()) / sum(w[0] for w in used) > 0.95  # fill of all windows
    for tier, shard in {k[:2] for k in steps}:
        loads = [sum(used[w] for w in ws) for k, ws in steps.items() if k[:2] == (tier, shard) and len(ws) == 64 // tier]
        assert not loads or max(loads) - min(loads) <= tier


def test_calls_are_those_of_a_plain_decoder(spark):
    assert [int(x) for x in media.MULAW] == [brute.mulaw(i) for i in range(256)] and [int(x) for x in media.ALAW] == [brute.alaw(i) for i in range(256)]
    from .test_operators import _one_block

    r = np.random.default_rng(8)
    payloads = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 300, 256, 515, 4000)]
    rows = [(i, p, c) for i, p in enumerate(payloads) for c in media.CODECS] + [(90, None, "alaw"), (91, b"abc", "other"), (92, b"abc", None)]
    calls = spark.createDataFrame(rows, "doc_id long, payload binary, codec string")
    for to in (8000, 16000):
        got = {(x["doc_id"], x["codec"]): x for x in media.store_pcm(calls, F.col("payload"), F.col("codec"), to=to).collect()}
        for i, p, c in rows:
            x = got[i, c]
            if i >= 90:
                assert x["pcm"] is None and x["n_samples"] is None
                continue
            if c == "adpcm":
                want = [s for at in range(0, len(p), 256) if len(p[at : at + 256]) >= 4 for s in _one_block(list(p[at : at + 256]))]
            else:
                want = [(brute.mulaw if c == "mulaw" else brute.alaw)(b) for b in p]
            if to == 16000:  # every other sample is a given one; those between are sums under the filter
                taps = media._filters(2, 1)[1]
                reach = len(taps) // 2
                padded = [0] * reach + want + [0] * reach
                between = [max(-32768, min(32767, round(float(sum(np.float32(t) * padded[k + j + 1] for j, t in enumerate(taps)))))) for k in range(len(want))]
                pcm = np.frombuffer(x["pcm"], "<i2")
                assert pcm[::2].tolist() == want and (abs(pcm[1::2].astype(int) - between) <= 1).all()
            else:
                assert np.frombuffer(x["pcm"], "<i2").tolist() == want
            assert x["n_samples"] == len(want) * to // 8000


def test_toxicity_is_that_of_whole_vectors(spark):
    r = random.Random(2)
    vile = [f"vile{i}" for i in range(12)]
    texts = [" ".join(words_of(i, 40) + (r.choices(vile, k=1 + i % 3) if i % 4 == 0 else [])) for i in range(200)]
    texts += [texts[0], texts[0], "", None, "unheard of"]
    ids = [*range(200), 500, 500, 501, None, 502]
    corpus = spark.createDataFrame([(str(i) if i is not None else "no number", t, 3) for i, t in zip(ids, texts)], "doc_id string, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (3, None), (4, 0), (501, 1), (9999, 1)], "doc_id long, toxic int")
    index = toxicity.fit(corpus, labels)
    assert len(index.ids) == 121 and index.toxic.sum() == 31
    _, word, _ = toxicity._counts(pa.array([t for t, i in zip(texts, ids) if i is not None and i in range(120)] + [""]))
    names, n = np.unique(word, return_counts=True)
    assert (index.vocabulary == names[n >= 2]).all()
    doc, term, count = toxicity._terms(pa.array(texts), index.vocabulary)
    df = np.bincount(term, minlength=len(index.vocabulary))
    assert index.idf == pytest.approx(np.log((1 + len(texts)) / (1 + df)) ** 2)
    dense = np.zeros((len(texts), len(index.vocabulary)))
    dense[doc, term] = (1 + np.log(count)) * index.idf[term]
    dense /= np.maximum(np.sqrt((dense**2).sum(axis=1, keepdims=True)), 1e-300)
    row = {i: k for k, i in reversed(list(enumerate(ids)))}
    examples = dense[[row[int(i)] for i in index.ids]]
    cosine = np.round(dense @ examples.T, 9)

    def voted(k, own):
        order = [e for e in np.lexsort((index.ids, -cosine[k])) if cosine[k, e] > 0 and index.ids[e] != own][: index.k]
        w = [1 / (1.05 - cosine[k, e]) ** 3 for e in order]
        return order, sum(a * index.toxic[e] for a, e in zip(w, order)) / sum(w) if w else 0.0

    votes = np.array([voted(row[int(i)], int(i))[1] for i in index.ids])
    share = np.where(index.toxic == 1, 31 / index.toxic.sum(), 90 / (len(index.ids) - index.toxic.sum()))
    knots = toxicity.isotonic(votes, index.toxic.astype(float), share)
    assert index.votes == pytest.approx(knots[0]) and index.scores == pytest.approx(knots[1])
    got = toxicity.score(corpus, index).collect()
    assert len(got) == len(texts)
    assert sorted((x["doc_id"] is None, x["doc_id"]) for x in got if x["doc_id"] is not None) == sorted((False, i) for i in ids if i is not None)
    for x in got:
        if x["doc_id"] is None:
            assert not x["evidence"] and x["vote"] == 0
            continue
        k = row[x["doc_id"]]
        order, vote = voted(k, x["doc_id"])
        assert x["vote"] == pytest.approx(vote) and x["score"] == pytest.approx(np.interp(vote, *knots)) and x["toxic"] == (x["score"] >= 0.5)
        assert [e["doc_id"] for e in x["evidence"]] == [int(index.ids[e]) for e in order[: toxicity.EVIDENCE]]
