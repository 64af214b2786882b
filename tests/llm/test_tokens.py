"""BPE against the public library, packing against its limits, scores against plain sums."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orbweave.llm import attention_lm, bpe, packing

from . import samples

PATH = public_tokenizers.path("word_bpe_49k.json")


@cache
def shared():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def library():
    return shared()


def code(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("make", [samples.edge, samples.nothing, samples.documents])
def test_encoding(spark, make, library):
    docs = make(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = bpe.encode_documents(docs, PATH, ids=False).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(code(ids)).hexdigest()
        assert r["decoded_sha256"] == samples.sha(library.decode(ids, skip_special_tokens=False))


@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcdefghijklmnopqrstuvwxyzABC '’éßİİẞͅΣ 0123<|>endoftext", max_size=60)))
@settings(max_examples=600, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.coder(PATH).encode([text])[0] == code(shared().encode(text, add_special_tokens=False).ids)


def test_speculation_passes_most_words(library):
    own = bpe.WordBpe(PATH)
    texts = ["the government of the people has been elected by many voters " * 3, "pneumonoultramicroscopicsilicovolcanoconiosis zzxqjj " * 2]
    assert own.encode(texts) == [code(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.exact_merges < len(own.words)


@pytest.mark.parametrize("make", [samples.edge, samples.documents])
def test_packing(spark, make, library):
    docs = make(spark)
    rows = docs.select("doc_id", "text").collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    got = packing.pack_documents(docs, PATH, ids=False).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(code(own[r["start"] : r["start"] + r["length"]]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, own in ids.items():  # each token once, in each copy of a row
        cover = Counter(i for s, n in pieces[key] for i in range(s, s + n))
        assert cover == Counter({i: len(own) for i in range(len(own[0]))})
    waste = total = 0
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 2048 and len(found) <= 512
        total += at
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    assert waste <= 0.02 * total


def test_packing_nothing(spark):
    assert packing.pack_documents(samples.nothing(spark), PATH).count() == 0


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(6)
    packer, demand, out = packing.Packer(100, 5, 60), {}, []
    for d in range(400):
        n = int(rng.integers(1, 260))
        demand[d] = (n, int(rng.integers(0, n + 1)))
        out += list(packer.add(d, n, demand[d][1]))
    out += list(packer.finish())
    for sequence in out:
        assert sum(n for _, _, n in sequence) <= 100 and len(sequence) <= 5
        assert sum(packer.loss(s, n, demand[d][1]) for d, s, n in sequence) <= 60
    seen = defaultdict(list)
    for sequence in out:
        for d, s, n in sequence:
            seen[d] += range(s, s + n)
    assert all(sorted(seen[d]) == list(range(n)) for d, (n, _) in demand.items())


@pytest.mark.parametrize("make", [samples.edge, samples.documents])
@pytest.mark.parametrize("head", [262_144, 3])
def test_base_scores(spark, make, head, monkeypatch):
    monkeypatch.setattr(attention_lm, "HEAD_WORDS", head)
    monkeypatch.setattr(attention_lm, "EPOCHS", 1)
    docs = make(spark)
    if head == 3:
        docs = docs.where("coalesce(length(text), 0) < 3000")
    rows = docs.select("doc_id", "text").collect()
    words = {r["doc_id"]: attention_lm.words_of(r["text"] or "") + [b""] for r in rows}
    train = lambda i: i is None or samples.remainder(i) != 1
    counts = Counter(w for r in rows if train(r["doc_id"]) for w in words[r["doc_id"]])
    total, kinds = counts.total(), len(counts)
    got = attention_lm.score_documents(docs, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        own = words[r["doc_id"]]
        assert r["held_out"] == (not train(r["doc_id"])) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(w in counts for w in own))
        want = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_attention_beats_word_counts_on_held_out_texts(spark):
    got = attention_lm.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), PATH).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_network_learns_from_every_row(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "SAMPLE_DOCUMENTS", 5)
    monkeypatch.setattr(attention_lm, "EPOCHS", 1)
    monkeypatch.setattr(attention_lm, "GROUP_WORDS", 2000)
    monkeypatch.setattr(attention_lm, "LEARNED_IDS", 500)
    texts = [f"row {i} has its own word w{i}x{i * i} " + "and more " * (i % 60) for i in range(300)] + ["", None, "same text", "same text"]
    answered, renew = [], attention_lm.AttentionMixture.renew
    monkeypatch.setattr(attention_lm.AttentionMixture, "renew", lambda self, counts, prior: answered.append(counts.copy()) or renew(self, counts, prior))
    got = attention_lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), PATH).collect()
    assert len(got) == len(texts) and all(math.isfinite(r["score"]) for r in got)
    code = bpe.coder(PATH)
    ids = Counter(i for d, t in enumerate(texts) if samples.remainder(d) != 1 for i in [*np.frombuffer(code.encode_plain([t or ""])[0], "<u4").tolist(), len(code.strings) - 1])
    assert {int(i): round(float(answered[-1][i].sum())) for i in np.flatnonzero(answered[-1].any(1))} == dict(ids)


def test_each_subword_is_scored_once():
    for n in (1, 5, 24, 25, 100):
        ids = np.arange(n)
        inputs, targets = attention_lm.windows_of(ids, 7, 999)
        flat = targets.reshape(-1)
        assert flat[flat != 999].tolist() == ids.tolist()
        flow = [7, *ids[:-1]]
        for x, t in zip(inputs, targets):
            for j, goal in enumerate(t):
                if goal != 999:
                    assert x[attention_lm.WINDOW - attention_lm.STRIDE + j] == flow[goal]


def test_scoring_gives_what_the_trained_mixture_weighs():
    rng = np.random.default_rng(4)
    model = attention_lm.AttentionMixture(50)
    model.experts = rng.dirichlet(np.ones(50), attention_lm.EXPERTS).T.astype(np.float32)
    model.bias = rng.standard_normal(attention_lm.EXPERTS).astype(np.float32)
    texts = [rng.integers(0, 48, n) for n in (1, 23, 24, 25, 400)]
    got = model.prepare().freeze().log10(texts, 48, 49)
    assert len(got) == sum(map(len, texts))
    for ids, score in zip(texts, np.add.reduceat(got, np.cumsum([0, *map(len, texts[:-1])]))):
        inputs, targets = attention_lm.windows_of(ids, 48, 49)
        weights = model.mix(inputs, 49)[0].astype(float)
        p = (weights * model.experts[targets.reshape(-1)]).sum(1)[targets.reshape(-1) != 49]
        assert abs(np.log10(p).sum() - score) < 1e-4 * len(ids)


@pytest.mark.parametrize("bound", [1, 64 << 20])
def test_words_counted_in_bulk_are_those_of_each_text(spark, monkeypatch, bound):
    monkeypatch.setattr(attention_lm, "COUNTED_BYTES", bound)
    texts = [None, "", "   ", "  A b\x0b\u00c9 x\x1cy ", "\x85x \xa0 y\t", "a " * 70_000, *[f"w{i} W{i % 7}" for i in range(200)]]
    want = Counter(w for t in texts for w in [*attention_lm.words_of(t or ""), b""])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {bytes(r["word"]): r["n"] for r in attention_lm.count_words(docs).collect()} == dict(want)
    assert attention_lm.count_words(docs.where("false")).count() == 0


def test_attention_is_causal():
    model = attention_lm.AttentionMixture(50).prepare()
    x = np.random.default_rng(0).integers(0, 49, (1, attention_lm.WINDOW))
    y = x.copy()
    y[0, -1] = (y[0, -1] + 1) % 49
    a, b = model.mix(x, 49)[0], model.mix(y, 49)[0]
    assert np.allclose(a[:-1], b[:-1]) and not np.allclose(a[-1], b[-1])


def test_network_gradient_lowers_loss():
    ids = [np.tile(np.arange(5), 30) for _ in range(30)]
    cut = [attention_lm.windows_of(x, 5, 6) for x in ids]
    inputs, targets = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
    prior = np.array([0.19] * 5 + [0.05, 0.0])
    model = attention_lm.AttentionMixture(7).fit(inputs, targets, 6, prior, np.arange(7) % attention_lm.EXPERTS, epochs=4, size=16)
    assert model.log10(ids[:1], 5, 6).sum() > 0.5 * 150 * math.log10(0.2)


def test_memory_is_that_of_a_plain_count(spark):
    rng = np.random.default_rng(8)
    rows = [(int(r), bool(r % 5 == 0), int(c), int(c * 100 + g), float(np.float32(p))) for r, c, g, p in zip(rng.integers(0, 40, 900), rng.integers(0, 30, 900) ** 2 % 61, rng.integers(0, 9, 900) ** 2 % 11, rng.uniform(0.01, 0.9, 900))]
    rows += [(50 + i, False, 7, 701, 0.25) for i in range(400)] + [(99, True, 5000, 500001, 0.5), (99, True, 7, 799, 0.5)]
    counts = Counter((c, g) for _, held, c, g, _ in rows if not held)
    once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice)))
    total, kinds = Counter(), Counter()
    for (c, _), n in counts.items():
        total[c] += n
        kinds[c] += 1
    want = Counter()
    for r, _, c, g, p in rows:
        q = (max(counts[c, g] - d, 0) + d * kinds[c] * p) / total[c] if total[c] else p
        want[r] += math.log10(q / p)
    texts: dict = {}
    for r, held, *place in rows:
        texts.setdefault((r, held), []).append(tuple(place))
    table = spark.createDataFrame([(*k, v) for k, v in texts.items()], "row long, held_out boolean, places array<struct<context: long, going_on: long, p: float>>")
    got = {r["row"]: r["more"] for r in attention_lm._remembered(table.repartition(5)).collect()}
    assert got.keys() == want.keys() and all(got[r] == pytest.approx(want[r], abs=1e-6) for r in got)


def test_contexts_are_the_same_wherever_they_stand():
    texts = [np.array(x) for x in ([5, 6, 7, 8, 9, 10], [1, 5, 6, 7, 8], [5], list(range(300)))]
    place, context, going_on = attention_lm.contexts_of(np.concatenate(texts), np.array([len(t) for t in texts]), 40)
    seen = {}
    flat = [(tuple(([40] * attention_lm.ORDER + list(t))[i : i + attention_lm.ORDER]), int(t[i])) for t in texts for i in range(len(t))]
    for at, c, g in zip(place, context, going_on):
        assert seen.setdefault(c, flat[at][0]) == flat[at][0] and seen.setdefault(g, flat[at]) == flat[at] and c >= 0 and g >= 0
    held = {flat[at][0] for at in place}
    assert all((before in held) == (i in set(place.tolist())) for i, (before, _) in enumerate(flat))
    assert 0 < len(place) < len(flat) / 4


@pytest.mark.parametrize("size, first, parts", [(50, 48, 1), (50, 48, 7), (49_409, 49_407, 3), (70_000, 69_998, 4)])
def test_memory_of_chunks_is_that_of_a_plain_count(spark, size, first, parts):
    rng = np.random.default_rng(size + parts)
    texts = [np.append(rng.integers(0, 4, rng.integers(0, 60)) * (size // 5), first) for _ in range(120)] + [np.array([first])]
    texts += [texts[3]] * 20 + [np.append(np.full(500, 7), first)]
    held = [i % 5 == 1 for i in range(len(texts))]
    coded = [(i // 30, i, held[i], bytearray(attention_lm._packed(x, size))) for i, x in enumerate(texts)]
    # two partitions cut through the second chunk
    coded = spark.createDataFrame(spark.sparkContext.parallelize(coded, 1).zipWithIndex().map(lambda x: (int(x[1] > 44), x[0])).partitionBy(2).values(), "chunk long, row long, held_out boolean, ids binary")
    answers = attention_lm._answered(attention_lm._asked(coded, size, parts), size).orderBy("start", "part").collect()
    assert len({(r["chunk"], r["start"]) for r in answers}) == 6
    flat = [(tuple(([first] * attention_lm.ORDER + x.tolist())[i : i + attention_lm.ORDER]), int(x[i]), held[t]) for t, x in enumerate(texts) for i in range(len(x))]
    counts = Counter((c, g) for c, g, out in flat if not out)
    once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
    assert (once, twice) == (sum(r["once"] for r in answers), sum(r["twice"] for r in answers)) and once
    d, total, kinds = attention_lm.discount_of(once, twice), Counter(), Counter()
    for (c, _), n in counts.items():
        total[c] += n
        kinds[c] += 1
    got = []
    for start in sorted({r["start"] for r in answers}):
        mine = [r for r in answers if r["start"] == start]
        rows = texts[start : mine[0]["stop"] + 1]
        keys = attention_lm.keys_of(np.concatenate(rows), np.array([len(x) for x in rows]), first, size)
        got += zip(*attention_lm._known(keys, [bytes(r["counts"]) for r in mine], d))
    assert len(got) == len(flat)
    for (c, g, _), (a, b) in zip(flat, got):
        assert (a, b) == pytest.approx((max(counts[c, g] - d, 0) / total[c], d * kinds[c] / total[c]) if total[c] else (0, 1), rel=1e-5)


def test_every_context_is_remembered(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "EPOCHS", 1)
    monkeypatch.setattr(attention_lm, "CHUNK_IDS", 300, raising=False)
    monkeypatch.setattr(attention_lm, "COUNTED_IDS", 500, raising=False)
    rng = np.random.default_rng(2)
    texts = ["".join(chr(97 + c) if c < 26 else " " for c in rng.integers(0, 30, 300)) for _ in range(20)]
    kept, out = ([d for d in range(400) if (samples.remainder(d) == 1) == held] for held in (False, True))
    rows = [(d, texts[i % 20]) for i, d in enumerate(kept[:80])] + [(d, t) for d, t in zip(out, texts)]
    got = {r["doc_id"]: r["score"] for r in attention_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH).collect()}
    subwords = [len(c) // 4 + 1 for c in bpe.coder(PATH).encode_plain(texts)]
    assert len(got) == 100 and min(subwords) > 100
    # each text was learned four times, so of each subword at least 3 1/2 in 4 go to what follows
    assert all(got[d] / n > -0.1 for d, n in zip(out, subwords))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_texts_learned_twice_are_likelier(spark):
    docs = samples.documents(spark).select("doc_id", "text").where("length(text) between 400 and 3000")
    some = docs.where("doc_id % 4 = 0 and crc32(cast(doc_id as string)) % 5 <> 1")
    copies = some.selectExpr("doc_id + 1000000 as doc_id", "text").where("crc32(cast(doc_id as string)) % 5 <> 1")
    before = {r["doc_id"]: r["score"] / r["n_tokens"] for r in attention_lm.score_documents(docs, PATH).collect()}
    after = {r["doc_id"]: r["score"] / r["n_tokens"] for r in attention_lm.score_documents(docs.unionByName(copies), PATH).collect()}
    twice = [r["doc_id"] - 1000000 for r in copies.collect()]
    rise = [after[i] - before[i] for i in twice]
    assert len(twice) > 5 and min(rise) > 0 and sum(rise) / len(rise) > 0.1


def test_responsibilities_are_those_of_the_trained_mixture():
    rng = np.random.default_rng(6)
    model = attention_lm.AttentionMixture(50)
    model.experts = rng.dirichlet(np.ones(50), attention_lm.EXPERTS).T.astype(np.float32)
    model.bias = rng.standard_normal(attention_lm.EXPERTS).astype(np.float32)
    got = np.zeros((50, attention_lm.EXPERTS))
    inputs, targets = attention_lm.windows_of(rng.integers(0, 48, 1500), 48, 49)
    model.prepare().freeze().add_responsibilities(inputs, targets, 49, got)
    goal = targets.reshape(-1)
    r = model.mix(inputs, 49)[0] * model.experts[goal]
    r /= r.sum(1, keepdims=True)
    want = np.zeros_like(got)
    np.add.at(want, goal[goal != 49], r[goal != 49])
    assert np.allclose(got, want, rtol=1e-3, atol=1e-4) and got.sum() == pytest.approx(1500, rel=1e-4)


def test_scores_with_nothing_to_learn_from(spark):
    assert attention_lm.score_documents(samples.nothing(spark), PATH).count() == 0
