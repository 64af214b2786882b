"""Exact and near duplicates against all pairs."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from orbweave.llm import block_naming, components, golay, rp_forest, simhash

from . import samples


def normal(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("make", [samples.edge, samples.nothing, samples.documents])
@pytest.mark.parametrize("block", [8192, 7])
def test_exact(spark, make, block, monkeypatch):
    monkeypatch.setattr(block_naming, "BLOCK", block)
    docs = make(spark)
    if block == 7:
        docs = docs.where("coalesce(length(text), 0) < 9000")
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r["text"])].append(r)
    got = block_naming.exact_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    for r in got:
        own = groups[normal(texts[r["doc_id"]])]
        best = min(own, key=lambda x: (-len(x["text"] or ""), x["doc_id"] if x["doc_id"] is not None else -1))
        assert (r["keep_id"], r["group_size"]) == (best["doc_id"], len(own))
        assert r["text_sha256"] == samples.sha(normal(texts[r["doc_id"]]))
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_runs_no_python(spark):
    plan = block_naming.exact_duplicates(samples.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def print_of(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("make", [samples.edge, samples.nothing, samples.documents])
def test_near(spark, make):
    docs = make(spark).where("coalesce(length(text), 0) < 60000 and doc_id is not null")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {k: print_of(t) for k, t in texts.items()}
    ids = sorted(prints)
    want = samples.least_reachable(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("full", [4096, 64])
def test_links_of_random_fingerprints(spark, full, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", full)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 60, np.int64)
    values = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(rng.integers(1, 12)):
            x = int(s)
            for b in rng.choice(63, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    near = sorted(int(x) for x in rng.choice(1 << 10, 300, replace=False))  # a crowd that shares its keys
    values |= set(near)
    values = sorted(values)
    want = samples.least_reachable(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4])
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fingerprint long"))
    found = samples.least_reachable(values, [(r["a"], r["b"]) for r in links.collect()])
    assert found == want
    joined = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert all(joined.get(v, v) == want[v] for v in values)


def test_golay_words_two_bits_apart_share_a_codeword():
    code, rng = golay.Golay(), np.random.default_rng(2)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 23))
        y = x ^ sum(1 << int(b) for b in rng.choice(23, rng.integers(0, 3), replace=False))
        a, b = (set(map(int, row)) - {-1} for row in code.keys(np.array([x, y], np.int64)))
        assert a & b


def test_drop_exact(spark):
    docs = samples.edge(spark).where("doc_id is not null")
    exact = {r["doc_id"] for r in block_naming.drop_exact_duplicates(docs).collect()}
    assert 6 in exact and 7 in exact and 8 not in exact and 15 in exact and 16 not in exact
    rows = [(1, "abc"), (1, "abc"), (2, "a bc"), (2, "abc"), (None, "abc"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id int, text string, _kept int, _row int, identity int").repartition(3)
    got = block_naming.drop_exact_duplicates(docs)
    assert got.schema == docs.schema and sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "x"), (2, "a bc")]
    named = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t ")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in block_naming.exact_duplicates(named).collect()} == {("a", None), ("b", None), (None, None)}


def test_names_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40} " * (1 + i % 7 * 200)) for i in range(300)], "doc_id long, text string")
    one, two = ({(r["id"], r["identity"]) for r in block_naming.identities(docs.repartition(n)).collect()} for n in (1, 9))
    assert one == two and len(one) == 300


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 40] + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(160)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, [2 * x for x in rows[0][1]]), (403, None), (404, [0.0] * 16), (405, [None] + [1.0] * 15), (406, [float("nan")] * 16), (407, [float("inf")] + [1.0] * 15), (408, [1.0] * 3), (409, []), (0, rows[0][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("which", ["made", "table"])
def test_vectors(spark, which):
    df = vectors(spark) if which == "made" else spark.read.parquet(f"{samples.SF}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    good = [r for r in rows if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    width = Counter(len(r["embedding"]) for r in good).most_common(1)[0][0]
    good = [r for r in good if len(r["embedding"]) == width]
    x = np.array([r["embedding"] for r in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    at = list(range(len(good)))
    comp = samples.least_reachable(at, list(zip(*np.nonzero(hit))))
    least = defaultdict(list)
    for i in at:
        least[comp[i]].append(good[i]["vec_id"])
    links = Counter()
    for i in at:
        links[good[i]["vec_id"]] = int(hit[i].sum())
    want = {good[i]["vec_id"]: min(least[comp[i]]) for i in at}
    got = rp_forest.near_vectors(df).collect()
    assert len(got) == len(rows)
    total, found = sum(links.values()), 0
    for r in got:
        assert r["n_links"] <= links[r["vec_id"]]
        found += r["n_links"] if r["vec_id"] != 0 else 0
        assert r["component_id"] == want.get(r["vec_id"], r["vec_id"])
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert found >= 0.9 * (total - links[0])


def test_no_vectors(spark):
    assert rp_forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert simhash.near_duplicates(samples.nothing(spark)).count() == 0
