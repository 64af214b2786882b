"""Near-duplicate texts against a plain version over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from orbweave.llm import near_texts

from . import samples


def shingles(text, size=near_texts.WORDS):
    words = near_texts.words_of(text or "")
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def plain(rows, similarity=near_texts.SIMILARITY):
    """Ids that stay: of each group that links connect, the smallest."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    least = samples.least_reachable(range(len(rows)), links)
    return sorted((rows[i][0] for i in least if least[i] == i), key=repr)


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]


def test_planted_near_copies_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randint(80, 400)))) for i in range(150)]
    near = []
    for k in range(60):  # a tenth of similarity is lost by some 5 changes in 400 words
        base = rows[k][1].split()
        for c in range(3):
            copy = list(base)
            for _ in range(max(1, len(base) // 100)):
                copy[rng.randrange(len(copy))] = "changed"
            near.append((1000 + 3 * k + c, " ".join(copy)))
    passage = " ".join(words(rng, 60))  # shared, but far from most of a text
    rows += [(3000 + i, passage + " " + " ".join(words(rng, 300))) for i in range(40)]
    rows += near + [(5000, "Short Text"), (5001, "short  text"), (5002, None), (5003, ""), (5004, "short text two"), (None, "no id at all"), (None, "NO id at all")]
    want = plain(rows)
    docs = spark.createDataFrame([(i, t, "kept", i, i) for i, t in rows], "doc_id long, text string, row string, _row long, component long").repartition(7)
    got = near_texts.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    got = sorted((r["doc_id"] for r in got.collect()), key=repr)
    assert set(got) >= set(want) and len(set(got) - set(want)) <= 0.02 * len(near)


def test_links_below_the_similarity_do_not_join(spark):
    rng = random.Random(5)
    flow = words(rng, 300)
    rows = [(i, " ".join(flow[i * 12 + i // 4 * 40 : i * 12 + i // 4 * 40 + 200])) for i in range(9)]  # neighbours alike but for every fourth
    want = sorted(plain(rows))
    got = sorted(r["doc_id"] for r in near_texts.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want == [0, 4, 8]


def test_edge_rows(spark):
    docs = samples.edge(spark)
    got = near_texts.drop_near_duplicates(docs)
    assert got.schema == docs.schema
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == plain(rows)
    assert near_texts.drop_near_duplicates(samples.nothing(spark)).count() == 0


def test_spanning_connects_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 300)
    a[100:] = a[rng.integers(0, 100, 200)] ^ (1 << rng.integers(0, 62, 200))
    b, row = np.zeros(300, np.int64), np.arange(300)
    one, two = near_texts.spanning(row, a, b)
    links = [(i, j) for i in range(300) for j in range(i) if bin(int(a[i] ^ a[j])).count("1") <= near_texts.NEAR]
    assert samples.least_reachable(range(300), zip(one.tolist(), two.tolist())) == samples.least_reachable(range(300), links) and len(one) < 300


@pytest.mark.parametrize("bucket_rows", [3, 40, 4096])
def test_full_buckets_give_the_same_groups(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(near_texts, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 42, (6, 2))
    flips = lambda n: (1 << rng.integers(0, 42, n)) ^ (1 << rng.integers(0, 42, n))
    rows = [(i, int(a ^ x), int(b ^ y)) for i, ((a, b), x, y) in enumerate(zip(centres[rng.integers(0, 6, 300) // 2 * 2], flips(300), flips(300)))]
    links = near_texts.candidate_links(spark.createDataFrame(rows, "row long, a long, b long").repartition(4)).collect()
    apart = lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() + (rows[i][2] ^ rows[j][2]).bit_count()
    assert all(apart(r["a"], r["b"]) <= near_texts.NEAR for r in links)
    top = list(range(300))

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for r in links:
        top[root(r["a"])] = root(r["b"])
    assert all(root(i) == root(j) for i in range(300) for j in range(i) if apart(i, j) <= 8)


def test_a_bucket_longer_than_what_a_task_holds_is_full_once():
    key = np.sort(np.concatenate([np.full(1_200_000, 5), np.repeat(np.arange(10, 60), 2), [3, 3]])).astype(np.int32)
    row, same = np.arange(len(key)), np.zeros(len(key), np.int64)
    parts = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 9999]) for x in (key, row, same, same)], names=["key", "row", "a", "b"]) for i in range(0, len(key), 9999)]
    out = pa.Table.from_batches(list(near_texts._links(4096)(iter(parts)))).to_pylist()
    assert [r["full"] for r in out if r["full"] is not None] == [5]
    assert {(r["a"], r["b"]) for r in out if r["full"] is None} == {(i, j) for i, j in zip(row, row[1:]) if key[i] == key[j] != 5}


def test_sizes_rule_out_only_what_cannot_be_similar():
    draw = np.random.default_rng(4)
    n = draw.integers(0, 60, 400)
    for i, j in zip(n[:200].tolist(), n[200:].tolist()):
        most = min(i, j) / max(i, j) if max(i, j) else 1.0  # the similarity of a set and one that holds it
        assert bool(near_texts._sized(np.int64(i), np.int64(j), 0.8)) == (most >= 0.8)
    row, same = np.arange(5), np.zeros(5, np.int64)
    one, two = near_texts.spanning(row, same, same, np.array([100, 80, 79, 64, 10]), 0.8)
    assert {(min(a, b), max(a, b)) for a, b in zip(one.tolist(), two.tolist())} == {(0, 1), (1, 2), (1, 3)}


def frames(families, seed=7):
    """Two pages for each family, all of one site: 0.9 or so alike in a family, 0.6 across."""
    rng = random.Random(seed)
    frame = words(rng, 240)
    rows = []
    for k in range(families):
        own = words(rng, 75)
        rows.append((2 * k, " ".join(frame[:120] + own + frame[120:])))
        own[rng.randrange(10, 60)] = "other"
        rows.append((2 * k + 1, " ".join(frame[:120] + own + ["more", "of", "it"] * rng.randrange(2) + frame[120:])))
    return rows


@pytest.mark.parametrize("families, paired, bucket_rows", [(300, 128, 4096), (300, 8, 64)])
def test_no_link_is_lost_where_all_texts_share_a_frame(spark, monkeypatch, families, paired, bucket_rows):
    monkeypatch.setattr(near_texts, "PAIRED", paired)
    monkeypatch.setattr(near_texts, "BUCKET_ROWS", bucket_rows)
    rows = frames(families)
    got = near_texts.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(r["doc_id"] for r in got) == [2 * k for k in range(families)]


def test_rare_shingles_meet_for_all_pairs_that_are_similar(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "BUCKET_ROWS", 16)
    monkeypatch.setattr(near_texts, "PAIRED", 4)
    draw = np.random.default_rng(11)
    bases = [draw.choice(4000, 60, replace=False) for _ in range(8)]
    sets = [np.unique(np.where(draw.random(60) < draw.random() * 0.2, draw.integers(0, 4000, 60), bases[i % 8])).astype(np.int32) for i in range(200)]
    table = spark.createDataFrame([(i, i // 2, s.tolist()) for i, s in enumerate(sets)], "row long, component long, shingles array<int>").repartition(3)
    found = {(r["a"], r["b"]) for r in near_texts.rare_links(table, 0.8).collect()}
    alike = {(i, j) for j in range(200) for i in range(j) if i // 2 != j // 2 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert len(alike) > 100 and alike <= found and all(i // 2 != j // 2 for i, j in found)
    kept = near_texts.verified(spark.createDataFrame(sorted(found), "a long, b long"), table.select("row", "shingles"), 0.8)
    assert {(r["a"], r["b"]) for r in kept.collect()} == alike


def test_trees_hold_all_that_candidates_connect_in_a_bucket():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 40)[rng.integers(0, 40, 90)] ^ (1 << rng.integers(0, 62, 90))
    key, row, b = np.sort(rng.integers(0, 9, 90)).astype(np.int32), np.arange(90), np.zeros(90, np.int64)
    parts = [pa.RecordBatch.from_arrays([pa.array(x) for x in (key, row, a, b)], names=["key", "row", "a", "b"])]
    trees: dict = {}
    for r in pa.Table.from_batches(list(near_texts._links(4096)(iter(parts)))).to_pylist():
        trees.setdefault((r["key"], r["root"]), {r["root"]}).add(r["b"])
        assert key[r["a"]] == key[r["b"]] == r["key"]
    links = [(i, j) for i in range(90) for j in range(i) if key[i] == key[j] and (int(a[i]) ^ int(a[j])).bit_count() <= near_texts.NEAR]
    least = samples.least_reachable(range(90), links)
    want: dict = {}
    for i in range(90):
        want.setdefault(least[i], set()).add(i)
    assert sorted(map(sorted, trees.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_hashing_lets_go_of_encoders():
    from orbweave.llm import bpe

    class Frame:  # hands the function of mapInArrow over, as a reused worker gets it
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    bpe._coders["left by a packing task"] = object()
    text = pa.RecordBatch.from_pydict({"row": pa.array([1], pa.int64()), "text": ["one two three four five six"]})
    out = list(near_texts._prints(Frame(), 5).run(iter([text])))
    assert out[0].column(3).to_pylist() == [2] and not bpe._coders


def family(size, seed=13):
    """Near copies of one text, each with a few changes of its own: most pairs are similar enough, and all share a bucket."""
    rng = random.Random(seed)
    base = words(rng, 160)
    rows = []
    for i in range(size):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = "".join(rng.choices("abcdefghij", k=7))
        rows.append((i, " ".join(copy)))
    return rows


def test_pairs_verified_grow_with_the_rows_of_a_family_not_with_its_pairs_or_keys(spark, monkeypatch):
    tried, verify = [], near_texts.verified
    monkeypatch.setattr(near_texts, "verified", lambda pairs, *rest: tried.append(pairs.count()) or verify(pairs, *rest))
    rows = family(300)
    got = near_texts.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in got) == plain(rows)
    assert sum(tried) <= 4 * len(rows)


@pytest.mark.parametrize("part_rows", [10, 1 << 19])
def test_half_keys_give_the_keys_that_more_than_one_row_has(spark, monkeypatch, part_rows):
    monkeypatch.setattr(near_texts, "PART_ROWS", part_rows)
    monkeypatch.setattr(near_texts, "WIDENED_ROWS", 50)
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 62, 3)[rng.integers(0, 3, 60)] ^ (1 << rng.integers(0, 62, 60))
    b = rng.integers(0, 1 << 42, 3)[rng.integers(0, 3, 60)]
    prints = spark.createDataFrame([(i, int(x), int(y), 5) for i, (x, y) in enumerate(zip(a, b))], "row long, a long, b long, n int")
    want = near_texts._keys(prints).toPandas()
    halves = near_texts._half_keys(prints).toPandas().sort_values(["part", "row"])
    assert len(halves) < len(want) / 3
    wide = []
    parts = [pa.RecordBatch.from_pandas(halves[i : i + 37], preserve_index=False) for i in range(0, len(halves), 37)]
    got = pa.Table.from_batches(list(near_texts._widened(iter(parts), wide))).to_pandas()
    assert got["key"].is_monotonic_increasing and (part_rows > 60) == (not wide)
    want = want[want.groupby("key")["row"].transform("size").gt(1) & ~(want["key"] // 4096).isin(wide)]
    order = ["key", "row", "a", "b", "n"]
    assert got.sort_values(order)[order].values.tolist() == want.sort_values(order)[order].values.tolist()


def test_wide_half_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "PART_ROWS", 10)
    monkeypatch.setattr(near_texts, "WIDENED_ROWS", 50)
    rows = family(60) + [(100 + i, t) for i, t in frames(20)]
    got = near_texts.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == plain(rows)


def test_sketches_rule_out_only_what_cannot_be_similar():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32)) for n in (1, 40, 300, 3000)]
    sets += [np.unique(np.where(rng.random(len(s)) < 0.1, rng.integers(-(1 << 31), 1 << 31, len(s)), s).astype(np.int32)) for s in sets]
    n = np.array([len(s) for s in sets])
    bits = near_texts._sketches(np.concatenate(sets), n)
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert near_texts._most_shared(n[[i]], bits[[i]], bits[[j]])[0] >= len(np.intersect1d(sets[i], sets[j]))
