"""Shards by their law, toxicity by held-out accuracy, the pipeline by its rows."""

import os
import random
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__
from orbweave.llm import kd_sharding, queries, toxicity

from . import samples


@pytest.mark.parametrize("make", [samples.edge, samples.documents])
def test_shards(spark, make):
    docs = make(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = kd_sharding.assign_shards(docs, shards=8).collect()
    assert len(got) == docs.count()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) <= sum(sizes.values()) / 8 + largest + sum(sizes.values()) / 64


def test_shards_by_target(spark):
    docs = samples.documents(spark)
    total = sum(r["size"] for r in kd_sharding.assign_shards(docs, shards=1).collect())
    got = kd_sharding.assign_shards(docs, target_bytes=total // 5).collect()
    assert {r["shard"] for r in got} == set(range(5))


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text number {i // 2}", "en", "s", 1) for i in range(12_000)]
    got = kd_sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shards=8).collect()
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert all(shard[i] == shard[i + 1] for i in range(0, 12_000, 2))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.02 * min(sizes.values())


def test_groups_of_all_sizes_stay_together(spark):
    groups = [(g, 2 + g) for g in range(60)] + [(100 + g, 1000 + 300 * g) for g in range(7)]  # a shard has some 3,000 rows
    rows = [(g, f"group {g}") for g, n in groups for _ in range(n)] + [(1000 + i, f"alone {i}") for i in range(9000)]
    rows = [(i, t, "en", f"https://host/{g % 9}", 1) for i, (g, t) in enumerate(rows)]
    got = kd_sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), shards=8).collect()
    shards, sizes = defaultdict(set), Counter()
    for r in got:
        shards[rows[r["doc_id"]][1]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    shard = sum(sizes.values()) / 8
    total = Counter(t for _, t, *_ in rows)
    split = [t for t, s in shards.items() if len(s) > 1]
    assert all(total[t] * (len(t) + 1) > shard / 2 for t in split) and len(sizes) == 8
    assert max(sizes.values()) < 1.05 * shard and min(sizes.values()) > 0.95 * shard


def test_no_shards(spark):
    assert kd_sharding.assign_shards(samples.nothing(spark), shards=8).count() == 0


def auc(rows):
    yes, no = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))


def test_toxicity_ranks_held_out_texts(spark):
    sf = next(d for d in ("/root/testdata/sf0.1", samples.SF) if os.path.isdir(d))
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (samples.remainder(i) == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    rows = [(got[i]["score"], y) for i, y in labels.items() if y is not None and i in got and got[i]["held_out"]]
    assert auc(rows) > 0.95  # some labels are wrong on purpose


def test_toxicity_scores_keep_the_share_of_labels_beyond_the_bound(spark):
    toxic = {i: int(i % 10 == 0) for i in range(4000)}
    bad = {i: bool(toxic[i]) or i % 100 in (1, 12, 23, 34, 45, 56) for i in toxic}
    docs = spark.createDataFrame([(i, "what a gronk here" if bad[i] else "what a day here") for i in toxic], "doc_id long, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels, labelled=300)
    learned = [i for i in toxic if samples.remainder(i) != 0 and bad[i]]
    share = sum(toxic[i] for i in learned) / len(learned)
    assert abs(grammar.score("what a gronk here") - share) < 0.1


def test_toxicity_of_edge_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    grammar = toxicity.learn(samples.edge(spark), labels)
    docs = samples.edge(spark)
    assert toxicity.score_documents(docs, grammar).count() == docs.count()
    assert toxicity.score_documents(samples.nothing(spark), grammar).count() == 0
    plain = toxicity.learn(samples.nothing(spark), labels)
    assert toxicity.drop_toxic(docs, plain).count() == docs.count()


def test_grammar_composes_its_transducers():
    grammar = toxicity.Grammar({"idiot": 3.0, "moron*": 2.0})
    kinds = lambda t: [k for k, _ in grammar.clause(t.split())]
    assert kinds("you are an idiot") == ["targeted"]
    assert kinds("what an idiot") == ["insult"]
    assert kinds("you are not an idiot") == ["negated"]
    assert kinds("he said you are a moronic fool") == ["reported"]
    assert kinds("i will kill you") == ["threat_targeted"]
    assert kinds("never kill it") == ["negated"]


@pytest.mark.skipif("pipeline" not in __spark_entry__.queries(), reason="no pipeline here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{samples.SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, samples.SF)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= kept
        kept = now
    packed = corpus_pipeline.run(spark, samples.SF).collect()
    assert {r["doc_id"] for r in packed} == kept
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert sum(len(r["token_ids"]) for r in packed) == sum(tokens.values())


@pytest.mark.skipif("pipeline" not in __spark_entry__.queries(), reason="no pipeline here")
def test_pipeline_stages_take_edge_rows_and_none(spark):
    import corpus_pipeline

    for docs in (samples.edge(spark).select("doc_id", "text", "lang", "source", "n_chars"), samples.nothing(spark).select("doc_id", "text", "lang", "source", "n_chars")):
        for _, step in corpus_pipeline.STAGES:
            step(spark, docs, samples.SF).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{samples.SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, samples.SF)
    assert sorted(df.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())


def test_composition_equals_enumerated_paths():
    rng, machines = random.Random(4), toxicity.transducers()
    grammar = toxicity.Grammar({"idiot": 2.0, "moro*": 1.5})
    words = ["idiot", "morons", "kill", "you", "not", "said", "tree"]
    for _ in range(400):
        clause = rng.choices(words, k=rng.randint(0, 9))
        tape = grammar.read(clause)
        paths = [[]]
        for machine in machines:  # every way through every machine, one after the other
            paths = [[*p, q] for p in paths for q in machine.paths([x for x, _ in tape])]
        assert len(paths) == 1  # one accepting path each
        marks = [frozenset().union(*m) for m in zip(*paths[0])] if tape else []
        want = [(toxicity.CLASSES[k], w) for m, (_, w) in zip(marks, tape) if (k := toxicity.class_of(m)) >= 0]
        assert grammar.clause(clause) == want


def test_negated_and_reported_hits_weigh_less(spark):
    rows = [(i, f"some words here, number {i}. " + ("you idiot!" if i % 3 == 0 else "fine."), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    grammar = toxicity.learn(docs, spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int"))
    score = grammar.score
    assert score("You are an idiot.") > 0.5 > score("A tree is a tree.")
    assert score("You are an idiot.") > score("You are not an idiot.") and score("You are an idiot.") > score("They said he is an idiot.")
    assert score("I will kill you.") > score("I will not kill you.") and score("I will kill you.") > score("A tree.")
