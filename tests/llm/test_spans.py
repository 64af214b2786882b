"""Secrets and personal data against the plain patterns."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.llm import pii, secret_scan

from . import samples

SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def number(s):
    return re.sub("[^0-9]", "", s)


PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(number(m[0])) <= 19 and luhn(number(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(number(m[0])) <= 15),
]


def plain(text, rules):
    return [(k, s, e) for s, _, k, e in sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(rules) for m in p.finditer(text) if ok(m))]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def compare(rows, texts, rules):
    for r in rows:
        want = plain(texts[r["doc_id"]] or "", rules)
        counts = Counter(k for k, _, _ in want)
        for k, _, _ in rules:
            assert r[f"n_{k}"] == counts[k]
        assert r["base_sha256"] == samples.sha(listed(want))
        spans = r["spans"].split(",") if r["spans"] else []
        assert not Counter(listed([x]) for x in want) - Counter(spans)
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


@pytest.mark.parametrize("make", [samples.edge, samples.nothing, samples.documents])
def test_secrets(spark, make):
    docs = make(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = secret_scan.scan_documents(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    compare(rows, texts, SECRETS)


@given(st.text(alphabet="aAkKIiſK passwordtoken:=\"'_-+/.0189f", max_size=60))
@settings(max_examples=200, deadline=None)
def test_secrets_of_any_text(text):
    found = [x for x in secret_scan.find_secrets(text) if x[0] in secret_scan.BASE]
    assert found == plain(text, SECRETS)


def test_ledger_scans_unseen_blobs_only(spark, tmp_path):
    docs, ledger = samples.edge(spark), str(tmp_path / "ledger")
    first = {r["doc_id"]: r["spans"] for r in secret_scan.scan_documents(docs, ledger).collect()}
    n = spark.read.parquet(ledger).count()
    assert n == len({t or "" for t in samples.TEXTS}) + 1
    more = docs.unionByName(spark.createDataFrame([(900, "token=abcdefghijklmnop")], "doc_id long, text string"), allowMissingColumns=True)
    second = {r["doc_id"]: r["spans"] for r in secret_scan.scan_documents(more, ledger).collect()}
    assert spark.read.parquet(ledger).count() == n + 1
    assert second == first | {900: "assign:0:22"}


def test_redaction_keeps_rows_and_columns(spark):
    docs = samples.edge(spark)
    out = secret_scan.redact_documents(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert "[access]" in by[10]["text"] and "AKIA" not in by[10]["text"] and by[10]["n_chars"] == len(by[10]["text"])
    assert by[1]["text"] is None and by[17]["text"] == samples.LONG
    assert secret_scan.redact_documents(samples.nothing(spark)).count() == 0


@pytest.mark.parametrize("make", [samples.edge, samples.nothing, samples.documents])
def test_personal_data(spark, make):
    docs = make(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.digest(pii.find_personal_data(docs)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    compare(rows, texts, PERSONAL)


def test_personal_data_in_awkward_texts(spark):
    parts = ["a@b.c", "@", "a@b", "..", "1.2.3.4", "999.1.1.1", "001.02.3.255", "4111-1111 1111 1111", "5500000000000004", "+1 (555) 010-9999", "+1", " ", "é", "🙂", "-", "x@y.z@w.v", "+12.34.56.78.90", "1.2.3.4.5.6.7.8", "0" * 25]
    import random

    rng = random.Random(4)
    texts = {i: "".join(rng.choice(parts) for _ in range(12)) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compare(pii.digest(pii.find_personal_data(docs)).collect(), texts, PERSONAL)


def test_personal_data_is_replaced(spark):
    out = {r["doc_id"]: r["text"] for r in pii.redact(samples.edge(spark).where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert "[email]" in out[13] and "jane.doe" not in out[13] and "[card]" in out[13] and "10.0.0.256" in out[13]
    assert out[6] == samples.TEXTS[5]


def test_boosting_separates_and_calibrates():
    counts = {(0b01, True): 90, (0b01, False): 5, (0b10, True): 3, (0b10, False): 400}
    model = pii.boost(counts)
    least = pii.calibrate(counts, model)
    score = lambda b: model[0] + sum(t[2][2 * (b >> t[0] & 1) + (b >> t[1] & 1)] for t in model[1])
    assert score(0b01) >= least - 1e-6 > score(0b10)


def test_no_python_in_personal_data(spark):
    plan = pii.digest(pii.find_personal_data(samples.documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_misses_in_the_surroundings_of_what_passes_are_added(spark):
    rows = [(i, f"row {i}: please call +49 (030) 555-{1000 + i} today") for i in range(80)] + [(90 + i, f"row {i}: please call (030) 555-{2000 + i} today") for i in range(4)]
    rows += [(100 + i, f"order x{10**9 + 37 * i}y and part {10**7 + i} of lot {i}") for i in range(60)]
    found = {r["id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {(i, dict(rows)[i][x["start"] : x["end"]]) for i, r in found.items() for x in r["added"]}
    assert added == {(90 + i, f"(030) 555-{2000 + i}") for i in range(4)}  # all of them, and nothing else


def test_a_long_text_of_dots_and_digits_takes_little_time(spark):
    import time

    long = "1." * 100_000
    docs = spark.createDataFrame([(1, "mail a@b.cd")], "doc_id long, text string")
    pii.find_personal_data(docs).count()
    began = time.time()
    got = pii.candidates(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert len(got[0]["base"]) == 25_000 and time.time() - began < 20  # it took minutes in proportion to the square


def test_redaction_where_columns_have_the_names_used_inside(spark):
    rows = [(1, "mail jane.doe@example.org", "x", "y", "z"), (2, "password = 'Abcdefghij12345'", "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _spans string, _blob string")
    for redacted in (secret_scan.redact_documents(docs), pii.redact(docs)):
        out = {r["doc_id"]: r for r in redacted.collect()}
        assert redacted.columns == docs.columns and all((r["_id"], r["_spans"], r["_blob"]) == ("x", "y", "z") for r in out.values())
    assert "jane" not in {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[1] and "Abc" not in {r["doc_id"]: r["text"] for r in secret_scan.redact_documents(docs).collect()}[2]
