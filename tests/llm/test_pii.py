import random
import re

import numpy as np

from loomlog.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def base_spans(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
            if good.get(k, lambda: True)():
                out.append((k, m.start(), m.end()))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string")
    return [(r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find_pii(df).collect()]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["1", "2", "55", "0", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "😀", "\n", "4111 1111 1111 1111", "10.0.0.1", "%", "x@y.z", "256.1.1.1", "+1 555 123 4567", "0000010.000.1.2"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 100_000 + " " + "1 " * 50_000 + "x@y.z"), (5003, "9" * 60_000), (None, "x@y.z"), (None, "x@y.z"), (5004, "x@y.z"), (5004, "1.2.3.4")]
    want = sorted((str(d), base_spans(t or "")) for d, t in rows)
    assert sorted((str(d), [(k, a, b) for k, a, b, base in s if base]) for d, s in found(spark, rows)) == want


def test_votes_find_secrets_and_spare_plain_words(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(40)]
    rows = [(i, f'set token = "{h}" now') for i, h in enumerate(hexes)] + [(100 + i, "a verylongordinarywordwithoutdigits" + "x" * i) for i in range(40)]
    rows += [(200, "ssn 123-45-6789"), (201, "see page 3")]
    got = dict(found(spark, rows))
    assert all([s[:3] for s in got[i]] == [("secret", 13, 53)] for i in range(40))
    assert all(got[100 + i] == [] for i in range(40)) and got[201] == []
    assert [x[:3] for x in got[200]] == [("ssn", 4, 15)]


def test_other_kinds_and_short_secrets(spark):
    rows = [(i, f"{cue}: {value}") for i, (cue, value) in enumerate(
        [("password", "hunter2secret"), ("pwd", "abc123!x"), ('api_key', '"k3y-93hf7"'), ("IBAN", "DE89 3704 0044 0532 0130 00"), ("call", "555-867-5309"), ("my ssn", "219-09-9999")] * 6
    )]
    rows += [(100, "password: required"), (101, "token: see below"), (102, "the secret of 555 ways"), (103, "order 123-45-6789-00")]
    got = {d: [(k, rows[d][1][a:b]) for k, a, b, _ in spans] for d, spans in found(spark, rows) if d < 36}
    want = [("secret", "hunter2secret"), ("secret", "abc123!x"), ("secret", "k3y-93hf7"), ("iban", "DE89 3704 0044 0532 0130 00"), ("local_phone", "555-867-5309"), ("ssn", "219-09-9999")]
    assert all(got[i] == [want[i % 6]] for i in range(36))
    assert all(spans == [] for d, spans in found(spark, rows) if d >= 100)


def test_digest_counts_all_spans(spark):
    df = spark.createDataFrame([(1, "a@b.cd and 10.0.0.1", 0), (2, None, 0)], "doc_id long, text string, n_spans int")
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_spans) for r in pii.digest_columns(pii.find_pii(df)).collect()} == {1: (1, 1, 2), 2: (0, 0, 0)}


def test_redaction_of_null_and_repeated_ids(spark):
    rows = [(None, "x@y.zz"), (1, "x@y.zz"), (1, "x@y.zz"), (1, "10.0.0.1 x"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in pii.redact(df, pii.find_pii(df)).collect()), key=str)
    assert out == sorted([(None, "<EMAIL>"), (1, "<EMAIL>"), (1, "<EMAIL>"), (1, "<IP> x"), (None, None), (2, "")], key=str)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.cd or 10.0.0.1!", 3), (2, "none", 4)], "doc_id long, text string, n int")
    out = {r.doc_id: r.text for r in pii.redact(df, pii.find_pii(df)).collect()}
    assert out == {1: "é mail <EMAIL> or <IP>!", 2: "none"}


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) for a in (0.95, 0.9, 0.85, 0.6)], 1).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, table, prior = pii.em(counts.astype(float), patterns)
    right = [table[j, 1, 2] / (table[j, 1, 1] + table[j, 1, 2]) for j in range(4)]
    assert abs(prior - 0.3) < 0.03 and all(abs(x - a) < 0.04 for x, a in zip(right, (0.95, 0.9, 0.85, 0.6), strict=True))


def test_empty_table_and_native_plan(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    assert pii.digest_columns(pii.find_pii(df.limit(0))).collect() == []
    plans, write = [], pii.write_table
    told = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pii, "write_table", lambda x, name: plans.append(told(x)) or write(x, name))
    plans.append(told(pii.find_pii(df)))
    assert len(plans) == 3 and not any("Python" in p or "Arrow" in p for p in plans)
