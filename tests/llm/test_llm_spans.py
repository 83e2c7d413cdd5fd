"""Personal data and secrets: base spans against Python's regular expressions."""

import hashlib
import random
import re
import secrets as tokens

import numpy as np
import pytest
from helpers import SMOKE, docs_of
from pyspark.sql import functions as F

from canframes.llm import pii, secrets
from canframes.llm.spans import running_totals


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
TRICKY = [
    "mail a@b.c.d@e.f_g@h.i z", "@x.y a@b", "1.2.3.4.5.6.7.8 999.1.1.1 00000255.1.1.1 256.1.1.1 1.2.3", "+1 ((( +1 555 555 5555 +12-3",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "é😀a@b.co 😀 1.2.3.4", "a@b" + ".c" * 3000 + " x", "1" * 5000, "x@" * 500, "1.2." * 500,
    "password:token:abcdefgh", "API_KEY='abc.def=ghi' apikey=12345 Token = \"" + "0f" * 20 + '"', "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "Z9" * 8 + " AKIAshort",
    None, "",
]


def brute(kinds, text, by_start):
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    found.sort(key=lambda x: (x[0], x[1]) if by_start else (x[1], x[0]))
    return [f"{name}:{s}:{e}" for s, _, name, e in found]


@pytest.mark.parametrize(("kinds", "op", "by_start"), [
    (PII, lambda d: pii.span_columns(pii.find_personal_data(d)), False), (SECRETS, lambda d: secrets.span_columns(secrets.find_secrets(d)), True),
])
def test_base_spans(spark, kinds, op, by_start):
    given = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    d = given.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in d.collect()}
    out = op(d).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = brute(kinds, texts[r.doc_id], by_start)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r.doc_id]
        for name, _, _ in kinds:
            assert r[f"n_{name}"] == sum(s.startswith(f"{name}:") for s in spans)
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_contexts_of_seeds_find_an_unseen_identifier(spark):
    texts = [f"please contact agent number user{i}@acme.org today" for i in range(6)]
    texts += ["please contact agent number ZX-99871, today", "the year 2024 was fine", "we met in 2024 again"]
    rows = {r.doc_id: r.spans for r in pii.span_columns(pii.find_personal_data(docs_of(spark, texts))).collect()}
    assert rows[6] == "email:28:36"
    assert rows[7] == rows[8] == ""


def test_a_token_that_touches_a_seed_is_no_new_span(spark):
    texts = [f"please contact agent number user{i}@acme.org today" for i in range(6)] + ["please contact agent number user0@acme.org/x7 today"]
    rows = {r.doc_id: r.spans for r in pii.span_columns(pii.find_personal_data(docs_of(spark, texts))).collect()}
    assert rows[6] == "email:28:42"


def test_running_totals_over_blocks(spark):
    n = 1000
    got = spark.range(1).select(running_totals(F.sequence(F.lit(1), F.lit(n))).alias("t")).first().t
    assert got == [i * (i + 1) // 2 for i in range(n)]
    assert spark.range(1).select(running_totals(F.array(F.lit(7))).alias("t")).first().t == [0]


def test_random_tokens_are_found_and_words_are_not(spark):
    word = "internationalisation"
    texts = [f"plain {word}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}ofthings text" for i in range(300)]
    texts += [f"value {tokens.token_urlsafe(40).replace('-', 'x').replace('_', 'y')} end" for _ in range(40)] + ["see 2024-01-01-2024-01-02-2024-01-03-2024-01-04 ok"]
    rows = {r.doc_id: r.spans for r in secrets.span_columns(secrets.find_secrets(docs_of(spark, texts))).collect()}
    hits = sum("random:" in rows[i] for i in range(300, 340))
    assert hits >= 30
    assert not any("random:" in rows[i] for i in [*range(300), 340])


def test_randomness_battery():
    p = lambda t: secrets.randomness(t)[-1]
    assert p("a" * 30) < 1e-6
    assert p("etaoinetaoinetaoinetaoinetaoin") < 0.01
    assert secrets.infer_encoding("0123456789") == "decimal"
    assert secrets.infer_encoding("DEADBEEF") == "HEX"
    assert secrets.infer_encoding("aZ09+/==") == "base64"


def test_random_tokens_of_letters_alone_are_found(spark):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    prose = "the committee met again and wrote down what every member of the council had said about the old harbour"
    made = ["".join(rng.choice(letters) for _ in range(n)) for n in (40, 44, 52, 60) for _ in range(15)]
    texts = [f"{prose} {t} and so on" for t in made]
    texts += [f"{prose} {'Internationalisation' * 2}{i % 7 * 'of'}Things and so on" for i in range(60)]
    rows = {r.doc_id: r.spans for r in secrets.span_columns(secrets.find_secrets(docs_of(spark, texts))).collect()}
    assert sum("random:" in rows[i] for i in range(60)) >= 50
    assert not any("random:" in rows[i] for i in range(60, 120))


def test_short_words_are_no_discoveries_without_long_ones(spark):
    # no candidate of letters alone, and a battery that short written tokens often pass
    words = ["harbour", "council", "member", "written", "bright", "morning", "people", "village"]
    rng = random.Random(7)
    texts = [f"the {rng.choice(words)}-{rng.choice(words)}_{rng.choice(words)} of the town" for _ in range(300)]
    rows = secrets.span_columns(secrets.find_secrets(docs_of(spark, texts))).collect()
    assert sum("random:" in r.spans for r in rows) <= 3


def test_no_discovery_without_a_reference():
    n = np.zeros(secrets.BINS)
    n[:3] = 5
    assert secrets.discovery_limits({8: n}, {}, 0.01) == {}
    full = np.zeros(secrets.BINS)
    full[300] = 20_000
    assert secrets.discovery_limits({8: n}, {8: full}, 0.01) == {8: secrets._bin(secrets.MIN_RANDOMNESS)}


def chain(steps, width=6):
    """Edges of a chain: each group of instances is reached only by patterns of the group before."""
    groups = [[(f"0:s{i}", 0) for i in range(width)]] + [[(f"?:{k}x{i}", 4) for i in range(width)] for k in range(steps)]
    out = []
    for k, (known, new) in enumerate(zip(groups, groups[1:], strict=False)):
        out += [(f"p{k} {i} {side}", *x) for i, one in enumerate(new) for side in "lr" for x in [*known, one]]
    return out


def test_the_bootstrap_goes_on_until_nothing_changes(spark):
    edges = spark.createDataFrame(chain(9), "pattern string, instance string, kind int")
    assert pii.bootstrap(edges).count() == 54
    with pytest.raises(RuntimeError):
        pii.bootstrap(edges, max_rounds=4)


def test_a_swap_or_a_raised_score_is_a_change(spark):
    taken = lambda *rows: spark.createDataFrame(rows, "instance string, kind int, score double")
    a = taken(("x", 0, 0.9), ("y", 1, 0.8))
    assert pii._settled(a, taken(("y", 1, 0.8), ("x", 0, 0.9 + 1e-13)))
    for other in (taken(("x", 0, 0.9), ("z", 1, 0.8)), taken(("x", 0, 0.9), ("y", 2, 0.8)), taken(("x", 0, 0.9), ("y", 1, 0.81)), taken(("x", 0, 0.9))):
        assert not pii._settled(a, other) and not pii._settled(other, a)


def test_a_long_identifier_is_a_candidate(spark):
    texts = [f"please contact agent number user{i}@acme.org today" for i in range(6)]
    long = "ZX-" + "99871" * 14
    texts += [f"please contact agent number {long}, today"]
    rows = {r.doc_id: r.spans for r in pii.span_columns(pii.find_personal_data(docs_of(spark, texts))).collect()}
    assert rows[6] == f"email:28:{28 + len(long)}"
