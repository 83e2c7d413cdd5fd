"""Periodic runs against brute force; fill-in-middle against SQL, exact round trip."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from helpers import SMALL, SMOKE, awkward, docs_of, same_as_oracle

from canframes.llm import infill, periodic
from canframes.llm.common import table
from canframes.llm.queries import QUERIES

EMPTY = hashlib.sha256(b"").hexdigest()


def brute_runs(words, min_length=12):
    """Maximal stretches by comparing each word with the one q before, smallest q first."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    """The rule of the query, written out word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = planted_words(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    of = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, of(lines), of(kept))


def test_runs_of_random_sequences():
    rng = random.Random(5)
    for _ in range(3000):
        kinds, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randint(0, 70)
        w = [rng.randrange(kinds) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        least = rng.choice([12, 2, 4, 7])
        assert periodic.word_runs(w, least) == brute_runs(w, least)


def test_forest_gives_last_ends_and_longest_suffixes():
    rng = random.Random(8)
    for _ in range(300):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 40))]
        forest = periodic.SuffixForest()
        for i, s in enumerate(w):
            last = {}  # earlier end -> longest suffix of w[: i + 1] whose last earlier end it is
            for n in range(1, i + 1):
                ends = [e for e in range(n - 1, i) if w[e - n + 1 : e + 1] == w[i - n + 1 : i + 1]]
                if ends:
                    last[ends[-1]] = n
            assert dict(forest.append(s)) == last


def test_stretches_hold_every_run():
    rng = random.Random(2)
    words = [str(i) for i in range(400)]
    for at, p, n in ((0, 6, 12), (60, 7, 21), (200, 1, 12), (300, 50, 100)):
        words[at : at + n] = [f"r{at}_{k % p}" for k in range(n)]
    rng.shuffle(words[390:])
    assert periodic.word_runs(words) == brute_runs(words) == [(0, 12, 6), (60, 21, 7), (200, 12, 1), (300, 100, 50)]


@pytest.mark.parametrize("words", [["x"] * 30000, [f"w{i % 11}" for i in range(30000)], [f"w{i}" for i in range(30000)]])
def test_long_texts(words):
    p = len(set(words))
    assert periodic.word_runs(words) == ([] if p == len(words) else [(0, len(words), p)])


def test_periodic_query_on_the_smoke_table(spark):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SMOKE).collect()}
    rows = table(spark, SMOKE, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) >= len(rows) // 20
    for r in rows:
        if len(r["text"].split()) <= 1500:
            assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])


def test_periodic_awkward_rows(spark):
    src = awkward(spark)
    got = periodic.run_columns(periodic.find_runs(src, words=periodic.with_periodic_tail)).collect()
    want = [brute_row(r["doc_id"], r["text"]) if len(r["text"] or "") < 50000 else None for r in src.collect()]
    rest = sorted(repr(tuple(r)) for r in got)
    for w in filter(None, want):
        rest.remove(repr(w))
    assert len(rest) == want.count(None) == 1  # the long text: one word sequence, repeated
    assert periodic.find_runs(src.limit(0)).collect() == []
    longest = periodic.run_columns(periodic.find_runs(src.filter("length(text) > 50000"))).first()
    assert (longest["n_runs"], longest["start"], longest["length"], longest["period"], longest["exponent_milli"]) == (1, 0, 40000, 5, 8_000_000)
    empty = periodic.run_columns(periodic.find_runs(docs_of(spark, [None, ""]))).collect()
    assert [(r["n_runs"], r["start"], r["runs_sha256"], r["collapsed_sha256"]) for r in empty] == [(0, None, EMPTY, EMPTY)] * 2


def test_collapsed_text_and_runs_are_given(spark):
    text = "intro " + "a b c " * 5 + "end"
    r = periodic.find_runs(docs_of(spark, [text])).first()
    assert r["collapsed"] == "intro a b c end" and [tuple(x) for x in r["runs"]] == [(1, 15, 3)] and r["n_words"] == 17


# --- fill-in-middle -------------------------------------------------------------------------


def test_infill_against_sql(spark):
    docs = table(spark, SMALL, "documents")
    same_as_oracle(QUERIES["op12_fill_in_middle"](spark, SMALL), infill.ORACLE, documents=docs)


def test_infill_awkward_rows_against_sql(spark):
    src = awkward(spark)
    same_as_oracle(infill.digest_columns(infill.fill_in_middle(src)), infill.ORACLE, documents=src)
    assert infill.fill_in_middle(src.limit(0)).collect() == []


def test_infill_units_and_marks(spark):
    texts = ["<", "a<S b> c<", "<P", " \n ", "\x1c x\x85y z w v", "é" * 50 + " a b \t\n", "a <P> b", "x <M>", "<<S>", "<S<P d e f g"] * 12
    src = docs_of(spark, texts)
    same_as_oracle(infill.digest_columns(infill.fill_in_middle(src)), infill.ORACLE, documents=src)
    rows = infill.fill_in_middle(src).collect()
    assert {r["form"] for r in rows if "<P>" in texts[r["doc_id"]] or "<M>" in texts[r["doc_id"]] or "<S>" in texts[r["doc_id"]]} == {"plain"}
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_infill_gives_the_text_back(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    made = infill.fill_in_middle(docs)
    both = made.withColumn("again", infill.restore(made["output"], made["form"])).join(docs, "doc_id")
    assert both.filter("NOT (again <=> coalesce(text, ''))").count() == 0
    share = made.groupBy("form").count().collect()
    n = {r["form"]: r["count"] for r in share}
    assert 0.4 < n["plain"] / sum(n.values()) < 0.6 and n["spm"] > 2 * n["psm"]


def test_infill_of_a_text_longer_than_a_chunk(spark):
    text = "wörd " * (infill.CHUNK_BYTES // 4)
    src = docs_of(spark, ["a b", text, None, text])
    made = infill.fill_in_middle(src, fim_percent=100)
    got = made.withColumn("again", infill.restore(made["output"], made["form"])).selectExpr("doc_id", "n", "form", "sha2(again, 256) AS h").collect()
    want = hashlib.sha256(text.encode()).hexdigest()
    n = infill.CHUNK_BYTES // 4 + 1
    assert [(r["n"], r["h"] == want) for r in sorted(got)] == [(2, False), (n, True), (0, False), (n, True)]
