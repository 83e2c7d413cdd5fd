"""The N-gram Jaccard join against brute force over all pairs, on long lists and crowded groups too."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SMALL, SMOKE, awkward, components, docs_of

from canframes.llm import ngramjoin as J
from canframes.llm.common import table
from canframes.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(texts, percent=85, k=4):
    """{id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    like = lambda a, b: bool(a and b) and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b)
    root = components(sets, like)
    return {i: (len(sets[i]), root[i]) for i in texts}


def result(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_merge_short_keeps_what_counting_keeps():
    rng = random.Random(4)
    for _ in range(500):
        lists = [sorted(rng.sample(range(40), rng.randint(0, 12))) for _ in range(rng.randint(0, 12))]
        least = rng.randint(1, 6)
        count = Counter(x for one in lists for x in one)
        assert J.merge_short(lists, least) == sorted((x, n) for x, n in count.items() if n >= least)


def test_divide_skip_keeps_what_counting_keeps():
    rng = random.Random(9)
    for _ in range(500):
        lists = [np.array(sorted(rng.sample(range(60), rng.choice([0, 1, 3, 10, 50]))), dtype=np.int64) for _ in range(rng.randint(0, 20))]
        need = rng.randint(1, 12)
        count = Counter(x for one in lists for x in one.tolist())
        ids, n = J.divide_skip(lists, need, 60)
        assert list(zip(ids.tolist(), n.tolist(), strict=True)) == sorted((x, k) for x, k in count.items() if k >= need)


@pytest.mark.parametrize("percent", [50, 85, 95])
def test_heads_of_linked_sets_share_enough(percent):
    rng = random.Random(percent)
    met = 0
    for _ in range(3000):
        a = sorted(rng.sample(range(10**6), rng.randint(1, 120)))
        b = sorted(set(rng.sample(a, max(1, len(a) - rng.randint(0, len(a) * (100 - percent) // 80 + 1)))) | set(rng.sample(range(10**6), rng.choice([0, 0, 1, 2, 8]))))
        if a == b or 100 * len(set(a) & set(b)) < percent * len(set(a) | set(b)):
            continue
        heads = [set(x[: int(J.head_size(len(x), percent))]) for x in (a, b)]
        least = int(J.head_overlap(min(len(a), len(b)), percent))
        assert len(heads[0] & heads[1]) >= least >= 1
        met += 1
    assert met > 20


def test_block_links_connect_what_all_pairs_connect():
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    sets = [J.shingle_set(edited(rng, base, rng.randint(0, 6))) for _ in range(60)]
    nodes = list(enumerate(sets))
    links = J.block_links(nodes[::2], nodes, 85)
    like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    assert len(links) < len(nodes) and all(like(sets[a], sets[b]) for a, b in links)
    asked = {i for i, _ in nodes[::2]}
    edges = {(i, j) for i in asked for j, _ in nodes if i != j and like(sets[i], sets[j])}
    assert _closure(len(nodes), edges) == _closure(len(nodes), links)


def _closure(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("sf", [SMOKE, SMALL])
def test_query_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = result(QUERIES["op13_ngram_jaccard"](spark, sf))
    assert got == brute(texts)
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("max_list,block", [(64, 1 << 19), (2, 1 << 19), (3, 300), (5, 2000)])
def test_large_groups_of_near_copies(spark, max_list, block):
    """Groups whose shingles all stand on long lists: members that do not link with their hub are
    searched in blocks, and nothing is lost."""
    rng = random.Random(max_list)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60 + 40 * g)]
        texts += [edited(rng, base, rng.randint(0, 4)) for _ in range(50)]
    passage = " ".join(f"p{i}" for i in range(55))
    texts += [" ".join(f"own{d}_{i}" for i in range(rng.randint(2, 40))) + " " + passage for d in range(60)]
    texts += ["same text here"] * 20 + ["Same Text  here\n", "same text", "", None]
    rng.shuffle(texts)
    want = brute(dict(enumerate(texts)))
    got = result(J.similar_documents(docs_of(spark, texts), max_list=max_list, block_shingles=block))
    assert got == want


@pytest.mark.parametrize("percent,k", [(50, 2), (95, 4), (100, 3)])
def test_other_parameters(spark, percent, k):
    rng = random.Random(percent)
    base = [f"w{i}" for i in range(40)]
    texts = [edited(rng, base[: rng.randint(1, 40)], rng.randint(0, 3)) for _ in range(80)]
    got = result(J.similar_documents(docs_of(spark, texts), shingle_words=k, percent=percent, max_list=3, block_shingles=200))
    assert got == brute(dict(enumerate(texts)), percent, k)


def test_awkward_rows(spark):
    src = awkward(spark)
    rows = J.similar_documents(src).collect()
    assert len(rows) == src.count() and rows[0].asDict().keys() == {"doc_id", "n_shingles", "component_id"}
    by = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert by[(3, 4, 3)] == 2 and by[(4, 4, 3)] == 1  # the same words under three rows
    assert by[(0, 0, 0)] == by[(1, 0, 1)] == 1 and by[(None, 0, None)] == 1  # no words
    assert by[(None, 1, None)] == 1 and by[(2, 1, 2)] == 1 and by[(3, 1, 3)] == 1
    assert J.similar_documents(src.limit(0)).collect() == []
