"""SimHash groups, components, line dedup and decontamination against brute force."""

import itertools
import random

import pytest
import xxhash
from helpers import SMOKE, components, docs_of, same_as_oracle

from canframes.llm import decontaminate, linedup, simhash
from canframes.llm.common import table
from canframes.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_groups(spark):
    d = table(spark, SMOKE, "documents")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in d.collect()}
    got = simhash.simhash_groups(d).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == components(fps, near)


def test_long_postings_link_the_same_groups(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        values.add(x)
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in enumerate(sorted(values))}
    nodes = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    plain = {i: v % (1 << 64) for i, v in signed.items()}
    expected = components(plain, near)
    for most in (10_000, 3):
        edges = [(r.a, r.b) for r in simhash.links(nodes, 2, most).collect()]
        assert all(near(a % (1 << 64), b % (1 << 64)) for a, b in edges)
        number = {v: i for i, v in signed.items()}
        met = {frozenset((number[a], number[b])) for a, b in edges}
        assert components({i: i for i in signed}, lambda a, b, m=met: frozenset((a, b)) in m) == expected


def test_shared_blocks_tell_the_shared_bytes():
    assert len(simhash.BLOCKS) == 14
    for three in itertools.combinations(range(8), 3):
        assert sum(set(three) <= set(b) for b in simhash.BLOCKS) == 1
    for n in range(5):
        for other in itertools.combinations(range(8), n):
            blocks = sum(not set(other) & set(b) for b in simhash.BLOCKS)
            assert blocks == {0: 14, 1: 7, 2: 3, 3: 1}[n] if n < 4 else blocks <= 1
    assert (simhash.least_shared(1), simhash.least_shared(2)) == (7, 3)


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("most", [1, 4, 64])
def test_links_are_all_pairs_within_the_distance(spark, bits, most):
    """Fingerprints that meet in short and long postings, some with pairs in both."""
    rng = random.Random(10 * bits + most)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            values.add(x)
    order = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in order]
    edges = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, most).collect()}
    within = lambda a, b: (a ^ b).bit_count() <= bits
    pairs = {(a, b) for a, x in zip(signed, order, strict=True) for b, y in zip(signed, order, strict=True) if a < b and within(x, y)}
    if most == 64:
        assert edges == pairs
    met = {frozenset(e) for e in edges}
    assert components(dict(zip(signed, order, strict=True)), within) == components({v: v for v in signed}, lambda a, b: frozenset((a, b)) in met)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3), (5, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_patience_aligns_and_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        m = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert linedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert linedup.patience(list(range(5)), [9, 1, 2, 3, 8]) == [(1, 1), (2, 2), (3, 3)]


def line(n, words=6):
    return " ".join(f"w{n}x{k}" for k in range(words))


def test_blocks_go_from_the_later_document(spark):
    block = [line(900, 20), "short", line(901, 30), line(902, 10)]
    texts = [
        "\n".join([line(1), *block, line(2)]), "\n".join([line(3), line(4), *block]), "\n".join([line(1), *block, line(2)]),
        "\n".join([line(5), "short", line(6)]), "\n".join([block[2], line(7), block[0]]), line(8), "\n".join(x.upper() + " " for x in block),
    ]
    rows = {r.doc_id: r for r in linedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert rows[0].text == texts[0]
    assert rows[1].text == "\n".join([line(3), line(4)])
    assert rows[2].text == ""
    assert rows[3].text == texts[3] and rows[5].text == texts[5]
    assert rows[4].text == line(7)  # moved blocks
    assert rows[6].text == ""


def test_line_dedup_against_all_earlier_documents(spark):
    d = table(spark, SMOKE, "documents")
    texts = sorted((r.doc_id, r.text) for r in d.collect())
    got = {r.doc_id: set(r.removed_lines) for r in linedup.dedup_lines(d).collect()}
    shapes = []
    for i, text in texts:
        h, w, _ = linedup.profile(text)
        expected = {x for g in shapes for x in linedup.common_block_lines(g, h, w)}
        shapes.append(h)
        assert {x for x in got[i] if w[x]} == {x for x in expected if w[x]}


def test_a_line_in_every_document_stays_in_the_first_only(spark):
    texts = [f"{line(77, 9)}\n{line(i)}" for i in range(30)]
    rows = {r.doc_id: r.text for r in linedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert rows[0] == texts[0]
    assert all(rows[i] == line(i) for i in range(1, 30))


def test_leaks_match_the_oracle(spark):
    d, b = table(spark, SMOKE, "documents"), table(spark, SMOKE, "benchmark")
    same_as_oracle(decontaminate.find_leaks(d, b), decontaminate.ORACLE, documents=d, benchmark=b)


def test_a_short_item_inside_a_long_document(spark):
    item = " ".join(f"q{i}" for i in range(20))
    long = " ".join(f"z{i}" for i in range(20_000))
    changed = " ".join(f"q{i}" if i != 0 else "other" for i in range(20))
    broken = " ".join(f"q{i}" if i % 4 else "other" for i in range(20))
    d = docs_of(spark, [long + " " + item.upper() + "! " + long, changed, broken, "q0 q1", item[:30]])
    b = spark.createDataFrame([(5, item), (6, None), (7, "?!"), (8, "q0 q1"), (5, item), (9, item)], "item_id long, text string")
    rows = {r.doc_id: (r.contaminated, r.item_ids, r.n_items) for r in decontaminate.find_leaks(d, b).collect()}
    assert rows[0] == rows[1] == (True, "5,9", 2)
    assert rows[2] == rows[4] == (False, "", 0)
    assert rows[3] == (True, "8", 1)


def test_sketch_misses_no_pair_at_the_threshold(spark):
    rng = random.Random(3)
    items = [[f"i{k}w{rng.randint(0, 30)}" for _ in range(rng.randint(3, 40))] for k in range(15)]
    texts = [" ".join(w if rng.random() < 0.97 else "zz" for w in rng.choice(items)) for _ in range(150)]
    d = docs_of(spark, texts)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    same_as_oracle(decontaminate.find_leaks(d, b), decontaminate.ORACLE, documents=d, benchmark=b)


def test_sketch_asks_each_size_class_for_its_matches(spark):
    """A document with half of a sketch, one with a shared phrase alone, items of all classes."""
    phrase = " ".join(f"every{i}" for i in range(12))
    items = [phrase + " " + " ".join(f"i{k}w{i}" for i in range(6 * k)) for k in range(40)]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    each = decontaminate.item_shingles(b)
    low = decontaminate.sketch(each).groupBy("item", "size_class", "need").count().join(each.select("item", "n"), "item").collect()
    assert len(low) == 40
    assert all(r.size_class == r.n.bit_length() - 1 and r["count"] == r.n - r.need + max(1, r.size_class) for r in low)
    rng = random.Random(5)
    texts = [phrase + " and nothing else of any item", "x " * 50 + items[30] + " y" * 50]
    for k in range(120):
        w = items[k % 40].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    d = docs_of(spark, texts + texts[:20])
    same_as_oracle(decontaminate.find_leaks(d, b), decontaminate.ORACLE, documents=d, benchmark=b)


def runs_searched(first, later, size, least=8):
    """Lines with a word of ``later`` in any common run of ``least`` words, by comparing all pairs of starts."""
    out = set()
    for i in range(len(first)):
        for j in range(len(later)):
            n = 0
            while i + n < len(first) and j + n < len(later) and first[i + n] == later[j + n]:
                n += 1
            if sum(size[j : j + n]) >= least:
                out.update(x for x in range(j, j + n) if size[x])
    return out


def test_a_block_beside_a_short_line_in_another_order():
    assert linedup.common_block_lines([1, 2], [2, 1], [3, 50]) == [1]
    assert linedup.common_block_lines([1, 5, 2, 6, 3], [3, 2, 1], [3, 4, 50]) == [2]
    assert linedup.common_block_lines([1, 2, 9, 2, 3], [1, 2, 3], [4, 5, 4]) == [0, 1, 2]  # overlapping blocks


def test_no_common_run_is_left():
    rng = random.Random(4)
    for _ in range(1500):
        words = [0, *(rng.randint(1, 9) for _ in range(rng.randint(2, 9)))]
        a = [rng.randrange(len(words)) for _ in range(rng.randint(0, 14))]
        b = [rng.randrange(len(words)) for _ in range(rng.randint(0, 14))]
        size = [words[x] for x in b]
        got = linedup.common_block_lines(a, b, size)
        assert {x for x in got if size[x]} == runs_searched(a, b, size)


def test_deletions_are_the_runs_of_any_earlier_document(spark):
    rng = random.Random(5)
    pool = ["", *(line(i, rng.randint(1, 9)) for i in range(12))]
    made = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    gap = [f"{line(80, 4)}\n\n{line(81, 5)}", f"{line(80, 4)}\n{line(81, 5)}", f"{line(82, 2)}\n{line(80, 4)}\n{line(81, 5)}"]
    smoke = [r.text for r in table(spark, SMOKE, "documents").orderBy("doc_id").collect()]
    for texts in (made, gap, smoke):
        got = {r.doc_id: set(r.removed_lines) for r in linedup.dedup_lines(docs_of(spark, texts)).collect()}
        shapes = []
        for i, text in enumerate(texts):
            h, w, _ = linedup.profile(text)
            expected = {x for g in shapes if not set(g).isdisjoint(h) for x in runs_searched(g, h, w)}
            assert {x for x in got[i] if w[x]} == expected
            shapes.append(h)


def test_blocks_come_from_the_alignment():
    """The alignment alone says what goes, and the lines of all shared runs do."""
    import random

    rng = random.Random(12)
    rows = []
    for _ in range(400):
        size_of = [rng.randint(0, 9) for _ in range(12)]
        a, b = ([rng.randrange(12) for _ in range(rng.randint(1, 25))] for _ in range(2))
        rows.append((a, b, [size_of[x] for x in b]))
    for a, b, size in rows:
        runs = linedup._shared_runs(a, b, size, 8)
        assert all(a[i : i + hi - lo] == b[lo:hi] for lo, hi, i in runs)
        got = linedup.common_block_lines(a, b, size)
        assert [x for x in got if size[x]] == sorted({x for lo, hi, _ in runs for x in range(lo, hi) if size[x]})
    a, b, size = [1, 2, 3, 9], [3, 1, 2], [9, 5, 5]
    assert linedup._aligned_blocks(a, b, size, [(0, 1), (1, 2)], 8) == {1, 2}
    assert linedup._aligned_blocks(a, b, size, [(2, 0)], 8) == {0}
    assert linedup.common_block_lines(a, b, size) == [0, 1, 2]


def test_heaviest_part_by_brute_force():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        pairs = list({(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randint(0, 9))})
        size = [rng.randint(0, 6) for _ in range(7)]
        best = max(
            sum(size[j] for _, j in part)
            for n in range(len(pairs) + 1)
            for part in itertools.combinations(sorted(pairs), n)
            if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(part, part[1:]))
        )
        got = linedup._heaviest(pairs, size)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:])) and set(got) <= set(pairs)
        assert sum(size[j] for _, j in got) == best
