"""Quotation linking, licence rules and SentencePiece against oracles and brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import SMOKE, docs_of, same_as_oracle
from pyspark.sql import functions as F

from canframes.llm import licenses, pieces, quotes
from canframes.llm.common import table

TALK = [
    (1, 0, "u", "Hello there.\nHow are you today my friend?"), (1, 1, "a", "> How are you today my friend?\nFine, thanks.\nAnd you?"),
    (1, 2, "u", "On Monday, Bob wrote:\n> > How are you today my friend?\n> Fine, thanks.\n> And you?\n\nAlso fine."), (1, 3, "a", ">Also fine.\nGood"),
    (1, 4, "u", "> not said by anyone\nok"), (1, 4, "u", "> not said by anyone\nok"), (2, 0, "u", "> Fine, thanks.\nother conv"), (2, 1, "a", None),
    (None, 1, "a", "> other conv\nx"), (2, None, "a", "> other conv\nx"), (2, 2, "a", "  >  > other conv  \n>   x\n\n"), (2, 3, "a", ""),
    (3, 0, "u", "a\nb\nc d e"), (3, 1, "u", "c d e"), (3, 2, "u", "> a b\n> c d e"), (3, 3, "u", "> a\n> b\nthen\n> c d e"), (3, 4, "u", "> c d e\n> c d e\n>\n> later"), (3, 5, "u", "later"),
]


def test_quotes(spark):
    d = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    out = quotes.link_quotes(d)
    same_as_oracle(out, quotes.ORACLE, conversations=d)
    rows = {(r.conv_id, r.turn): r for r in out.collect()}
    assert [(rows[1, t].reply_to, rows[1, t].thread, rows[1, t].depth) for t in range(4)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (2, 0, 3)]
    assert rows[1, 2].text == "Also fine."
    assert rows[2, 0].reply_to is None  # another conversation said it


def test_drawn_quotes_lead_to_their_originals(spark):
    """The given conversations with replies written into them: each quotes one earlier turn, whole
    or a line of it, wrapped anew, in other case and punctuation, below quotes of what that turn
    quoted. Every reply finds its turn, and all rows equal the oracle's."""
    rng = random.Random(11)
    talk, parents = [], {}
    turns = table(spark, SMOKE, "conversations").filter("text IS NOT NULL").orderBy("conv_id", "turn").collect()
    by_conv = {}
    for r in turns:
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv, rows in by_conv.items():
        own, quoted = {}, {}
        for t in range(max(6, len(rows))):
            words = (rows[t % len(rows)].text.split() or ["empty"])[:40]
            own[t] = [f"turn {conv} {t} says " + " ".join(words[:20]), f"and then {conv} {t} " + " ".join(words[20:])]
            lines = []
            if t and rng.random() < 0.8:
                parent = parents[conv, t] = rng.randrange(t)
                said = own[parent] if rng.random() < 0.5 else [rng.choice(own[parent])]
                if rng.random() < 0.5:
                    said = ["".join(c.upper() if c.isascii() else c for c in x) + "!" for x in said]
                if rng.random() < 0.4:  # wrapped anew as one passage
                    flat = " ".join(own[parent]).split()
                    said = [" ".join(flat[i : i + 7]) for i in range(0, len(flat), 7)]
                deeper = quoted.get(parent, [])[:6]
                lines = [f"On day {t}, user{parent} wrote:", *["> " + x for x in deeper], *[rng.choice(["> ", ">", "  > "]) + x for x in said]]
            quoted[t] = lines[1:]
            talk.append((conv, t, rng.choice(["user", "assistant"]), "\n".join([*lines, "" if rng.random() < 0.5 else "\n", *own[t]])))
    d = spark.createDataFrame(rng.sample(talk, len(talk)), "conv_id long, turn long, role string, text string")
    out = quotes.link_quotes(d)
    same_as_oracle(out, quotes.ORACLE, conversations=d)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(parents) > 50 and {k: got[k].reply_to for k in parents} == parents
    assert all(r.reply_to is None for k, r in got.items() if k not in parents)
    assert all(">" not in r.text and "wrote:" not in r.text for r in got.values())


def test_a_long_reply_chain(spark):
    n = 70
    talk = [(9, i, "u", (f"> word{i - 1} said here\n" if i else "") + f"word{i} said here") for i in range(n)]
    rows = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert all(rows[i].depth == i and rows[i].thread == 0 for i in range(n))


MIT = '''The MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
'''
BSD = '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
'''
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
TEXTS = [
    MIT, "\n".join("# " + x for x in MIT.split("\n")), BSD, BSD + ENDORSE, ENDORSE + BSD, "words without an end\nReleased under the MIT License.\nmore", "SPDX-License-Identifier: Apache-2.0\ncode",
    "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "Copyright 2001 X\nAll rights reserved.", "the licence of a poet", "", None, "You may obtain a copy of the License at", "released UNDER the  mit license!",
]
NAMES = ["MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-2-Clause", "MIT", "Apache-2.0", "CC-BY-4.0,CC-BY-NC-4.0", "All-Rights-Reserved", "", "", "", "", "MIT"]


def test_licenses(spark):
    d = docs_of(spark, TEXTS).unionByName(table(spark, SMOKE, "documents"))
    out = licenses.find_licenses(d)
    same_as_oracle(out, licenses.oracle(), documents=d)
    rows = {r.doc_id: r for r in licenses.find_licenses(docs_of(spark, TEXTS)).collect()}
    assert [rows[i].licenses for i in range(len(TEXTS))] == NAMES
    assert rows[12].unmatched and not rows[0].unmatched


def test_every_known_sentence_has_a_trigger_and_every_rule_known_sentences():
    import re

    trigger = re.compile(licenses._TRIGGER)
    assert all(trigger.search(t.lower()) for texts in licenses.SENTENCES.values() for t in texts)
    assert all(name in {*licenses.CATALOGUE.values(), "copyright"} for _, rule in licenses.RULES for name in rule)


WRAPPED = {
    "# Released under the\n# MIT License\n# more code words": "MIT",
    "Licensed under the Apache License,\nVersion 2.0\nand other words": "Apache-2.0",
    "Licensed under the MIT license, see LICENSE file.": "MIT",
    "Dual licensed under the MIT License and Apache License 2.0.": "Apache-2.0,MIT",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3": "GPL-3.0-only",
    "under the GNU General Public License, version 3 or later, as you like": "GPL-3.0-or-later",
    "the GNU Lesser General Public License, version 2.1": "",
    "subject to the terms of the Mozilla Public License,\n// v. 2.0. If a copy": "MPL-2.0",
    "MIT License": "MIT",
    "Copyright (c) 2020 Somebody\nLicensed under the MIT License\nCopyright 2021 Other": "MIT",
    "permit licenses of summit license boards": "",
    "the copyright holder of this permission": "",
    "word " * 5000 + "\n * released\n * under the ISC\n * License\n" + "word " * 5000: "ISC",
}


def test_wrapped_licences(spark):
    d = docs_of(spark, list(WRAPPED))
    out = licenses.find_licenses(d)
    same_as_oracle(out, licenses.oracle(), documents=d)
    assert [r.licenses for r in sorted(out.collect())] == list(WRAPPED.values())


def test_planted_licence_sentences_are_all_found(spark):
    """Every known sentence, wrapped at drawn places behind comment signs, at the start, in the
    middle and at the end of words without a stop; and a plain left-to-right search."""
    import random

    rng = random.Random(5)
    words = "alpha beta license gamma delta warranty epsilon permission the under licensed copyright".split()
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    keys = {tuple(k.split(" ")): v for k, v in licenses.CATALOGUE.items()}
    planted = []
    for name, texts in [*licenses.SENTENCES.items(), *[(f"spdx.{x.lower()}", [f"SPDX-License-Identifier: {x}"]) for x in licenses.SPDX]]:
        for sentence in texts:
            for before, after in ((0, 9), (9, 9), (9, 0)):
                parts = filler(before) + ([sentence] if name.startswith("spdx") else sentence.split()) + filler(after)
                planted.append((name, sentence, "".join(w + rng.choice([" ", " ", " ", "\n# ", "\n   // "]) for w in parts)))
    d = docs_of(spark, [t for *_, t in planted])
    out = licenses.find_licenses(d)
    rows = [r.sentence_ids.split(",") for r in sorted(out.collect())]
    assert [(n, s) for (n, s, _), ids in zip(planted, rows, strict=True) if n not in ids] == []
    same_as_oracle(out, licenses.oracle(), documents=d)

    runs = [" ".join(rng.choice([*filler(2), *rng.choice(list(keys))]) for _ in range(60)) for _ in range(40)]
    runs += [" ".join(" ".join(rng.choice([tuple(filler(3)), *keys])) for _ in range(8)) for _ in range(80)]
    want = []
    for run in runs:
        w, i, ids = licenses.normalised(run).split(" "), 0, []
        while i < len(w):
            hits = [(len(k), v) for k, v in keys.items() if tuple(w[i : i + len(k)]) == k]
            if w[i] == "copyright" and i + 1 < len(w) and (w[i + 1] == "c" or (len(w[i + 1]) == 4 and w[i + 1].isdigit())):
                hits.append((2, "copyright"))
            n, v = max(hits, default=(1, None))
            ids += [v] if v and v not in ids else []
            i += n
        want.append(",".join(ids))
    assert [r.sentence_ids for r in sorted(licenses.find_licenses(docs_of(spark, runs)).collect())] == want


def best_score(text, table):
    """Best total over all segmentations of the whole normal form, by a plain table."""
    score, longest, unknown = {p: s for p, _, s in table.pieces}, table.longest, table.unknown_score
    s = "▁" + text.replace(" ", "▁")
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - longest), e):
            v = score.get(s[b:e], unknown if e - b == 1 else float("-inf"))
            best[e] = max(best[e], best[b] + v)
    return best[-1]


def total(ids, table):
    score, unknown = {i: s for _, i, s in table.pieces}, table.unknown_score
    out, run = 0.0, b""
    for i in [*ids, -1]:
        if i in table.byte_ids:
            run += bytes([table.byte_ids.index(i)])
            continue
        out += unknown * len(run.decode("utf-8"))
        run = b""
        out += score.get(i, 0.0)
    return out


TRICKY = ["Hello  world\n\tx  é 你好𝔘 ", " ", "a" * 700, "x y\u0000z 12.5² ²a", "naïve—“quotes” 3.14", "".join(random.Random(4).choice("abcdeth ") for _ in range(300))]


@pytest.mark.parametrize("most", [pieces.DICTIONARY_BYTES, 30_000, 0])
def test_best_paths_and_round_trip(spark, most):
    model = pieces.load_pieces()
    texts = TRICKY + [None, ""] + [r.text for r in table(spark, SMOKE, "documents").limit(40).collect()]
    out = pieces.encode(docs_of(spark, texts), model, most)
    rows = out.collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame(rows, out.schema), model).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for r in rows:
        if texts[r.doc_id]:
            assert total(r.ids, model) == best_score(texts[r.doc_id], model), texts[r.doc_id][:50]
        else:
            assert r.ids == []


def test_units_are_not_crossed_by_any_piece():
    model = pieces.load_pieces()
    assert "|[^" in model.unit_pattern()
    crossing = pieces.PieceTable([("▁a", 1, -1.0), ("a.b", 2, -2.0)], None, 0)
    assert crossing.unit_pattern() == "▁*[^▁]+|▁+"
    with pytest.raises(ValueError, match="space mark"):
        pieces.PieceTable([("a▁b", 1, -1.0)], None, 0).unit_pattern()


def _polynomial(unit):
    """The unit hash in whole-number arithmetic."""
    values, base, raw = pieces._byte_values().tolist(), int(pieces._BASE), unit.encode()
    h = sum(values[b] * pow(base, i, 1 << 64) for i, b in enumerate(raw)) % (1 << 64)
    h = (h ^ (h >> 32) ^ len(raw)) * int(pieces._MIX) % (1 << 64)
    h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def test_units_and_their_hashes(spark):
    """Cutting and hashing whole chunks equals findall and the polynomial, unit by unit."""
    import re

    model = pieces.load_pieces()
    texts = [*TRICKY, None, "", "▁▁ a▁b", "ab" * 400, "a\xffb ÿ"] + [r.text for r in table(spark, SMOKE, "documents").collect()]
    pattern = re.compile(model.unit_pattern())
    want = [pattern.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    found = pieces.Units(model)(pa.array(texts, pa.string()))
    assert found.ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
    units = [u for x in want for u in x]
    assert found.strings(np.arange(len(units))).to_pylist() == units
    distinct = dict.fromkeys(units)
    assert dict(zip(units, found.hashes.tolist(), strict=True)) == {u: _polynomial(u) for u in distinct}
    assert len(set(found.hashes.tolist())) == len(distinct) and pieces.unit_hash("é1") == _polynomial("é1")


def test_short_and_long_paths_agree(spark):
    model = pieces.load_pieces()
    rng = random.Random(6)
    units = ["▁" + "".join(rng.choice("abcdehtéing") for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["你", "x1²"]
    frame = spark.createDataFrame([(u, pieces.unit_hash(u), 1) for u in units], "unit string, h long, n long")
    edges = pieces.lattice(frame, model)
    scores = pieces._constants([model.unknown_score, *[s for _, _, s in model.useful()]], "double")
    size = F.length("unit")
    longest = max(len(p) for p, _, _ in model.useful())
    both = edges.select(
        pieces.short_path(F.col("edges"), size, scores).alias("short"),
        pieces.best_path(F.col("edges"), size, scores, longest, F.lit(model.most_ending(False))).alias("long"),
    ).collect()
    assert len(both) == len(set(units)) and all(r.short == r.long for r in both)


def test_a_text_that_its_ids_do_not_give_back_is_marked(spark):
    model = pieces.load_pieces()
    rows = pieces.encode(docs_of(spark, ["a▁b", "a b", "x" * 50]), model).collect()
    assert [r.round_trip for r in sorted(rows)] == [False, True, True]
    cut, spell = pieces.Units(model), pieces.Spelling.of(model)
    ids = np.array([i for r in sorted(rows)[1:] for i in r.ids])
    ends = np.cumsum([len(r.ids) for r in sorted(rows)[1:]])
    texts = pa.array(["a b", "x" * 50])
    assert pieces._decode_alike(cut, texts, ids, ends, spell) == [True, True]
    ids[-1] = ids[0]
    assert pieces._decode_alike(cut, texts, ids, ends, spell) == [True, False]


def test_long_units_fold_in_blocks(spark):
    model = pieces.PieceTable([("a", 1, -3.0), ("aa", 2, -4.0), ("▁", 3, -1.0)], None, 0)
    rows = pieces.encode(docs_of(spark, ["a" * 1001]), model).collect()
    assert rows[0].ids.count(2) == 500 and rows[0].ids.count(1) == 1 and rows[0].ids[0] == 3
