"""Quality rules and language identification: counts against the definitions, verdicts and
languages on held-out rows."""

import itertools
import math
import re
import unicodedata
import zlib

import pytest
from helpers import SMALL, SMOKE

from canframes.llm import language, quality
from canframes.llm.common import table
from canframes.llm.queries import QUERIES

TRICKY = ["", None, "a a a a", "a b c a b c", "x\nx\n\n\nx y\nx", "α β # $$ |", "a\x0bb\x0cc\rd e f", "w " * 60, " ".join(f"w{i}" for i in range(60))]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_counts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect() if len(r.text) < 3000] + TRICKY
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.apply_quality(d, quality.QualityModel(None)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed)


def test_quality_on_rows_it_was_not_fitted_on(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.fit_quality(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.apply_quality(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    assert sum(r.quality == 1 for r in rows) > 50
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    assert not [r for r in rows if r.quality == 1 and not r.kept]


def test_one_class_of_labels_rejects_nothing_more(spark):
    docs = table(spark, SMOKE, "documents")
    model = quality.fit_quality(docs, table(spark, SMOKE, "labels").filter("quality = 1"))
    assert model.weights is None


def test_language_on_held_out_rows(spark):
    got = QUERIES["op7_language_id"](spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in table(spark, SMALL, "documents").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_text_without_letters_is_unknown(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "12 34 !!", "en"), (3, "the cat", "en"), (4, "", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(d, language.fit_language(d)).collect()}
    assert rows[1] == rows[2] == rows[4] == ("und", 0.0)
    assert rows[3][0] == "en"
    assert {r.lang_pred for r in language.identify(d, language.fit_language(d.limit(0))).collect()} == {"und"}


LETTERLESS = ["½ ② ²", "Ⅷ", "١٢٣", "_ __", "\u0301\u0902", "12½", "①Ⅻ"]


@pytest.mark.parametrize("text", LETTERLESS)
def test_numbers_of_any_script_are_no_letters(spark, text):
    d = spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr")], "doc_id long, text string, lang string")
    assert language.fit_language(d).predict(text) == ("und", 0.0)


def test_marks_stay_with_their_letters():
    assert language.letters("हिन्दी में!").decode() == " हिन्दी में "
    assert language.letters("x½y Ⅷ E\u0301a").decode() == " x y e\u0301a "


def _mixed(value, salt, dims):
    """The slot hash in whole-number arithmetic."""
    h = (value ^ (salt * 0x27D4EB2F & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 15)) * 0x9E3779B1 & 0xFFFFFFFF
    return (h ^ (h >> 13)) & (dims - 1)


def _predicted(model, text):
    """Family, pair votes and score, n-gram by n-gram."""
    text = text or ""
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text).split()
    raw = (" " + " ".join(words).lower() + " ").encode()
    grams = []
    for n in (1, 2, 3, 4):
        slots = []
        for i in range(len(raw) - n + 1):
            h = raw[i]
            for c in raw[i + 1 : i + n]:
                h = (h * 0x9E3779B1 + c) & 0xFFFFFFFF
            slots.append(_mixed(h, n, language.DIMS))
        grams.append(slots)

    def margin(w, b):
        w = w.tolist()
        return b + sum(math.fsum(w[s] for s in slots) / len(slots) for slots in grams if slots)

    z = [margin(w, b) for w, b in zip(model.family_w, model.family_b, strict=True)]
    family = model.families[z.index(max(z))]
    share = 1 / sum(math.exp(v - max(z)) for v in z)
    langs = model.members[family]
    if len(langs) == 1:
        return langs[0], share
    votes, belief = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
    pairs, w, b, ab = model.pairs[family]
    assert pairs == list(itertools.combinations(langs, 2))
    for k, (x, y) in enumerate(pairs):
        p = 1 / (1 + math.exp(-(ab[k][0] * margin(w[k], b[k]) + ab[k][1])))
        votes[x if p >= 0.5 else y] += 1
        belief[x] += p / (len(langs) - 1)
        belief[y] += (1 - p) / (len(langs) - 1)
    best = max(langs, key=lambda c: (votes[c], belief[c]))
    return best, share * belief[best]


def test_language_against_a_plain_scorer(spark):
    """Every text of the smoke table (and some without letters), scored over the fitted weights
    one n-gram at a time."""
    docs = table(spark, SMOKE, "documents")
    model = language.fit_language(docs.filter(~language.held_out()))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if len(r.text) < 20000}
    texts |= {-1 - k: t for k, t in enumerate([*LETTERLESS, None, "", "Élan vital.", "word"])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in language.identify(d, model).collect():
        lang, score = _predicted(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, (r, lang, score)


def test_repeated_ids_teach_their_own_language(spark):
    rows = [(i, t, c) for i in range(30) for t, c in ((f"der hund {i}x und die katze", "de"), (f"the dog {i}x and a cat", "en"))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(d)
    assert model.predict("der und die")[0] == "de" and model.predict("the and a")[0] == "en"
    same = [language.fit_language(d.repartition(n)).predict("the hund and cat")[1] for n in (1, 5)]
    assert abs(same[0] - same[1]) < 1e-9
    many = spark.range(language.MOST_LANGUAGES + 1).selectExpr("id AS doc_id", "'a b' AS text", "string(id) AS lang")
    with pytest.raises(ValueError, match="languages"):
        language.fit_language(many)


def test_families():
    assert language.family_of("de") == language.family_of("en") != language.family_of("fr") == language.family_of("es")
    assert language.family_of("xx") != language.family_of("yy")
