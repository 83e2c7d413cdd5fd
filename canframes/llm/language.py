"""Language identification in two steps: first the language family, then one-versus-one
linear support vector machines between the languages of the winning family.

Features are hashed character n-grams (1 to 4 bytes) of the lower-cased letters of the whole
text. Models are fitted on at most ``per_class`` documents of each language; only text and
language of training rows are looked at, and predictions see only the text."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import Shared, map_batches
from canframes.llm.linear import Sample, bounded_sample, char_slots, fit_logistic, fit_svm, margins, platt

DIMS = 1 << 15
PER_CLASS = 500
UNKNOWN = "und"
# fixed values: language families of common language codes; any other code is a family of its own
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")
_NO_WORD = regex.compile(r"[^\p{L}\p{M}]+")  # marks stay with their letters
#: more languages than this are taken for a wrong column
MOST_LANGUAGES = 500


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower(), f"only {lang}")


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters and their marks, one space between and around them; empty
    without a letter."""
    if not _LETTER.search(text or ""):
        return b""
    return b" %b " % _NO_WORD.sub(" ", text).strip().lower().encode("utf-8")


def feature_blocks(text: str | None) -> list[np.ndarray]:
    raw = letters(text)
    return [char_slots(raw, n, DIMS) for n in (1, 2, 3, 4)] if raw else []


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None
    family_b: np.ndarray | None = None
    #: family -> (language pairs, weights, biases, Platt parameters)
    pairs: dict[str, tuple] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        blocks = feature_blocks(text)
        if not blocks or not self.families:
            return UNKNOWN, 0.0
        share, family = 1.0, self.families[0]
        if self.family_w is not None:
            z = margins(blocks, self.family_w, self.family_b)
            e = np.exp(z - z.max())
            best = int(e.argmax())
            share, family = float(e[best] / e.sum()), self.families[best]
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], share
        pairs, w, b, ab = self.pairs[family]
        p = 1 / (1 + np.exp(-np.clip(ab[:, 0] * margins(blocks, w, b) + ab[:, 1], -30, 30)))
        votes = dict.fromkeys(langs, 0.0)
        belief = dict.fromkeys(langs, 0.0)
        for (x, y), px in zip(pairs, p, strict=True):
            votes[x if px >= 0.5 else y] += 1
            belief[x] += px / (len(langs) - 1)
            belief[y] += (1 - px) / (len(langs) - 1)
        lang = max(langs, key=lambda c: (votes[c], belief[c]))
        return lang, min(1.0, max(0.0, share * belief[lang]))


def fit_on(s: Sample) -> LanguageModel:
    langs = sorted(set(s.labels))
    families = sorted({family_of(c) for c in langs})
    model = LanguageModel(families, {f: [c for c in langs if family_of(c) == f] for f in families})
    label = np.array(s.labels)
    fam = np.array([family_of(c) for c in s.labels])
    if len(families) > 1:
        fits = [fit_logistic(s, np.where(fam == f, 1, -1)) for f in families]
        model.family_w = np.stack([w for w, _ in fits]).astype(np.float32)
        model.family_b = np.array([b for _, b in fits])
    for f, members in model.members.items():
        if len(members) > 1:
            pairs, fits, ab = list(itertools.combinations(members, 2)), [], []
            for x, y in pairs:
                own = s.part((label == x) | (label == y))
                sign = np.where(np.array(own.labels) == x, 1, -1)
                w, b = fit_svm(own, sign)
                fits.append((w, b))
                ab.append(platt(own.dot(w) + b, sign, np.full(len(sign), 1 / len(sign))))
            model.pairs[f] = (pairs, np.stack([w for w, _ in fits]).astype(np.float32), np.array([b for _, b in fits]), np.array(ab))
    return model


def fit_language(docs: DataFrame, per_class: int = PER_CLASS) -> LanguageModel:
    """Fit on rows of ``docs`` (doc_id, text, lang); rows with a null or letterless text, a
    null lang or a null doc_id teach nothing; without any row every text is ``und``. A row is
    known by doc_id and lang, so a repeated doc_id never teaches a text under another row's
    language. More than ``MOST_LANGUAGES`` values of lang raise an error."""
    own = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    own = own.select(F.xxhash64(F.col("doc_id").cast("long"), "lang").alias("doc_id"), F.col("lang").alias("label"), "text")
    if own.select("label").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return fit_on(bounded_sample(own.select("doc_id", "text"), own.select("doc_id", "label"), per_class, feature_blocks, DIMS))


def held_out() -> Column:
    """True where crc32 of the doc_id as text leaves 1 modulo 3 (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row.

    Defined cases: a null, empty or letterless text is ``und`` with score 0; a null doc_id
    stays null; repeated rows give repeated results; an empty table gives no rows; other
    columns of ``docs`` are not looked at."""
    shared = Shared(docs.sparkSession, model)

    def run(rows):
        for r in rows:
            lang, score = shared.value.predict(r["text"])
            yield {"doc_id": r["doc_id"], "lang_pred": lang, "score": score}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(src, "doc_id long, lang_pred string, score double", run, ["doc_id", "text"])
