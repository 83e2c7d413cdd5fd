"""Secret scans: fixed patterns, plus tokens that a battery of randomness tests cannot tell
from random draws of their alphabet.

Candidates are runs of ``[A-Za-z0-9+/_-]`` (``=`` padding allowed) of at least
20 characters that touch no base span. For each one an encoding is inferred
(decimal, hex, lower/upper base32, base36, base62, base64) and three tests are made against
uniform draws of that alphabet: chi-squared over the symbols, Wald-Wolfowitz runs around
the middle of the alphabet, and lag-1 serial correlation. Their p-values combine (Fisher)
into one randomness p-value.

A long enough word fails these tests, a random token passes, but a short token passes too
easily. So the null hypothesis of the decision is "written text", and its p-value is the
share of *reference* tokens of the same lengths that look at least as random. The reference
holds no candidate: it is drawn from a character model (trigrams) of the ordinary words of
the corpus, runs of letters under 20 characters, joined up plainly, in camel case or with
hyphens. Classes are powers of sqrt(2) in length; lengths over 64 share the reference of
64, which looks more random than longer text. False discoveries are controlled per length
class by Benjamini-Hochberg over all candidates, those of letters alone included; a share is
never taken as less than one in the reference. Only the trigram counts (27^3) and histograms
of bounded size (length classes x 400 bins, 64 lengths) reach the driver."""

from __future__ import annotations

import bisect
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import map_batches
from canframes.session import land

# fixed patterns of the base spans, in the order of the kinds
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs, so the same as all runs less those under 24
KINDS = ["assign", "access", "hex", "random"]
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_WORD = re.compile(r"(?<![\w+/=-])[A-Za-z]{1,19}(?![\w+/=-])")
# counts once in every model, so that a corpus of few words has one too
_PRIOR = (
    "It was a bright morning and the people of the small town went down to the river to see what the water had brought "
    "them over night some of them found pieces of wood while others looked for their boats which were not where they should be"
)

FALSE_DISCOVERY_RATE = 0.01
MIN_RANDOMNESS = 0.01  # randomness p-value below which no token is called random
BINS = 400
_BIN_WIDTH = 0.05  # of -ln p
MAX_LENGTH = 64  # of reference tokens
MIN_REFERENCE, MAX_REFERENCE, _PER_DRAW = 20_000, 2_000_000, 2_000  # reference tokens of a length class

# fixed alphabets in the order they are tried; symbols in their numeric order
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32lower": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_sf(x: float, dof: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    t = (x / dof) ** (1 / 3)
    return _upper_tail((t - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof)))


def infer_encoding(token: str) -> str:
    have = set(token.rstrip("="))
    return next((name for name, letters in ALPHABETS.items() if have <= set(letters)), "base64")


def randomness(token: str) -> tuple[str, float, float, float, float]:
    """(encoding, chi-squared p, runs p, serial p, Fisher-combined p) of a token."""
    name = infer_encoding(token)
    letters = ALPHABETS[name]
    place = {c: i for i, c in enumerate(letters)}
    x = np.array([place[c] for c in token.rstrip("=")], dtype=np.float64)
    n, k = len(x), len(letters) if name != "base64" else 64
    counts = np.bincount(x.astype(np.int64), minlength=len(letters))
    p_chi = _chi2_sf(float(((counts - n / k) ** 2).sum() / (n / k)), k - 1)
    high = x >= len(letters) / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = min(1.0, 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    power = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / power if power else 1.0
    p_serial = min(1.0, 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n)))
    stat = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    half = stat / 2  # chi-squared with 6 degrees of freedom has a closed tail
    return name, p_chi, p_runs, p_serial, math.exp(-half) * (1 + half + half * half / 2)


def _scan(rows):
    for r in rows:
        text = r["text"] or ""
        base, tokens = [], list(_CANDIDATE.finditer(text))
        if tokens or "=" in text or ":" in text:
            base = base_spans(text)
        starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
        cands = []
        for m in tokens:
            before = bisect.bisect_left(starts, m.end())  # base spans that start before the token ends
            if not before or reach[before - 1] <= m.start():
                enc, *_, p = randomness(m[0])
                cands.append({"start": m.start(), "end": m.end(), "enc": enc, "size": _length_class(m[0]), "length": len(m[0].rstrip("=")), "bin": _bin(p), "p": p})
        yield {"doc_id": r["doc_id"], "base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "cands": cands}


def _length_class(token: str) -> int:
    return math.floor(2 * math.log2(len(token.rstrip("="))))


def _bin(p: float) -> int:
    return min(BINS - 1, int(-math.log(max(p, 1e-300)) / _BIN_WIDTH))


_SCAN_SCHEMA = (
    "doc_id long, base array<struct<start:int,kind:int,end:int>>, "
    "cands array<struct<start:int,end:int,enc:string,size:int,length:int,bin:int,p:double>>"
)


def _letters(words: list[str]) -> np.ndarray:
    """Joined words as numbers: 0 between them, 1 to 26 for the letters."""
    x = np.frombuffer(f" {' '.join(words)} ".lower().encode(), dtype=np.uint8).astype(np.int64)
    return np.where(x == 32, 0, x - 96)


def _trigrams(words: list[str]) -> np.ndarray:
    x = _letters(words)
    return np.bincount(x[:-2] * 729 + x[1:-1] * 27 + x[2:], minlength=27**3)


def word_model(docs: DataFrame) -> np.ndarray:
    """Trigram counts (27 x 27, 27) of the ordinary words of ``docs``."""

    def run(batches):
        total = np.zeros(27**3, dtype=np.int64)
        for batch in batches:
            total += _trigrams([w for x in batch.column(0) for w in _WORD.findall(x.as_py() or "")])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["code", "n"])

    out = _trigrams(_PRIOR.split()).astype(np.float64)
    for r in docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] += r["n"]
    return out.reshape(27 * 27, 27)


def written_tokens(model: np.ndarray, length: int, number: int, seed: list[int]) -> list[str]:
    """``number`` tokens of ``length`` characters of words drawn from ``model``: joined
    plainly, in camel case and with hyphens in turn."""
    rng = np.random.default_rng(seed)
    starts = model[::27]  # contexts that end between two words
    first = starts.sum(axis=0)
    share = np.where(model.sum(axis=1, keepdims=True) > 0, model, first)
    upto = np.cumsum(share / share.sum(axis=1, keepdims=True), axis=1)
    state = rng.choice(27, size=number, p=starts.sum(axis=1) / starts.sum()) * 27
    drawn = np.empty((number, 2 * length + 2), dtype=np.uint8)  # no two gaps meet: enough letters
    for step in range(drawn.shape[1]):
        c = np.minimum((upto[state] <= rng.random(number)[:, None]).sum(axis=1), 26)
        drawn[:, step] = np.where(c == 0, 32, c + 96)
        state = state % 27 * 27 + c
    texts = [bytes(x).decode() for x in drawn]
    style = [lambda t: t.replace(" ", ""), lambda t: t.title().replace(" ", ""), lambda t: t.strip().replace(" ", "-")]
    return [style[i % 3](t)[:length] for i, t in enumerate(texts)]


def reference_counts(docs: DataFrame, cands: DataFrame, tested: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Length class -> reference tokens by bin, of the lengths of the class's candidates
    (``MAX_LENGTH`` at most). More are drawn where few of the candidates look random, so that
    a rare find can be told from chance; classes where none does need no reference."""
    passing = {s: n[: _bin(MIN_RANDOMNESS) + 1].sum() for s, n in tested.items()}
    wanted = {s: min(MAX_REFERENCE, max(MIN_REFERENCE, int(1000 * n.sum() / passing[s]))) for s, n in tested.items() if passing[s]}
    if not wanted:
        return {}
    length = F.least(F.col("length"), F.lit(MAX_LENGTH))
    draws, chunk = [], 0
    for r in cands.groupBy("size", length.alias("length")).agg(F.count("*").alias("n")).orderBy("size", "length").collect():
        if r["size"] in wanted:
            left = math.ceil(wanted[r["size"]] * r["n"] / tested[r["size"]].sum())
            while left > 0:
                draws.append((r["size"], r["length"], min(left, _PER_DRAW), chunk))
                left, chunk = left - _PER_DRAW, chunk + 1
    model = word_model(docs)

    def run(rows):
        for r in rows:
            bins = np.bincount([_bin(randomness(t)[-1]) for t in written_tokens(model, r["length"], r["n"], [r["length"], r["chunk"]])], minlength=BINS)
            yield from ({"size": r["size"], "bin": int(b), "n": int(bins[b])} for b in np.flatnonzero(bins))

    jobs = docs.sparkSession.createDataFrame(draws, "size int, length int, n int, chunk int")
    out = {s: np.zeros(BINS) for s in wanted}
    for r in map_batches(jobs, "size int, bin int, n long", run, ["size", "length", "n", "chunk"]).groupBy("size", "bin").agg(F.sum("n").alias("n")).collect():
        out[r["size"]][r["bin"]] = r["n"]
    return out


def discovery_limits(tested: dict[int, np.ndarray], reference: dict[int, np.ndarray], rate: float) -> dict[int, int]:
    """Length class -> largest bin that is still a discovery (Benjamini-Hochberg in each
    class), from the candidates and the reference tokens of each class by bin. A class
    without reference has no discoveries."""
    random_enough = np.arange(BINS) <= _bin(MIN_RANDOMNESS)
    out = {}
    for size, n in tested.items():
        found, ref = np.cumsum(n), np.cumsum(reference.get(size, np.zeros(BINS)))
        p_text = (ref + 1) / (ref[-1] + 1)  # share of written tokens that look at least this random
        ok = np.flatnonzero((p_text <= rate * found / max(1, found[-1])) & (found > 0) & random_enough)
        if len(ok):
            out[size] = int(ok.max())
    return out


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """doc_id and found (array of start, kind, end, encoding, p by start and then kind;
    offsets are code points, the end is exclusive) for every row.

    Defined cases: a null text is empty; a null doc_id stays null; repeated rows give
    repeated results (and count as often in the statistics); an empty table gives no rows;
    other columns of ``docs`` are not looked at. Candidates of letters alone are tested like
    any other."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = land(map_batches(src, _SCAN_SCHEMA, _scan, ["doc_id", "text"]), "secret-scan")
    c = seen.select(F.explode("cands").alias("c")).select("c.size", "c.bin", "c.length")
    tested: dict[int, np.ndarray] = {}
    for r in c.groupBy("size", "bin").agg(F.count("*").alias("n")).collect():
        tested.setdefault(r["size"], np.zeros(BINS))[r["bin"]] = r["n"]
    limits = discovery_limits(tested, reference_counts(src, c, tested), rate)

    def decide(rows):
        for r in rows:
            base = [{**b, "kind": KINDS[b["kind"]], "order": b["kind"], "enc": None, "p": None} for b in r["base"]]
            extra = [
                {"start": c["start"], "kind": KINDS[3], "order": 3, "end": c["end"], "enc": c["enc"], "p": c["p"]}
                for c in r["cands"] if c["bin"] <= limits.get(c["size"], -1)
            ]
            found = sorted(base + extra, key=lambda x: (x["start"], x["order"]))
            yield {"doc_id": r["doc_id"], "found": [{k: x[k] for k in ("start", "kind", "end", "enc", "p")} for x in found]}

    return map_batches(seen, "doc_id long, found array<struct<start:int,kind:string,end:int,enc:string,p:double>>", decide, ["doc_id", "base", "cands"])


def span_columns(found: DataFrame) -> DataFrame:
    """The digest columns of the spans: counts by base kind, the hash of the base spans and
    all spans as text."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"] != KINDS[3])
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
