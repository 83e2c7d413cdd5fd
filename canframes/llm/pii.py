"""Personal data: fixed patterns as seeds, and a contextual bootstrap from them.

1. Seeds: e-mail addresses, IPv4 numbers, card numbers (Luhn) and phone numbers.
2. Every seed, and every other identifier-like token (with a digit or ``@``, 4 characters
   or more), gives edges of a pattern-instance graph: its two words to the left, and its
   neighbour words on both sides, are the lexical patterns; its normalised surface is the
   instance. Edges are distinct, so copies of a text do not count again.
3. Rounds: a pattern's confidence for a kind is the summed score of its instances known for
   that kind over all its instances plus one (at least ``min_support`` of them known); an
   unknown instance scores 1 - product(1 - confidence) over its patterns and is taken up at
   ``min_score``. Scores are aggregations and joins over the landed edges; the loop ends
   when a round changes neither the instances taken up nor their kinds and scores. Rounds that
   have not settled after ``max_rounds`` are an error, never a result.
4. All occurrences of the instances taken up that touch no seed become spans of their kind.

SQL functions only. Joins meet one row per pattern or instance on one side, so a hot one is
a skewed key that adaptive execution splits; counts are partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canframes.llm.common import text_key
from canframes.llm.spans import let, matches
from canframes.session import land

KINDS = ["email", "ip", "card", "phone"]
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 3, 0.5, 0.8
MAX_ROUNDS = 1000  # no bound on the result: rounds that do not settle by then are an error
SETTLED = 1e-9  # scores that differ by less are equal: sums vary with the order of rows
CONTEXT_CHARS = 80

# The leftmost match never starts inside a run of its first class unless the match before
# ended there: the guards and possessive quantifiers keep the scan linear, with the same matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_EDGE_PUNCTUATION = ".,;:!?()[]{}<>\"'*#$%&|="


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _is_ip(x: Column) -> Column:
    def small(part: Column) -> Column:
        return let(F.regexp_replace(part, "^0+", ""), lambda z: (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255")))

    return F.forall(F.split(x, r"\."), small)


def _is_card(x: Column) -> Column:
    def luhn(d: Column) -> Column:
        def digit(i: Column) -> Column:
            v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, v).otherwise(let(v * 2, lambda w: F.when(w > 9, w - 9).otherwise(w)))

        total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + digit(i))
        return F.length(d).between(13, 19) & (total % 10 == 0)

    return let(_digits(x), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def _is_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(9, 15)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _patterns(m: Column) -> Column:
    """The lexical patterns of an occurrence: two words to the left; one on each side."""
    left = _words(F.right(m["before"], F.lit(CONTEXT_CHARS)))
    right = _words(F.left(m["after"], F.lit(CONTEXT_CHARS)))

    def build(lr: Column) -> Column:
        back = lambda i: F.coalesce(F.get(lr["l"], F.size(lr["l"]) - i), F.lit("^"))
        after = F.coalesce(F.get(lr["r"], F.lit(0)), F.lit("$"))
        return F.array(F.concat_ws(" ", back(2), back(1), F.lit("_")), F.concat_ws(" ", back(1), F.lit("_"), after))

    return let(F.struct(left.alias("l"), right.alias("r")), build)


def _occurrence(kind: int, start: Column, end: Column, instance: Column, m: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), instance.alias("instance"), _patterns(m).alias("patterns"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, tokens): valid seeds and identifier-like tokens of every
    text as arrays of (kind, start, end, instance, patterns)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), text_key(F.col("text")).alias("text_key"))
    text = F.col("text")
    digit, at = F.col("has_digit"), F.contains(text, F.lit("@"))
    d = d.withColumn("has_digit", text.rlike("[0-9]"))
    found = d.select(
        "doc_id", "text_key",
        matches(text, EMAIL, at).alias("m0"),
        matches(text, IP, digit & F.contains(text, F.lit("."))).alias("m1"),
        matches(text, CARD, digit).alias("m2"),
        matches(text, PHONE, digit & F.contains(text, F.lit("+"))).alias("m3"),
        matches(text, TOKEN, digit | at).alias("m4"),
    )
    valid = [lambda m: F.lit(True), lambda m: _is_ip(m["surface"]), lambda m: _is_card(m["surface"]), lambda m: _is_phone(m["surface"])]
    norm = [F.lower, F.lower, _digits, _digits]

    def seeds(k: int) -> Column:
        return F.transform(
            F.filter(f"m{k}", valid[k]), lambda m: _occurrence(k, m["start"], m["end"], F.concat(F.lit(f"{k}:"), norm[k](m["surface"])), m)
        )

    def token(m: Column) -> Column:
        inner = F.ltrim(m["surface"], F.lit(_EDGE_PUNCTUATION))
        core = F.rtrim(inner, F.lit(_EDGE_PUNCTUATION))
        start = m["start"] + F.length(m["surface"]) - F.length(inner)
        # long surfaces stand as their digest; no short one starts with #, which is trimmed
        name = let(F.lower(core), lambda x: F.when(F.length(x) <= 64, x).otherwise(F.concat(F.lit("#"), F.sha2(x.cast("binary"), 256))))
        return _occurrence(4, start, start + F.length(core), F.concat(F.lit("?:"), name), m)

    tokens = F.filter(F.transform("m4", token), lambda o: F.length(o["instance"]) >= 6)
    return found.select("doc_id", "text_key", F.concat(*map(seeds, range(4))).alias("base"), tokens.alias("tokens"))


def _settled(now: DataFrame, before: DataFrame) -> bool:
    """True if both hold the same instances with the same kinds and scores."""
    old = before.select("instance", F.col("kind").alias("old_kind"), F.col("score").alias("old_score"))
    same = (F.col("kind") == F.col("old_kind")) & (F.abs(F.col("score") - F.col("old_score")) <= SETTLED)
    return now.join(old, "instance", "full").filter(~F.coalesce(same, F.lit(False))).isEmpty()


def bootstrap(edges: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(instance, kind, score) of the instances taken up. ``edges``: distinct (pattern,
    instance, kind), kind 0 to 3 for seeds and 4 for unknown instances. Rounds go on until
    one changes nothing; RuntimeError if that takes more than ``max_rounds``."""
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = edges.filter("kind < 4").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    unknown = edges.filter("kind = 4").select("pattern", "instance")
    known, before = seeds, None
    for _ in range(max_rounds):
        support = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("pos"), F.count("*").alias("n"))
        confident = (
            support.filter(F.col("n") >= min_support).join(totals, "pattern")
            .withColumn("conf", F.col("pos") / (F.col("total") + 1)).filter(F.col("conf") >= min_confidence)
            .groupBy("pattern").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("best"))
            .select("pattern", F.col("best.conf").alias("conf"), (-F.col("best.k")).alias("kind"))
        )
        scored = unknown.join(confident, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score"))
        best = scored.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        taken = land(
            best.select("instance", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score")).filter(F.col("score") >= min_score), "pii-instances"
        )
        if taken.isEmpty() if before is None else _settled(taken, before):
            return taken
        before, known = taken, seeds.unionByName(taken)
    raise RuntimeError(f"the bootstrap has not settled after {max_rounds} rounds")


def find_personal_data(docs: DataFrame, **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and found, arrays of (kind, start, end) by
    kind as listed in ``KINDS`` and then start (code points, end exclusive); found holds
    base and the spans that the bootstrap adds.

    Defined cases: a null text is empty; a null doc_id stays null; repeated rows give
    repeated results; an empty table gives no rows; other columns of ``docs`` are not
    looked at."""
    seen = land(scan(docs), "pii-scan")
    texts = seen.filter("size(base) + size(tokens) > 0").dropDuplicates(["text_key"])
    occ = texts.select("text_key", F.explode(F.concat("base", "tokens")).alias("o")).select("text_key", "o.*")
    # by start for seeds and by last character for tokens: all seeds that start before a
    # token ends come before it, and it touches one if any of those ends after its start
    order = F.when(F.col("kind") < 4, F.col("start")).otherwise(F.col("end") - 1)
    earlier = Window.partitionBy("text_key").orderBy(order, "kind", "start").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(F.col("kind") < 4, F.col("end"))).over(earlier), F.lit(0))
    occ = land(occ.withColumn("reach", reach).filter((F.col("kind") < 4) | (F.col("reach") <= F.col("start"))).drop("reach"), "pii-occurrences")
    edges = land(occ.select("instance", "kind", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    taken = bootstrap(edges, **params)
    spans = F.sort_array(F.collect_set(F.struct(taken["kind"], "start", "end")))
    added = occ.filter("kind = 4").drop("kind").join(taken, "instance").groupBy("text_key").agg(spans.alias("added"))
    short = lambda a: F.transform(a, lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    rows = seen.select("doc_id", "text_key", short(F.col("base")).alias("base"), (F.size("tokens") > 0).alias("more"))
    plain = rows.filter(~F.col("more")).select("doc_id", "base", F.col("base").alias("found"))
    joined = rows.filter("more").join(added, "text_key", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("found"))
    return plain.unionByName(joined)


def span_columns(found: DataFrame) -> DataFrame:
    """The digest columns: counts of the base spans by kind, their hash, all spans as text."""
    name = lambda o: F.element_at(F.array(*map(F.lit, KINDS)), o["kind"] + 1)
    text = lambda a: F.array_join(F.transform(a, lambda o: F.concat_ws(":", name(o), o["start"], o["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda o: o["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
