"""Secret scans: fixed patterns plus a randomness test battery, in Column expressions only.

Base spans: leftmost non-overlapping matches of three kinds (assign, access, hex) over whole texts.

Battery: every run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` is tested.  Its encoding is
inferred from its characters (hex, base32, base64); runs that fit none are ordinary words or
numbers and not tested.  Under "uniformly random over that alphabet" three p-values are taken:
chi-squared of the symbol counts (Wilson-Hilferty), number of runs above and below the middle of
the alphabet, and lag-one serial correlation of the symbols' places.  P-values are kept as log10 of
tail probabilities whose error is relative, down to 1e-300.  Their Bonferroni combination
must not fall below ``MIN_RANDOM_P``.  How well the token stands out from text is a fourth p-value,
that of its chi-squared under a non-central chi-squared whose shift is its length times the
unevenness of text over that alphabet: short tokens cannot stand out far.  Benjamini-Hochberg at
rate ``FDR`` within classes of length, over all tokens of the corpus, sets the threshold of that
p-value.  Spans that lie in a base span are not listed twice; base spans always stay.

The p-values are counted in bins, so the corpus is reduced to at most 4 * (MAX_BIN + 1) rows before
the thresholds (one number for each length class) reach the driver.

Defined cases: a null or empty text has no spans (its digest is that of the empty string); repeated
rows are scanned one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrograph.llm.common import empty_text, saved

# The patterns of the three kinds, in the order in which kinds are listed.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: The same matches, where those too short are left out at once (a run's maximal match is the same).
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: encoding: (rule, alphabet, unevenness of ordinary text over it per character)
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.6),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+=*$",
               "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
}
#: Lowest lengths of the classes within which discoveries are controlled.
LENGTH_CLASSES = (20, 32, 48, 96)
MIN_RANDOM_P, FDR, MAX_BIN = 0.001, 0.01, 400
MASK = "[SECRET]"


def match_spans(text: Column, pattern: str, kind: int, check: str | None = None, least: int = 0) -> Column:
    """array<struct<start, kind, stop, value>> of the leftmost non-overlapping matches, in code points.

    The texts between matches and the matches alternate, so places are running sums of lengths.
    ``check`` names the group whose length must be ``least`` or more.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    found = F.arrays_zip(gaps.alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(int(check or 0))).alias("part"))
    empty = F.from_json(F.lit("[]"), "array<struct<start: bigint, kind: int, stop: bigint, value: string>>")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        stop = start + F.coalesce(F.length(m["value"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"),
                        m["value"].alias("value"))
        good = m["value"].isNotNull() & (F.length(m["part"]) >= least)
        return F.struct(stop.alias("at"),
                        F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    walked = F.aggregate(found, state, step)["spans"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


# Coefficients, lowest power first, of a published approximation of erfc with a relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def log10_below(z: Column) -> Column:
    """log10 of P(Z <= z) of a standard normal: its error is relative to the probability, however small that is.

    z is bound once: it may be a large expression.
    """
    def tail(s: Column) -> Column:
        x = F.abs(s["z"]) / 2 ** 0.5
        return F.struct(s["z"].alias("z"), x.alias("x"), (1 / (1 + 0.5 * x)).alias("t"))

    def outer(s: Column) -> Column:
        series = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            series = c + s["t"] * series
        return F.struct(s["z"].alias("z"), (F.log(s["t"] / 2) - s["x"] * s["x"] + series).alias("ln"))

    bound = F.transform(F.transform(F.array(F.struct(z.alias("z"))), tail), outer)
    return F.get(F.transform(bound, lambda s: F.when(s["z"] <= 0, s["ln"]).otherwise(F.log1p(-F.exp(s["ln"])))),
                 F.lit(0)) / F.log(F.lit(10.0))


def encoding(token: Column) -> Column:
    """Place in ENCODINGS of the first rule that fits (from 1), or null."""
    out = F.lit(None).cast("int")
    for i, (rule, _, _) in reversed(list(enumerate(ENCODINGS.values(), 1))):
        out = F.when(token.rlike(rule), F.lit(i)).otherwise(out)
    return out


def _of(kind: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), kind)


def tested(tokens: Column) -> Column:
    """array<struct<start, kind, stop, random_p, text_p>> (log10 of the p-values) of the tokens whose encoding is known.

    Each step binds what the next one uses, so the expression stays small: the alphabet is a value
    looked up by encoding, and the symbols of a token are split off once.
    """
    alphabets = [alphabet for _, alphabet, _ in ENCODINGS.values()]
    base = lambda t: [t["start"].alias("start"), t["kind"].alias("kind"), t["stop"].alias("stop")]
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def inferred(t: Column) -> Column:
        return F.struct(*base(t), encoding(t["value"]).alias("encoding"),
                        F.translate(F.rtrim(t["value"], F.lit("=")), "_-", "/+").alias("bare"))

    def symbols(t: Column) -> Column:
        one = F.when(t["encoding"] == 1, F.lower(t["bare"])).otherwise(t["bare"])
        alphabet = _of(t["encoding"], alphabets)
        return F.struct(*base(t), _of(t["encoding"], [float(len(x)) for x in alphabets]).alias("k"),
                        _of(t["encoding"], [u for _, _, u in ENCODINGS.values()]).alias("uneven"),
                        F.transform(F.regexp_extract_all(one, F.lit("."), F.lit(0)), lambda c: F.instr(alphabet, c).cast("double")).alias("place"))

    def counted(t: Column) -> Column:
        # Sum of squared symbol counts: the r-th of equal symbols adds 2r - 1.
        state = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

        def step(acc: Column, x: Column) -> Column:
            run = F.when(x == acc["last"], acc["run"] + 1).otherwise(F.lit(1.0))
            return F.struct(x.alias("last"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))

        n = F.size(t["place"]).cast("double")
        return F.struct(*base(t), *(t[c].alias(c) for c in ("k", "uneven", "place")), n.alias("n"),
                        F.aggregate(F.array_sort(t["place"]), state, step)["sum"].alias("squares"),
                        (total(t["place"]) / n).alias("middle"),
                        F.transform(t["place"], lambda x: (x > t["k"] / 2).cast("double")).alias("upper"))

    def measured(t: Column) -> Column:
        off = F.transform(t["place"], lambda x: x - t["middle"])
        return F.struct(*base(t), *(t[c].alias(c) for c in ("k", "uneven", "n")),
                        (t["squares"] * t["k"] / t["n"] - t["n"]).alias("chi"), total(t["upper"]).alias("ones"),
                        total(F.zip_with(t["upper"], F.slice(t["upper"], 2, F.size(t["upper"])),
                                         lambda x, y: F.coalesce(F.abs(x - y), F.lit(0.0)))).alias("turns"),
                        total(F.transform(off, lambda x: x * x)).alias("square"),
                        total(F.zip_with(off, F.slice(off, 2, F.size(off)),
                                         lambda x, y: F.coalesce(x * y, F.lit(0.0)))).alias("cross"))

    def scores(t: Column) -> Column:
        free, shift = t["k"] - 1, t["n"] * t["uneven"]
        wilson = (F.pow(F.greatest(t["chi"], F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        mean = 2 * t["ones"] * (t["n"] - t["ones"]) / t["n"]
        spread = F.sqrt(F.greatest(mean * (mean - 1) / (t["n"] - 1), F.lit(1e-9)))
        return F.struct(*base(t), (-wilson).alias("chi"),
                        ((t["chi"] - (free + shift)) / F.sqrt(2 * (free + 2 * shift))).alias("text"),
                        (-F.abs(t["turns"] - mean) / spread).alias("runs"),
                        (-F.abs(t["cross"] / F.greatest(t["square"], F.lit(1e-9))) * F.sqrt(t["n"])).alias("serial"))

    def combined(t: Column) -> Column:
        least = F.least(log10_below(t["chi"]), log10_below(F.least(t["runs"], t["serial"])) + math.log10(2))
        return F.struct(*base(t), F.least(F.lit(0.0), least + math.log10(3)).alias("random_p"),
                        log10_below(t["text"]).alias("text_p"))

    known = F.filter(F.transform(tokens, inferred), lambda t: t["encoding"].isNotNull())
    for stage in (symbols, counted, measured, scores, combined):
        known = F.transform(known, stage)
    return known


def length_class(n: Column) -> Column:
    return sum(((n >= low).cast("int") for low in LENGTH_CLASSES[1:]), F.lit(0))


def p_bin(log10_p: Column) -> Column:
    """Tenths of powers of ten below 1."""
    return F.least(F.lit(MAX_BIN), F.floor(-10 * log10_p).cast("int"))


def thresholds(tests: DataFrame) -> dict[int, int]:
    """Length class -> lowest bin of a discovery (Benjamini-Hochberg); tests: cls, bin."""
    from pyspark.sql import Window as W

    counts = tests.groupBy("cls", "bin").agg(F.count("*").alias("n"))
    up = W.partitionBy("cls").orderBy(F.desc("bin"))
    ranked = counts.select("cls", "bin", F.sum("n").over(up).alias("rank"),
                           F.sum("n").over(W.partitionBy("cls")).alias("m"))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= FDR * F.col("rank") / F.col("m"))
    return {r["cls"]: r["low"] for r in passed.groupBy("cls").agg(F.min("bin").alias("low")).collect()}


def scanned(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with base and random: array<struct<start, kind, stop>>, sorted."""
    text = F.col("_text")
    docs = documents.select(*keep, empty_text().alias("_text"))
    places = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    raw = docs.select(
        *keep,
        F.array_sort(F.concat(places(match_spans(text, ASSIGN, 0, "2", 8)), places(match_spans(text, ACCESS_LONG, 1)),
                              places(match_spans(text, HEX_LONG, 2)))).alias("base"),
        match_spans(text, TOKEN, 3).alias("tokens"))
    scored = saved(raw.select(*keep, "base", tested(F.col("tokens")).alias("tokens")), "secrets")
    each = scored.select(F.explode("tokens").alias("t")).select(
        length_class(F.col("t.stop") - F.col("t.start")).alias("cls"), p_bin(F.col("t.text_p")).alias("bin"))
    low = thresholds(each)

    def found(t: Column) -> Column:
        cls = length_class(t["stop"] - t["start"])
        limit = F.lit(None).cast("int")
        for c, b in low.items():
            limit = F.when(cls == c, b).otherwise(limit)
        return F.coalesce((p_bin(t["text_p"]) >= limit) & (t["random_p"] >= math.log10(MIN_RANDOM_P)), F.lit(False))

    outside = lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (b["stop"] >= t["stop"]))
    return scored.select(*keep, "base", places(F.filter("tokens", lambda t: found(t) & outside(t))).alias("random"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["stop"])), ",")


def secret_table(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scanned(documents).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
        count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "random"))).alias("spans"))


def redacted(documents: DataFrame) -> DataFrame:
    """documents with every span of its text replaced by a mask; n_chars follows."""
    names = documents.columns
    found = scanned(documents.select(F.struct(*names).alias("_row"), "text"), ("_row",))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def masked(row: Column) -> Column:
        """The text with its spans masked; ``row`` binds both, so neither is worked out again for each span."""
        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(row["text"], (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), new.alias("out"))

        # Only the last step knows where the rest of the text begins.
        return F.aggregate(row["spans"], state, step, lambda acc: F.concat(
            acc["out"], F.substring(row["text"], (acc["at"] + 1).cast("int"), F.length(row["text"]))))

    spans = F.array_sort(F.concat("base", "random"))
    bound = F.array(F.struct(F.col("_row.text").alias("text"), spans.alias("spans")))
    clean = F.get(F.transform(bound, lambda row: F.when(F.size(row["spans"]) > 0, masked(row)).otherwise(row["text"])), F.lit(0))
    done = found.select("_row", (F.size("base") + F.size("random") > 0).alias("_hit"), clean.alias("_clean"))
    out = {"text": F.col("_clean")} | ({"n_chars": F.when(F.col("_hit"), F.length("_clean"))
                                        .otherwise(F.col("_row.n_chars")).cast(documents.schema["n_chars"].dataType)}
                                       if "n_chars" in names else {})
    return done.select(*(out.get(n, F.col(f"_row.{n}")).alias(n) for n in names))
