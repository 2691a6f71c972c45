"""Secret scans with Spark expressions only: fixed patterns, and a battery of randomness tests.

The battery looks at runs of token characters, in which '=' is padding at the end only. As '/', '+', '_' and '-' may
belong to a secret or join it to a name or a path, the runs of letters and digits alone are looked at as well as those
with some of the four. Each gets an encoding (the smallest alphabet that holds it), and tests of "these are
independent, uniform characters of that alphabet": chi-squared of the counts of characters and of kinds (upper, lower,
digit, sign), runs above and below the middle of the alphabet and runs of one kind, and the serial correlation of
neighbours. Words and identifiers fail at least one of them. The p-values are combined by Bonferroni.

What is reported are runs that pass, so the false discoveries to control are runs that pass by chance and are not
random. In each encoding and length class the share of random runs is estimated from the large p-values, which the
others hardly reach; what more there is at smaller ones is taken to be false. Runs are reported from the least p on at
which the false ones are at most `FDR` of them, and never below `LEAST_P`. The decision needs only counts of p-values
in fixed bins, so it is a small table whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Fixed patterns: kind, pattern, the group whose length counts (0: the match), least length. In listed order.
#: In the last two the least length stands in the pattern: a run that is too short holds no longer one.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
FIXED = [("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16)]
#: What a text must hold to be looked at closely, by kind; a match implies it.
HINT = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}",
        "hex": r"[0-9a-f]{16}"}
LEAST = 20
#: The characters beside letters and digits that a candidate may hold; each text is searched for every set's runs.
INNER = ["+/", "_-", "+", "/", "_", "-", ""]
CANDIDATES = [rf"[A-Za-z0-9{inner}]{{{LEAST},}}=*" for inner in INNER]
HOLDS_CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST}}}"
#: Encodings from small to large alphabets: name, pattern, alphabet in the order of its values, least length.
ENCODINGS = [
    ("digits", r"^[0-9]+$", "0123456789", 40),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 40),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 40),
    ("letters", r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 40),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef", 24),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF", 24),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 24),
    ("base62", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 20),
]
FDR = 0.05
#: No run below is reported: so many of the random ones are missed at most.
LEAST_P = 0.05
#: Where p-values are large enough to be those of random runs.
LARGE_P = 0.5
#: Tests that are combined.
TESTS = 5
KINDS = ("U", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("L", "abcdefghijklmnopqrstuvwxyz"), ("D", "0123456789"), ("S", "+/-_")
#: Bins of -log10(p), this many per decade, up to p = 1e-30.
BINS_PER_DECADE, DECADES = 20, 30
SPANS = "array<struct<start:bigint,end:bigint,rank:int,kind:string,text:string>>"


def _matches(text: Column, pattern: str, kind: str, rank: int, group: int, least: int) -> Column:
    """Spans of the matches of `pattern` from left to right, those too short left out after matching.

    The gaps between matches and the matches themselves give the positions.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    lengths = F.zip_with(
        F.transform(gaps, lambda g: F.char_length(g).cast("bigint")),
        F.zip_with(found, counted, lambda m, c: F.struct(m.alias("text"), F.char_length(c).alias("counted"))),
        lambda g, m: F.struct(g.alias("gap"), m["text"].alias("text"), m["counted"].alias("counted")),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + F.coalesce(F.char_length(m["text"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                        m["text"].alias("text"))
        kept = F.when(m["counted"] >= least, F.concat(acc["spans"], F.array(span).cast(SPANS))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.aggregate(lengths, start, step)["spans"]


def fixed_spans(docs: DataFrame) -> DataFrame:
    """Adds `found`: the spans of the fixed patterns and the candidates of the battery, by kind."""
    text = F.col("text")
    for rank, (kind, pattern, group, least) in enumerate(FIXED):
        spans = F.when(text.rlike(HINT[kind]), _matches(text, pattern, kind, rank, group, least))
        docs = docs.withColumn(f"spans_{kind}", F.coalesce(spans, F.array().cast(SPANS)))
    spans = F.concat(*[_matches(text, pattern, "random", len(FIXED), 0, LEAST) for pattern in CANDIDATES])
    candidates = F.when(text.rlike(HOLDS_CANDIDATE), F.array_distinct(spans))
    return docs.withColumn("candidates", F.coalesce(candidates, F.array().cast(SPANS)))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0; Abramowitz and Stegun 26.2.17, error under 1e-7 beside the tail's own size."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) / 2.5066282746310002 * series, F.lit(1e-300))


def _chi_squared_tail(x: Column, freedom: Column) -> Column:
    """P(X >= x) for up to three degrees of freedom; 1 for none."""
    root = 2 * _normal_tail(F.sqrt(x))
    three = root + F.sqrt(x * 0.6366197723675814) * F.exp(-x / 2)
    exact = F.when(freedom == 1, root).when(freedom == 2, F.exp(-x / 2)).when(freedom == 3, three).otherwise(1.0)
    return F.greatest(exact, F.lit(1e-300))


def battery(tokens: DataFrame) -> DataFrame:
    """`tokens` (token, ...) with encoding, length, and the p-values of the tests and of all.

    Tokens of one character or of no encoding are left out.
    """
    encoding = F.lit(None).cast("string")
    alphabet, least = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, pattern, letters, need in reversed(ENCODINGS):
        fits = F.col("token").rlike(pattern)
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        least = F.when(fits, F.lit(need)).otherwise(least)
    # `inline` makes columns of these, so that the functions below don't infer them again for every character.
    share = lambda letters: F.char_length(F.translate(alphabet, letters, "")) / F.char_length(alphabet)
    inferred = F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), least.alias("least"),
                        F.char_length(alphabet).cast("double").alias("k"),
                        F.array(*[1 - share(letters) for _, letters in KINDS]).alias("shares"))
    out = tokens.select("*", F.inline(F.array(inferred)))
    body = F.rtrim(F.col("token"), F.lit("="))
    out = out.where("encoding is not null").withColumn("values", F.transform(
        F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr("alphabet", c).cast("double") - 1))
    out = out.where("size(values) > 1").withColumn("n", F.size("values").cast("double"))
    # Chi-squared against equal counts, normalised by its mean and variance under independence.
    squares = F.aggregate(
        F.transform(F.array_distinct("values"), lambda v: F.size(F.filter("values", lambda w: w == v)).cast("double")),
        F.lit(0.0), lambda s, c: s + c * c)
    out = out.withColumn("chi", F.col("k") / F.col("n") * squares - F.col("n"))
    out = out.withColumn("chi_z", (F.col("chi") - (F.col("k") - 1)) /
                         F.sqrt(2 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n")))
    # Runs above and below the middle of the alphabet.
    high = F.transform("values", lambda v: F.when(v >= F.col("k") / 2, 1.0).otherwise(0.0))
    out = out.withColumn("high", high).withColumn(
        "above", F.aggregate("high", F.lit(0.0), lambda s, v: s + v)).withColumn(
        "runs", 1 + F.aggregate(F.zip_with(F.slice("high", F.lit(2), F.size("high")),
                                           F.slice("high", F.lit(1), F.size("high") - 1), lambda a, b: F.abs(a - b)),
                                F.lit(0.0), lambda s, v: s + v))
    # Against a fair split: the runs have mean 1 + (n - 1) / 2, the count above has mean n / 2.
    out = out.withColumn("runs_z", F.greatest(
        F.abs(F.col("runs") - 1 - (F.col("n") - 1) / 2) / F.sqrt((F.col("n") - 1) / 4),
        F.abs(F.col("above") - F.col("n") / 2) / F.sqrt(F.col("n") / 4)))
    # Lag-one serial correlation about the alphabet's mean.
    centred = F.transform("values", lambda v: v - (F.col("k") - 1) / 2)
    out = out.withColumn("centred", centred)
    products = F.aggregate(
        F.zip_with(F.slice("centred", F.lit(2), F.size("centred")), F.slice("centred", F.lit(1), F.size("centred") - 1),
                   lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    variance = (F.col("k") * F.col("k") - 1) / 12
    out = out.withColumn("serial_z", F.abs(products) / (variance * F.sqrt(F.col("n") - 1)))
    # Kinds of characters: their counts, and how often neighbours are of one kind.
    named = F.translate(body, "".join(x for _, x in KINDS), "".join(kind * len(x) for kind, x in KINDS))
    out = out.withColumn("kinds", F.filter(F.split(named, ""), lambda c: c != ""))
    count = lambda kind: F.size(F.filter("kinds", lambda c: c == kind)).cast("double")
    counts = F.array(*[count(kind) for kind, _ in KINDS])
    squared = F.zip_with(counts, "shares", lambda c, q: F.when(
        q > 0, F.pow(c - F.col("n") * q, F.lit(2)) / (F.col("n") * q)).otherwise(0.0))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    out = out.withColumn("kind_chi", add(squared)).withColumn("freedom", F.size(F.filter("shares", lambda q: q > 0)) - 1)
    alike = add(F.zip_with(F.slice("kinds", F.lit(2), F.size("kinds")), F.slice("kinds", F.lit(1), F.size("kinds") - 1),
                           lambda a, b: F.when(a == b, 1.0).otherwise(0.0)))
    out = out.select("*", alike.alias("alike"), add(F.transform("shares", lambda q: q * q)).alias("same"),
                     add(F.transform("shares", lambda q: q * q * q)).alias("thrice"))
    pairs = F.col("n") - 1
    spread = pairs * (F.col("same") - F.col("same") * F.col("same")) + 2 * (F.col("n") - 2) * (
        F.col("thrice") - F.col("same") * F.col("same"))
    out = out.withColumn("alike_z", F.when(F.col("freedom") > 0, F.abs(F.col("alike") - pairs * F.col("same")) / F.sqrt(
        F.greatest(spread, F.lit(1e-9)))).otherwise(0.0))
    tail = lambda c: _normal_tail(F.greatest(F.col(c), F.lit(0.0)))
    out = out.select("*", tail("chi_z").alias("p_chi"), (4 * tail("runs_z")).alias("p_runs"),
                     (2 * tail("serial_z")).alias("p_serial"), (2 * tail("alike_z")).alias("p_alike"),
                     _chi_squared_tail(F.col("kind_chi"), F.col("freedom")).alias("p_kinds"))
    combined = F.least(F.lit(1.0), TESTS * F.least("p_chi", "p_runs", "p_serial", "p_alike", "p_kinds"))
    return out.withColumn("p", combined).withColumn("long_enough", F.col("n") >= F.col("least"))


def passing_random(p: Column) -> Column:
    """Chance that a random run's combined p-value is at least `p`, its tests being independent."""
    return F.pow(1 - F.least(p, F.lit(1.0)) / TESTS, F.lit(TESTS))


def random_from(tested: DataFrame) -> DataFrame:
    """(encoding, class, cut): bins of -log10(p) below `cut` are reported.

    With N runs at or above LARGE_P, (N + 1) / (chance of that) of the class are estimated to be random; the one is
    for classes too small to tell. Of the R runs at or above some p, those beyond the random ones' expected number are
    false; the cut is the least p at which they are at most FDR * R.
    """
    counted = tested.groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("encoding", "class")
    larger = whole.orderBy("bin")
    edge = F.pow(F.lit(10.0), -(F.col("bin") + 1) / BINS_PER_DECADE)
    large = F.sum(F.when(edge >= LARGE_P, F.col("c")).otherwise(0)).over(whole)
    # The least p of the bins that count as large.
    at = 10 ** (-(int(-math.log10(LARGE_P) * BINS_PER_DECADE)) / BINS_PER_DECADE)
    summed = counted.select("encoding", "class", "bin", F.sum("c").over(larger).alias("r"),
                            ((large + 1) / passing_random(F.lit(at))).alias("random"), edge.alias("edge"))
    false = F.col("r") - F.col("random") * passing_random(F.col("edge"))
    fits = summed.where((false <= FDR * F.col("r")) & (F.col("edge") >= LEAST_P))
    return fits.groupBy("encoding", "class").agg((F.max("bin") + 1).alias("cut"))


def random_tokens(candidates: DataFrame) -> DataFrame:
    """Distinct tokens of `candidates` (token) that pass for random: (token, encoding, p).

    A token counts once in its class, as its copies are no evidence of their own.
    """
    distinct = candidates.select("token").distinct()
    # Length classes by powers of the square root of two, as the tests' power grows with the length.
    tested = battery(distinct).where("long_enough").select(
        "token", "encoding", "p",
        F.floor(2 * F.log2("n")).cast("int").alias("class"),
        F.least(F.floor(-F.log10("p") * BINS_PER_DECADE), F.lit(BINS_PER_DECADE * DECADES)).cast("int").alias("bin"),
    )
    tested = staged(tested, "randomness")
    return tested.join(random_from(tested), ["encoding", "class"]).where("bin < cut").select("token", "encoding", "p")


def _scanned(found: DataFrame) -> DataFrame:
    """Adds `spans` to a staged table with row, base and candidates: the base's and those that the battery adds."""
    each = found.where("size(candidates) > 0").select("row", "base", F.explode("candidates").alias("c"))
    outside = each.where(~F.exists("base", lambda b: (b["start"] <= F.col("c.start")) & (b["end"] >= F.col("c.end"))))
    outside = outside.select("row", F.col("c.text").alias("token"), F.col("c").alias("span"))
    marked = outside.join(random_tokens(each.select(F.col("c.text").alias("token"))), "token")
    # Runs and their parts may both pass: what lies within another is left out.
    ends = F.max("span.end").over(Window.partitionBy("row").orderBy("span.start", F.desc("span.end")).rowsBetween(
        Window.unboundedPreceding, -1))
    marked = marked.withColumn("ends", ends).where("ends is null or span.end > ends")
    added = marked.groupBy("row").agg(F.collect_list("span").alias("added"))
    spans = F.concat("base", F.coalesce("added", F.array().cast(SPANS)))
    return found.join(added, "row", "left").withColumn("spans", spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, base, spans) of each row of `docs`.

    `spans` are the fixed patterns' spans and those that the battery adds; ends are exclusive and in code points.
    An added span that lies within a fixed or another added one is left out, as it adds nothing. Null and empty texts have none.
    Repeated ids keep a row each; other columns are ignored; an empty table gives an empty result.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = F.concat(*[f"spans_{k}" for k, *_ in FIXED]).alias("base")
    row = F.monotonically_increasing_id().alias("row")
    found = staged(fixed_spans(picked).select("id", "candidates", base, row), "secret-spans")
    return _scanned(found).select("row", "id", "base", "spans")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with the same rows and columns, each span of a secret replaced by `mark`; null texts stay null.

    Spans that overlap become one mark.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    picked = docs.select(whole, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = F.concat(*[f"spans_{k}" for k, *_ in FIXED]).alias("base")
    row = F.monotonically_increasing_id().alias("row")
    found = staged(fixed_spans(picked).select("whole", "candidates", base, row), "secret-spans")
    scanned = _scanned(found).select("whole", _order(F.col("spans")).alias("spans"))
    text = F.col("whole").getField(text_col)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.lit(mark)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    cut = F.aggregate("spans", start, step)
    clean = F.concat(F.array_join(cut["parts"], ""), F.substr(text, (cut["at"] + 1).cast("int")))
    new = F.when(F.size("spans") > 0, clean).otherwise(text)
    return scanned.select(*[
        (new if c == text_col else F.col("whole").getField(c)).alias(c) for c in docs.columns
    ])


def _order(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                                              s["end"].alias("end"), s["kind"].alias("kind"))))


def _shown(spans: Column) -> Column:
    return F.array_join(
        F.transform(_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, counts by fixed kind, the digest of their spans, and all spans as text."""
    found = scan_secrets(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        *[count(kind).alias(f"n_{kind}") for kind, *_ in FIXED],
        F.sha2(F.encode(_shown(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _shown(F.col("spans")).alias("spans"),
    )
