"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Rules find the plain cases (assignments, access keys, long hexadecimal runs). The battery looks at what else has the letters
of an encoded key: a chi-squared test of how evenly the inferred encoding's alphabet is used, a runs test above and below the
alphabet's middle, and a lag-one serial correlation, combined by Fisher's method into the p-value of "these are random
symbols". Structured names and numbers have small p-values, random keys evenly spread ones. So in each band of lengths, the
count of p-values above 1/2 tells how many tokens are random, and a token is taken for a secret where the estimated share of
structured tokens among all with at least its p-value stays below `max_false`. Counts by band and p-value, a table of fixed
size, are all that meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: Shorter runs can be no match and hold none, so the least length is part of these two patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
HEX_HINT = r"[0-9a-f]{24}"
CODED = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
P_BINS = 20
#: Matches whose positions are added up in one list; a text's lists are put together afterwards.
LIST = 128


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches; positions in characters, value: a group. Matches
    whose value has fewer than `least` characters are dropped after matching.

    A text is its gaps and matches in turn, so positions are sums of their lengths. An array is copied whenever it grows, so they
    are added up in short lists first, from each list's begin, and each list is then moved to its place.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length) if group else F.transform(value, F.length)
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("size"), value.alias("value")), lambda x: x["size"].isNotNull())

    def in_list(steps: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            start, end = s["at"] + x["gap"], s["at"] + x["gap"] + x["size"]
            found = F.array_append(s["found"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
            return F.struct(end.alias("at"), (F.when(F.length(x["value"]) >= least, found).otherwise(s["found"]) if least else found).alias("found"))

        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), add)

    def place(lists: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            return F.struct((s["at"] + x["at"]).alias("at"), F.array_append(s["placed"], F.struct(s["at"].alias("by"), x["found"].alias("found"))).alias("placed"))

        none = F.array().cast("array<struct<by:int,found:array<struct<start:int,end:int,value:string>>>>")
        return F.aggregate(lists, F.struct(F.lit(0).alias("at"), none.alias("placed")), add)["placed"]

    # A one-element array binds what its lambda uses more than once.
    cut = F.transform(F.array(steps), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / LIST).cast("int")), lambda k: in_list(F.slice(all_, k * LIST + 1, LIST))))[0]
    moved = F.transform(place(cut), lambda p: F.transform(p["found"], lambda m: F.struct((m["start"] + p["by"]).alias("start"), (m["end"] + p["by"]).alias("end"), m["value"].alias("value"))))
    return F.flatten(moved)


def _rule(kind: str, text: Column, hint: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Spans of a rule where the hint holds."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = F.transform(matches(text, pattern, group, least), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
    return F.when(hint, spans).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the logistic approximation."""
    return 1 / (1 + F.exp(F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)) * 1.5976 + F.pow(F.least(F.greatest(z, F.lit(-9.0)), F.lit(9.0)), 3) * 0.070565))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x), by Wilson and Hilferty's cube root."""
    return normal_tail((F.cbrt(x / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, p_uniform, p_runs, p_serial and p_value to a table with the column value.

    Tokens whose letters fit no encoding (no digit, or one case with other signs) are dropped: they are words, not keys.
    """
    v = F.col("value")
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    encodings = (
        ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", digits + "abcdef"),
        ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", digits + "ABCDEF"),
        ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", upper + "234567"),
        ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", digits + lower),
        ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", digits + upper),
        ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", digits + upper + lower),
        ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$", digits + upper + lower + "+/_-"),
    )
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, fits, alphabet in reversed(encodings):
        name, letters = F.when(v.rlike(fits), label).otherwise(name), F.when(v.rlike(fits), alphabet).otherwise(letters)
    t = tokens.withColumns({"encoding": name, "letters": letters}).where("encoding is not null")
    t = t.withColumn("x", F.expr("transform(split(value, ''), c -> cast(instr(letters, c) - 1 as double))"))
    t = t.withColumns({
        "n": F.size("x").cast("double"),
        "k": F.when(F.col("encoding") == "base64", 64.0).otherwise(F.length("letters").cast("double")),
        "same": F.expr("aggregate(array_distinct(x), 0D, (s, d) -> s + pow(size(filter(x, y -> y = d)), 2))"),
        "mean": F.expr("aggregate(x, 0D, (s, y) -> s + y) / size(x)"),
        "high": F.expr("transform(x, y -> if(2 * y >= length(letters), 1, 0))"),
    })
    t = t.withColumns({
        "n1": F.expr("cast(aggregate(high, 0, (s, y) -> s + y) as double)"),
        "runs": F.expr("1D + size(filter(sequence(1, size(high) - 1), i -> high[i] != high[i - 1]))"),
        "lag": F.expr("aggregate(sequence(1, size(x) - 1), 0D, (s, i) -> s + (x[i] - mean) * (x[i - 1] - mean))"),
        "square": F.expr("aggregate(x, 0D, (s, y) -> s + (y - mean) * (y - mean))"),
    })
    n, k = F.col("n"), F.col("k")
    expected = 2 * F.col("n1") * (n - F.col("n1")) / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    r = F.when(F.col("square") > 0, F.col("lag") / F.col("square")).otherwise(1.0)
    t = t.withColumns({
        "p_uniform": chi2_tail(F.greatest(F.col("same") * k / n - n, F.lit(0.0)), k - 1),
        "p_runs": F.least(F.lit(1.0), 2 * normal_tail(F.abs(F.col("runs") - expected) / spread)),
        "p_serial": F.least(F.lit(1.0), 2 * normal_tail(F.abs(r + 1 / n) * F.sqrt(n))),
    })
    fisher = -2 * (F.log(F.greatest("p_uniform", F.lit(1e-12))) + F.log(F.greatest("p_runs", F.lit(1e-12))) + F.log(F.greatest("p_serial", F.lit(1e-12))))
    return t.withColumn("p_value", chi2_tail(fisher, F.lit(6.0))).drop("letters", "x", "n", "k", "same", "mean", "high", "n1", "runs", "lag", "square")


def accept_random(tested: DataFrame, max_false: float = 0.1) -> DataFrame:
    """The rows of `tested` (value, p_value) that are taken for random, by band of lengths; see the module's text."""
    tested = tested.withColumns({"band": F.least(F.floor(F.log2(F.length("value") / 5.0)), F.lit(10)).cast("int"), "bin": F.least(F.floor(F.col("p_value") * P_BINS), F.lit(P_BINS - 1)).cast("int")})
    counts = tested.groupBy("band", "bin").agg(F.count("*").alias("n"))  # at most 11 * P_BINS rows
    band, above = Window.partitionBy("band"), Window.partitionBy("band").orderBy(F.desc("bin"))
    random = 2 * F.sum(F.when(F.col("bin") >= P_BINS // 2, F.col("n")).otherwise(0)).over(band) + 1
    share = 1 - F.least(random * (1 - F.col("bin") / P_BINS) / F.sum("n").over(above), F.lit(1.0))
    bins = counts.select("band", "bin", share.alias("share")).where((F.col("share") <= max_false) & (F.col("bin") > 0))
    least = bins.groupBy("band").agg(F.min("bin").alias("least"))
    return tested.join(F.broadcast(least), "band").where("bin >= least").drop("band", "bin", "least")


def _free_tokens(scanned: DataFrame) -> DataFrame:
    """row, start, end, value of the coded tokens that overlap no base span of their row, in one pass along each text: a token
    overlaps one if, of the spans that start before its end, one ends after its start."""
    token = F.transform("coded", lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("last"), c.alias("c")))
    no_token = F.lit(None).cast("struct<start:int,end:int,value:string>")
    span = F.transform("base", lambda b: F.struct(b["start"].alias("at"), b["end"].alias("last"), no_token.alias("c")))
    places = scanned.where(F.size("coded") > 0).select("row", F.inline(F.concat(token, span)))
    before = Window.partitionBy("row").orderBy("at", F.col("c").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return places.withColumn("reach", F.max("last").over(before)).where("c is not null and reach <= c.start").select("row", "c.*")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_false: float = 0.1) -> DataFrame:
    """One row for each document (repeated rows each have theirs): the id, base and spans, both array<struct<start, kind, end>>
    sorted by start and kind (numbers into KINDS). spans also has the tokens that the battery takes for random keys and that
    overlap no base span. Null and empty texts have none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = F.concat(
        _rule("assign", text, text.rlike(ASSIGN_HINT), ASSIGN, 6, 2),
        _rule("access", text, text.contains("AKIA"), ACCESS),
        _rule("hex", text, text.rlike(HEX_HINT), HEX),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    coded = F.when(text.rlike(CODED), matches(text, CODED)).otherwise(none)
    scanned = settle(own.select(F.monotonically_increasing_id().alias("row"), "id", F.array_sort(base).alias("base"), coded.alias("coded")), "secrets")
    tokens = _free_tokens(scanned)
    span = F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")
    more = accept_random(battery(tokens), max_false).groupBy("row").agg(F.collect_list(span).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return scanned.join(more, "row", "left").select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def _written(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *n, F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"))
