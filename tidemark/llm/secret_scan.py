"""Secret scan: fixed patterns plus a battery of randomness tests, in DataFrame expressions only.

One pass over the texts keeps the matches of each pattern and the gaps between them; everything later works on that small table.
Positions are running sums of gaps and match lengths, so a text with very many matches costs linear time.

Added spans: every maximal run of 20 or more characters of the common encodings is a candidate. Its encoding is inferred from the
characters it uses. Three tests ask whether it could be a uniform draw from that alphabet: chi-squared on the symbol counts, the
runs test around the middle of the alphabet and the lag-one serial correlation; Fisher's method combines them. Against ordinary
words stands a fourth p value, for changes between letters and digits or from lower to upper case, which are rare in text. It is
held to Benjamini-Hochberg control within classes of like length (powers of two), as short strings bear less evidence. A
candidate is a secret when it is a discovery of its length class and the battery does not reject it as random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep

#: The patterns of the base scan. Lengths are demanded where that finds the same matches.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Kinds in the order of the span list, and the encodings with their alphabets, narrowest first.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM)))
ENCODINGS = (
    ("decimal", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"),
    ("base32", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "-_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("mixed", "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"))
BINS = 64


def matches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row_key, doc_id and, for each kind, the gaps before each match and the matches: one pass over the texts, kept."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = []
    for kind, pattern in PATTERNS.items():
        found = text.rlike(pattern)
        columns += [
            F.when(found, F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("long"))).alias(f"{kind}_gaps"),
            F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(kind)]
        if kind == "assign":
            columns.append(F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).alias("assign_value"))
    return keep(docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), *columns),
                "secret-matches")


def spans(found: DataFrame, kind: str) -> DataFrame:
    """row_key, kind_no, start, end, value of every match of a kind (code points, end exclusive)."""
    parts = [F.slice(f"{kind}_gaps", 1, F.size(kind)).alias("gap"), F.col(kind).alias("hit")]
    parts.append(F.col("assign_value" if kind == "assign" else kind).alias("value"))
    rows = (found.where(F.col(kind).isNotNull()).select("row_key", F.posexplode(F.arrays_zip(*parts)).alias("i", "m"))
            .select("row_key", "i", F.col("m.gap").alias("gap"), F.char_length("m.hit").alias("length"), F.col("m.value").alias("value")))
    so_far = Window.partitionBy("row_key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    return rows.withColumn("end", end).select(
        "row_key", F.lit(KINDS.index(kind)).alias("kind_no"), (F.col("end") - F.col("length")).alias("start"), "end", "value")


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal: Zelen and Severo's polynomial below 6, the leading asymptotic term beyond."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    tail = F.when(x > 6, density / F.greatest(x, F.lit(1.0))).otherwise(density * poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, p_uniform (Fisher's combination of the three tests), p_text and the length class of each value."""
    body = F.regexp_replace("value", "=+$", "")
    encoding, alphabet = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][1])
    for name, letters in reversed(ENCODINGS[:-1]):
        fits = F.translate("body", letters, "") == ""
        encoding, alphabet = F.when(fits, name).otherwise(encoding), F.when(fits, letters).otherwise(alphabet)
    rows = candidates.withColumn("body", body).withColumns({"encoding": encoding, "alphabet": alphabet})
    rows = rows.withColumns({
        "n": F.char_length("body").cast("double"), "k": F.char_length("alphabet").cast("double"),
        "x": F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")),
        "squares": F.aggregate(F.array_distinct(F.filter(F.split("body", ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a + F.pow(
            F.col("n") - F.char_length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)))})
    n, k, x = F.col("n"), F.col("k"), F.col("x")
    df = k - 1
    chi = F.col("squares") * k / n - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    following = F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    rows = rows.withColumns({"p_chi": normal_tail(z_chi), "pairs": pairs, "mean": mean,
                             "high": F.size(F.filter(x, lambda v: v >= F.col("k") / 2)).cast("double")})
    runs = 1 + F.size(F.filter("pairs", lambda p: (p["a"] >= F.col("k") / 2) != (p["b"] >= F.col("k") / 2)))
    product = 2 * F.col("high") * (n - F.col("high"))
    spread = product * (product - n) / (n * n * (n - 1))
    z_runs = (runs - 1 - product / n) / F.sqrt(spread)
    covariance = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))
    variance = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - F.col("mean"), F.lit(2.0)))
    rows = rows.withColumns({
        # A value on one side of its alphabet, or of one symbol, is as unlike a uniform draw as can be.
        "p_runs": F.when(spread > 0, 2 * normal_tail(F.abs(z_runs))).otherwise(0.0),
        "p_serial": F.when(variance > 0, 2 * normal_tail(F.abs(covariance / variance * F.sqrt(n)))).otherwise(0.0)})
    fisher = F.aggregate(F.array("p_chi", "p_runs", "p_serial"), F.lit(0.0), lambda s, p: s - F.log(F.greatest(p, F.lit(1e-300))))
    changes = F.char_length("body") - F.char_length(F.regexp_replace("body", r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]", ""))
    rate = 0.1  # of such changes per character of ordinary text
    z_text = (changes - 0.5 - rate * (n - 1)) / F.sqrt(rate * (1 - rate) * (n - 1))
    return rows.withColumn("fisher", fisher).select(
        *candidates.columns, "encoding", (F.exp(-F.col("fisher")) * (1 + F.col("fisher") + F.pow("fisher", F.lit(2.0)) / 2)).alias("p_uniform"),
        normal_tail(z_text).alias("p_text"), F.floor(F.log2("n")).cast("int").alias("length_class"))


def discoveries(tested: DataFrame, level: float = 0.01) -> DataFrame:
    """Rows of tested that Benjamini-Hochberg control at the level declares, each length class on its own.

    p values are put into bins of 1/64 of a power of ten, each standing for its largest value, so only bin counts meet.
    """
    rows = tested.withColumn("bin", F.floor(-F.log10(F.greatest("p_text", F.lit(1e-300))) * BINS).cast("int"))
    counts = rows.groupBy("length_class", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("length_class")
    ranked = counts.withColumns({"at_least": F.sum("n").over(whole.orderBy(F.desc("bin"))), "all": F.sum("n").over(whole)})
    passed = F.pow(F.lit(10.0), -F.col("bin") / BINS) <= level * F.col("at_least") / F.col("all")
    cuts = keep(ranked.where(passed).groupBy("length_class").agg(F.min("bin").alias("cut")), "secret-cuts")
    return rows.join(cuts, "length_class").where("bin >= cut").drop("bin", "cut")


def scan(docs: DataFrame, level: float = 0.01, alpha: float = 1e-4, text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Null and empty texts have no spans and the digest of the empty string. Rows that repeat a doc_id are rows of their own.
    Columns other than doc_id and text_col are not read. An empty input gives an empty result.
    """
    found = matches(docs, text_col)
    base = spans(found, "assign").where(F.char_length("value") >= 8)
    for kind in ("access", "hex"):
        base = base.unionByName(spans(found, kind))
    tested = keep(battery(spans(found, "random")), "secret-tests")
    random = discoveries(tested.where(F.col("p_uniform").isNotNull()), level).where(F.col("p_uniform") >= alpha)
    columns = ["row_key", "kind_no", "start", "end"]
    gathered = base.select(columns).unionByName(random.select(columns)).groupBy("row_key").agg(
        *[F.count(F.when(F.col("kind_no") == i, 1)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.struct("start", "kind_no", "end"))).alias("all"))
    names = F.array(*map(F.lit, KINDS))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["end"])), ",")

    out = found.select("row_key", "doc_id").join(gathered, "row_key", "left")
    some = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>"))
    return out.select(
        "doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(F.filter(some, lambda s: s["kind_no"] < 3)).cast("binary"), 256).alias("base_sha256"), joined(some).alias("spans"))
