"""Benchmark decontamination by templates, in DataFrame expressions only.

Texts become templates: tokens with a digit, capitalised tokens inside a sentence and units after a number turn into typed
placeholders, the rest into lower-case letters and digits. A document leaks an item when a window of 13 template tokens (the
whole item where it is shorter) stands in both and the values in the slots agree one to one, so a question with other numbers
or names is caught, and one whose numbers are shuffled without sense is not.

Verbatim copies are looked up by their plain lower-cased tokens as well, with no demand on literals, so an item made of numbers or names
and a copy in other case or spacing are found.

The item side indexes the short windows at every position, the document side only at every STRIDE-th: a common run of WINDOW
tokens always holds one of these whole. So a sixth of the positions is looked up, and none is lost. Hits are then verified
token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, keep

WINDOW = 13
PROBE = 8
STRIDE = WINDOW - PROBE + 1
#: An item below this many tokens says too little to be told from chance; it leaks nowhere.
LEAST_ITEM = 5
#: A window needs this many tokens that are not placeholders, unless it is a verbatim copy.
LEAST_LITERALS = 4
#: Unit names that become a placeholder after a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours days weeks months years percent usd eur gbp dollars euros "
         "cents meters metres kilometers kilometres grams kilograms liters litres seconds minutes miles feet inches pounds degrees "
         "mph kmh watts volts").split()
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
_PLACES = (NUM, NAME, UNIT)


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}<>\s]+", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def raw_tokens(text: Column) -> Column:
    """Letters and digits of each token, aligned with template(): both drop the tokens that have neither."""
    return tokens(letters(F.regexp_replace(F.coalesce(text, F.lit("")), "[<>]", "")))


def template(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[<>]", ""), f"[{SPACE}]+", " ")
    named = F.regexp_replace(text, r"(?<=[^.!?:\s]\s)\p{Lu}\S*+", NAME)
    with_numbers = F.regexp_replace(named, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", NUM)
    # A number's own stop or comma goes with it; a unit must follow at once.
    low = F.lower(with_numbers)
    units = F.regexp_replace(low, rf"(?<=<num>\s)(?:{'|'.join(UNITS)})(?=[.,;:!?]*(?:\s|$))", UNIT)
    return tokens(letters(F.when(text.rlike("[0-9]"), units).otherwise(low)))


def plain(text: Column) -> Column:
    """Lower-cased tokens: no placeholders, so equal windows are verbatim copies."""
    return F.transform(raw_tokens(text), F.lower)


def hashes(column: str, length: Column | int, stride: int) -> Column:
    """Hashes of the windows of a token array at every stride-th position."""
    last = F.size(column) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.xxhash64(F.slice(column, i + 1, length))))


def literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda t: ~t.isin(*_PLACES)))


def telling(item: str, at: Column | str, probe: int) -> Column:
    """Whether some window of the item around its probe at `at` has the literals that a match needs.

    Runs of placeholders, as in tables of numbers, would meet each other at every place and be refused afterwards.
    """
    at, length = F.col(at), F.least(F.size(item), F.lit(WINDOW))
    first, last = F.greatest(at + probe - length, F.lit(0)), F.least(at, F.size(item) - length)
    return F.exists(F.sequence(first, last), lambda s: literals(F.slice(item, s + 1, length)) >= LEAST_LITERALS)


def identity(docs: DataFrame) -> list[Column]:
    """Key of a row: rows alike in it are alike in all that matters here."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct pairs that leak: doc_id, text_key, item_id, exact (some shared window has equal slot values).

    Null and empty texts leak nothing; items below LEAST_ITEM tokens match nothing; repeated rows give one pair; equal items
    give a pair each. A null doc_id or item_id is carried as it is. Columns other than ids and texts are not read.
    """
    found = _matches(docs, items, template).unionByName(_matches(docs, items, plain))
    return found.groupBy("doc_id", "text_key", "item_id").agg(F.max("exact").alias("exact"))


def _matches(docs: DataFrame, items: DataFrame, template) -> DataFrame:
    """leaks() for one way to make tokens of a text."""
    bench = keep(items.select(F.col("item_id").cast("long").alias("item_id"), template(F.col("text")).alias("item"),
                              raw_tokens(F.col("text")).alias("item_raw")).where(F.size("item") >= LEAST_ITEM)
                 .withColumn("item_key", F.monotonically_increasing_id()), "bench-items")
    grams = docs.where(F.col("text").isNotNull()).select(*identity(docs), template(F.col("text")).alias("doc"))
    found = None
    short = [r[0] for r in bench.where(F.size("item") < WINDOW).select(F.size("item").alias("n")).distinct().collect()]  # below 13
    for length, stride in [(PROBE, STRIDE), *((n, 1) for n in short)]:
        probe = length if stride == 1 else PROBE
        wanted = F.size("item") == length if stride == 1 else F.size("item") >= WINDOW
        places = bench.where(wanted).select("item_key", "item", F.posexplode(hashes("item", probe, 1)).alias("item_at", "gram"))
        index = keep(places.where(telling("item", "item_at", probe)).drop("item"), "bench-index")
        hits = (grams.select("doc_id", "text_key", F.posexplode(hashes("doc", probe, stride)).alias("n", "gram"))
                .join(index, "gram").select("doc_id", "text_key", (F.col("n") * stride).alias("doc_at"), "item_key", "item_at"))
        found = hits if found is None else found.unionByName(hits)
    hits = keep(found.distinct(), "bench-hits")
    wanted = hits.select("doc_id", "text_key").distinct()
    wanted = keep(wanted, "bench-docs").withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    texts = (docs.where(F.col("text").isNotNull()).select(*identity(docs), "text")
             .join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi")
             .dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", template(F.col("text")).alias("doc"), raw_tokens(F.col("text")).alias("doc_raw"))
             .withColumnsRenamed({"doc_id": "id", "text_key": "key"}))
    rows = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).drop("id", "key").join(bench, "item_key")
    length = F.least(F.size("item"), F.lit(WINDOW))
    rows = rows.withColumn("length", length).withColumn("looks", F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.col("length") - PROBE, F.lit(0))), lambda o: (
            (F.col("doc_at") >= o) & (F.col("item_at") >= o) & (F.col("doc_at") - o + F.col("length") <= F.size("doc"))
            & (F.col("item_at") - o + F.col("length") <= F.size("item")))),
        lambda o: F.struct(*[F.slice(c, (F.col(at) - o + 1).cast("int"), F.col("length").cast("int")).alias(c) for c, at in (
            ("doc", "doc_at"), ("item", "item_at"), ("doc_raw", "doc_at"), ("item_raw", "item_at"))])))

    def slots(look: Column) -> Column:
        places = F.filter(F.arrays_zip(look["item"].alias("t"), look["item_raw"].alias("i"), look["doc_raw"].alias("d")),
                          lambda s: s["t"].isin(*_PLACES))
        return F.transform(places, lambda s: F.struct(s["i"].alias("i"), s["d"].alias("d")))

    def agrees(look: Column) -> Column:
        pairs = F.array_distinct(slots(look))
        one_to_one = ((F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"]))))
                      & (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["d"])))))
        return (look["doc"] == look["item"]) & one_to_one & (literals(look["item"]) >= LEAST_LITERALS)

    good = F.filter("looks", agrees)
    rows = rows.select("doc_id", "text_key", "item_id", "item_key", good.alias("good")).where(F.size("good") > 0)
    exact = F.exists("good", lambda look: F.forall(slots(look), lambda s: s["i"] == s["d"]))
    return rows.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.max(exact).alias("exact")).drop("item_key")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs doc_id, item_id of documents that hold an item, with exact: false where only numbers, names or units differ."""
    return leaks(docs, items).groupBy("doc_id", "item_id").agg(F.max("exact").alias("exact"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; all other rows and all columns stay."""
    bad = keep(leaks(docs, items).select("doc_id", "text_key").distinct(), "bench-leaks")
    bad = bad.select(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text_key")).alias("tidemark_bad"))
    key = F.struct(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return docs.withColumn("tidemark_key", key).join(bad, F.col("tidemark_key") == F.col("tidemark_bad"), "left_anti").drop("tidemark_key")
