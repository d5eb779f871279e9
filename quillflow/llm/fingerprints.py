"""Bottom-k sketches of word shingles, with built-in functions only.

A fingerprint is the sorted array of the k smallest distinct 32-bit hashes of a text's shingles of
five words. Fingerprints of parts merge into that of the whole; two fingerprints estimate
resemblance and containment, one estimates its number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 256
WORDS = 5
RANGE = 1 << 32


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def fingerprint(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Sketch of a text. A text of fewer words is one shingle; a null text or one without words has an empty sketch."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - words),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]).bitwiseAND(F.lit(RANGE - 1)))
        few = F.array(F.xxhash64(h).bitwiseAND(F.lit(RANGE - 1)))
        return F.when(F.size(h) >= words, many).when(F.size(h) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return smallest(bound(hashed, shingles), k)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what both sketches stand for."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles, 0 to 1; exact while both have fewer than k shingles. Two empty ones: 1."""
    return bound(
        F.struct(merged(a, b, k).alias("u"), F.array_intersect(a, b).alias("c")),
        lambda s: F.when(F.size(s["u"]) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(s["c"], s["u"])) / F.size(s["u"])))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(RANGE) / F.greatest(F.element_at(a, k), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained in anything."""
    def share(r: Column) -> Column:
        common = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
        return F.least(F.lit(1.0), common / distinct_count(a, k))

    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(bound(resemblance(a, b, k), share))


def shown(a: Column) -> Column:
    """A sketch as text: eight hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def with_next(rows: DataFrame, key: str, columns: dict[str, Column], parts: int) -> DataFrame:
    """Add next_<name> for each of `columns` (computed here): its value in the next row by ascending `key`,
    in the first row for the last one.

    Rows are dealt to ranges of the key whose lower ends are keys that occur. The first row of a range
    also goes to the range before it, as its end, so that no row has to look beyond its own range.
    Null keys come first; rows of equal key follow one another by a hash of `columns`.
    """
    low = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    steps = [i / parts for i in range(1, parts)]
    found = rows.select(low.alias("k")).agg(
        F.min("k").alias("least"), F.percentile_approx("k", steps or [0.5], 20 * parts).alias("ends")).first()
    ends = sorted({e for e in found["ends"] or [] if e > found["least"]})
    least, bounds = found["least"], F.array(*[F.lit(e) for e in ends]).cast("array<bigint>")
    own = F.size(F.filter(bounds, lambda e: e <= F.col("_key")))
    home = lambda part, end: F.struct(part.alias("part"), F.lit(end).alias("end"))
    nowhere = F.array().cast("array<struct<part:int,end:int>>")
    homes = F.concat(
        F.array(home(own, 0)),
        F.when(F.array_contains(bounds, F.col("_key")), F.array(home(own - 1, 1))).otherwise(nowhere),
        F.when(F.col("_key") == F.lit(least), F.array(home(F.lit(len(ends)), 1))).otherwise(nowhere))
    dealt = rows.withColumn("_key", low).withColumn("_home", F.explode(homes)).select(
        "*", F.col("_home.part").alias("_part"), F.col("_home.end").alias("_end")).drop("_home")
    dealt = dealt.repartition(max(1, parts // 4), "_part")
    names = list(columns)
    dealt = dealt.select("*", *[columns[n].alias(f"_own_{n}") for n in names])
    order = Window.partitionBy("_part").orderBy("_end", "_key", F.xxhash64(*[f"_own_{n}" for n in names]))
    led = dealt.select("*", *[F.lead(f"_own_{n}").over(order).alias(f"next_{n}") for n in names])
    led = led.where(F.col("_end") == 0).drop("_key", "_part", "_end")
    for n in names:
        led = led.drop(n).withColumnRenamed(f"_own_{n}", n)
    return led


def edited(documents: DataFrame, parts: int) -> DataFrame:
    """Every document of (doc_id, text), its second half replaced by the start of the next document, with the
    fingerprints of both and their likenesses. Null texts are empty; repeated doc_ids stay rows of their own."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(rows, "doc_id", {"text": F.col("text"), "print": fingerprint(F.col("text"))}, parts)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    led = led.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    led = led.withColumn("edited_print", fingerprint(F.col("edited")))
    return led.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("print")).alias("fingerprint"),
        shown(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print")).alias("near_edited"),
        resemblance(F.col("print"), F.col("next_print")).alias("near_next"))
