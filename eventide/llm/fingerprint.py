"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's five-word shingles. Sketches of parts merge into the sketch of the union,
and estimate resemblance, containment and the number of distinct shingles.
Everything is DataFrame functions; no Python runs on executors.

Defined results
- null text: empty. A text without words has an empty sketch and fingerprint;
  two empty sketches resemble each other with 1, an empty and another one with 0.
- a text of one to four words is one shingle.
- white space only separates words, so texts that differ in it alone have one sketch.
- ``with_next``: rows follow each other by descending doc_id, null ids last,
  rows of one id by text; after the last row comes the first. A single row
  follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions

SHINGLE = 5
SIZE = 128
SALTS = 64


def sketch(text: Column, k: int = SIZE, words: int = SHINGLE) -> Column:
    """Bottom-k sketch of ``text``: an ascending array of at most ``k`` hashes."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: _bottom(_shingles(h, words), k))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use).getItem(0)


def _shingles(h: Column, words: int) -> Column:
    n = F.size(h)
    windows = F.transform(
        F.sequence(F.lit(0), n - F.lit(words)),
        lambda i: F.xxhash64(*[F.get(h, i + F.lit(j)) for j in range(words)]))
    return F.when(n >= words, windows).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def _bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, keys: list[str], column: str, k: int = SIZE, salts: int = SALTS) -> DataFrame:
    """One merged sketch per key. A hot key is merged in ``salts`` parts first."""
    rows = df.select(*keys, F.explode(column).alias("_h"))
    parts = rows.groupBy(*keys, F.pmod("_h", F.lit(salts)).alias("_salt"), "_h").agg(F.lit(1).alias("_one"))
    near = W.partitionBy(*keys, "_salt").orderBy("_h")
    parts = parts.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k)
    least = W.partitionBy(*keys).orderBy("_h")
    return (
        parts.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= k)
        .groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))
    )


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of common shingles among all, 0 to 1."""
    def share(least: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(least, a), b))
        return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least).cast("double"))

    return _let(merge(a, b, k), share)


def distinct_count(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles (exact below k)."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has, 0 to 1."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as a string of 16 hex digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(rows: DataFrame, columns: list[str], derived: dict | None = None, id_column: str = "doc_id",
              tie: str = "text") -> DataFrame:
    """``rows`` with ``next_<c>`` of the following row for every ``c`` in ``columns``.

    Rows are dealt into ranges of ids (quantiles, one per shuffle partition); each
    range also gets a copy of the row that comes after its end, so no row has to
    look across tasks. Only the quantiles and one id per range reach the driver.
    ``derived`` names columns to compute after the rows are dealt, from a function of
    the row's columns: they need not travel.
    """
    spark = rows.sparkSession
    n = max(1, partitions(spark))
    ident = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    ids = rows.select(ident.alias("_id"))
    cuts = ids.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))

    def bucket(value: Column) -> Column:
        """How many cuts are smaller: a binary search in one array."""
        if not cuts:
            return F.lit(0)
        table, bits = F.array(*[F.lit(x) for x in cuts]), len(cuts).bit_length()

        def halve(low: Column, bit: Column) -> Column:
            here = low + bit
            return F.when((here <= len(cuts)) & (F.element_at(table, F.least(here, F.lit(len(cuts)))) < value), here).otherwise(low)

        return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(bits))]), F.lit(0), halve)

    heads = ids.select("_id", bucket(F.col("_id")).alias("_b")).groupBy("_b").agg(F.max("_id").alias("top")).collect()
    tops = {r["_b"]: r["top"] for r in heads}
    order = sorted(tops, reverse=True)  # buckets from the largest ids down
    after = {b: tops[order[(i + 1) % len(order)]] for i, b in enumerate(order)}

    # Numbered names keep any column of ``rows`` from clashing with the helpers.
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    plain = rows.select(*[F.col(c).alias(x) for c, x in names.items()], ident.alias("_id"))
    keyed = plain.withColumns({"_b": bucket(F.col("_id")), "_copy": F.lit(False)})
    firsts = plain.filter(F.col("_id").isin(list(tops.values()))).withColumn(
        "_r", F.row_number().over(W.partitionBy("_id").orderBy(names[tie]))).filter("_r = 1").drop("_r")
    if after:
        goes_to = spark.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(top).cast("long").alias("_id"), F.lit(b).alias("_b")) for b, top in after.items()])))
        firsts = firsts.join(F.broadcast(goes_to), "_id").withColumn("_copy", F.lit(True))  # one row per range
    else:
        firsts = firsts.withColumns({"_b": F.lit(0), "_copy": F.lit(True)})
    # Whole buckets by range: neighbours in number share tasks evenly, where a hash would pile some up.
    dealt = keyed.unionByName(firsts.select(*keyed.columns)).repartitionByRange(n, "_b")
    for name, make in (derived or {}).items():
        names[name] = f"c{len(names)}"
        dealt = dealt.withColumn(names[name], make(lambda c: F.col(names[c])))
    follow = W.partitionBy("_b").orderBy("_copy", F.desc("_id"), names[tie])
    return dealt.select(
        "_copy", *[F.col(x).alias(c) for c, x in names.items()],
        *[F.lead(names[c]).over(follow).alias(f"next_{c}") for c in columns]).filter(~F.col("_copy")).drop("_copy")


def edited_fingerprints(docs: DataFrame, k: int = SIZE) -> DataFrame:
    """Each document's sketch beside that of its text with the end replaced by the next document's start.

    The last floor(n/2) code points give way to as many of the next text (all of
    it if it is shorter).
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "sketch"], {"sketch": lambda c: sketch(c("text"), k)})
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    return rows.select(
        "doc_id", "n_chars", "sketch", "edited", "next_sketch", sketch(F.col("edited"), k).alias("edited_sketch"))
