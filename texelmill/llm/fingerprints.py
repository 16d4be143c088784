"""Document fingerprints by consistent weighted sampling, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texelmill.session import cut_lineage

#: Samples of a fingerprint: BLOCKS rows of WIDTH columns. The standard error of a likeness of one half is 0.5 / sqrt(64).
BLOCKS, WIDTH = 8, 8
#: Steps of the gamma distribution's inverse table; every sample reads two of its own, so they should stay in a core's cache.
STEPS = 256
_LEAST = -(2**63)


def gamma_quantiles(steps: int = STEPS) -> list[float]:
    """The Gamma(2, 1) quantiles at the middles of ``steps`` equal shares: 1 - (1 + x) exp(-x) = share."""
    out, x = [], 0.01
    for i in range(steps):
        share = (i + 0.5) / steps
        for _ in range(60):
            move = (1 - (1 + x) * math.exp(-x) - share) / (x * math.exp(-x))
            x = max(x - move, x / 2)
            if abs(move) < 1e-14 * x:
                break
        out.append(x)
    return out


def _table(values: list[float]) -> Column:
    """A constant array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def _pick(table: Column, at: Column) -> Column:
    return F.get(table, at.cast("int"))


def sample_value(term: Column, log_weight: Column, number: int, rates: Column, logs: Column) -> Column:
    """log a of one consistent weighted sample: r and c are Gamma(2, 1), b uniform, all by a hash of the term and the sample's number.

    t = floor(log S / r + b), log y = r (t - b), log a = log c - log y - r. The least a over the terms of a document names a (term, t) pair; two documents have it in
    common with the probability of their generalised Jaccard similarity, and equal pairs have equal a, so a itself is the sample.
    """
    bits = F.xxhash64(term.bitwiseXOR(F.lit((number * 0x9E3779B97F4A7C15) % 2**63)))
    r = _pick(rates, bits.bitwiseAND(F.lit(STEPS - 1)))
    log_c = _pick(logs, F.shiftrightunsigned(bits, 8).bitwiseAND(F.lit(STEPS - 1)))
    b = F.shiftrightunsigned(bits, 16) * F.lit(2.0**-48)
    return log_c - r * (F.floor(log_weight / r + b) - b + 1)


def least_samples(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, s0, s1, ...) of (keys, term, n): the least a of each sample. One aggregation, no string or Python in it.

    A term makes a row for each block, by an own hash of the term, so that the aggregation has few columns.
    """
    quantiles = gamma_quantiles()
    rates, logs = _table(quantiles), _table([math.log(x) for x in quantiles])
    seeds = F.array(*[F.struct(F.lit(b).alias("block"), F.lit((b + 1) * 0xD1B54A32D192ED03 % 2**63).alias("seed")) for b in range(BLOCKS)])
    rows = terms.withColumn("w", F.log(F.col("n").cast("double"))).withColumn("b", F.explode(seeds))
    rows = rows.select(*keys, "w", "b.block", F.col("term").bitwiseXOR(F.col("b.seed")).alias("term"))
    return rows.groupBy(*keys, "block").agg(*[F.min(sample_value(F.col("term"), F.col("w"), j, rates, logs)).alias(f"s{j}") for j in range(WIDTH)])


def _short(columns: list[Column]) -> Column:
    """16 bits of each sample; null where there is none."""
    return F.when(columns[0].isNotNull(), F.array(*[F.xxhash64(c).bitwiseAND(F.lit(0xFFFF)).cast("int") for c in columns]))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; texts without words are alike to each other (1) and to nothing else (0)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).otherwise(F.coalesce(same, F.lit(0.0)))


def _printed(samples: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ""), F.lit(""))


def next_documents(ids: DataFrame) -> DataFrame:
    """(k, version, ...) plus the columns of the next row in descending (k, version) as next_k, next_version; the last one's is the first.

    Only ids go through the ordering: range partitions, each numbered on its own, and one row per partition to find the neighbour across a border.
    """
    ranged = ids.repartitionByRange(F.col("k").desc(), F.col("version").desc()).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    pair = F.struct("k", "version")
    heads = ranged.groupBy("part").agg(F.max(pair).alias("head"))
    # one row for each range partition
    order = Window.orderBy("part")
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    own = Window.partitionBy("part").orderBy(F.col("k").desc(), F.col("version").desc())
    out = ranged.withColumn("next", F.lead(pair).over(own)).join(heads.select("part", "after"), "part")
    out = out.withColumn("next", F.coalesce("next", "after"))
    return out.drop("part", "after").withColumn("next_k", F.col("next.k")).withColumn("next_version", F.col("next.version")).drop("next")


def fingerprint_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    Terms are words by the number of times they occur. ``edited`` is the text whose last floor(n_chars / 3) code points are replaced by the first as many (or all) of the
    next document in descending ``doc`` (after the last: the first; a single document is its own next). A null text counts as empty; a text without words has an empty fingerprint. A null ``doc`` counts as the
    smallest of all; rows equal in ``doc`` follow each other by a hash of the text, and rows equal in both are one document whose result repeats.

    The text is shuffled once by id and its opening once to the document that takes it. Where the two meet, one pass makes the words of both texts and the digest, which travels as a row of its own
    (in the keys, so that the aggregations stay hashed); words are counted and sampled there. After that only ids and samples move.
    """
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(_LEAST)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    ids = cut_lineage(rows.groupBy("k", "version").agg(F.count("*").alias("times"), F.first(F.char_length("text")).alias("n_chars")))
    if ids.where("times > 1").limit(1).collect():
        rows = rows.dropDuplicates(["k", "version"])
    following = cut_lineage(next_documents(ids))
    takers = following.select(F.col("next_k").alias("k"), F.col("next_version").alias("version"), F.col("k").alias("to_k"), F.col("version").alias("to_version"), F.floor(F.col("n_chars") / 3).cast("int").alias("m"))
    openings = rows.join(takers, ["k", "version"]).select(F.col("to_k").alias("k"), F.col("to_version").alias("version"), "m", F.expr("left(text, m)").alias("opening"))
    both = rows.join(openings, ["k", "version"])
    edited = F.concat(F.expr("left(text, char_length(text) - m)"), F.col("opening"))
    sides = both.select("k", "version", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), edited.alias("text")))).alias("s"))
    sides = sides.select("k", "version", "s.side", "s.text")
    # the entry before the first word is the edited text's digest
    entries = F.concat(F.array(F.when(F.col("side") == 1, F.sha2("text", 256)).otherwise("")), F.split("text", r"[\x20\x09-\x0D]+"))
    words = sides.select("k", "version", "side", F.posexplode(entries).alias("pos", "word")).where("word <> ''")
    counts = [F.sum(F.when((F.col("side") == i) & F.col("term").isNotNull(), 1).otherwise(0)).alias(f"n{i}") for i in (0, 1)]
    words = words.select("k", "version", "side", F.when(F.col("pos") == 0, F.col("word")).alias("digest"), F.when(F.col("pos") > 0, F.xxhash64("word")).alias("term"))
    terms = words.groupBy("k", "version", "digest", "term").agg(*counts)
    # a term as frequent in both texts is sampled once for both (side 2)
    weights = F.when(F.col("n0") == F.col("n1"), F.array(F.struct(F.lit(2).alias("side"), F.col("n0").alias("n"))))
    weights = weights.otherwise(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"n{i}").alias("n")) for i in (0, 1)]))
    terms = terms.select("k", "version", "digest", "term", F.explode(weights).alias("s")).select("k", "version", "digest", "s.side", "term", "s.n").where("n > 0 or digest is not null")
    least = least_samples(terms, ["k", "version", "digest", "side"])
    # a side's text takes the least of its own terms and of those that both have
    names = [f"s{j}" for j in range(WIDTH)]
    joint = least.groupBy("k", "version", "digest", "block").agg(*[F.min(F.when(F.col("side") != 1 - i, F.col(c))).alias(f"{c}_{i}") for i in (0, 1) for c in names])
    part = F.struct("block", *[_short([F.col(f"{c}_{i}") for c in names]).alias(name) for i, name in ((0, "own"), (1, "edit"))])
    joint = joint.select("k", "version", "digest", F.when(F.col("digest").isNull(), part).alias("part"))
    joint = joint.groupBy("k", "version").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.max("digest").alias("edited_sha256"))
    # a text without words has no parts, or parts without samples
    side = lambda c: F.when(F.size("parts") > 0, F.flatten(F.col(f"parts.{c}"))).alias(c)
    sampled = cut_lineage(joint.select("k", "version", "edited_sha256", side("own"), side("edit")))
    own = sampled.select(F.col("k").alias("next_k"), F.col("version").alias("next_version"), F.col("own").alias("next"))
    out = following.join(sampled, ["k", "version"]).join(own, ["next_k", "next_version"])
    out = out.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(
        F.when(F.col("k") != _LEAST, F.col("k")).alias(doc),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        _printed(F.col("own")).alias("fingerprint"),
        _printed(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
