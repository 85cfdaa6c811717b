"""Operator 10, mixing sources to target weights: Poisson replication.

Each source's mean repetition rate is its target share of all documents over its real share. A document's count is
the inverse of the Poisson distribution function at a uniform value drawn from a hash of (seed, doc_id), so a
recomputed task gives the same count. A rate above ``MOST_RATE`` is dealt to as many independent draws of equal means
as keep each at or below it; their sum is of Poisson's distribution with that rate. Documents are exploded by their
counts and shuffled globally: dealt out and sorted by a hash of (seed, doc_id, copy), which is even whatever the
sources' sizes.

Up to ``MOST_SOURCES`` sources (which is checked first), the rates are a constant of the plan and documents are shuffled
once; more of them meet the documents in a join on source and a salt, so that a source of a third of all rows is dealt
to many tasks.

Defined cases: a source without a target weight gets its real share to the power ``temperature``, in proportion to
the others; a null source is a source of its own; a null doc_id hashes as an empty string; repeated rows get equal
counts each, and rows of one id, or of none, are dealt out by their texts, too; an empty table gives no rows; columns beside doc_id and source are carried along, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import free_name

TEMPERATURE, SEED = 0.5, 7
#: The mean of one draw at most, so that exp(-mean) stays far from zero.
MOST_RATE = 20
#: Sources whose rates are held as a constant of the plan, at most; salts of a source beyond that.
MOST_SOURCES, SALTS = 10_000, 64


def uniform(*parts: Column) -> Column:
    """A value in (0, 1) from the first 52 bits of an MD5 over the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source and its mean repetition rate; one row per source."""
    counts = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    tempered = F.pow(F.col("n"), F.lit(temperature))
    given = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(float(v))) for k, v in weights.items()))) if weights else None
    weight = F.coalesce(F.try_element_at(given, F.col("source")), tempered) if given is not None else tempered
    weighed = counts.select("source", "n", weight.alias("w"))
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    return weighed.select("source", (F.col("w") / F.lit(total["w"] or 1.0) * F.lit(total["n"] or 0.0) / F.col("n")).alias("rate"))


def poisson_count(draw, rate: Column) -> Column:
    """Of Poisson's distribution of mean ``rate``. ``draw(j)`` is the j-th uniform value, counted from 0; each of the
    ceil(rate / MOST_RATE) draws gives the least k with P(X <= k) > u."""
    draws = F.greatest(F.lit(1), F.ceil(rate / MOST_RATE)).cast("int")
    mean = rate / draws
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def count(u: Column) -> Column:
        step = lambda a, i: F.when(a["c"] > u, a).otherwise(F.struct((a["p"] * mean / i).alias("p"), (a["c"] + a["p"] * mean / i).alias("c"), (a["k"] + 1).alias("k")))
        # So many steps as a count of this mean takes for any u that has 52 bits.
        steps = (mean + 10 * F.sqrt(mean) + 20).cast("int")
        return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda a: a["k"])

    # A document's first draw is the only one of most; the rest is added where there are more.
    more = F.aggregate(F.sequence(F.lit(1), draws - 1), F.lit(0), lambda acc, j: acc + count(draw(j)))
    return count(draw(F.lit(0))) + F.when(draws > 1, more).otherwise(0)


def document_draw(seed: int):
    """The j-th uniform value of a document; the first is of its seed and id alone."""
    return lambda j: uniform(F.concat_ws(":", F.lit(str(seed)), F.when(j > 0, j.cast("string"))), F.col("doc_id"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``copy`` and ``shuffle_key``, each row as often as its count says, in a global random order.

    Where ``docs`` has columns of these names, its own stay and the added ones get underscores before their names.
    """
    name_of, rate, count, copy, shuffle_key = (free_name(docs, x) for x in ("_source", "rate", "_n", "copy", "shuffle_key"))
    mixed = rates(docs, weights, temperature)
    held = mixed.limit(MOST_SOURCES + 1).collect()
    if len(held) <= MOST_SOURCES:
        known = [r for r in held if r["source"] is not None]
        null = next((r["rate"] for r in held if r["source"] is None), 0.0)
        of = F.when(F.col("source").isNull(), F.lit(float(null)))
        if known:
            of = of.otherwise(F.try_element_at(F.map_from_arrays(F.lit([r["source"] for r in known]), F.lit([float(r["rate"]) for r in known])), F.col("source")))
        with_rate = docs.withColumn(rate, of)
    else:
        salt = free_name(docs, "_salt")
        salted = mixed.select(F.col("source").alias(name_of), F.col("rate").alias(rate), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        with_rate = docs.join(salted, F.col("source").eqNullSafe(F.col(name_of)) & (mine == F.col(salt))).drop(name_of, salt)
    n = poisson_count(document_draw(seed), F.col(rate))
    copies = with_rate.withColumn(count, n).filter(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))).drop(rate, count)
    keyed = copies.withColumn(shuffle_key, uniform(F.lit(seed), F.col("doc_id"), F.col(copy)))
    # Rows of one id, or of none, have one shuffle key; their texts part them.
    parting = [F.xxhash64("text")] if "text" in docs.columns else []
    return keyed.repartition(F.col(shuffle_key), *parting).sortWithinPartitions(shuffle_key)


def replication_oracle(temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """The same rows in DuckDB's SQL (default weights)."""
    u = lambda *p: f"(('0x' || substr(md5(concat_ws(':', {', '.join(p)})), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}"
    doc = "coalesce(doc_id::VARCHAR, '')"
    return f"""
    WITH RECURSIVE s AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
    r AS (SELECT source, pow(n, {temperature}) / (SELECT sum(pow(n, {temperature})) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
    m AS (SELECT source, greatest(1, ceil(rate / {MOST_RATE}))::INT AS draws, rate / greatest(1, ceil(rate / {MOST_RATE})) AS mean FROM r),
    d AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM m UNION ALL
          SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM d WHERE k < (mean + 10 * sqrt(mean) + 20)::INT),
    j AS (SELECT source, draws, unnest(range(draws)) AS j FROM m),
    v AS (SELECT documents.*, row_number() OVER () AS line FROM documents),
    u AS (SELECT v.*, j.j, {u("CASE WHEN j.j > 0 THEN " + repr(f"{seed}:") + " || j.j ELSE " + repr(str(seed)) + " END", doc)} AS u FROM v JOIN j ON j.source IS NOT DISTINCT FROM v.source),
    n AS (SELECT u.line, u.doc_id, u.text, u.lang, u.source, u.n_chars, sum((SELECT min(k) FROM d WHERE d.source IS NOT DISTINCT FROM u.source AND d.c > u.u))::INT AS n
          FROM u GROUP BY ALL),
    e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM n)
    SELECT doc_id, text, lang, source, n_chars, copy, {u(repr(str(seed)), doc, "copy::VARCHAR")} AS shuffle_key FROM e
    """
