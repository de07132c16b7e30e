"""A broadcast of bounded size that thins rows out before an exact join: one bit for each slot of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a key from which on it is joined in SALTS parts.
COMMON, SALTS = 1000, 32
#: Slots; the broadcast has at most SLOTS / 64 rows of two longs, whatever the input.
SLOTS = 1 << 22


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(SLOTS).cast("long"))


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): which slots the keys (longs, hashes) fall into."""
    slots = keys.select(_slot(F.col(key)).alias("slot"))
    return slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))


def sift(rows: DataFrame, key: str, through: DataFrame) -> DataFrame:
    """Rows whose key may be among the sieve's keys: all that are, and of the others a share that grows with the number of keys."""
    asked = rows.withColumn("slot", _slot(F.col(key)))
    held = asked.join(F.broadcast(through), F.expr("slot div 64") == F.col("word"))
    return held.where(F.expr("shiftright(bits, cast(slot % 64 as int)) & 1 = 1")).select(*rows.columns)


def marked(rows: DataFrame, key: str, through: DataFrame, flag: str) -> DataFrame:
    """All rows, and whether their key may be among the sieve's keys: the same answer for the same key wherever it is asked."""
    asked = rows.withColumn("slot", _slot(F.col(key)))
    held = asked.join(F.broadcast(through), F.expr("slot div 64") == F.col("word"), "left")
    return held.withColumn(flag, F.coalesce(F.expr("shiftright(bits, cast(slot % 64 as int)) & 1 = 1"), F.lit(False))).select(*rows.columns, flag)


def join_common(rows: DataFrame, few: DataFrame, key: str, common: DataFrame) -> DataFrame:
    """Inner join of ``rows`` (key, h, ...; h is a hash of the key) with ``few`` (key, ...) that deals the rows of very common keys to SALTS tasks.

    ``common`` (h): the hashes of such keys. Both sides ask one sieve of them, so a key that only seems common is joined in parts too, and whole.
    ``few`` should have a row or a few for each key: those of common keys are repeated SALTS times.
    """
    through = sieve(common, "h")
    parts = F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = marked(few.withColumn("few_h", F.xxhash64(key)), "few_h", through, "common").withColumn("salt", F.explode(parts)).drop("common", "few_h")
    own = F.when(F.col("common"), F.pmod(F.xxhash64(*[c for c in rows.columns if c not in (key, "h")]), F.lit(SALTS)).cast("int")).otherwise(0)
    left = marked(rows, "h", through, "common").withColumn("salt", own).drop("common")
    return left.join(right, [key, "salt"]).drop("salt")
