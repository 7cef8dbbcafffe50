"""Exact set-similarity joins by prefix, length, positional and bitmap filters. Native: only DataFrame functions.

Sets are rows (id, n, keys, bits): keys holds the n distinct elements as 64-bit hashes in rising order, rare ones
first (see `rare_first`); bits is the parity bitmap of parity(). Two sets whose Jaccard similarity is at least t
share an element within their first n - ceil(t n) + 1; their first shared element at places i and j leaves an overlap of
at most 1 + min(n_a - i, n_b - j) from there; and they differ in at most (n_a + n_b) (1 - t) / (1 + t) elements, each of
which changes one bit of the bitmap, so bitmaps that differ in more bits rule a pair out. What passes is verified on the
whole sets. `similar_pairs` also partitions sets by length.

`with_earlier` asks only whether a smaller id is similar. Rounds come first that compare each set with the leader (least
id) of each element of its prefix (or of some, see _leads(), where only beginnings are held), which settles the members of groups of near copies in linear work, and those that found
no similar leader with the leaders among themselves; then all that are still open are compared with all that share an
element of their prefix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import durable, few, release

_EPS = 1e-9
#: Elements are counted in 2^RARITY_BITS buckets by the high bits of their hash, if not said otherwise: a table of fixed
#: size, 4 MB.
RARITY_BITS = 22
#: The rounds of leaders go on while one settles this share of its sets.
WORTH = 0.1
#: The beginning of a set that is compared before all of it, as a multiple of the share of elements that may differ.
HEAD = 2.5
#: See _leads().
LED_FIRST, LED = 2, 4
#: Level of rarity, three for each doubling, up to which an element has one leader: about 2^14 sets.
COMMON = 42
_LOW = (1 << 56) - 1
_NEVER = -(1 << 63)


def parity(keys: Column) -> Column:
    """Bit k is set where an odd number of elements has k as its lowest six bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int"))))


def prefix_length(n: Column, t: float) -> Column:
    return (n - F.ceil(n * F.lit(t) - F.lit(_EPS)) + 1).cast("int")


def prefixes(sets: DataFrame, t: float) -> DataFrame:
    """The sets' columns but keys, at, key: a row for each element of each set's prefix; at counts from 0."""
    return sets.select(*[c for c in sets.columns if c != "keys"], F.posexplode(F.slice("keys", F.lit(1), prefix_length(F.col("n"), t))).alias("at", "key"))


_AT = (1 << 32) - 1


def _packed(n: Column, at: Column) -> Column:
    return F.shiftleft(n.cast("long"), 32).bitwiseOR(at.cast("long"))


def _unpacked(place: Column) -> tuple[Column, Column]:
    return F.shiftright(place, 32), place.bitwiseAND(F.lit(_AT))


def may_match(na: Column, ia: Column, ba: Column, nb: Column, ib: Column, bb: Column, t: float) -> Column:
    """Bitmap, length and positional filter for two sets' prefix elements at places ia and ib."""
    total = na + nb
    apart = F.bit_count(ba.bitwiseXOR(bb)) <= total * F.lit((1 - t) / (1 + t)) + F.lit(_EPS)
    lengths = (na >= nb * F.lit(t) - F.lit(_EPS)) & (nb >= na * F.lit(t) - F.lit(_EPS))
    return apart & lengths & (F.least(na - ia, nb - ib) >= total * F.lit(t / (1 + t)) - F.lit(_EPS))


def beginning(t: float) -> Column:
    """The rare elements of a set that its prefix and the comparison of beginnings read."""
    return F.slice("keys", F.lit(1), F.greatest(prefix_length(F.col("n"), t), _head_length(t)))


def _head_length(t: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(HEAD * (1 - t) / (1 + t))).cast("int"))


def _heads_near(pairs: DataFrame, met: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) that the beginnings of their sets do not rule out: up to the lesser of their last elements they must
    not differ in more elements than whole sets may."""
    apart = (1 - t) / (1 + t)
    head = F.slice("keys", F.lit(1), _head_length(t))
    b = met.select(F.col("id").alias("b"), F.col("n").alias("n_b"), head.alias("head_b"))
    a = met.select(F.col("id").alias("a"), F.col("n").alias("n_a"), head.alias("head_a"))
    both = b.join(few(pairs), "b").join(a, "a")
    last = F.least(F.element_at("head_a", -1), F.element_at("head_b", -1))
    seen = F.size(F.filter("head_a", lambda k: k <= last)) + F.size(F.filter("head_b", lambda k: k <= last))
    differ = seen - 2 * F.size(F.array_intersect("head_a", "head_b"))
    return durable(both.where(differ <= (F.col("n_a") + F.col("n_b")) * F.lit(apart) + F.lit(_EPS)).select("a", "b"), "heads")


def verified(candidates: DataFrame, sets: DataFrame, t: float, later: bool = False, whole: DataFrame | None = None) -> DataFrame:
    """A durable table of the pairs (a, b) of a durable table whose sets are similar enough; later: (id) of their b; whole:
    (id, keys) of whole sets, where `sets` has only their beginnings."""
    ids = durable(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct(), "ids")
    # only the sets that are in a pair are shuffled, first their beginnings, then what pairs these leave
    met = durable(sets.join(few(ids), "id", "left_semi").select("id", "n", "keys"), "compared")
    release(ids)
    near = _heads_near(candidates, met, t)
    firsts = durable(near.select("a").distinct(), "ids")
    if whole is not None:
        release(met)
        ids = durable(near.select(F.col("b").alias("id")).union(firsts).distinct(), "ids")
        met = durable(whole.join(few(ids), "id", "left_semi"), "compared")
        release(ids)
    a = met.select(F.col("id").alias("a"), F.col("keys").alias("keys_a")).join(few(firsts), "a", "left_semi")
    b = met.select(F.col("id").alias("b"), F.col("keys").alias("keys_b"))
    both = b.join(few(near), "b").join(a, "a")
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    union = F.size("keys_a") + F.size("keys_b") - shared
    found = both.where(shared >= union * F.lit(t) - F.lit(_EPS))
    out = durable(found.select(F.col("b").alias("id")).distinct() if later else found.select("a", "b"), "similar")
    for table in (met, near, firsts):
        release(table)
    return out


def _leads() -> Column:
    """Whether an element of a prefix is compared with its leader: the first ones, and of the others one in LED by hash, the
    same in all sets. What this leaves unsettled meets by all elements."""
    return (F.col("at") < LED_FIRST) | (F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(LED - 1)) == 0)


def _like_leaders(sets: DataFrame, t: float, whole: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(id) of the sets that are similar to the leader of one of their prefix's elements, and of those that were compared
    with a leader in vain. A very common element has several leaders, each for a part of its sets by a hash."""
    parts = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.floor((F.shiftright("key", 56) - F.lit(COMMON)) / 3)).cast("int"))
    # one column for an element and its part: what is shuffled and sorted stays narrow, and any grouping is right
    group = F.when(parts > 1, F.xxhash64("key", F.pmod(F.xxhash64("id"), parts))).otherwise(F.col("key"))
    each = prefixes(sets, t)
    rows = (each if whole is None else each.where(_leads())).select(group.alias("group"), "id", "bits", _packed(F.col("n"), F.col("at")).alias("place"))
    before = Window.partitionBy("group").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    led = rows.withColumn("l", F.first(F.struct("id", "bits", "place")).over(before))
    (n_l, at_l), (n, at) = _unpacked(F.col("l.place")), _unpacked(F.col("place"))
    fits = may_match(n_l, at_l, F.col("l.bits"), n, at, F.col("bits"), t)
    pairs = durable(led.where((F.col("id") > F.col("l.id")) & fits).select(F.col("l.id").alias("a"), F.col("id").alias("b")).distinct(), "to-leaders")
    settled = verified(pairs, sets, t, later=True, whole=whole)
    missed = durable(pairs.select(F.col("b").alias("id")).distinct().join(few(settled), "id", "left_anti"), "missed")
    release(pairs)
    return settled, missed


def _by_length(rows: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """Prefix rows as the shorter and as the longer set of a pair: a set is looked up in the partition of its own length
    by those that are no shorter, in all partitions from the least length they reach to their own."""
    part = length_part(F.col("n"), t)
    least = length_part(F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(t) - F.lit(_EPS))), t)
    names = [c for c in rows.columns if c != "key"]
    shorter = rows.select("key", part.alias("part"), *[F.col(c).alias(f"{c}_s") for c in names])
    longer = rows.select("key", F.explode(F.sequence(least, part)).alias("part"), *[F.col(c).alias(f"{c}_l") for c in names])
    return shorter, longer


def _pair_test(t: float) -> Column:
    no_shorter = (F.col("n_s") < F.col("n_l")) | ((F.col("n_s") == F.col("n_l")) & (F.col("id_s") < F.col("id_l")))
    return no_shorter & may_match(F.col("n_s"), F.col("at_s"), F.col("bits_s"), F.col("n_l"), F.col("at_l"), F.col("bits_l"), t)


def with_earlier(sets: DataFrame, t: float, by_length: bool = False, whole: DataFrame | None = None) -> DataFrame:
    """(id) of the sets that have a similar set of smaller id. sets: a durable table of distinct sets, rare elements first.

    by_length: join by element and length partition, which pays where few lengths meet; else by element alone. whole: a
    durable table (id, keys) of whole sets in any order, where `sets` holds only their beginning().
    """
    settled, missed = _like_leaders(sets, t, whole)
    while (open_ := missed.count()) > 0:
        more, missed = _like_leaders(sets.join(few(missed), "id", "left_semi"), t, whole)
        settled = durable(settled.union(more), "all-settled")
        if more.count() < WORTH * open_:
            break
    marked = sets.join(few(settled.withColumn("done", F.lit(True))), "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    rows = prefixes(marked.select("id", "n", "keys", "bits", "done"), t)
    if by_length:
        # open is the id, or less than any id where the set is settled
        shorter, longer = _by_length(rows.withColumn("open", F.when(F.col("done"), F.lit(_NEVER)).otherwise(F.col("id"))).drop("done"), t)
        later_open = F.when(F.col("id_s") < F.col("id_l"), F.col("open_l")).otherwise(F.col("open_s")) > F.lit(_NEVER)
        met = shorter.join(longer, (shorter["key"] == longer["key"]) & (shorter["part"] == longer["part"]) & later_open & _pair_test(t))
        met = met.select(F.least("id_s", "id_l").alias("id_a"), F.greatest("id_s", "id_l").alias("id_b"))
    else:
        met = _meet(rows, t)
    pairs = durable(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "to-others")
    rest = verified(pairs, sets, t, later=True, whole=whole)
    release(pairs)
    return settled.union(rest)


def _meet(rows: DataFrame, t: float) -> DataFrame:
    """Pairs id_a < id_b of prefix rows with one element, b not done. Both sides have the same columns and no condition of
    their own, so that one exchange serves both; n, at and done are one column, as all of it is shuffled and sorted."""
    place = F.shiftleft(_packed(F.col("n"), F.col("at")), 1).bitwiseOR(F.col("done").cast("long"))
    narrow = rows.select("key", "id", "bits", place.alias("place"))
    a = narrow.select("key", *[F.col(c).alias(f"{c}_a") for c in ("id", "bits", "place")])
    b = narrow.select("key", *[F.col(c).alias(f"{c}_b") for c in ("id", "bits", "place")])

    def parts(side: str) -> tuple[Column, Column, Column]:
        """n, at and open: the id, or less than any id where the set is settled."""
        place = F.col(f"place_{side}")
        settled = place.bitwiseAND(F.lit(1).cast("long")) == 1
        return *_unpacked(F.shiftright(place, 1)), F.when(settled, F.lit(_NEVER)).otherwise(F.col(f"id_{side}"))

    (na, ia, open_a), (nb, ib, open_b) = parts("a"), parts("b")
    test = may_match(na, ia, F.col("bits_a"), nb, ib, F.col("bits_b"), t)
    return a.join(b, (a["key"] == b["key"]) & (F.col("id_a") < open_b) & (open_a <= F.col("id_b")) & test)


def rarity_levels(sets: DataFrame, bits: int) -> DataFrame:
    """One row (levels array<tinyint>): for each bucket of elements a number that rises with the sets that hold one."""
    each = sets.select(F.explode("keys").alias("key"))
    counts = each.groupBy(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("bucket")).count()
    # at most 2^bits rows of 5 bytes, whatever the input
    found = counts.select("bucket", F.least(F.lit(127), F.floor(3 * F.log2(F.col("count") + 1))).cast("byte").alias("level")).toArrow()
    levels = np.zeros(1 << bits, np.int8)
    levels[found.column("bucket").to_numpy()] = found.column("level").to_numpy()
    table = pa.table({"levels": pa.ListArray.from_arrays(pa.array([0, len(levels)], pa.int32()), pa.array(levels))})
    return durable(sets.sparkSession.createDataFrame(table), "levels")


def rare_first(sets: DataFrame, bits: int = RARITY_BITS) -> DataFrame:
    """A durable table of sets with the elements ordered by rarity, which stands in their highest byte, then by the lower 56
    bits of their hash."""
    levels = rarity_levels(sets, bits).scalar()

    def ranked(k: Column) -> Column:
        level = F.get(F.col("levels"), F.shiftrightunsigned(k, 64 - bits).cast("int"))
        # never null, as longs that may be null are sorted as objects
        return F.coalesce(F.shiftleft(level.cast("long"), 56).bitwiseOR(k.bitwiseAND(F.lit(_LOW))), F.lit(0).cast("long"))

    return sets.withColumn("levels", levels).withColumn("keys", F.sort_array(F.transform("keys", ranked))).drop("levels")


def length_part(n: Column, t: float) -> Column:
    """The partition of a length; it rises with n, and lengths n and t n are at most one apart but for rounding."""
    return F.floor(F.ln(n) / F.lit(-math.log(t))).cast("int") if t < 1 else n.cast("int")


def similar_pairs(sets: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b, of all similar sets of a durable table of distinct sets, joined by element and length partition."""
    shorter, longer = _by_length(durable(prefixes(sets, t), "prefixes"), t)
    met = shorter.join(longer, (shorter["key"] == longer["key"]) & (shorter["part"] == longer["part"]) & _pair_test(t))
    return verified(durable(met.select(F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b")).distinct(), "pairs"), sets, t)
