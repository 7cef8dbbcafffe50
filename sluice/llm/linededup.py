"""Line deduplication across a corpus by an exact set-similarity join. Native: only DataFrame functions.

A line is the set of its lower-cased words (between blanks and tabs). A line goes if an earlier one (smaller doc_id,
then smaller line number) has a Jaccard similarity of at least `threshold` with it; the earlier one need not have stayed
itself. Words are ordered by rarity, known from counts over all different lines (see `setjoin.rare_first`), then by hash;
any order gives the same result, a rare-first one gives fewer candidates. Words are compared by 64-bit hashes.

Lines with the same set of words are joined by a group-by before all else, so however often a line is repeated, one row
stands for it. Defined results: null texts stay null with no lines; lines without a word stay; repeated rows and null
ids are ordered by id (null first) and a hash of the text, so copies of a row lose their lines to the first; an empty
table gives an empty table; further columns stay, but for an n_lines or n_removed, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import durable, few, release
from sluice.llm.setjoin import beginning, parity, rare_first, with_earlier

THRESHOLD = 0.8
#: Bits that hold the line numbers of any text.
LINE_BITS = 31


def _plain(text: Column) -> Column:
    """The text with other blanks as spaces."""
    plain, met = text, F.lit(False)
    for odd in "\t\r\x0b\x0c":
        plain = F.replace(plain, F.lit(odd), F.lit(" "))
        met = met | F.contains(text, F.lit(odd))
    # a search for a byte costs a fraction of a replacement that finds nothing
    return F.when(met, plain).otherwise(text)


def word_keys(line: Column) -> Column:
    """The distinct words of a line as sorted 64-bit hashes."""
    keys = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    # two blanks side by side have an empty word between them
    return F.sort_array(F.array_remove(keys, F.xxhash64(F.lit(""))))


def numbered(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, Column, int]:
    """docs, a number for each row that rises with its id, and how many bits a line number needs."""
    key = F.col(id_column).cast("long")
    s = docs.select(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("d"), F.min("k").alias("low"), F.max("k").alias("high")).first()
    unique, high = s["n"] == s["d"] and (s["n"] == 0 or s["low"] >= 0), s["high"] or 0
    if unique and high < 1 << (63 - LINE_BITS):
        return docs, key, LINE_BITS
    longest = docs.agg(F.max(F.octet_length(text_column))).first()[0] or 0
    bits = max(1, math.ceil(math.log2(longest + 2)))
    if unique and high < 1 << (63 - bits):
        return docs, key, bits
    # repeated, missing, negative or very large ids: number the rows in order
    mark = "__row"
    spread = docs.repartitionByRange(key.asc_nulls_first(), F.xxhash64(text_column)).sortWithinPartitions(key.asc_nulls_first(), F.xxhash64(text_column))
    kept = durable(spread.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    most = kept.agg(F.max(F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)))).first()[0] or 0
    return kept, F.shiftrightunsigned(mark, 33) * F.lit(most + 1) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)), bits


def keyed_lines(docs: DataFrame, number: Column, bits: int, text_column: str = "text") -> DataFrame:
    """id, keys, same: every line with a word; id is the row's number and the line's, same a hash of all words."""
    # a column of its own, as a generator works out what it repeats each time
    lower = docs.select(number.alias("row"), F.lower(F.col(text_column)).alias("lower"))
    lines = lower.select("row", _plain(F.col("lower")).alias("plain")).select("row", F.posexplode(F.split("plain", "\n")).alias("line", "words"))
    keyed = lines.where(F.trim("words") != "").select((F.shiftleft(F.col("row"), bits) + F.col("line")).alias("id"), word_keys(F.col("words")).alias("keys"))
    return keyed.select("id", "keys", F.xxhash64("keys").alias("same"))


def first_lines(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, n, keys, bits of the first line of each set of words, and a durable table (id) of the others."""
    first = keyed.groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("same", "first")
    # the words are shuffled only where very many are repeated
    first = few(durable(first, "repeated"))
    again = durable(keyed.select("same", "id").join(first, "same").where(F.col("id") != F.col("first")).select("id"), "copies")
    once = keyed.join(first, "same", "left").where(F.coalesce("first", "id") == F.col("id"))
    return once.select("id", F.size("keys").alias("n"), "keys", parity(F.col("keys")).alias("bits")), again


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the lines removed from the text, and columns n_lines and n_removed."""
    names = docs.columns
    docs, number, bits = numbered(docs, id_column, text_column)
    found = durable(keyed_lines(docs, number, bits, text_column), "lines", "zstd")
    once, again = first_lines(found)
    # the words are written once; of their order by rarity only what prefixes and beginnings need
    sets = durable(rare_first(once).withColumn("keys", beginning(threshold)), "rare-first", "zstd")
    later = with_earlier(sets, threshold, whole=found.select("id", "keys"))
    gone = again.union(later.select("id")).select(F.shiftrightunsigned("id", bits).alias("__number"), F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("line"))
    by_row = durable(gone.groupBy("__number").agg(F.collect_set("line").alias("__gone")), "gone")
    release(sets)
    release(found)
    joined = docs.withColumn("__number", number).join(few(by_row), "__number", "left")
    lines = F.split(F.col(text_column), "\n")
    out = joined.withColumn("__lines", lines)
    stay = F.array_join(F.filter("__lines", lambda line, i: ~F.array_contains("__gone", i)), "\n")
    return out.select(
        *[F.when(F.col("__gone").isNull(), F.col(c)).otherwise(stay).alias(c) if c == text_column else F.col(c) for c in names if c not in ("n_lines", "n_removed")],
        F.when(F.col(text_column).isNull(), 0).otherwise(F.size("__lines")).alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).alias("n_removed"),
    )
