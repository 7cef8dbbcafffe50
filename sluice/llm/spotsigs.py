"""Document fingerprints by SpotSigs. Native: only DataFrame functions.

A spot signature is a common word (an anchor) with the next CHAIN words that are not anchors, however far they are. A
document's fingerprint is the set of its signatures as 64-bit hashes, written as sorted hexadecimal digits, sixteen for
each; the likeness of two fingerprints is the Jaccard similarity of their sets. `alike_earlier` finds the documents that
resemble an earlier one, `near_documents` all similar pairs: sets are partitioned by length, so that only partitions whose
lengths can reach the threshold meet, and compared through prefix and positional pruning, signatures ordered by counted
rarity.

Defined results: null texts are empty ones; in a text without any anchor every word is one, with the words next to it; a
text without any word has the hash of the whole text as its only signature, so equal texts have equal fingerprints and
likeness 1; the document after the last is the first, a single document follows itself; repeated rows follow one another; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import durable, few, release
from sluice.llm.setjoin import parity, rare_first, similar_pairs, with_earlier

#: Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an the and of to in is was that it for on with as at by be this from or are there said not have has had were which "
    "der die das und zu ist ein eine den von mit auf dem des im nicht sich auch es sie "
    "le la les de et un une que est dans pour du il au par sur pas "
    "el los las y en del por con para se su lo como"
).split()
CHAIN = 2
#: Nearly all signatures are rare: a small table of counts tells the others.
RARITY_BITS = 18
#: Rows in a bucket of neighbouring ids, as long as MOST_BUCKETS suffice.
BUCKET_ROWS, MOST_BUCKETS = 2000, 8192


def _word_list(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted distinct signatures of a text column that is never null, as array<long>."""
    words, content, places = f"__words_{out}", f"__content_{out}", f"__places_{out}"
    df = df.withColumn(words, _word_list(F.col(text)))
    w = F.col(words)
    df = df.withColumn(content, F.filter(w, lambda x: ~x.isin(ANCHORS)))
    df = df.withColumn(places, F.filter(F.transform(w, lambda x, at: F.when(x.isin(ANCHORS), at)), lambda at: at.isNotNull()))
    # before the k-th anchor, at place p, stand p - k words that are none
    spots = F.transform(places, lambda p, k: F.xxhash64(F.get(w, p), F.slice(F.col(content), p - k + 1, F.lit(CHAIN))))
    every = F.transform(w, lambda x, at: F.xxhash64(x, F.slice(w, at + 2, F.lit(CHAIN))))
    alone = F.when(F.size(w) > 0, every).otherwise(F.array(F.xxhash64(F.col(text))))
    found = F.when(F.size(places) > 0, spots).otherwise(alone)
    return df.withColumn(out, F.sort_array(F.array_distinct(found))).drop(words, content, places)


def as_text(signature_set: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature_set, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; sets without a common range of values are not intersected."""
    apart = (F.element_at(a, -1) < F.element_at(b, 1)) | (F.element_at(b, -1) < F.element_at(a, 1))
    shared = F.size(F.array_intersect(a, b))
    return F.when(apart, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _buckets(ids: DataFrame) -> tuple[Column, list[tuple]]:
    """An expression for the bucket of neighbouring ids, and for each bucket the id that follows its last (bucket, id)."""
    parts = min(MOST_BUCKETS, max(1, ids.count() // BUCKET_ROWS))
    bucket = F.lit(0)
    if parts > 1:
        found = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 4 * parts).alias("b")).first()["b"]
        bounds = sorted(set(found or []))
        table = F.expr("array(" + ",".join(f"{b}L" for b in bounds) + ")")
        steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        # binary search for the number of bounds that the id reaches
        bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= F.col("doc_id"), at + s).otherwise(at))
    # a row for each bucket, of which there are at most MOST_BUCKETS
    firsts = sorted((r["bucket"], r["head"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("head")).collect())
    return bucket, [(b, firsts[(k + 1) % len(firsts)][1]) for k, (b, _) in enumerate(firsts)]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs and the text and sigs of the document with the next id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket, follows = _buckets(docs.select("doc_id"))
    if not follows:
        return signatures(docs, "text", "sigs").select("*", F.col("text").alias("next_text"), F.col("sigs").alias("next_sigs"))
    own = docs.withColumn("bucket", bucket).withColumn("guest", F.lit(False))
    heads = docs.sparkSession.createDataFrame([(h, b) for b, h in follows], "head long, guest_bucket int")
    # guests: each bucket also gets the document that follows its last; at most MOST_BUCKETS rows
    guests = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("guest_bucket").alias("bucket"), F.lit(True).alias("guest"))
    # only texts are dealt out; their signatures are made where they arrive
    both = signatures(own.union(guests).repartition("bucket"), "text", "sigs")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first())
    ahead = F.lead(F.struct("text", "sigs")).over(order)
    return both.withColumn("ahead", ahead).where(~F.col("guest")).select("doc_id", "text", "sigs", F.col("ahead.text").alias("next_text"), F.col("ahead.sigs").alias("next_sigs"))


def _twin_hashes(sets: Column) -> list[Column]:
    """128 bits that stand for a set."""
    return [F.xxhash64(sets).alias("h1"), F.xxhash64(F.lit(1), sets).alias("h2")]


def alike_earlier(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """h1, h2, class_id, near_earlier of the signature sets that several documents have or that resemble an earlier one.

    class_id: the least doc_id with the set. near_earlier: another set whose class_id is less has a likeness of at least
    the threshold with it, found by an exact join: sets partitioned by length, prefixes of rare signatures, positional
    and bitmap filters, Jaccard of what is left. Sets of documents without an id take no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = signatures(texts.where(F.col("doc_id").isNotNull()), "text", "keys")
    classes = found.groupBy("keys").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("docs"))
    classes = durable(classes.select("*", *_twin_hashes(F.col("keys"))), "classes", "zstd")
    # numbers that rise with class_id; an id that comes with several texts may stand for several sets
    dealt = classes.repartitionByRange("class_id", "h1").sortWithinPartitions("class_id", "h1")
    numbered = durable(dealt.select(F.monotonically_increasing_id().alias("id"), F.size("keys").alias("n"), "keys", parity(F.col("keys")).alias("bits"), "class_id", "docs", "h1", "h2"), "numbered", "zstd")
    release(classes)
    sets = durable(rare_first(numbered.select("id", "n", "keys", "bits"), RARITY_BITS), "rare-first", "zstd")
    later = durable(with_earlier(sets, threshold, by_length=True), "later")
    marked = numbered.join(few(later.withColumn("near", F.lit(True))), "id", "left").where("docs > 1 or near")
    out = durable(marked.select("h1", "h2", "class_id", F.coalesce("near", F.lit(False)).alias("near_earlier")), "alike")
    release(sets)
    release(numbered)
    return out


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the query's contract), and their likenesses; class_id and
    near_earlier of alike_earlier, where a set that is not listed there is its document's alone."""
    alike = alike_earlier(docs)
    both = with_next(docs)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    out = signatures(both.withColumn("edited", edited), "edited", "edited_sigs")
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        *_twin_hashes(F.col("sigs")),
    ).join(few(alike), ["h1", "h2"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("near_earlier", F.lit(False)).alias("near_earlier"),
    )


def near_documents(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All links between similar documents, as two tables.

    members (doc_id, class_id, representative): a row for each row of docs; documents with equal signature sets share a
    class, whose representative is its least id (null where no row of the class has one). pairs (a, b): the class_ids of
    classes with similar sets, each once. Two rows are linked if they share a class or their classes are a pair. Class
    numbers hold within one call only.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = durable(signatures(texts, "text", "keys").select("doc_id", "keys"), "signatures")
    classes = found.groupBy("keys").agg(F.min("doc_id").alias("representative"))
    # the numbers are written, so that all that follows sees the same ones
    classes = durable(classes.select(F.monotonically_increasing_id().alias("id"), "representative", F.size("keys").alias("n"), "keys", parity(F.col("keys")).alias("bits")), "classes")
    # read from files on both sides, so that Spark can split the rows of a text with very many copies
    members = found.join(classes, "keys").select("doc_id", F.col("id").alias("class_id"), "representative")
    sets = durable(rare_first(classes.select("id", "n", "keys", "bits"), RARITY_BITS), "rare-first")
    return members, similar_pairs(sets, threshold)


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b), a < b: the pairs of near_documents by their representatives, where both have one; no members."""
    members, pairs = near_documents(docs, threshold)
    ids = durable(members.where(F.col("representative").isNotNull()).select("class_id", "representative").distinct(), "representatives")
    a = ids.select(F.col("class_id").alias("a"), F.col("representative").alias("x"))
    b = ids.select(F.col("class_id").alias("b"), F.col("representative").alias("y"))
    return pairs.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
