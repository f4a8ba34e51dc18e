"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame operations. One scan counts rows by (length, prefix hash); groups of one are settled there. A second scan
computes the full hash of rows in larger groups only, and ends in a narrow table; what follows never touches a text again.
Which rows are in larger groups is looked up in a broadcast table: of the groups themselves while they are few, else in a filter of
bits of bounded size that knows all of them (it may take a row of a group of one for one of a larger group, which costs a hash and
changes no result, as rows are joined to the groups exactly behind the scan).

Cases: a null text is an empty one. Texts are equal when they are identical after deleting [\\x20\\x09-\\x0D]. Of equal
texts the row with the most code points in the original stays, then the one with the smallest id (null ids last). Rows that
repeat id and text alike all carry kept = true; exact_dedup_filter leaves one of them. Other columns are not looked at, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, text_of, without_blanks

#: Bytes of the normalised text that the second level hashes.
PREFIX = 64
#: Candidate (length, prefix) groups are broadcast up to this many (24 bytes each); beyond it a filter of this many words of 64 bits is.
BROADCAST_GROUPS, FILTER_WORDS = 500_000, 1 << 20


def _filter_of(groups: DataFrame, words: int) -> DataFrame:
    """(word, bits): three bits for each group, in one word of 64."""
    word, bits = _bits(F.col("norm_length"), F.col("prefix_hash"), words)
    return groups.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _bits(length: Column, prefix: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(length, prefix)
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(h, F.lit(words)).cast("int"), one(40).bitwiseOR(one(47)).bitwiseOR(one(54))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False, broadcast_groups: int = BROADCAST_GROUPS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, level ('prefix' or 'full': where it was settled), norm_length,
    prefix_hash and text_sha256 (of every row if with_digest, else only of those that reached the last level)."""
    # the key columns come last, after all that is needed of the input is named, so clashing names can't interfere
    base = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text_of(F.col(text_col))).cast("long").alias("n"), without_blanks(F.col(text_col)).alias("norm"))
    keyed = base.select("doc_id", "n", "norm", F.octet_length("norm").alias("norm_length"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix_hash"))

    shared = cut(keyed.groupBy("norm_length", "prefix_hash").agg(F.count("*").alias("rows")).where("rows > 1").select("norm_length", "prefix_hash", F.lit(True).alias("open")), "dedup-prefix")
    full = F.sha2(F.col("norm"), 256)
    digest = lambda open_: full if with_digest else F.when(open_, full)
    if shared.limit(broadcast_groups + 1).count() <= broadcast_groups:
        marked = keyed.join(F.broadcast(shared), ["norm_length", "prefix_hash"], "left")
        rows = marked.select("doc_id", "n", "norm_length", "prefix_hash", F.coalesce("open", F.lit(False)).alias("open"), digest(F.col("open")).alias("sha"))
    else:  # texts don't pass through a shuffle
        word, bits = _bits(F.col("norm_length"), F.col("prefix_hash"), filter_words)
        marked = keyed.withColumns({"word": word, "own": bits}).join(F.broadcast(_filter_of(shared, filter_words)), "word", "left")
        hashed = cut(marked.select("doc_id", "n", "norm_length", "prefix_hash", digest(F.col("bits").bitwiseAND(F.col("own")) == F.col("own")).alias("sha")), "dedup-hashed")
        rows = hashed.join(shared, ["norm_length", "prefix_hash"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        if not with_digest:
            rows = rows.withColumn("sha", F.when(F.col("open"), F.col("sha")))
    rows = cut(rows.select("doc_id", "n", "norm_length", "prefix_hash", "open", "sha"), "dedup-rows")

    key = ["norm_length", "prefix_hash", "sha"]
    first = F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"))
    # as a table of its own, both sides of the join are plain exchanges, and the adaptive planner can split a large group of copies
    groups = cut(rows.where("open").groupBy(*key).agg(F.count("*").alias("rows"), F.min(first)["doc_id"].alias("keep")).where("rows > 1"), "dedup-groups")
    joined = rows.alias("r").join(groups.alias("g"), key, "left")
    size = F.coalesce("rows", F.lit(1).cast("long"))
    keep = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), F.when(F.col("open"), "full").otherwise("prefix").alias("level"), "norm_length", "prefix_hash")


def exact_dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The rows of docs that stay, with the columns of docs; one of the rows that repeat id and text alike."""
    found = cut(exact_dedup(docs, id_col, text_col, broadcast_groups=broadcast_groups).where("group_size > 1").select("doc_id", "kept", "norm_length", "prefix_hash", "text_sha256"), "dedup-found")
    norm = without_blanks(F.col(text_col))
    full = F.sha2(norm, 256)
    fits = lambda d: d.limit(broadcast_groups + 1).count() <= broadcast_groups
    own_len, own_pre, own_sha, g_id, g_len, g_pre, g_sha, hint = free_names(docs, "norm_length", "prefix_hash", "sha", "g_id", "g_length", "g_prefix", "g_sha", "hint")
    as_gone = lambda d: d.select(F.col("doc_id").alias(g_id), F.col("text_sha256").alias(g_sha))
    gone = as_gone(found.where("not kept").distinct()).distinct()
    again = as_gone(found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows")).where("rows > 1"))
    hints = found.select(F.col("doc_id").alias(g_id), F.col("norm_length").alias(g_len), F.col("prefix_hash").alias(g_pre), F.lit(True).alias(hint)).distinct()
    if fits(hints):  # ids may be null or repeated: only the full hash tells the text, and few rows need it
        keyed = docs.select("*", F.octet_length(norm).alias(own_len), F.xxhash64(F.substring(norm, 1, PREFIX)).alias(own_pre))
        keyed = keyed.join(F.broadcast(hints), docs[id_col].eqNullSafe(hints[g_id]) & (keyed[own_len] == hints[g_len]) & (keyed[own_pre] == hints[g_pre]), "left")
        keyed = keyed.withColumn(own_sha, F.when(F.col(hint), full)).drop(own_len, own_pre, g_id, g_len, g_pre, hint)
    else:
        keyed = docs.withColumn(own_sha, full)
    small = lambda d: F.broadcast(d) if fits(d) else d
    same = lambda x, d: x[id_col].eqNullSafe(d[g_id]) & (x[own_sha] == d[g_sha])
    stay = keyed.join(small(gone), same(keyed, gone), "left_anti")
    if not again.isEmpty():
        again = small(again)
        one = stay.join(again, same(stay, again), "left_semi").dropDuplicates([id_col, own_sha])
        stay = stay.join(again, same(stay, again), "left_anti").unionByName(one)
    return stay.drop(own_sha)
