"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are compared after every run of white space became one space.  Three
passes read the text column and none of them shuffles it:

1. lengths that occur more than once;
2. for rows of those lengths only, (length, hash of the first ``prefix`` characters) classes that
   occur more than once;
3. for rows of those classes only, SHA-256 of the whole text, on which the groups form.

What a pass learns reaches the next as a bitmap of fixed size (``bits`` bits, 2 MB by default,
broadcast): a set bit may be a false positive, which only costs a hash, never a result.  Groups are
pre-aggregated before the shuffle, and a group of any size is joined back with a join that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import SPACE, col, text_of

PREFIX = 256
BITS = 1 << 24


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """One row per 32,768 bits with the hashed ``k`` values of ``keys`` set."""
    at = F.pmod(col("k"), F.lit(bits)) + 1
    return (keys.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_pos"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_pos").alias("_bitmap")))


def _flagged(rows: DataFrame, key: Column, keys: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with boolean ``name``: whether the bit of ``key`` is set for ``keys``."""
    at = F.pmod(key, F.lit(bits)) + 1
    pos = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    probe = rows.withColumn("_bucket", F.bitmap_bucket_number(at))
    # at most bits / 32,768 rows of 4 KB: a proven bound
    return (probe.join(F.broadcast(_bitmap(keys, bits)), "_bucket", "left")
            .withColumn(name, F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False)))
            .drop("_bucket", "_bitmap"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False,
                prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep_id`` is the smallest id of the rows with an equal text.  ``text_sha256`` is null for texts
    without an equal unless ``digest`` asks for every row's.

    Null texts count as empty and equal each other.  Rows that repeat the smallest id of their group
    all count as kept (they are one row, repeated); null ids come last, and a group of null ids only
    keeps all of them.  An empty table gives an empty result.  Other columns are not read.
    """
    base = docs.select(col(id_col).alias("_id"), normalised(text_of(text_col)).alias("_norm"))
    sized = base.withColumn("_n", F.octet_length("_norm"))
    lengths = sized.groupBy("_n").count().where("count > 1").select(F.xxhash64("_n").alias("k"))
    by_length = _flagged(sized, F.xxhash64("_n"), lengths, bits, "_same_length")
    headed = by_length.withColumn("_head", F.when(
        F.col("_same_length"), F.xxhash64("_n", F.substring("_norm", 1, prefix))))
    heads = (headed.where("_same_length").groupBy("_n", "_head").count().where("count > 1")
             .select(F.col("_head").alias("k")))
    probed = _flagged(headed, F.coalesce(F.col("_head"), F.lit(0).cast("long")), heads, bits, "_same_head")
    full = F.sha2(F.col("_norm").cast("binary"), 256)
    open_ = F.col("_same_length") & F.col("_same_head")
    rows = probed.select("_id", "_n", "_head", open_.alias("_open"),
                         (full if digest else F.when(open_, full)).alias("text_sha256"))
    groups = (rows.where("_open").groupBy("_n", "_head", "text_sha256")
              .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
              .where("_size > 1").select(F.col("text_sha256").alias("_full"), "_keep", "_size"))
    # grouped by three columns but joined on one, so both sides are dealt out anew and a hot group can be split
    joined = rows.join(groups, rows["text_sha256"] == groups["_full"], "left")
    keep = F.when(F.col("_full").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(F.col("_id").alias(id_col), keep.alias("keep_id"),
                         F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
