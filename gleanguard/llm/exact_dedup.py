"""Exact duplicates by two passes over a Bloom filter, with DataFrame functions alone.

Pass 1 reads all rows' hashes and finds the filter's bits that more than one row sets: one number for each row is
shuffled, no hash and no text. These bits make a blocked Bloom filter, a bitmap for each block. Pass 2 tests each row:
one whose bit is not set has a hash that no other row has and passes straight through. Only the others are grouped by
their hash, and there the full hash decides, so a false alarm costs a shuffled row and never a wrong result.

The filter has BITS_PER_ROW bits for each row, so about one row in BITS_PER_ROW is a false alarm. It is cut into
slices of SLICE_BYTES, each broadcast by itself; a scan of the hashes meets up to SLICES_A_SCAN of them and takes
only the rows of these slices, so memory is bounded and no row moves to meet the filter at any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanguard.llm.common import documents, fresh, settled

BITS_PER_ROW = 32
#: Fixed: the bits of a bitmap that bitmap_construct_agg makes.
BLOCK_BITS = 32768
#: Bytes of the filter that are one broadcast, and broadcasts of one scan: the bound of what an executor holds.
SLICE_BYTES, SLICES_A_SCAN = 16 << 20, 8


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def blocks_for(rows: int) -> int:
    return max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))


def slices_for(blocks: int) -> int:
    return max(1, -(-blocks * BLOCK_BITS // 8 // SLICE_BYTES))


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks * BLOCK_BITS).cast("long"))


def filter_of(keys: DataFrame, column: str, blocks: int, least: int) -> DataFrame:
    """(slice, block, bitmap): the bits that `least` rows of keys set, or more."""
    counted = keys.select(_place(F.col(column), blocks).alias("place")).groupBy("place").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    bits = F.bitmap_construct_agg(F.expr(f"place % {BLOCK_BITS}")).alias("bitmap")
    found = counted.groupBy(F.expr(f"place div {BLOCK_BITS}").alias("block")).agg(bits)
    return settled(found.select((F.col("block") % slices_for(blocks)).alias("slice"), "block", "bitmap"), "filter")


def with_alarm(rows: DataFrame, column: str, filters: DataFrame, blocks: int, alarm: str) -> DataFrame:
    """The rows and a column `alarm`: whether the filter has the bit of their key. Each row comes from one scan."""
    slices = slices_for(blocks)
    at, bits = fresh(rows, "_at", "_bits")
    placed = rows.withColumn(at, _place(F.col(column), blocks))
    block = F.expr(f"`{at}` div {BLOCK_BITS}")
    set_bit = F.expr(f"(cast(conv(hex(substring(`{bits}`, cast((`{at}` % {BLOCK_BITS}) div 8 as int) + 1, 1)), 16, 10) as int) >> cast(`{at}` % 8 as int)) & 1") == 1
    parts = []
    for first in range(0, slices, SLICES_A_SCAN):
        own = range(first, min(first + SLICES_A_SCAN, slices))
        part = placed if slices <= SLICES_A_SCAN else placed.where((block % slices).isin(list(own)))
        names = fresh(placed, *(f"{kind}{s}" for s in own for kind in ("_block", "_bitmap")))
        for s, own_block, own_bits in zip(own, names[::2], names[1::2], strict=True):
            one = filters.where(F.col("slice") == s).select(F.col("block").alias(own_block), F.col("bitmap").alias(own_bits))
            part = part.join(F.broadcast(one), block == F.col(own_block), "left")
        found = part.withColumn(bits, F.coalesce(*(F.col(n) for n in names[1::2])))
        parts.append(found.select(*rows.columns, F.coalesce(set_bit, F.lit(False)).alias(alarm)))
    return reduce(DataFrame.unionByName, parts)


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of (doc_id, text).

    Texts are equal when they are after each run of ASCII white space became one space; null counts as empty.
    The row with the smallest doc_id stays, null ids last; of rows that repeat this id, one stays. Long texts are
    hashed whole; an empty table gives no rows. Other columns are not read, so they may have any names.
    """
    rows = settled(df.select("doc_id", F.sha2(normalised(), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "hashes")
    blocks = blocks_for(rows.count())
    marked = with_alarm(rows, "text_sha256", filter_of(rows, "text_sha256", blocks, 2), blocks, "alarm")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    groups = settled(marked.where("alarm").groupBy("text_sha256").agg(F.min(order).alias("keep"), F.count("*").alias("group_size")), "groups")
    met = marked.where("alarm").join(groups, "text_sha256")
    grouped = met.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")
    alone = marked.where("not alarm").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """The rows of df, all columns under any names, that stay; equality and choice as in duplicate_groups.

    What goes is found among hashes and ids. A second filter, of the texts that rows go of, is broadcast to the scan of
    whole rows: rows without alarm pass as they are, the others meet the list of what goes. (Where rows go by tens of
    millions and this filter has more slices than a scan meets, all rows meet the list in a join, as whole rows are
    read only once.) Rows that repeat both id and text are reduced to one. An empty table stays empty.
    """
    key, alarm, gone_id, gone_key = fresh(df, "_text_sha256", "_alarm", "_gone_id", "_gone_sha256")
    keyed = df.withColumn(key, F.sha2(normalised(), 256))
    rows = settled(keyed.select("doc_id", F.col(key).alias("sha")), "hashes")
    blocks = blocks_for(rows.count())
    alarmed = with_alarm(rows, "sha", filter_of(rows, "sha", blocks, 2), blocks, "alarm").where("alarm").groupBy("doc_id", "sha").agg(F.count("*").alias("rows"))
    alarmed = settled(alarmed, "alarmed")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    groups = alarmed.groupBy("sha").agg(F.min(order).alias("keep"), F.sum("rows").alias("n")).where("n > 1")
    met = alarmed.join(settled(groups, "groups"), "sha").withColumn("stay", F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))).where("NOT stay OR rows > 1")
    gone = settled(met.select(F.col("doc_id").alias(gone_id), F.col("sha").alias(gone_key), "stay"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    blocks = blocks_for(gone.count())
    if slices_for(blocks) <= SLICES_A_SCAN:
        marked = with_alarm(keyed, key, filter_of(gone, gone_key, blocks, 1), blocks, alarm)
    else:
        marked = keyed.withColumn(alarm, F.lit(True))
    suspects = marked.where(F.col(alarm))
    whole = marked.where(~F.col(alarm)).select(df.columns).unionByName(suspects.join(gone.select(gone_id, gone_key), same, "left_anti").select(df.columns))
    twice = gone.where("stay").select(gone_id, gone_key)
    if twice.isEmpty():
        return whole
    return whole.unionByName(suspects.join(twice, same, "left_semi").dropDuplicates(["doc_id", key]).select(df.columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


OP7_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
