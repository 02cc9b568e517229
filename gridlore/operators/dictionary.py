"""Dictionary encoding: palettes, ranks, bit packing and its inverse, bitmaps. Cells are rows (key, pos, atom)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: more distinct atoms than this are stored directly.
MOST_ENTRIES = 256


def bits_per_entry(size: Column) -> Column:
    return F.when(size <= 2, 1).when(size <= 4, 2).when(size <= 16, 4).when(size <= MOST_ENTRIES, 8).otherwise(16)


def palette_bits(size: Column) -> Column:
    """0 entries: direct, 16 bits."""
    return F.when(size == 0, 16).otherwise(bits_per_entry(size))


def bit_length(n: Column) -> Column:
    """ceil(log2 n) for n >= 1 in integers: bits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long"))))


def palette(cells: DataFrame, key: str, order: str = "count") -> DataFrame:
    """(key, atom, n, rk, size, bits): entries ranked by count (ties: first seen), by atom on ties, or by first sight."""
    sums = cells.groupBy(key, "atom").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    by = {"count": [F.col("n").desc(), F.col("first_pos")], "atom": [F.col("n").desc(), F.col("atom")], "seen": [F.col("first_pos")]}[order]
    rank = (F.row_number().over(Window.partitionBy(key).orderBy(*by)) - 1).cast("int")
    size = F.count("*").over(Window.partitionBy(key)).cast("int")
    out = sums.withColumn("rk", rank).withColumn("size", size)
    return out.withColumn("bits", bits_per_entry(F.col("size"))).drop("first_pos")


def pack(cells: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, word_no, bits, word): ranks packed low bits first, 64 / bits of them a word."""
    coded = cells.join(entries.select(key, "atom", "rk", "bits"), [key, "atom"])
    per = (F.lit(64) / F.col("bits")).cast("int")
    shifted = F.call_function("shiftleft", F.col("rk").cast("long"), (F.col("pos") % per) * F.col("bits"))
    return coded.select(key, "bits", F.floor(F.col("pos") / per).cast("int").alias("word_no"), shifted.alias("part")).groupBy(key, "bits", "word_no").agg(
        F.bit_or("part").alias("word")
    )


def unpack(words: DataFrame, entries: DataFrame, key: str, n_cells: int) -> DataFrame:
    """Inverse of pack: (key, pos, atom)."""
    per = (F.lit(64) / F.col("bits")).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    slots = words.withColumn("i", F.explode(F.sequence(F.lit(0), per - 1)))
    idx = F.call_function("shiftrightunsigned", F.col("word"), F.col("i") * F.col("bits")).bitwiseAND(mask).cast("int")
    coded = slots.select(key, (F.col("word_no") * per + F.col("i")).alias("pos"), idx.alias("rk")).where(F.col("pos") < n_cells)
    return coded.join(entries.select(key, "rk", "atom"), [key, "rk"]).select(key, "pos", "atom")


def packed_histogram(words: DataFrame, key: str, n_cells: int) -> DataFrame:
    """(key, rk, n) from words alone."""
    per = (F.lit(64) / F.col("bits")).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    slots = words.withColumn("i", F.explode(F.sequence(F.lit(0), per - 1))).where(F.col("word_no") * per + F.col("i") < n_cells)
    idx = F.call_function("shiftrightunsigned", F.col("word"), F.col("i") * F.col("bits")).bitwiseAND(mask).cast("int")
    return slots.groupBy(key, idx.alias("rk")).agg(F.count("*").alias("n"))


def global_palette(cells: DataFrame) -> DataFrame:
    """(atom, id): distinct atoms ascending, numbered. Atoms are 16-bit, so this is at most 65 536 rows."""
    return cells.select("atom").distinct().withColumn("id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("atom")) - 1).cast("int"))


def rank_atoms(cells: DataFrame) -> DataFrame:
    """(atom, n, rank) by count descending, atom ascending; at most 65 536 rows are ordered."""
    return rank_sums(cells.groupBy("atom").agg(F.count("*").alias("n")))


def rank_sums(sums: DataFrame) -> DataFrame:
    """(atom, n) with rank; atoms are 16-bit."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "atom")
    return sums.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def substitute(cells: DataFrame, table: DataFrame) -> DataFrame:
    """cells with the atom that table (atom, value) gives for theirs; others stay. Atoms are 16-bit, so the table is broadcast."""
    values = F.broadcast(table.select(F.col("atom").alias("_from"), F.col("value").alias("_to")))
    return cells.join(values, F.col("atom") == F.col("_from"), "left").withColumn("atom", F.coalesce("_to", "atom").cast("int")).drop("_from", "_to")


def classify(cells: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, kind, entries, depth): uniform or palette tiles with their sorted distinct atoms.

    keys: all tiles; those without cells are absent, with no entries.
    """
    sets = cells.groupBy(key).agg(F.array_sort(F.collect_set("atom")).alias("entries"))  # at most the cells of a tile
    if keys is not None:
        sets = keys.select(key).distinct().join(sets, key, "left").withColumn("entries", F.coalesce("entries", F.expr("CAST(array() AS array<int>)")))
    size = F.size("entries")
    kind = F.when(size == 0, "absent").when(size == 1, "uniform").otherwise("palette")
    return sets.select(key, kind.alias("kind"), "entries", bit_length(size).cast("int").alias("depth"))


def bitmap(df: DataFrame, key: str, slot: str) -> DataFrame:
    """(key, byte_no, bits): most significant bit first."""
    bit = F.call_function("shiftleft", F.lit(1), (F.lit(7) - F.col(slot) % 8).cast("int"))
    return df.groupBy(key, F.floor(F.col(slot) / 8).cast("int").alias("byte_no")).agg(F.bit_or(bit).cast("int").alias("bits"))


def descriptors(df: DataFrame, key: str, section: str, kind: Column) -> DataFrame:
    """(key, byte_no, kinds, n, levels): four 2-bit kinds a byte (section % 4 from the low bits), history counts."""
    per = df.groupBy(key, section).agg(F.count("*").alias("n"), F.max(kind).alias("kind"))
    shifted = F.call_function("shiftleft", F.col("kind").cast("int"), (F.col(section) % 4 * 2).cast("int"))
    return per.groupBy(key, F.floor(F.col(section) / 4).cast("int").alias("byte_no")).agg(
        F.bit_or(shifted).cast("int").alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("levels")
    )
