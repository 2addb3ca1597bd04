"""What the operators share: stored tables, tasks over Arrow batches, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from modelshift.session import new_folder

Columns = dict[str, list]
TILE = 1024  # rows of a block that meet as many others in one task, on average
WORDS = 1 << 20  # of 64 bits: a table of slots that preselects rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below the shared folder and read again.

    Cuts the lineage with files that outlive an executor.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


def map_columns(
    df: DataFrame, schema: str, prepare: Callable[[], Callable[[Columns], Columns]],
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Run a function over the Arrow batches of ``df``, as lists by column name.

    ``prepare`` is called once in each task and returns that function; what it builds is not
    pickled. Columns named in ``carry`` come out as they came in, after those of ``schema``; the
    function then gives a row for each row, in their order. One that starts with an underscore is
    not made a list.
    """
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = prepare()
        for batch in batches:
            out = fn({n: batch.column(n).to_pylist() for n in batch.schema.names
                      if not (n in carry and n.startswith("_"))})
            arrays = [pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *[batch.column(n) for n in carry]],
                schema=pa.schema([*arrow, *[batch.schema.field(n) for n in carry]])
            )

    return df.mapInArrow(run, StructType([*parsed.fields, *[df.schema[n] for n in carry]]))


def slot_of(*columns: str | Column) -> Column:
    """The slot of a row, by a hash of its columns; nulls are skipped."""
    return F.pmod(F.xxhash64(*columns), F.lit(64 * WORDS))


def slot_words(slots: DataFrame) -> DataFrame:
    """``(_word, _bits)``: a bit for each slot (column ``slot``); at most ``WORDS`` rows, however many there are."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    return slots.select(F.shiftright("slot", 6).alias("_word"), bit.alias("bit")).groupBy("_word").agg(
        F.bit_or("bit").alias("_bits"))


def slot_table(slots: DataFrame) -> np.ndarray:
    """The words of ``slot_words`` as one array of 8 MB, for ``in_slots``."""
    found = slot_words(slots).toArrow()
    table = np.zeros(WORDS, dtype=np.int64)
    table[found.column("_word").to_numpy()] = found.column("_bits").to_numpy()
    return table


def in_slots(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def with_likely(df: DataFrame, slot: Column, slots: DataFrame, name: str = "likely") -> DataFrame:
    """``df`` and, as column ``name``, whether a row's slot is among ``slots``: always for rows that are looked for, else seldom.

    As many more rows are looked for than the table has bits, more others are likely too.
    """
    words = F.broadcast(slot_words(slots))  # at most WORDS rows
    placed = df.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6)).join(words, "_word", "left")
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), F.col("_slot").bitwiseAND(F.lit(63)).cast("int"))
    return placed.withColumn(name, F.coalesce(hit.bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop(
        "_slot", "_word", "_bits")


def connected_groups(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (columns ``a``, ``b``, any order).

    ``root`` is the smallest node of the connected group. Alternates large-star and small-star
    steps, which end after a number of rounds that grows with the logarithm of the links; each
    round is a grouping and a join, so a node with very many links is split like any skewed key.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(), "links",
    )
    before = None
    while True:
        # Large star: each larger neighbour of u points to the smallest node next to u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        after = stored(small, "links")
        state = after.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        discard(edges)
        edges = after
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct())


def wider_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups ``(node, root)`` after more links, whose nodes may be in none of them yet.

    ``root`` is the smallest node, as it is in ``groups``; only the links between groups are connected.
    """
    def root_of(side: str) -> DataFrame:
        return groups.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))

    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    wider = stored(connected_groups(between), "wider-groups")
    old = groups.join(wider.select(F.col("node").alias("root"), F.col("root").alias("wider")), "root", "left")
    return old.select("node", F.coalesce("wider", "root").alias("root")).unionByName(
        wider.join(groups, "node", "left_anti"))


def pairs_across(members: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """``(a, b)``, the nodes of all pairs of one block, but of different groups, that are ``near``.

    ``members`` has ``(key, node, grp, at)``; ``near`` judges two structs ``at``. A block with one
    group alone is left out. The others are compared whole: the rows of a block are dealt out in
    tiles of about ``TILE``, and each two tiles meet under a key of their own, so that no task
    holds a block, however large. A pair that shares several blocks comes once.
    """
    several = members.groupBy("key").agg(
        F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.min("grp").alias("low"), F.max("grp").alias("high"),
    ).where("low <> high").select("key", "tiles")
    # A pair that shares several blocks is met in the one with the smallest key.
    some = members.join(several, "key")
    keys = some.groupBy("node").agg(F.collect_set("key").alias("keys"))
    dealt = some.join(keys, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    row = F.struct("node", "grp", "at", "keys")
    one = dealt.select("key", F.col("tile").alias("i"), F.explode(
        F.sequence("tile", F.col("tiles") - 1)).alias("j"), row.alias("one"))
    two = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("i"),
                       F.col("tile").alias("j"), row.alias("two"))
    once = (F.col("i") < F.col("j")) | (F.col("one.node") < F.col("two.node"))
    apart = F.col("one.grp") != F.col("two.grp")
    here = F.col("key") == F.array_min(F.array_intersect("one.keys", "two.keys"))
    return one.join(two, ["key", "i", "j"]).where(
        once & apart & near(F.col("one.at"), F.col("two.at")) & here).select(
        F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))
