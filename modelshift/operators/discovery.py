"""What identifies a row, and what refers to what: searched level by level, over all rows.

Sets of columns are compared by two 64-bit hashes of their values. Sets whose hashes all differ
hold no copies for certain; unequal values would have to agree in both hashes to pass for copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.functions.keys import stable
from modelshift.operators.rules import Contract, Key, Reference
from modelshift.session import new_folder, settings

#: Column sets measured in one pass over the rows.
SETS_PER_SCAN = 16
#: Rows of a set that are looked at for copies before all of them are.
ROWS_FOR_REFUSAL = 1_000_000
#: Sets of columns that rows of a sample agree in, at most; the largest.
AGREEMENTS = 10_000
#: Columns whose equal rows are compared pair by pair: pairs a row on average; rows of a value.
PAIRS_PER_ROW = 32
ROWS_OF_A_VALUE = 1_000
#: What a task of a key search reads and gets, so that its memory does not grow with the table: bytes
#: of a file or of a joined-up shuffle partition; values of one shuffle partition.
BYTES_OF_A_TASK = "16m"
VALUES_OF_A_TASK = 1_000_000
#: Columns in one mask: the bits of a bigint but for its sign.
MASK_BITS = 62

Columns = tuple[str, ...]


def _hashes(values: Sequence[Column]) -> tuple[Column, Column]:
    """Two hashes of a tuple, which share no step."""
    return (F.xxhash64(*[F.xxhash64(v) for v in values]),
            F.xxhash64(*[F.xxhash64(F.lit(1), v) for v in values]))


def _plain(df: DataFrame, name: str) -> Column:
    return stable(P.column(name), df.schema[name].dataType)


def _batches(items: Sequence, size: int) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start:start + size]


def _measured(df: DataFrame, sets: Sequence[Columns], one_in: int = 1) -> dict[Columns, tuple[int, int, int]]:
    """Per set, its distinct values, the rows of the most frequent one, and the pairs of equal rows.

    With ``one_in``, over the rows whose value of the set has a hash divisible by it: all copies of
    such a value are among them, so a repeat there is a repeat.
    """
    found: dict[Columns, tuple[int, int, int]] = {}
    for some in _batches(sets, SETS_PER_SCAN):
        used = sorted({c for s in some for c in s})
        at = {c: k for k, c in enumerate(used)}
        # Each value is hashed once, whatever the number of sets that it is part of.
        single = df.select(*[
            h.alias(f"{side}{k}") for c, k in at.items()
            for side, h in (("a", F.xxhash64(_plain(df, c))), ("b", F.xxhash64(F.lit(1), _plain(df, c))))])
        coded = F.array(*[
            F.struct(F.lit(i).alias("i"), *[
                F.xxhash64(*[F.col(f"{side}{at[c]}") for c in s]).alias(side) for side in "ab"])
            for i, s in enumerate(some)])
        rows = single.select(F.inline(coded))
        if one_in > 1:
            rows = rows.where(F.pmod("a", F.lit(one_in)) == 0)
        groups = rows.groupBy("i", "a", "b").agg(F.count("*").alias("n"))
        pairs = F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)"))
        for r in groups.groupBy("i").agg(
                F.count("*").alias("d"), F.max("n").alias("most"), pairs.alias("pairs")).collect():
            found[some[r["i"]]] = (r["d"], r["most"], int(r["pairs"]))
    return found


def _largest(sets: Iterable[frozenset[str]]) -> list[frozenset[str]]:
    out: list[frozenset[str]] = []
    for one in sorted(sets, key=len, reverse=True):
        if not any(one <= x for x in out):
            out.append(one)
    return out


def _pair_agreements(df: DataFrame, names: Sequence[str], column: str) -> list[frozenset[str]]:
    """The largest sets of columns in which two rows of one value of ``column`` agree, of all pairs.

    A set with ``column`` has copies if and only if it lies within one of them: one shuffle on the
    column settles all sets that it is part of, whatever their size. Values agree if a 64-bit
    hash does.
    """
    words = range(-(-len(names) // MASK_BITS))
    at = [f"a{k}" for k in range(len(names))]
    rows = df.select(F.monotonically_increasing_id().alias("row"), *[
        F.xxhash64(_plain(df, c)).alias(a) for a, c in zip(at, names)])
    key = at[list(names).index(column)]
    one, two = (rows.select(*[F.col(c).alias(f"{side}{c}") for c in rows.columns]) for side in "xy")
    pairs = one.join(two, (F.col(f"x{key}") == F.col(f"y{key}")) & (F.col("xrow") < F.col("yrow")))
    masks = []
    for w in words:
        bits = [F.when(F.col(f"x{a}") == F.col(f"y{a}"), _bit(i)).otherwise(F.lit(0).cast("bigint"))
                for i, a in enumerate(at) if i // MASK_BITS == w]
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        masks.append(mask.alias(f"m{w}"))
    found = pairs.select(*masks).distinct().collect()
    return _largest({frozenset(c for i, c in enumerate(names) if r[i // MASK_BITS] >> i % MASK_BITS & 1)
                     for r in found})


def _agreements(df: DataFrame, names: Sequence[str], one_in: int) -> list[frozenset[str]]:
    """Large sets of columns in which some two rows agree, so that no part of them is a key.

    The rows whose hash is divisible by ``one_in``, sorted by the columns from each one on in turn;
    neighbours are compared in all columns. Any such pair of rows is proof; a pair that is not met
    here only leaves its sets to be counted.
    """
    spark = df.sparkSession
    at = [f"a{k}" for k in range(len(names))]
    rows = df.select(*[F.xxhash64(_plain(df, c)).alias(a) for a, c in zip(at, names)])
    folder = new_folder(spark, "sample")
    rows.where(F.pmod(F.xxhash64(*at), F.lit(one_in)) == 0).write.parquet(folder)
    some = spark.read.schema(rows.schema).parquet(folder)
    pairs: DataFrame | None = None
    for k in range(len(at)):
        turned = at[k:] + at[:k]
        before = Window.partitionBy(turned[0]).orderBy(*turned[1:])
        agreed = F.array_compact(F.array(*[
            F.when(F.col(a) == F.lag(a).over(before), F.lit(i)) for i, a in enumerate(at)]))
        one = some.select(agreed.alias("agreed"))
        pairs = one if pairs is None else pairs.unionByName(one)
    assert pairs is not None
    found = pairs.distinct().orderBy(F.size("agreed").desc(), "agreed").limit(AGREEMENTS).collect()
    return _largest({frozenset(names[i] for i in r["agreed"]) for r in found})


def discover_keys(
    df: DataFrame, entity: str, columns: list[str] | None = None, max_size: int | None = None
) -> DataFrame:
    """All minimal column sets that identify a row: ``(entity, key, size, n_rows)``.

    No nulls, no copies, and no smaller key inside. ``columns`` is all columns unless given, of any
    type; ``max_size`` stops at sets of so many columns, else the search ends where no
    set is left. An empty table has no keys.

    A set is looked at when all sets with one column less are known to have copies. Sets that
    cannot have as many values as there are rows, by the exact counts of their parts, are not
    looked at, nor sets in which two rows of a sample agree. The others first show their copies within
    the values of one hash bucket, about
    ``ROWS_FOR_REFUSAL`` rows; those that show none there are counted over all rows. A level takes
    a pass or two over the columns it needs, not one for each set, and copies of a value
    collapse before the shuffle. Sets with a column that has few rows to a value (by its counts, up to
    ``ROWS_OF_A_VALUE``, and ``PAIRS_PER_ROW`` on average) take no pass of their own: the pairs of rows
    that agree in the column are compared once, and show for every such set whether it has copies.

    Files are read in parts of ``BYTES_OF_A_TASK`` and the shuffles have more partitions, the more rows
    there are: a task counts or sorts about ``VALUES_OF_A_TASK`` values at most, in tables of any size.
    """
    names = columns or df.columns
    counts = df.agg(F.count("*").alias("n"), *[
        F.count(P.column(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    assert counts is not None
    n_rows = counts["n"]
    filled = [c for i, c in enumerate(names) if n_rows and counts[f"c{i}"] == n_rows]
    with settings(df.sparkSession, _task_sizes(df.sparkSession, n_rows * len(filled))):
        found = _minimal_keys(df, filled, n_rows, max_size)
    return df.sparkSession.createDataFrame(
        [(entity, ",".join(k), len(k), n_rows) for k in found],
        "entity string, key string, size int, n_rows bigint")


def _task_sizes(spark: SparkSession, values: int) -> dict[str, str]:
    name = "spark.sql.shuffle.partitions"
    return {
        "spark.sql.files.maxPartitionBytes": BYTES_OF_A_TASK,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": BYTES_OF_A_TASK,
        name: str(max(int(spark.conf.get(name)), -(-values // VALUES_OF_A_TASK))),
    }


def _minimal_keys(
    df: DataFrame, filled: Sequence[str], n_rows: int, max_size: int | None
) -> list[Columns]:
    """The keys of ``discover_keys``, among columns without nulls."""
    found: list[Columns] = []
    at = {c: i for i, c in enumerate(filled)}
    #: the most values a set with copies can have
    bound: dict[Columns, int] = {}
    single: dict[str, int] = {}
    one_in = max(1, n_rows // ROWS_FOR_REFUSAL)
    level: list[Columns] = [(c,) for c in filled]
    copies: list[frozenset[str]] = []
    #: columns all of whose pairs of equal rows are known
    paired: set[str] = set()

    def has_copies(s: Columns) -> bool:
        return any(x.issuperset(s) for x in copies)

    while level:
        size = len(level[0])
        settled = [s for s in level if paired.intersection(s)]
        keys = {s for s in settled if not has_copies(s)}
        open_ = [s for s in level if not paired.intersection(s)]
        if size > 1:
            for s in level:
                bound[s] = min(bound[tuple(x for x in s if x != c)] * single[c] for c in s)
            open_ = [s for s in open_ if bound[s] >= n_rows and not has_copies(s)]
            if one_in > 1:
                shown = _measured(df, open_, one_in)
                open_ = [s for s in open_ if s not in shown or shown[s][1] == 1]
        whole = _measured(df, open_)
        for s, (distinct, _, _) in whole.items():
            bound[s] = distinct
            if size == 1:
                single[s[0]] = distinct
        keys |= {s for s, (_, most, _) in whole.items() if most == 1}
        found += sorted(keys, key=lambda s: [at[c] for c in s])
        if size == max_size:
            break
        level = _wider([s for s in level if s not in keys], at)
        if size == 1 and level:
            rest = [c for c in filled if (c,) not in keys]
            for c in sorted(rest, key=lambda c: whole[c,][2]):
                _, most, pairs = whole[c,]
                if most <= ROWS_OF_A_VALUE and pairs <= PAIRS_PER_ROW * n_rows:
                    copies = _largest([*copies, *_pair_agreements(df, rest, c)])
                    paired.add(c)
            if any(not paired.intersection(s) for s in level):
                copies = _largest([*copies, *_agreements(df, [c for c in rest if c not in paired], one_in)])
    return found


def _wider(sets: Sequence[Columns], at: Mapping[str, int]) -> list[Columns]:
    """The sets with one column more, all of whose parts of this size are among ``sets``."""
    known, last = set(sets), {}
    for s in sets:
        last.setdefault(s[:-1], []).append(s[-1])
    out = []
    for head, tails in last.items():
        for a, b in combinations(sorted(tails, key=at.__getitem__), 2):
            s = (*head, a, b)
            if all(s[:i] + s[i + 1:] in known for i in range(len(s))):
                out.append(s)
    return out


def _comparable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def _family(dtype: T.DataType) -> str:
    """Columns are compared within their family, in one type."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return dtype.simpleString()


def discover_references(
    frames: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Pairs of columns where every value of the one also occurs in the other.

    Columns of one entity are compared too. Each distinct value carries a bit for each column that
    holds it, in as many words as that takes; the bits common to all values of a column name the
    columns that include it. One shuffle on the values, whose copies collapse beforehand, instead
    of a join per pair. Columns are compared within their type family; ``columns`` is all but
    lists, maps and objects unless given.
    """
    families: dict[str, list[tuple[str, str]]] = {}
    for entity, df in frames.items():
        for c in columns.get(entity, ()) if columns is not None else df.columns:
            dtype = P.type_at(df.schema, c)
            if columns is not None or _comparable(dtype):
                families.setdefault(_family(dtype), []).append((entity, c))
    out: DataFrame | None = None
    for family, members in families.items():
        if len(members) > 1:
            part = _included(frames, members, family)
            out = part if out is None else out.unionByName(part)
    if out is None:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], "child string, parent string, n_values bigint")
    return out


def _bit(i: int) -> Column:
    return F.lit(1 << i % MASK_BITS).cast("bigint")


def _included(
    frames: Mapping[str, DataFrame], members: list[tuple[str, str]], family: str
) -> DataFrame:
    numbered = list(enumerate(members))
    words = [f"w{k}" for k in range(-(-len(members) // MASK_BITS))]
    bits: dict[str, list[Column]] = {}
    for i, (entity, c) in numbered:
        value = P.value(frames[entity].schema, c).cast(family)
        mine = [(_bit(i) if k == i // MASK_BITS else F.lit(0).cast("bigint")).alias(w)
                for k, w in enumerate(words)]
        bits.setdefault(entity, []).append(F.struct(value.alias("v"), *mine))
    pairs: DataFrame | None = None
    for entity, structs in bits.items():
        one = frames[entity].select(F.inline(F.array(*structs))).where("v is not null")
        pairs = one if pairs is None else pairs.unionByName(one)
    assert pairs is not None
    masks = pairs.groupBy("v").agg(*[F.bit_or(w).alias(w) for w in words])
    out: DataFrame | None = None
    for some in _batches(numbered, MASK_BITS):
        aggs, kids = [], []
        for i, (entity, c) in some:
            mine = F.col(words[i // MASK_BITS]).bitwiseAND(_bit(i)) != 0
            aggs.append(F.count_if(mine).alias(f"n{i}"))
            aggs += [F.bit_and(F.when(mine, F.col(w))).alias(f"m{i}_{w}") for w in words]
            kids.append(F.struct(F.lit(f"{entity}.{c}").alias("child"), F.col(f"n{i}").alias("n_values"),
                                 *[F.col(f"m{i}_{w}").alias(w) for w in words]))
        part = masks.agg(*aggs).select(F.inline(F.array(*kids)))
        out = part if out is None else out.unionByName(part)
    # One row per column, each met by the list of column names: as many rows as name pairs.
    folks = F.array(*[
        F.struct(F.lit(f"{e}.{c}").alias("parent"),
                 (F.col(words[j // MASK_BITS]).bitwiseAND(_bit(j)) != 0).alias("holds"))
        for j, (e, c) in numbered])
    assert out is not None
    return (
        out.select("child", "n_values", F.inline(folks)).where("holds")
        .where(F.col("child") != F.col("parent")).select("child", "parent", "n_values"))


#: child entity, parent entity, and their columns pair by pair
Inclusion = tuple[str, str, tuple[tuple[str, str], ...]]


def discover_composite_references(
    frames: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None,
    keys: Mapping[str, Sequence[Columns]] | None = None, max_size: int | None = None,
) -> DataFrame:
    """Tuples of two columns or more that all occur in another tuple: ``(child, parent, n_values)``.

    Names read ``entity.a,b``; the first column corresponds to the first, and so on. ``n_values``
    counts the child's different tuples; one with a null part refers to nothing, but what it does
    hold must still occur: every part of a reference is a reference too. A column never
    corresponds to itself, and an entity may refer to itself.

    Inclusions of single columns are joined into pairs, pairs into triples and so on, as long as
    all their parts hold; ``max_size`` stops earlier. With ``keys``, only references to exactly those
    column sets are returned, and only what can grow into one is followed. All candidates of a size
    are judged in one grouping, in which copies of a tuple collapse before the shuffle.
    """
    spark = next(iter(frames.values())).sparkSession
    wanted = None if keys is None else {e: [frozenset(k) for k in ks] for e, ks in keys.items()}
    order = {(e, c): i for e, df in frames.items() for i, c in enumerate(df.columns)}

    def useful(x: Inclusion) -> bool:
        parents = {p for _, p in x[2]}
        return wanted is None or any(parents <= k for k in wanted.get(x[1], ()))

    held: set[Inclusion] = set()
    for r in discover_references(frames, columns).collect():
        (child, c), (parent, p) = r["child"].split(".", 1), r["parent"].split(".", 1)
        held.add((child, parent, ((c, p),)))
    level = {x for x in held if useful(x)}
    out: list[tuple[str, str, int]] = []
    size = 1
    while level and size != max_size:
        size += 1
        heads: dict[tuple, list[tuple[str, str]]] = {}
        for child, parent, pairs in level:
            heads.setdefault((child, parent, pairs[:-1]), []).append(pairs[-1])
        tried: list[Inclusion] = []
        for (child, parent, head), tails in heads.items():
            tails = sorted(tails, key=lambda x: (order[child, x[0]], order[parent, x[1]]))
            for one, two in combinations(tails, 2):
                pairs = (*head, one, two)
                parts = [(child, parent, pairs[:i] + pairs[i + 1:]) for i in range(size)]
                apart = one[0] != two[0] and one[1] != two[1]
                if apart and all(x in level for x in parts) and useful((child, parent, pairs)):
                    tried.append((child, parent, pairs))
        tried.sort()
        level = set()
        # Neighbours share sides; a mask has room for both sides of each.
        for some in _batches(tried, MASK_BITS // 2):
            for x, n in _inclusions(frames, some):
                level.add(x)
                child, parent, pairs = x
                if wanted is None or frozenset(p for _, p in pairs) in wanted[parent]:
                    out.append((f"{child}.{','.join(c for c, _ in pairs)}",
                                f"{parent}.{','.join(p for _, p in pairs)}", n))
    return spark.createDataFrame(sorted(out), "child string, parent string, n_values bigint")


def _inclusions(
    frames: Mapping[str, DataFrame], tried: Sequence[Inclusion]
) -> list[tuple[Inclusion, int]]:
    """Those of ``tried`` that hold, with the number of the child's tuples.

    A side of several candidates is one tuple of columns, which travels once: each distinct value
    carries a bit for each tuple of columns that has it, as in :func:`discover_references`.
    """
    sides: dict[tuple[str, Columns], int] = {}
    ends = []
    for child, parent, pairs in tried:
        ends.append([
            sides.setdefault((entity, names), len(sides))
            for entity, names in ((child, tuple(c for c, _ in pairs)), (parent, tuple(p for _, p in pairs)))])
    kinds = [tuple(_family(P.type_at(frames[e].schema, c)) for c in names) for e, names in sides]
    coded: dict[str, list[Column]] = {}
    for (entity, names), i in sides.items():
        schema = frames[entity].schema
        values = [P.value(schema, c).cast(k) for c, k in zip(names, kinds[i])]
        filled = values[0].isNotNull()
        for v in values[1:]:
            filled &= v.isNotNull()
        a, b = _hashes(values)
        coded.setdefault(entity, []).append(F.struct(
            F.when(filled, _bit(i)).alias("held"), a.alias("a"), b.alias("b")))
    rows: DataFrame | None = None
    for entity, structs in coded.items():
        one = frames[entity].select(F.inline(F.array(*structs))).where("held is not null")
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return []
    # Tuples of other types may share a hash, but only sides of a candidate are compared.
    tuples = rows.groupBy("a", "b").agg(F.bit_or("held").alias("held"))
    counts = []
    for k, (c, p) in enumerate(ends):
        mine, theirs = (F.col("held").bitwiseAND(_bit(i)) != 0 for i in (c, p))
        counts += [F.count_if(mine & ~theirs).alias(f"missing{k}"), F.count_if(mine).alias(f"n{k}")]
    found = tuples.agg(*counts).first()
    assert found is not None
    return [(x, found[f"n{k}"]) for k, x in enumerate(tried)
            if found[f"missing{k}"] == 0 and found[f"n{k}"] > 0]


def proposed_contract(
    frames: Mapping[str, DataFrame], max_size: int | None = 1, self_references: bool = False
) -> Contract:
    """A contract proposed by the data: keys of up to ``max_size`` columns (none: any number) and
    the references into them.

    The first of the smallest keys of an entity is its primary key. An entity may refer to itself,
    by other columns than the key's, with ``self_references``.
    """
    contract = Contract()
    keys: dict[str, list[Columns]] = {}
    for name, df in frames.items():
        found = discover_keys(df, name, max_size=max_size).collect()
        keys[name] = [tuple(r["key"].split(",")) for r in found]
        for i, k in enumerate(keys[name]):
            contract = contract.add(Key(name, k, "primary" if i == 0 else "unique"))
    for r in discover_references(frames).collect():
        (child, c), (parent, p) = r["child"].split(".", 1), r["parent"].split(".", 1)
        if (p,) in keys[parent] and (self_references or child != parent):
            contract = contract.add(Reference(child, (c,), parent, (p,)))
    wider = {e: [k for k in ks if len(k) > 1] for e, ks in keys.items()}
    if any(wider.values()):
        for r in discover_composite_references(frames, keys=wider).collect():
            (child, c), (parent, p) = r["child"].split(".", 1), r["parent"].split(".", 1)
            if self_references or child != parent:
                contract = contract.add(Reference(child, tuple(c.split(",")), parent, tuple(p.split(","))))
    return contract
