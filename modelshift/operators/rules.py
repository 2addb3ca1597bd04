"""Rules on data: keys, references, cardinalities, CHECK, EXISTENCE; how each is measured."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.functions.checks import Predicate, Raw, violated

KEY_KINDS = ("primary", "unique", "partition", "clustering", "node", "document_id")
#: Key kinds that identify a row and therefore refuse nulls and copies.
IDENTIFYING = ("primary", "node", "document_id")
CARDINALITIES = ("0..1", "1..1", "0..n", "1..n")


def _bounds(cardinality: str) -> tuple[int, int | None]:
    if cardinality not in CARDINALITIES:
        raise ValueError(f"cardinality {cardinality!r}")
    low, high = cardinality.split("..")
    return int(low), None if high == "n" else int(high)


@dataclass(frozen=True)
class Key:
    """A key of some kind; clustering columns may say ``"c desc"``."""

    entity: str
    columns: tuple[str, ...]
    kind: str = "primary"

    def __post_init__(self) -> None:
        if self.kind not in KEY_KINDS:
            raise ValueError(f"key kind {self.kind!r}")

    @property
    def name(self) -> str:
        return f"{self.kind}({','.join(self.columns)})"

    @property
    def severity(self) -> str:
        return "error"


@dataclass(frozen=True)
class Reference:
    """Child columns that hold a parent's key; a logical one only warns."""

    entity: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    cardinality: str = "1..1"
    source_cardinality: str = "0..n"
    enforced: bool = True

    def __post_init__(self) -> None:
        if len(self.columns) != len(self.parent_columns):
            raise ValueError("a reference needs as many columns as the key it names")
        _bounds(self.cardinality), _bounds(self.source_cardinality)

    @property
    def name(self) -> str:
        return f"reference({','.join(self.columns)})->{self.parent}({','.join(self.parent_columns)})"

    @property
    def severity(self) -> str:
        return "error" if self.enforced else "warning"

    @property
    def required(self) -> bool:
        return _bounds(self.cardinality)[0] > 0


@dataclass(frozen=True)
class Check:
    """A condition on the value at ``path``; inside arrays every element must meet it."""

    entity: str
    path: str
    text: str
    test: Predicate
    severity: str = "error"

    @property
    def name(self) -> str:
        return f"check({self.path} {self.text})"

    @property
    def identity(self) -> str:
        """What the check says, whatever it is called."""
        return f"check({self.path} {self.test})"


@dataclass(frozen=True)
class Existence:
    entity: str
    path: str
    severity: str = "error"

    @property
    def name(self) -> str:
        return f"existence({self.path})"


@dataclass(frozen=True)
class Embedded:
    """An embedded object or array and how many it must hold."""

    entity: str
    path: str
    cardinality: str = "0..1"
    severity: str = "warning"

    @property
    def name(self) -> str:
        return f"embedded({self.path} {self.cardinality})"


Rule = Key | Reference | Check | Existence | Embedded
RowRule = Check | Existence | Embedded


@dataclass(frozen=True)
class Contract:
    """An immutable set of rules over the entities of a dataset."""

    rules: tuple[Rule, ...] = ()

    def add(self, *rules: Rule) -> Contract:
        return Contract(self.rules + tuple(r for r in rules if r not in self.rules))

    def remove(self, *rules: Rule) -> Contract:
        return Contract(tuple(r for r in self.rules if r not in rules))

    def of(self, entity: str, kind: type | None = None) -> list[Rule]:
        return [
            r for r in self.rules if r.entity == entity and (kind is None or isinstance(r, kind))
        ]

    def references_to(self, parent: str) -> list[Reference]:
        return [r for r in self.rules if isinstance(r, Reference) and r.parent == parent]

    def primary(self, entity: str) -> Key | None:
        for r in self.of(entity, Key):
            if r.kind in IDENTIFYING:
                return r
        return None

    def key_columns(self, entity: str) -> tuple[str, ...]:
        """The identifying key, or partition columns followed by clustering columns."""
        primary = self.primary(entity)
        if primary:
            return primary.columns
        cols: tuple[str, ...] = ()
        for kind in ("partition", "clustering"):
            for r in self.of(entity, Key):
                if r.kind == kind:
                    cols += tuple(c.split(" ")[0] for c in r.columns)
        return cols

    def without_entity(self, entity: str) -> Contract:
        """Without the entity's own rules and the references that point to it."""
        return Contract(
            tuple(
                r
                for r in self.rules
                if r.entity != entity and not (isinstance(r, Reference) and r.parent == entity)
            )
        )

    def without_column(self, entity: str, path: str) -> Contract:
        """Without the rules that use a column of the entity."""

        def within(col: str) -> bool:
            col = col.split(" ")[0]
            return col == path or col.startswith(path + ".")

        def uses(r: Rule) -> bool:
            if isinstance(r, Reference) and r.parent == entity and any(map(within, r.parent_columns)):
                return True
            if r.entity != entity:
                return False
            return any(map(within, r.columns)) if isinstance(r, (Key, Reference)) else within(r.path)

        return Contract(tuple(r for r in self.rules if not uses(r)))

    def moved_out(self, entity: str, path: str, new: str, columns: Iterable[str]) -> list[Rule]:
        """The rules on members of the object or list at ``path``, as rules of the entity
        ``new`` that has those members as ``columns``."""
        have, start = set(columns), path + "."

        def inner(col: str) -> str | None:
            rest = col[len(start):] if col.startswith(start) else ""
            return rest if rest.split(".")[0] in have else None

        out: list[Rule] = []
        for r in self.of(entity):
            if isinstance(r, Reference):
                cols = [inner(c) for c in r.columns]
                if all(cols):
                    out.append(replace(r, entity=new, columns=tuple(cols)))
            elif isinstance(r, RowRule) and inner(r.path):
                if not (isinstance(r, Check) and isinstance(r.test, Raw)):
                    out.append(replace(r, entity=new, path=inner(r.path)))
        return out

    def renamed_entity(self, old: str, new: str) -> Contract:
        def move(r: Rule) -> Rule:
            if r.entity == old:
                r = replace(r, entity=new)
            if isinstance(r, Reference) and r.parent == old:
                r = replace(r, parent=new)
            return r

        return Contract(tuple(move(r) for r in self.rules))

    def renamed_column(self, entity: str, old: str, new: str) -> Contract:
        """``old`` and ``new`` are full paths."""

        def moved(col: str) -> str:
            name, *order = col.split(" ")
            if name == old or name.startswith(old + "."):
                name = new + name[len(old) :]
            return " ".join([name, *order])

        def swap(cols: tuple[str, ...]) -> tuple[str, ...]:
            return tuple(map(moved, cols))

        def move(r: Rule) -> Rule:
            if isinstance(r, Reference) and r.parent == entity:
                r = replace(r, parent_columns=swap(r.parent_columns))
            if r.entity != entity:
                return r
            if isinstance(r, (Key, Reference)):
                return replace(r, columns=swap(r.columns))
            return replace(r, path=moved(r.path))

        return Contract(tuple(move(r) for r in self.rules))


# --- measuring ----------------------------------------------------------------------

def _any_null(cols: Iterable[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | P.column(c).isNull()
    return out


def key_values(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The key columns alone, under new names; paths may lie inside objects and arrays.

    Columns inside an array give one row per element, so they must share their array.
    """
    schema = df.schema
    paths = [P.resolve(schema, c) for c in columns]
    inside = [bool(P.arrays_above(schema, p)) for p in paths]
    values = [P.value(schema, p).alias(n) for p, n in zip(paths, names)]
    if not any(inside):
        return df.select(*values)
    if len({tuple(P.arrays_above(schema, p)) for p, i in zip(paths, inside) if i}) > 1:
        raise ValueError(f"{columns} lie in different arrays")
    zipped = F.arrays_zip(*[v for v, i in zip(values, inside) if i])
    opened = df.select(*[v for v, i in zip(values, inside) if not i], F.explode(zipped).alias("_z"))
    fields = iter(opened.schema["_z"].dataType.names)
    return opened.select(
        *[
            F.col("_z").getField(next(fields)).alias(n) if i else P.column(n)
            for n, i in zip(names, inside)
        ]
    )


def check_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, distinct keys, groups and rows that repeat a key, rows with a null part.

    Copies collapse to a count before the shuffle, and only the key columns are read.
    """
    names = [f"_k{i}" for i in range(len(columns))]
    groups = (
        key_values(df, columns, names)
        .groupBy(*names)
        .agg(F.count("*").alias("_n"))
        .select("_n", _any_null(names).alias("_null"))
    )
    repeats = (F.col("_n") > 1) & ~F.col("_null")
    return groups.agg(
        _total(F.col("_n")).alias("n_rows"),
        F.count_if(~F.col("_null")).alias("n_keys"),
        F.count_if(repeats).alias("duplicate_groups"),
        _total(F.when(repeats, F.col("_n"))).alias("duplicate_rows"),
        _total(F.when(F.col("_null"), F.col("_n"))).alias("null_rows"),
    )


def _total(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def _linked(
    child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]
) -> DataFrame:
    """Key values with the rows of both sides that hold them: ``_c`` and ``_p``, null for none.

    One grouping over both sides, whose copies collapse before the shuffle. A key with a null
    part meets nothing: its rows stay apart by side.
    """
    aliases = [f"_k{i}" for i in range(len(columns))]
    kids = key_values(child, columns, aliases).withColumn("_kid", F.lit(True))
    folks = key_values(parent, parent_columns, aliases).withColumn("_kid", F.lit(False))
    apart = F.when(_any_null(aliases), F.col("_kid")).alias("_apart")
    counted = kids.unionByName(folks).groupBy(*aliases, apart).agg(
        F.count_if("_kid").alias("_c"), F.count_if(~F.col("_kid")).alias("_p"))
    return counted.select(
        *aliases, F.nullif("_c", F.lit(0)).alias("_c"), F.nullif("_p", F.lit(0)).alias("_p"))


def check_reference(
    child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]
) -> DataFrame:
    """One row: rows, rows with a null part (not checked), orphan keys and orphan rows.

    Both sides are reduced to counted keys before they meet, so a key with many rows
    travels as one.
    """
    linked = _linked(child, columns, parent, parent_columns)
    null = _any_null([f"_k{i}" for i in range(len(columns))])
    orphan = ~null & F.col("_p").isNull() & F.col("_c").isNotNull()
    return linked.agg(
        _total(F.col("_c")).alias("n_rows"),
        _total(F.when(null, F.col("_c"))).alias("null_rows"),
        F.count_if(orphan).alias("orphan_keys"),
        _total(F.when(orphan, F.col("_c"))).alias("orphan_rows"),
    )


def _bounded_reference(
    child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str],
    rule: Reference,
) -> DataFrame:
    """One row: rows, null rows, orphan rows, and rows ``outside`` the rule's other bounds:
    child rows with more parents than allowed, parent rows with too few or too many children.
    """
    linked = _linked(child, columns, parent, parent_columns)
    null = _any_null([f"_k{i}" for i in range(len(columns))])
    most = _bounds(rule.cardinality)[1]
    low, high = _bounds(rule.source_cardinality)
    up, down = F.coalesce("_p", F.lit(0)), F.coalesce("_c", F.lit(0))
    many = F.lit(False) if most is None else up > most
    few = (down < low) if high is None else (down < low) | (down > high)
    return linked.agg(
        _total(F.col("_c")).alias("n_rows"),
        _total(F.when(null, F.col("_c"))).alias("null_rows"),
        _total(F.when(~null & F.col("_p").isNull(), F.col("_c"))).alias("orphan_rows"),
        (_total(F.when(many, F.col("_c"))) + _total(F.when(few, F.col("_p")))).alias("outside"),
    )


def orphans(
    child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]
) -> DataFrame:
    """The child rows whose key is set but has no parent."""
    cond = F.lit(True)
    lookup = parent.select(*[P.column(c).alias(f"_k{i}") for i, c in enumerate(parent_columns)])
    for i, c in enumerate(columns):
        cond = cond & (P.column(c) == F.col(f"_k{i}"))
    return child.where(~_any_null(columns)).join(lookup, cond, "left_anti")


def cardinality_text(low: Column, high: Column) -> Column:
    return F.concat(
        F.when(low >= 1, "1").otherwise("0"), F.lit(".."), F.when(high > 1, "n").otherwise("1")
    )


def observe_cardinality(
    child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]
) -> DataFrame:
    """One row: fewest and most parents per child row, and children per parent row."""
    linked = _linked(child, columns, parent, parent_columns)
    up, down = F.coalesce("_p", F.lit(0)), F.coalesce("_c", F.lit(0))
    measured = linked.agg(
        F.min(F.when(F.col("_c").isNotNull(), up)).alias("target_min"),
        F.max(F.when(F.col("_c").isNotNull(), up)).alias("target_max"),
        F.min(F.when(F.col("_p").isNotNull(), down)).alias("source_min"),
        F.max(F.when(F.col("_p").isNotNull(), down)).alias("source_max"),
    )
    return measured.select(
        "*",
        cardinality_text(F.col("target_min"), F.col("target_max")).alias("target_end"),
        cardinality_text(F.col("source_min"), F.col("source_max")).alias("source_end"),
    )


def recard(
    child: DataFrame,
    columns: list[str],
    parent: DataFrame,
    parent_columns: list[str],
    target: str,
    source: str = "0..n",
) -> DataFrame:
    """One row: how many child rows and parent rows break the wanted cardinality."""
    low, high = _bounds(target)
    s_low, s_high = _bounds(source)
    linked = _linked(child, columns, parent, parent_columns)
    up, down = F.coalesce("_p", F.lit(0)), F.coalesce("_c", F.lit(0))

    def outside(n: Column, lo: int, hi: int | None) -> Column:
        bad = n < lo
        return bad if hi is None else bad | (n > hi)

    return linked.agg(
        F.lit(target).alias("target_end"),
        F.lit(source).alias("source_end"),
        _total(F.when(outside(up, low, high), F.col("_c"))).alias("bad_child_rows"),
        _total(F.when(outside(down, s_low, s_high), F.col("_p"))).alias("bad_parent_rows"),
    )


def _broken_inside(
    value: Column, dtype: T.DataType, steps: list[str], broken: Callable[[Column], Column]
) -> Column:
    """Whether ``broken`` holds for the last step's value in some object that should hold it.

    Goes down one name at a time; at an array every element is an object of its own. A
    missing object holds nothing and breaks nothing.
    """
    while isinstance(dtype, T.ArrayType) and steps:
        inner = dtype.elementType
        return F.coalesce(
            F.exists(value, lambda x: _broken_inside(x, inner, steps, broken)), F.lit(False))
    field = value.getField(steps[0])
    kind = dtype[steps[0]].dataType
    test = broken(field) if len(steps) == 1 else _broken_inside(field, kind, steps[1:], broken)
    return F.coalesce(value.isNotNull() & test, F.lit(False))


def row_violation(df: DataFrame, rule: RowRule) -> Column:
    """True where a row breaks a rule that can be judged on the row alone.

    A path through arrays is judged for each object that holds its last member: an element
    without the member breaks an EXISTENCE, an empty list in one element breaks a 1..n.
    """
    schema = df.schema
    path = P.resolve(schema, rule.path)
    if isinstance(rule, Check):
        col = P.value(schema, path)
        if P.arrays_above(schema, path):
            return F.coalesce(F.exists(col, lambda x: violated(rule.test, x)), F.lit(False))
        return violated(rule.test, col)
    if isinstance(rule, Existence):
        broken = Column.isNull
    else:
        low, high = _bounds(rule.cardinality)
        if not low:
            return F.lit(False)

        def broken(c: Column) -> Column:
            return c.isNull() if high else F.coalesce(F.size(c), F.lit(0)) < 1

    first, *rest = path.split(".")
    col, dtype = P.column(first), schema[first].dataType
    if not rest:
        return broken(col)
    if not P.arrays_above(schema, path):
        # Along objects alone a missing object lacks its members too.
        return broken(P.value(schema, path))
    return _broken_inside(col, dtype, rest, broken)


RESULT = "entity string, rule string, severity string, n_rows bigint, violations bigint"
IDENTITY = ", identity string"


def check_rows(
    df: DataFrame, entity: str, rules: list[RowRule], identities: bool = False
) -> DataFrame:
    """All row rules of an entity in one scan."""
    aggs = [F.count_if(row_violation(df, r)).alias(f"v{i}") for i, r in enumerate(rules)]
    out = F.array(
        *[
            F.struct(
                F.lit(entity).alias("entity"),
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.col("n_rows"),
                F.col(f"v{i}").alias("violations"),
                *([F.lit(_identity(r)).alias("identity")] if identities else []),
            )
            for i, r in enumerate(rules)
        ]
    )
    return df.agg(F.count("*").alias("n_rows"), *aggs).select(F.inline(out))


def _identity(rule: Rule) -> str:
    return rule.identity if isinstance(rule, Check) else rule.name


def _result(df: DataFrame, rule: Rule, violations: Column, identities: bool) -> DataFrame:
    return df.select(
        F.lit(rule.entity).alias("entity"),
        F.lit(rule.name).alias("rule"),
        F.lit(rule.severity).alias("severity"),
        F.col("n_rows"),
        violations.cast("bigint").alias("violations"),
        *([F.lit(_identity(rule)).alias("identity")] if identities else []),
    )


def check_contract(
    frames: Mapping[str, DataFrame], contract: Contract, identities: bool = False
) -> DataFrame:
    """Every rule with the rows it looked at and the number of violations.

    ``identities`` adds what each rule says, apart from what it is called. A reference with
    bounds beyond its defaults also counts the child and parent rows that break them.

    Row rules of one entity share a scan; keys and references read only their columns. A
    key's violations are rows beyond the first of their key, plus null rows where the kind
    refuses them. Partition and clustering keys identify a row only together.
    """
    out: list[DataFrame] = []
    for entity in dict.fromkeys(r.entity for r in contract.rules):
        df = frames[entity]
        simple = [r for r in contract.of(entity) if isinstance(r, RowRule)]
        if simple:
            out.append(check_rows(df, entity, simple, identities))
        for rule in contract.of(entity, Key):
            if rule.kind in ("partition", "clustering"):
                names = list(contract.key_columns(entity))
            else:
                names = list(rule.columns)
            got = check_key(df, names)
            extra = F.col("n_rows") - F.col("null_rows") - F.col("n_keys")
            nulls = F.lit(0) if rule.kind == "unique" else F.col("null_rows")
            out.append(_result(got, rule, extra + nulls, identities))
        for rule in contract.of(entity, Reference):
            ends = (df, list(rule.columns), frames[rule.parent], list(rule.parent_columns))
            got = _bounded_reference(*ends, rule)
            nulls = F.col("null_rows") if rule.required and rule.enforced else F.lit(0)
            broken = F.col("orphan_rows") + F.col("outside") + nulls
            out.append(_result(got, rule, broken, identities))
    if not out:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], RESULT + (IDENTITY if identities else ""))
    union = out[0]
    for part in out[1:]:
        union = union.unionByName(part)
    return union


def broken_rules(df: DataFrame, rules: list[RowRule]) -> Column:
    """The names of the rules a row breaks."""
    return F.array_compact(
        F.array(*[F.when(row_violation(df, r), F.lit(r.name)) for r in rules])
    )


def quarantine(df: DataFrame, rules: list[RowRule]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the rules they break in ``_broken``."""
    marked = df.withColumn("_broken", broken_rules(df, rules))
    return (
        marked.where(F.size("_broken") == 0).drop("_broken"),
        marked.where(F.size("_broken") > 0),
    )
