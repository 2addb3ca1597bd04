"""Compare datasets: differences, equality, round trips, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.functions.keys import comparable, row_hash, stable
from modelshift.operators.grouping import require_unique
from modelshift.operators.rules import (
    Contract,
    check_contract,
    observe_cardinality,
)


def _side(df: DataFrame, key: list[str], prefix: str) -> DataFrame:
    return df.select(
        *[P.column(k).alias(f"_k{i}") for i, k in enumerate(key)],
        *[P.column(n).alias(f"{prefix}{n}") for n in df.columns if n not in key],
        F.lit(True).alias(f"{prefix}present"),
    )


def _equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType, labels: bool = False) -> Column:
    a, b = stable(a, ta), stable(b, tb)
    if labels:  # a vertex's labels are a set
        return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))
    if ta != tb:
        # Differing numeric widths still compare by value; other type changes by text.
        numeric = isinstance(ta, T.NumericType) and isinstance(tb, T.NumericType)
        return a.eqNullSafe(b) if numeric else a.cast("string").eqNullSafe(b.cast("string"))
    return a.eqNullSafe(b)


def dataset_diff(
    actual: DataFrame, expected: DataFrame, key: list[str], entity: str = ""
) -> DataFrame:
    """What differs between two frames with the same key, counted per column. One join.

    Rows: ``rows`` with those on one side only, then one row per column of either side.
    ``missing`` counts what only the expected side has, ``extra`` what only the actual side
    has, ``changed`` the common rows whose values differ. A key must be unique and set on
    both sides. A type difference is a hard one, a column that merely became nullable is
    not a difference.
    """
    require_unique(actual, key, "diff, actual")
    require_unique(expected, key, "diff, expected")
    both = _side(actual, key, "a_").join(
        _side(expected, key, "e_"), [f"_k{i}" for i in range(len(key))], "full_outer"
    )
    here, there = F.col("a_present").isNotNull(), F.col("e_present").isNotNull()
    aggs = [
        F.count_if(~here).alias("missing"),
        F.count_if(~there).alias("extra"),
        F.count_if(here & there).alias("common"),
    ]
    heads = [("rows", F.col("missing"), F.col("extra"), F.lit(0).cast("bigint"), "")]
    names = [n for n in actual.columns if n not in key]
    names += [n for n in expected.columns if n not in key and n not in actual.columns]
    for i, n in enumerate(names):
        mine = actual.schema[n].dataType if n in actual.columns else None
        yours = expected.schema[n].dataType if n in expected.columns else None
        zero = F.lit(0).cast("bigint")
        if mine is None:
            heads.append((n, F.col("common") + F.col("missing"), zero, zero, "column missing"))
        elif yours is None:
            heads.append((n, zero, F.col("common") + F.col("extra"), zero, "column extra"))
        else:
            same = _equal(P.column(f"a_{n}"), mine, P.column(f"e_{n}"), yours, n == "_labels")
            aggs.append(F.count_if(here & there & ~same).alias(f"c{i}"))
            note = "" if _type_text(mine) == _type_text(yours) else "type differs"
            heads.append((n, zero, zero, F.col(f"c{i}"), note))
    rows = F.array(
        *[
            F.struct(
                F.lit(entity).alias("entity"),
                F.lit(n).alias("item"),
                m.alias("missing"),
                x.alias("extra"),
                c.alias("changed"),
                F.lit(note).alias("note"),
            )
            for n, m, x, c, note in heads
        ]
    )
    return both.agg(*aggs).select(F.inline(rows))


def _type_text(dtype: T.DataType) -> str:
    return dtype.simpleString()


def bag_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that one side has more often, without any key: columns plus ``surplus``.

    Positive where the actual side has more copies, negative where the expected side has.
    Both directions come from one grouping, and copies collapse before the shuffle.
    """
    def marked(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            *[stable(P.column(f.name), f.dataType).alias(f.name) for f in df.schema.fields],
            F.lit(sign).cast("bigint").alias("surplus"),
        )

    both = marked(actual, 1).unionByName(marked(expected, -1))
    keys = [P.column(n) for n in actual.columns]
    return both.groupBy(*keys).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that is equal for equal bags of rows, in any row and column order."""
    hashed = df.select(row_hash(df).cast("decimal(38,0)").alias("h"))
    return hashed.agg(F.count("*").alias("n_rows"), F.sum("h").alias("hash_sum"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: row counts, whether the fingerprints agree. One scan of each side."""

    def hashed(df: DataFrame, other: DataFrame, is_left: bool) -> DataFrame:
        h = row_hash(df, other.schema).cast("decimal(38,0)")
        return df.select(h.alias("h"), F.lit(is_left).alias("l"))

    both = hashed(left, right, True).unionByName(hashed(right, left, False))
    sums = both.agg(
        F.count_if("l").alias("left_rows"),
        F.count_if(~F.col("l")).alias("right_rows"),
        F.sum(F.when(F.col("l"), F.col("h"))).alias("a"),
        F.sum(F.when(~F.col("l"), F.col("h"))).alias("b"),
    )
    equal = (F.col("left_rows") == F.col("right_rows")) & F.col("a").eqNullSafe(F.col("b"))
    return sums.select("left_rows", "right_rows", equal.alias("equal"))


def contract_diff(
    actual: Mapping[str, DataFrame],
    actual_rules: Contract,
    expected: Mapping[str, DataFrame],
    expected_rules: Contract,
) -> DataFrame:
    """Both contracts, measured on their own data, side by side.

    Rules are the same if they say the same: two checks with one label and different
    conditions are two rules.
    ``side`` tells where a rule is stated; the violations tell whether it holds there.
    Missing or extra keys and checks are errors, references and embeddeds warnings.
    """
    a = check_contract(actual, actual_rules, identities=True).select(
        "entity", "rule", "identity", F.col("violations").alias("actual_violations"), F.lit(1).alias("_a")
    )
    e = check_contract(expected, expected_rules, identities=True).select(
        "entity", "rule", "identity", F.col("violations").alias("expected_violations"), F.lit(1).alias("_e")
    )
    joined = a.join(e, ["entity", "rule", "identity"], "full_outer")
    side = (
        F.when(F.col("_e").isNull(), "actual").when(F.col("_a").isNull(), "expected").otherwise("both")
    )
    soft = F.col("rule").startswith("reference") | F.col("rule").startswith("embedded")
    severity = (
        F.when(side == "both", "none").when(soft, "warning").otherwise("error")
    )
    return joined.select(
        "entity", "rule", side.alias("side"), severity.alias("severity"),
        "actual_violations", "expected_violations",
    )


def integrity(frames: Mapping[str, DataFrame], contract: Contract) -> DataFrame:
    """Dangling references and repeated keys over all entities."""
    from modelshift.operators.rules import Key, Reference

    pointers = Contract(tuple(r for r in contract.rules if isinstance(r, (Key, Reference))))
    return check_contract(frames, pointers).select(
        "entity", "rule", "n_rows", "violations", (F.col("violations") == 0).alias("passed")
    )


def reconcile(
    entity: str,
    source: DataFrame,
    target: DataFrame,
    key: list[str],
    target_key: list[str] | None = None,
) -> DataFrame:
    """One row: rows on both sides, keys lost and invented, rows changed, and the verdict.

    Only the columns both sides have are compared, and rows travel as a key and one hash.
    Both sides go through one grouping by key, with the number of rows and the sum of their
    hashes for each side; nothing is joined. Values of different types are compared as in
    :func:`row_hash`, so a wider number type is no change.
    """
    target_key = target_key or key
    common = sorted(
        (set(source.columns) - set(key)) & (set(target.columns) - set(target_key))
    )
    names = [f"_k{i}" for i in range(len(key))]

    def marked(df: DataFrame, cols: list[str], other: DataFrame, theirs: list[str], left: bool) -> DataFrame:
        body, rest = (x.select(*[P.column(c) for c in common]) for x in (df, other))
        h = row_hash(body, rest.schema) if common else F.lit(0)
        kinds = [P.type_at(other.schema, c) for c in theirs]
        keys = [
            comparable(P.column(c), P.type_at(df.schema, c), t).alias(n)
            for c, t, n in zip(cols, kinds, names)
        ]
        return df.select(*keys, h.cast("decimal(38,0)").alias("_h"), F.lit(left).alias("_left"))

    both = marked(source, key, target, target_key, True).unionByName(
        marked(target, target_key, source, key, False)
    ).groupBy(*names).agg(
        F.count_if("_left").alias("s_n"), F.count_if(~F.col("_left")).alias("t_n"),
        F.sum(F.when(F.col("_left"), F.col("_h"))).alias("s_h"),
        F.sum(F.when(~F.col("_left"), F.col("_h"))).alias("t_h"),
    )
    # Keys with a null part never match, so they are counted as lost and invented.
    null = F.lit(False)
    for n in names:
        null = null | F.col(n).isNull()
    lost = (F.col("s_n") > 0) & ((F.col("t_n") == 0) | null)
    new = (F.col("t_n") > 0) & ((F.col("s_n") == 0) | null)
    changed = ~lost & ~new & ((F.col("s_n") != F.col("t_n")) | (F.col("s_h") != F.col("t_h")))
    counts = both.agg(
        F.coalesce(F.sum("s_n"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("t_n"), F.lit(0)).alias("target_rows"),
        F.count_if(lost).alias("keys_lost"),
        F.count_if(new).alias("keys_invented"),
        F.count_if(changed).alias("rows_changed"),
    )
    verdict = (
        F.when((F.col("source_rows") == 0) & (F.col("target_rows") == 0), "unverifiable")
        .when(F.col("keys_lost") > 0, "rows lost")
        .when(F.col("keys_invented") > 0, "rows invented")
        .when(F.col("rows_changed") > 0, "rows changed")
        .otherwise("ok")
    )
    return counts.select(F.lit(entity).alias("entity"), "*", verdict.alias("verdict"))


#: What a migration may come to, worst first.
VERDICTS = (
    "steps failed", "unverifiable", "rows lost", "rows invented", "rows changed", "rules broken", "ok",
)


def migration_verdict(
    clean: bool, reconciled: DataFrame | None, checked: DataFrame | None = None
) -> str:
    """One word on a migration: did all steps run, do the rows agree, do the rules hold.

    Failed steps outweigh everything; without a reconciliation nothing can be said.
    """
    if not clean:
        return "steps failed"
    if reconciled is None:
        return "unverifiable"
    seen = {r.verdict for r in reconciled.select("verdict").distinct().collect()}
    if checked is not None:
        errors = checked.where("violations > 0 AND severity = 'error'")
        if not errors.isEmpty():
            seen.add("rules broken")
    return min(seen or {"unverifiable"}, key=VERDICTS.index)


def edge_cardinality(
    child: DataFrame,
    child_key: list[str],
    reference: list[str],
    parent: DataFrame,
    parent_key: list[str],
    edges: DataFrame,
    *,
    from_parent: bool = False,
) -> DataFrame:
    """Cardinality ends of a reference, and of the edges made from it, in the same terms.

    For edges that run from parent to child the ends swap.
    """
    fk = observe_cardinality(child, reference, parent, parent_key)
    mine, other = ("dst", "src") if from_parent else ("src", "dst")
    # One edge per child row at most, so parents per child = edges per child.
    up = observe_cardinality(edges, [mine], child, child_key)
    down = observe_cardinality(edges, [other], parent, parent_key)
    target_end, source_end = ("source_end", "target_end") if from_parent else (
        "target_end", "source_end")
    measured = [
        (fk, "target_end", "target_end", "reference"),
        (fk, "source_end", "source_end", "reference"),
        (up, "source_end", "target_end", "edge"),
        (down, "source_end", "source_end", "edge"),
    ]
    facts = [
        df.select(F.lit(end).alias("reference_end"), F.lit(who).alias("who"), F.col(col).alias("is"))
        for df, col, end, who in measured
    ]
    union = facts[0]
    for one in facts[1:]:
        union = union.unionByName(one)
    edge_end = F.when(F.col("reference_end") == "target_end", target_end).otherwise(source_end)
    return (
        union.groupBy("reference_end")
        .agg(
            F.max(F.when(F.col("who") == "reference", F.col("is"))).alias("reference"),
            F.max(F.when(F.col("who") == "edge", F.col("is"))).alias("edge"),
        )
        .select(
            "reference_end", edge_end.alias("edge_end"), "reference", "edge",
            F.col("reference").eqNullSafe(F.col("edge")).alias("kept"),
        )
    )
