"""A dataset: named frames, their model, and the rules that go with them.

Each operation returns a new dataset and keeps the rules in step with the data. Frames are
lazy; an operation runs a job only where a key must be proved unique or group sizes known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.functions.checks import Predicate
from modelshift.functions.keys import natural_key
from modelshift.functions.types import conform, spark_type
from modelshift.operators import graph as G
from modelshift.operators import properties as pr
from modelshift.operators import structural as st
from modelshift.operators.grouping import DuplicateKey, duplicate_groups, require_unique
from modelshift.operators.rules import (
    IDENTIFYING,
    Check,
    Contract,
    Embedded,
    Existence,
    Key,
    Reference,
    Rule,
    check_contract,
)
from modelshift.session import new_folder, write_all

KINDS = ("table", "document", "vertex", "edge", "wide_column")
# The kind an entity has in each model.
KIND_OF_MODEL = {
    "relational": "table",
    "document": "document",
    "graph": "vertex",
    "wide_column": "wide_column",
}


class Skip(Exception):
    """An operation whose precondition is not met; the dataset stays as it was."""


class Ends(NamedTuple):
    """The entities an edge type runs between."""

    source: str
    target: str


def _frozen(d: Mapping) -> Mapping:
    return MappingProxyType(dict(d))


@dataclass(frozen=True)
class Dataset:
    frames: Mapping[str, DataFrame]
    contract: Contract = Contract()
    kinds: Mapping[str, str] = field(default_factory=dict)
    ends: Mapping[str, Ends] = field(default_factory=dict)
    #: Keys known to be unique, by a look at the data or by how the rows were made.
    proved: frozenset[tuple[str, tuple[str, ...]]] = frozenset()
    #: Per entity an earlier frame with the same rows and some unchanged plain columns.
    #: Keys are counted there, without the joins that have been added since.
    bases: Mapping[str, DataFrame] = field(default_factory=dict)
    #: Rows that an operation could not take along, by the entity it made.
    rejected: Mapping[str, DataFrame] = field(default_factory=dict)
    #: References that were deleted; edges made later take their cardinality from them.
    deleted: tuple[Reference, ...] = ()

    def __post_init__(self) -> None:
        kinds = {n: self.kinds.get(n, "table") for n in self.frames}
        bases = {n: self.bases.get(n, f) for n, f in self.frames.items()}
        object.__setattr__(self, "bases", _frozen(bases))
        object.__setattr__(self, "frames", _frozen(self.frames))
        object.__setattr__(self, "kinds", _frozen(kinds))
        object.__setattr__(self, "ends", _frozen(self.ends))

    def __getitem__(self, entity: str) -> DataFrame:
        if entity not in self.frames:
            raise Skip(f"no entity {entity!r}")
        return self.frames[entity]

    def __contains__(self, entity: str) -> bool:
        return entity in self.frames

    # --- helpers --------------------------------------------------------------------

    def put(
        self,
        changes: Mapping[str, DataFrame],
        contract: Contract | None = None,
        same_rows: bool = False,
        **kinds: str,
    ) -> Dataset:
        """New frames for some entities. Proved keys of a changed entity last only if no row
        of it was added or multiplied and the key columns are still there."""
        proved = frozenset(
            (e, cols)
            for e, cols in self.proved
            if e not in changes or (same_rows and all(c in changes[e].columns for c in cols))
        )
        return replace(
            self,
            frames={**self.frames, **changes},
            contract=self.contract if contract is None else contract,
            kinds={**self.kinds, **kinds},
            proved=proved,
            bases={
                **self.bases,
                **{e: self._base(e, f) if same_rows else f for e, f in changes.items()},
            },
        )

    def _base(self, entity: str, new: DataFrame) -> DataFrame:
        """The entity's base without the columns that ``new`` lacks or holds as another type.

        A column that was once gone stays out, even if one of its name is added later.
        """
        old = self.bases.get(entity)
        if old is None:
            return new
        types = {f.name: f.dataType for f in new.schema.fields}
        kept = [
            f.name
            for f in old.schema.fields
            if types.get(f.name) == f.dataType
            and not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        ]
        if kept == old.columns:
            return old
        return old.select(*[P.column(n) for n in kept]) if kept else new

    def key_rows(self, entity: str, columns: Iterable[str]) -> DataFrame:
        """A frame with the entity's rows that is cheapest for these columns."""
        base = self.bases[entity]
        return base if set(columns) <= set(base.columns) else self[entity]

    def _prove(self, *keys: tuple[str, tuple[str, ...]]) -> Dataset:
        return replace(self, proved=self.proved | set(keys))

    def is_proved(self, entity: str, columns: Iterable[str]) -> bool:
        """Whether some known key of the entity lies within these columns."""
        have = set(columns)
        return any(e == entity and set(cols) <= have for e, cols in self.proved)

    def prove_keys(self, *entities: str) -> Dataset:
        """Look for copies of the entities' keys, all in one job, and raise if there are any.

        Done on the source tables this reads the key columns alone, and the nesting steps
        that follow need not look again.
        """
        keys = [(e, self.contract.key_columns(e)) for e in entities or self.frames]
        keys = [(e, k) for e, k in keys if k and not self.is_proved(e, k)]
        repeats = [
            duplicate_groups(self.key_rows(e, k), list(k)).agg(F.count("*").alias("n")).select(
                F.lit(i).alias("i"), "n")
            for i, (e, k) in enumerate(keys)
        ]
        if not repeats:
            return self
        union = repeats[0]
        for one in repeats[1:]:
            union = union.unionByName(one)
        wrong = [keys[r.i] for r in union.where("n > 0").collect()]
        if wrong:
            raise DuplicateKey("; ".join(f"{e}({', '.join(k)}) repeats" for e, k in wrong))
        return self._prove(*keys)

    def _without(self, *names: str) -> Dataset:
        return replace(
            self,
            frames={n: f for n, f in self.frames.items() if n not in names},
            kinds={n: k for n, k in self.kinds.items() if n not in names},
            ends={n: e for n, e in self.ends.items() if n not in names},
            proved=frozenset(p for p in self.proved if p[0] not in names),
        )

    def locate(self, path: str) -> tuple[str, str]:
        """Split ``entity.path`` and look the path up in the entity's schema."""
        entity, _, rest = path.partition(".")
        df = self[entity]
        if not rest:
            raise Skip(f"{path!r} names no field")
        try:
            return entity, P.resolve(df.schema, rest)
        except KeyError as e:
            raise Skip(f"{entity}: {e.args[0]}") from None

    def _place(self, path: str) -> tuple[str, str]:
        """Split ``entity.path`` for a field that need not exist yet."""
        entity, _, rest = path.partition(".")
        self[entity]
        parent, name = P.parent_of(rest)
        if parent:
            _, parent = self.locate(f"{entity}.{parent}")
        return entity, f"{parent}.{name}" if parent else name

    def _not_edge(self, *names: str) -> None:
        for n in names:
            self[n]
            if self.kinds[n] == "edge":
                raise Skip(f"{n!r} is an edge type")

    # --- structure ------------------------------------------------------------------

    def nest(
        self,
        source: str,
        into: str,
        on: dict[str, str],
        fields: list[str] | None = None,
        *,
        many: bool | None = None,
        part_column: str | None = None,
        elements_per_part: int | None = None,
        drop_source: bool = False,
        dealt: bool = False,
    ) -> Dataset:
        """NEST: embed ``source`` into ``entity.alias``; ``on`` maps target to source columns.

        An array results when the source refers to the target, an object when the target
        refers to the source. Without a reference say which with ``many``.
        """
        target, alias = self._place(into)
        src, dst = self[source], self[target]
        to_target = [r for r in self.contract.of(source, Reference) if r.parent == target]
        to_source = [r for r in self.contract.of(target, Reference) if r.parent == source]
        if many is None:
            many = bool(to_target)
        contract = self.contract
        holder, name = P.parent_of(alias)
        inside = holder and isinstance(P.type_at(dst.schema, holder), T.ArrayType)
        if fields is None:
            refs = {c for r in contract.of(source, Reference) for c in r.columns}
            fields = [n for n in src.columns if n not in refs]
        if inside:
            # Elements of an array each take their one source row; ``on`` names their fields.
            key = list(contract.key_columns(target))
            if many or not key:
                raise Skip(f"nesting into {into!r} takes one row per element and a key")
            links = {P.parent_of(path)[1]: c for path, c in on.items()}
            out = st.nest_in_array(dst, src, holder, links, name, fields, key=key)
            contract = contract.add(Embedded(target, alias, "0..1"))
        elif many:
            out = st.nest_many(
                dst, src, on, alias, fields, part_column=part_column,
                elements_per_part=elements_per_part, counted_on=self.key_rows(source, on.values()),
                dealt=dealt,
            )
            need = any(r.source_cardinality == "1..n" for r in to_target)
            contract = contract.add(Embedded(target, alias, "1..n" if need else "0..n"))
            if part_column:
                for key in [k for k in contract.of(target, Key) if k.kind in IDENTIFYING]:
                    contract = contract.remove(key).add(
                        replace(key, columns=(*key.columns, part_column))
                    )
        else:
            if not self.is_proved(source, on.values()):
                require_unique(
                    self.key_rows(source, on.values()), list(on.values()), f"nest into {into}")
            out = st.nest_one(dst, src, on, alias, fields, check=False)
            need = bool(to_source) and all(r.required for r in to_source)
            for path in on:
                contract = contract.without_column(target, path)
            contract = contract.add(Embedded(target, alias, "1..1" if need else "0..1"))
        ds = self.put({target: out}, contract, same_rows=not (many and part_column))
        return ds.delete_entity(source) if drop_source else ds

    def unnest(
        self,
        path: str,
        as_: str,
        fields: list[str] | None = None,
        carry: dict[str, str] | None = None,
        *,
        key: str | None = None,
        key_from: list[str] | None = None,
        link: str | None = None,
        distinct: bool = False,
        part_column: str | None = None,
        keep: bool = False,
    ) -> Dataset:
        """UNNEST: move an embedded object or array to an entity of its own.

        ``keep`` leaves the parent as it is, so that several objects can each be taken from
        stored documents with a scan of their own columns; :meth:`link` replaces them later.
        With ``key`` and ``link`` the parent keeps the key; a link at the top of the parent
        and carried columns that are the parent's key become references.
        """
        entity, full = self.locate(path)
        try:
            new, rest = st.unnest(
                self[entity], full, fields, carry, key=key, key_from=key_from,
                link=link, distinct=distinct, part_column=part_column,
            )
        except KeyError as e:
            raise Skip(str(e)) from None
        contract = self.contract.add(
            *self.contract.moved_out(entity, full, as_, new.columns))
        if keep:
            rest = self[entity]
        else:
            contract = contract.without_column(entity, full)
        if key and distinct:
            contract = contract.add(Key(as_, (key,)))
        if key and link and "." not in full:
            contract = contract.add(Reference(entity, (link,), as_, (key,), "0..1"))
        parent_key = [c for c in contract.key_columns(entity) if c != part_column]
        carried = carry or {}
        if parent_key and all(c in carried for c in parent_key):
            contract = contract.add(
                Reference(as_, tuple(carried[c] for c in parent_key), entity, tuple(parent_key))
            )
        ds = self.put({entity: rest}, contract, same_rows=True).put(
            {as_: new}, **{as_: "table"})
        # A key over everything that tells distinct rows apart is unique by construction.
        return ds._prove((as_, (key,))) if key and distinct and not key_from and not carry else ds

    def link(
        self, path: str, to: str, column: str, key: str, key_from: list[str] | None = None
    ) -> Dataset:
        """Replace an embedded object by the surrogate ``key`` its own entity ``to`` has."""
        entity, full = self.locate(path)
        try:
            out = st.link_object(self[entity], full, column, key_from)
        except KeyError as e:
            raise Skip(str(e)) from None
        contract = self.contract.without_column(entity, full)
        if "." not in full:
            contract = contract.add(Reference(entity, (column,), to, (key,), "0..1"))
        return self.put({entity: out}, contract, same_rows=True)

    def join_parts(self, entity: str, part_column: str) -> Dataset:
        """Once its arrays are moved out, a spread-out document is its part 0 alone."""
        df = self[entity].where(P.column(part_column) == 0).drop(part_column)
        contract = self.contract
        for key in contract.of(entity, Key):
            if part_column in key.columns:
                rest = tuple(c for c in key.columns if c != part_column)
                contract = contract.remove(key).add(replace(key, columns=rest))
        return self.put({entity: df}, contract)

    def flatten(self, path: str) -> Dataset:
        entity, full = self.locate(path)
        try:
            out = st.flatten(self[entity], full)
        except KeyError as e:
            raise Skip(str(e)) from None
        contract = self.contract
        parent, name = P.parent_of(full)
        level = P.element_of(P.type_at(self[entity].schema, parent)) if parent else self[entity].schema
        for f in P.element_of(P.type_at(self[entity].schema, full)).names:
            flat = f"{name}_{f}"
            if flat not in level.names:  # a column of that name is kept, with its own rules
                contract = contract.renamed_column(
                    entity, f"{full}.{f}", f"{parent}.{flat}" if parent else flat)
        return self.put({entity: out}, contract.without_column(entity, full), same_rows=True)

    def unflatten(
        self, entity: str, fields: list[str] | dict[str, str], name: str, *, null_if_empty: bool = False
    ) -> Dataset:
        entity, _, parent = entity.partition(".")
        try:
            out = st.unflatten(
                self[entity], fields, name, parent=parent, null_if_empty=null_if_empty
            )
        except KeyError as e:
            raise Skip(str(e)) from None
        return self.put({entity: out}, same_rows=True)

    def unwind(self, path: str, *, keep_empty: bool = False) -> Dataset:
        entity, full = self.locate(path)
        if not isinstance(P.type_at(self[entity].schema, full), T.ArrayType):
            raise Skip(f"{path!r} is not a list")
        return self.put({entity: st.unwind(self[entity], full, keep_empty=keep_empty)})

    def unwind_into(
        self, path: str, as_: str, carry: dict[str, str] | None = None, position: str | None = None
    ) -> Dataset:
        entity, full = self.locate(path)
        new, rest = st.unwind_into(self[entity], full, carry, position=position)
        return self.put(
            {entity: rest, as_: new}, self.contract.without_column(entity, full), **{as_: "table"}
        )

    def wind(self, path: str) -> Dataset:
        entity, full = self.locate(path)
        return self.put({entity: st.wind(self[entity], full)})

    def wind_group(
        self, path: str, *, part_column: str | None = None, elements_per_part: int | None = None
    ) -> Dataset:
        entity, full = self.locate(path)
        return self.put({entity: st.wind_group(
            self[entity], full, part_column=part_column, elements_per_part=elements_per_part)})

    def merge(self, first: str, second: str, into: str, on: list[str] | None = None) -> Dataset:
        """MERGE: by key columns, or without any a union; the first entity's key wins."""
        self._not_edge(first, second)
        a, b = self[first], self[second]
        one = "first" if on and self.is_proved(first, on) else None
        if on and not one and self.is_proved(second, on):
            one = "second"
        out = st.merge_join(a, b, on, one=one) if on else st.merge_union(a, b)
        contract = self.contract
        rules = [replace(r, entity=into) for r in contract.of(first)]
        has_key = any(isinstance(r, Key) and r.kind in IDENTIFYING for r in rules)
        for r in contract.of(second):
            if not (has_key and isinstance(r, Key) and r.kind in IDENTIFYING):
                rules.append(replace(r, entity=into))
        incoming = [
            replace(r, parent=into)
            for r in contract.rules
            if isinstance(r, Reference) and r.parent in (first, second)
            and r.entity not in (first, second)
        ]
        contract = contract.without_entity(first).without_entity(second).add(*rules, *incoming)
        ends = {
            n: Ends(*(into if x in (first, second) else x for x in e)) for n, e in self.ends.items()
        }
        kind = self.kinds[first]
        ds = self._without(*[n for n in (first, second) if n != into])
        return replace(ds, ends=ends).put({into: out}, contract, **{into: kind})

    def split(
        self, source: str, parts: dict[str, list[str]], distinct: Iterable[str] = ()
    ) -> Dataset:
        """SPLIT: vertical parts; a part with the whole key keeps the key."""
        self._not_edge(source)
        try:
            pieces = st.split(self[source], parts, set(distinct))
        except KeyError as e:
            raise Skip(str(e)) from None
        contract = self.contract
        key = contract.primary(source)
        kind = self.kinds[source]
        for name, piece in pieces.items():
            if name == source:
                for gone in set(self[source].columns) - set(piece.columns):
                    contract = contract.without_column(source, gone)
            elif key and set(key.columns) <= set(piece.columns):
                contract = contract.add(replace(key, entity=name))
        ds = self if source in parts else self._without(source)
        if source not in parts:
            contract = contract.without_entity(source)
        ds = ds.put(pieces, contract, **{n: kind for n in pieces})
        # Every part has the source's rows, or fewer.
        return ds._prove(*[
            (n, cols)
            for e, cols in self.proved
            if e == source
            for n, piece in pieces.items()
            if set(cols) <= set(piece.columns)
        ])

    def transform_to_relationship(
        self,
        entity: str,
        src: tuple[str, list[str]],
        dst: tuple[str, list[str]],
        *,
        drop: list[str] | None = None,
        cardinality: str = "0..n",
    ) -> Dataset:
        """TRANSFORM INTO RELATIONSHIP: ``src`` and ``dst`` name an entity and the columns
        that refer to it. They are read before they are dropped.

        ``cardinality`` says how many edges leave a source; ``check`` measures it. Rows that
        lack one of the ends make no edge and are handed back in ``rejected``."""
        self._not_edge(entity, src[0], dst[0])
        edges = G.to_edges(self[entity], src[1], dst[1], drop)
        lost = G.without_ends(self[entity], src[1], dst[1])
        contract = self.contract.without_entity(entity).add(
            *self._end_rules(entity, Ends(src[0], dst[0]), cardinality)
        )
        ds = self.put({entity: edges}, contract, **{entity: "edge"})
        return replace(ds, ends={**ds.ends, entity: Ends(src[0], dst[0])},
                       rejected={**ds.rejected, entity: lost})

    def transform_to_entity(self, entity: str, key: str = "id") -> Dataset:
        """TRANSFORM INTO ENTITY: the edge type becomes rows that keep both ends as columns."""
        if self.kinds.get(entity) != "edge":
            raise Skip(f"{entity!r} is not an edge type")
        out = G.to_entity(self[entity], key)
        ds = self.put({entity: out}, self.contract.add(Key(entity, (key,))), **{entity: "table"})
        return replace(ds, ends={n: e for n, e in ds.ends.items() if n != entity})

    # --- properties -----------------------------------------------------------------

    def add_property(
        self, path: str, dtype: str | T.DataType = "string", default: Any = None, *,
        not_null: bool = False,
    ) -> Dataset:
        entity, full = self._place(path)
        try:
            out = pr.add_property(self[entity], full, dtype, default)
        except KeyError as e:
            raise Skip(str(e)) from None
        rules = [Existence(entity, full)] if not_null else []
        return self.put({entity: out}, self.contract.add(*rules), same_rows=True)

    def delete_property(self, path: str) -> Dataset:
        """DELETE_PROPERTY: with the keys, references and checks that use it."""
        entity, full = self.locate(path)
        return self.put(
            {entity: pr.delete_property(self[entity], full)},
            self.contract.without_column(entity, full),
            same_rows=True,
        )

    def rename_property(self, path: str, new: str) -> Dataset:
        entity, full = self.locate(path)
        parent, _ = P.parent_of(full)
        try:
            out = pr.rename_property(self[entity], full, new)
        except KeyError as e:
            raise Skip(str(e)) from None
        to = f"{parent}.{new}" if parent else new
        known = [
            tuple(to if c == full else c for c in cols) for e, cols in self.proved if e == entity
        ]
        ds = self.put({entity: out}, self.contract.renamed_column(entity, full, to))
        return ds._prove(*[(entity, cols) for cols in known])

    def copy_property(
        self, source: str, to: str, on: dict[str, str], *, agg: str | None = None
    ) -> Dataset:
        s_entity, s_path = self.locate(source)
        t_entity, t_path = self._place(to)
        if not agg and not self.is_proved(s_entity, on.values()):
            require_unique(
                self.key_rows(s_entity, on.values()), list(on.values()), f"copy of {source}")
        out = pr.copy_property(
            self[t_entity], self[s_entity], s_path, on, t_path, agg=agg, check=False
        )
        return self.put({t_entity: out}, same_rows=True)

    def move_property(
        self, source: str, to: str, on: dict[str, str], *, agg: str | None = None
    ) -> Dataset:
        return self.copy_property(source, to, on, agg=agg).delete_property(source)

    def cast_property(self, path: str, dtype: str | T.DataType) -> Dataset:
        entity, full = self.locate(path)
        return self.put({entity: pr.cast_property(self[entity], full, dtype)})

    def add_embedded(
        self, path: str, structure: str | T.StructType, cardinality: str = "1..1"
    ) -> Dataset:
        entity, full = self._place(path)
        many = cardinality.endswith("n")
        out = pr.add_embedded(self[entity], full, structure, many=many)
        return self.put(
            {entity: out}, self.contract.add(Embedded(entity, full, cardinality)), same_rows=True)

    def delete_embedded(self, path: str) -> Dataset:
        entity, full = self.locate(path)
        try:
            out = pr.delete_embedded(self[entity], full)
        except KeyError as e:
            raise Skip(str(e)) from None
        return self.put(
            {entity: out}, self.contract.without_column(entity, full), same_rows=True)

    # --- entities -------------------------------------------------------------------

    def add_entity(
        self,
        name: str,
        properties: dict[str, str | T.DataType] | None = None,
        *,
        source: str | None = None,
        columns: dict[str, str] | None = None,
        key: list[str] | None = None,
    ) -> Dataset:
        """ADD_ENTITY: the distinct values of ``columns`` (source to new name) of a source
        entity, or with ``properties`` an empty frame of that schema."""
        if name in self:
            raise Skip(f"{name!r} exists already")
        if source:
            assert columns
            frame = self[source].select(
                *[P.column(c).alias(n) for c, n in columns.items()]
            ).distinct()
        else:
            schema = T.StructType(
                [T.StructField(n, spark_type(t)) for n, t in (properties or {}).items()]
            )
            some = next(iter(self.frames.values()))
            frame = some.sparkSession.createDataFrame([], schema)
        contract = self.contract.add(Key(name, tuple(key))) if key else self.contract
        ds = self.put({name: frame}, contract, **{name: "table"})
        return ds._prove((name, tuple(frame.columns)))

    def add_edge(
        self,
        name: str,
        source: str,
        target: str,
        *,
        holder: str,
        reference: list[str],
        drop_reference: bool = False,
        cardinality: str | None = None,
    ) -> Dataset:
        """ADD_ENTITY .. FROM .. TO: edges out of the reference columns of ``holder``.

        ``holder`` is whichever end holds the reference; the direction follows. ``cardinality``
        says how many edges leave a source. Without it both ends come from the rule on the
        reference columns, also if that was deleted before, else they are 0..n.
        """
        for end in (source, target, holder):
            if end not in self:
                raise Skip(f"no entity {end!r}")
        key = list(self.contract.key_columns(holder))
        if not key:
            raise Skip(f"{holder!r} has no key")
        from_parent = holder == target and source != target
        held = [r for r in (*self.contract.of(holder, Reference), *reversed(self.deleted))
                if r.entity == holder and r.columns == tuple(reference)]
        bounds = ("0..n", "0..n")
        if cardinality:
            bounds = (cardinality, "0..n")
        elif held:
            bounds = (held[0].cardinality, held[0].source_cardinality)
            bounds = bounds[::-1] if from_parent else bounds
        edges = G.edges_from_reference(self[holder], key, reference, from_parent=from_parent)
        ds = self
        if drop_reference:
            for c in reference:
                ds = ds.delete_property(f"{holder}.{c}")
        contract = ds.contract.add(*self._end_rules(name, Ends(source, target), *bounds))
        known = self.is_proved(holder, key)
        ds = ds.put({name: edges}, contract, **{name: "edge"})
        if known:
            # One edge per row of the holder.
            ds = ds._prove((name, ("dst" if from_parent else "src",)))
        return replace(ds, ends={**ds.ends, name: Ends(source, target)})

    def edge_to_reference(self, edge: str, holder: str, column: str) -> Dataset:
        """The reverse of :meth:`add_edge`: the edge type becomes a column of ``holder``."""
        if self.kinds.get(edge) != "edge":
            raise Skip(f"{edge!r} is not an edge type")
        ends = self.ends[edge]
        from_parent = holder == ends.target and ends.source != ends.target
        parent = ends.source if from_parent else ends.target
        known = self.is_proved(edge, ["dst" if from_parent else "src"])
        out = G.edges_to_reference(
            self[holder], self[edge], column, from_parent=from_parent, check=not known)
        key = list(self.contract.key_columns(parent))
        rules = [Reference(holder, (column,), parent, tuple(key), "0..1")] if len(key) == 1 else []
        ds = self._without(edge)
        contract = self.contract.without_entity(edge).add(*rules)
        return ds.put({holder: out}, contract, same_rows=True)

    def _end_rules(
        self, name: str, ends: Ends, leaving: str = "0..n", arriving: str = "0..n"
    ) -> list[Rule]:
        """What holds for an edge type: both ends exist, and so many edges leave and arrive."""
        rules: list[Rule] = []
        for col, entity, many in (
            ("src", ends.source, leaving), ("dst", ends.target, arriving)
        ):
            key = self.contract.key_columns(entity)
            if self.kinds.get(entity) == "vertex":
                key = ("id",)
            if len(key) == 1:
                rules.append(Reference(name, (col,), entity, key, source_cardinality=many))
        return rules

    def delete_entity(self, name: str) -> Dataset:
        """DELETE_ENTITY: with the references to it and the edge types that touch it."""
        self[name]
        touching = [n for n, e in self.ends.items() if name in e and n != name]
        contract = self.contract
        for n in [name, *touching]:
            contract = contract.without_entity(n)
        return replace(self._without(name, *touching), contract=contract)

    def delete_rows(self, entity: str, where: Column) -> Dataset:
        """Remove rows of an entity and the edges that would dangle."""
        kept = self[entity].where(~F.coalesce(where, F.lit(False)))
        changes = {entity: kept}
        key = ["id"] if self.kinds[entity] == "vertex" else list(self.contract.key_columns(entity))
        for name, ends in self.ends.items():
            edges = self[name]
            for col, end in (("src", ends.source), ("dst", ends.target)):
                if end == entity:
                    edges = G.without_dangling(edges, kept, col, key)
            if entity in ends:
                changes[name] = edges
        return self.put(changes, same_rows=True).rebased(*changes)

    def rename_entity(self, old: str, new: str) -> Dataset:
        """RENAME_ENTITY: references, edge ends and vertex labels follow."""
        frame = self[old]
        if new in self:
            raise Skip(f"{new!r} exists already")
        if self.kinds[old] == "vertex":
            frame = G.rename_label(frame, old, new)
        kind = self.kinds[old]
        ends = {
            (new if n == old else n): Ends(*(new if x == old else x for x in e))
            for n, e in self.ends.items()
        }
        known = [(new, cols) for e, cols in self.proved if e == old]
        ds = replace(self._without(old), ends=ends)
        ds = ds.put({new: frame}, self.contract.renamed_entity(old, new), **{new: kind})
        return ds._prove(*known)

    def copy_entity(
        self, source: str, as_: str, ends: tuple[str, str] | None = None
    ) -> Dataset:
        """COPY_ENTITY: an edge type needs the ends of the copy, anything else must not name any."""
        frame = self[source]
        if as_ in self:
            raise Skip(f"{as_!r} exists already")
        is_edge = self.kinds[source] == "edge"
        if is_edge != (ends is not None):
            raise Skip("ends are for edge types, and required there")
        rules = [replace(r, entity=as_) for r in self.contract.of(source)]
        if is_edge:
            rules = self._end_rules(as_, Ends(*ends))
        ds = self.put({as_: frame}, self.contract.add(*rules), **{as_: self.kinds[source]})
        return replace(ds, ends={**ds.ends, as_: Ends(*ends)}) if is_edge else ds

    def cast_entity(self, entity: str, model: str) -> Dataset:
        """CAST_ENTITY: re-encode an entity for another model."""
        self._not_edge(entity)
        if model not in KIND_OF_MODEL:
            raise Skip(f"unknown model {model!r}")
        df = self[entity]
        if self.kinds[entity] == "vertex":
            df = G.from_vertices(df)
        df = conform(df, model)
        if model == "graph":
            key = list(self.contract.key_columns(entity))
            if not key:
                raise Skip(f"{entity!r} has no key")
            df = G.to_vertices(df, key, entity)
        ds = self.put({entity: df}, same_rows=True, **{entity: KIND_OF_MODEL[model]})
        if model == "graph" and ds.is_proved(entity, self.contract.key_columns(entity)):
            ds = ds._prove((entity, ("id",)))
        return ds

    def add_label(self, entity: str, label: str, where: Column | None = None) -> Dataset:
        if self.kinds.get(entity) != "vertex":
            raise Skip(f"{entity!r} is not a vertex entity")
        return self.put({entity: G.add_label(self[entity], label, where)}, same_rows=True)

    def delete_label(self, entity: str, label: str, where: Column | None = None) -> Dataset:
        if self.kinds.get(entity) != "vertex":
            raise Skip(f"{entity!r} is not a vertex entity")
        return self.put({entity: G.delete_label(self[entity], label, where)}, same_rows=True)

    # --- keys and constraints -------------------------------------------------------

    def add_key(
        self,
        entity: str,
        columns: list[str],
        kind: str = "primary",
        *,
        natural: list[str] | None = None,
    ) -> Dataset:
        """ADD_*_KEY: a missing single column is made as a surrogate over ``natural`` columns."""
        df = self[entity]
        names = [c.split(" ")[0] for c in columns]
        missing = [c for c in names if not P.has(df.schema, c)]
        changes = {}
        if missing:
            if len(columns) != 1:
                raise Skip(f"{entity!r} lacks {missing}")
            cols = natural or df.columns
            df = df.withColumn(names[0], natural_key(*[P.column(c) for c in cols]))
            changes[entity] = df
        contract = self.contract
        if kind == "primary":
            old = contract.primary(entity)
            if old:
                contract = contract.remove(old)
                if len(old.columns) == len(names):
                    # References that named the old key now name the new one.
                    for r in contract.references_to(entity):
                        if r.parent_columns == old.columns:
                            contract = contract.remove(r).add(
                                replace(r, parent_columns=tuple(names))
                            )
        if kind in ("partition", "clustering"):
            for r in contract.of(entity, Key):
                if r.kind == kind:
                    contract = contract.remove(r)
                    columns = [*r.columns, *columns]
        return self.put(changes, contract.add(Key(entity, tuple(columns), kind)))

    def delete_key(self, entity: str, columns: list[str], kind: str = "primary") -> Dataset:
        """DELETE_*_KEY: the rule of exactly these columns."""
        rule = Key(entity, tuple(columns), kind)
        if rule not in self.contract.rules:
            raise Skip(f"{entity!r} has no {rule.name}")
        return replace(self, contract=self.contract.remove(rule))

    def add_reference(
        self,
        entity: str,
        columns: list[str],
        parent: str,
        parent_columns: list[str],
        cardinality: str = "1..1",
        *,
        enforced: bool = True,
    ) -> Dataset:
        """ADD_FOREIGN_KEY, or with ``enforced=False`` ADD_CONSTRAINT AS REFERENCE.

        Replaces a reference over the same columns. A missing column is added, empty, with
        the type of the key it names.
        """
        df, changes = self[entity], {}
        target = self[parent]
        for c, p in zip(columns, parent_columns):
            if not P.has(df.schema, c):
                df = pr.add_property(df, c, P.type_at(target.schema, p))
                changes[entity] = df
        new = Reference(
            entity, tuple(columns), parent, tuple(parent_columns), cardinality, enforced=enforced
        )
        same = [r for r in self.contract.of(entity, Reference) if r.columns == new.columns]
        return self.put(changes, self.contract.remove(*same).add(new))

    def delete_reference(self, entity: str, columns: list[str]) -> Dataset:
        same = [r for r in self.contract.of(entity, Reference) if r.columns == tuple(columns)]
        if not same:
            raise Skip(f"{entity!r} has no reference over {columns}")
        return replace(
            self, contract=self.contract.remove(*same), deleted=(*self.deleted, *same))

    def add_check(self, path: str, text: str, test: Predicate) -> Dataset:
        entity, full = self.locate(path)
        return replace(self, contract=self.contract.add(Check(entity, full, text, test)))

    def add_existence(self, path: str) -> Dataset:
        entity, full = self.locate(path)
        return replace(self, contract=self.contract.add(Existence(entity, full)))

    def delete_constraint(self, path: str) -> Dataset:
        """DELETE_CONSTRAINT: logical references, checks and existence at the field."""
        entity, full = self.locate(path)
        gone: list[Rule] = [
            r
            for r in self.contract.of(entity)
            if (isinstance(r, (Check, Existence)) and r.path == full)
            or (isinstance(r, Reference) and not r.enforced and full in r.columns)
        ]
        if not gone:
            raise Skip(f"no constraint at {path!r}")
        return replace(self, contract=self.contract.remove(*gone))

    def cast_constraint(self, entity: str, columns: list[str], kind: str) -> Dataset:
        """CAST_CONSTRAINT: another kind for the key over exactly these columns."""
        old = [r for r in self.contract.of(entity, Key) if r.columns == tuple(columns)]
        if not old:
            raise Skip(f"{entity!r} has no key over {columns}")
        return replace(
            self, contract=self.contract.remove(*old).add(Key(entity, tuple(columns), kind))
        )

    def recard(self, entity: str, columns: list[str], cardinality: str) -> Dataset:
        """RECARD: another target-end cardinality; the source end stays.

        For an edge type it is the number of edges that leave a source.
        """
        if self.kinds.get(entity) == "edge":
            old = [r for r in self.contract.of(entity, Reference) if r.columns == ("src",)]
            new = [replace(r, source_cardinality=cardinality) for r in old]
            return replace(self, contract=self.contract.remove(*old).add(*new))
        old = [r for r in self.contract.of(entity, Reference) if r.columns == tuple(columns)]
        if not old:
            raise Skip(f"{entity!r} has no reference over {columns}")
        new = [replace(r, cardinality=cardinality) for r in old]
        return replace(self, contract=self.contract.remove(*old).add(*new))

    def store(self, *entities: str) -> Dataset:
        """Write entities to the shared folder and go on from the written tables.

        For results that several later entities are made from: they are then computed once,
        read with only the columns each use needs, and survive lost executors.
        """
        names = entities or tuple(self.frames)
        spark = self[names[0]].sparkSession
        folder = new_folder(spark, "store")
        write_all(spark, {e: self[e].write.format("parquet") for e in names}, folder)
        return self.put(
            {e: spark.read.schema(self[e].schema).parquet(f"{folder}/{e}") for e in names},
            same_rows=True,
        ).rebased(*names)

    def deal(self, entity: str, columns: list[str]) -> Dataset:
        """Partition an entity's rows by columns that they are grouped by later (``nest`` with
        ``dealt``), before small entities nested into it widen them."""
        return self.put({entity: self[entity].repartition(*[P.column(c) for c in columns])}, same_rows=True)

    def rebased(self, *entities: str) -> Dataset:
        """Take the entities' present frames as their bases."""
        return replace(self, bases={**self.bases, **{e: self[e] for e in entities}})

    def check(self) -> DataFrame:
        """Every rule, measured on the data."""
        return check_contract(self.frames, self.contract)


# --- steps --------------------------------------------------------------------------

class Step(NamedTuple):
    """One operation by name, with its arguments."""

    op: str
    args: tuple
    kwargs: dict[str, Any]

    def __call__(self, ds: Dataset) -> Dataset:
        return getattr(ds, self.op)(*self.args, **self.kwargs)


def step(op: str, *args: Any, **kwargs: Any) -> Step:
    if not callable(getattr(Dataset, op, None)):
        raise ValueError(f"no operation {op!r}")
    return Step(op, args, kwargs)


@dataclass
class StepRecord:
    number: int
    op: str
    status: str
    reason: str
    entities: tuple[str, ...]
    counts: dict[str, Observation]


@dataclass
class StepLog:
    """What each step did; row counts arrive once the resulting frames have been written."""

    records: list[StepRecord] = field(default_factory=list)

    @property
    def clean(self) -> bool:
        return bool(self.records) and all(r.status == "ok" for r in self.records)

    def rows(self, written: Iterable[str]) -> list[tuple]:
        """One row per step and entity; counts only of entities that were written, since an
        unused frame is never computed."""
        done = set(written)
        out = []
        for r in self.records:
            if not r.entities:
                out.append((r.number, r.op, "", r.status, r.reason, None))
            for e in r.entities:
                seen = r.counts.get(e)
                n = seen.get["n"] if seen is not None and e in done else None
                out.append((r.number, r.op, e, r.status, r.reason, n))
        return out


LOG_SCHEMA = "step int, op string, entity string, status string, reason string, n_rows bigint"


def run_steps(
    ds: Dataset,
    steps: Iterable[Step | Callable[[Dataset], Dataset]],
    *,
    observe: Iterable[str] = (),
    strict: bool = True,
) -> tuple[Dataset, StepLog]:
    """Apply steps in order and log each as ok, skipped or error.

    For entities in ``observe`` each step's row count is measured while the final frames
    are computed, without a job of its own. With ``strict`` a failed step raises.
    """
    log, watched = StepLog(), set(observe)
    for number, one in enumerate(steps, 1):
        op = one.op if isinstance(one, Step) else getattr(one, "__name__", "step")
        try:
            new = one(ds)
        except Skip as e:
            if strict:
                raise
            log.records.append(StepRecord(number, op, "skipped", str(e), (), {}))
            continue
        except Exception as e:
            if strict:
                raise
            reason = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            log.records.append(StepRecord(number, op, "error", reason, (), {}))
            continue
        touched = tuple(n for n, f in new.frames.items() if ds.frames.get(n) is not f)
        counts: dict[str, Observation] = {}
        for n in touched:
            if n in watched:
                counts[n] = Observation(f"step{number}_{n}")
                new = new.put({n: new[n].observe(counts[n], F.count("*").alias("n"))})
        log.records.append(StepRecord(number, op, "ok", "", touched, counts))
        ds = new
    return ds, log
