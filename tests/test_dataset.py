"""Datasets: rules follow the data, preconditions skip, steps are logged."""

import pytest
from pyspark.sql import functions as F

from modelshift.dataset import Dataset, Skip, run_steps, step
from modelshift.functions import checks as C
from modelshift.operators.grouping import DuplicateKey
from modelshift.operators.rules import Contract, Embedded, Key, Reference
from modelshift.plans import trade


@pytest.fixture()
def ds(spark):
    people = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "pid int, name string, email string")
    orders = spark.createDataFrame([(10, 1, 5.0), (11, 1, 6.0), (12, None, 7.0)],
                                   "oid int, pid int, amount double")
    return Dataset({"people": people, "orders": orders}, Contract((
        Key("people", ("pid",)), Key("orders", ("oid",)),
        Reference("orders", ("pid",), "people", ("pid",), "0..1"))))


def test_nest_object_follows_reference(ds):
    out = ds.nest("people", "orders.buyer", {"pid": "pid"}, ["name"])
    assert "pid" not in out["orders"].columns
    assert Embedded("orders", "buyer", "0..1") in out.contract.rules
    assert not out.contract.of("orders", Reference)


def test_nest_array_follows_reference(ds):
    out = ds.nest("orders", "people.orders", {"pid": "pid"})
    assert {r.pid: len(r.orders) for r in out["people"].collect()} == {1: 2, 2: 0}
    assert Embedded("people", "orders", "0..n") in out.contract.rules


def test_nest_into_array_elements(ds, spark):
    goods = spark.createDataFrame([(1, "pen"), (2, "ink")], "gid int, title string")
    lists = spark.createDataFrame([(7, [(1, 3), (2, 4)]), (8, [])], "lid int, items array<struct<gid int, n int>>")
    both = Dataset({"goods": goods, "lists": lists}, Contract((Key("lists", ("lid",)),)))
    out = both.nest("goods", "lists.items.good", {"items.gid": "gid"}, ["title"])
    got = {r.lid: [(i.n, i.good.title) for i in r["items"]] for r in out["lists"].collect()}
    assert got == {7: [(3, "pen"), (4, "ink")], 8: []}


def test_key_counts_use_the_table_before_joins(ds):
    out = ds.nest("people", "orders.buyer", {"pid": "pid"}, ["name"])
    assert out.key_rows("orders", ["oid"]) is not out["orders"]
    assert "pid" not in out.bases["orders"].columns
    later = out.add_property("orders.pid", "Integer", 1)
    assert later.key_rows("orders", ["pid"]) is later["orders"]


def test_verdict(ds):
    from modelshift.operators.compare import migration_verdict, reconcile

    same = reconcile("people", ds["people"], ds["people"], ["pid"])
    fewer = reconcile("people", ds["people"], ds["people"].where("pid = 1"), ["pid"])
    assert migration_verdict(False, same) == "steps failed"
    assert migration_verdict(True, None) == "unverifiable"
    assert migration_verdict(True, same.unionByName(fewer)) == "rows lost"
    assert migration_verdict(True, same, ds.check()) == "ok"
    assert migration_verdict(True, same, ds.recard("orders", ["pid"], "1..1").check()) == "rules broken"


def test_rename_entity_moves_pointers(ds):
    out = ds.rename_entity("people", "clients")
    assert out.contract.of("orders", Reference)[0].parent == "clients"
    with pytest.raises(Skip):
        ds.rename_entity("people", "orders")


def test_rename_property_moves_rules(ds):
    out = ds.rename_property("people.pid", "id")
    assert out.contract.primary("people").columns == ("id",)
    assert out.contract.of("orders", Reference)[0].parent_columns == ("id",)


def test_delete_property_takes_rules_along(ds):
    out = ds.delete_property("orders.pid")
    assert not out.contract.of("orders", Reference)
    with pytest.raises(Skip):
        ds.delete_property("orders.nothing")


def test_delete_entity_takes_edges_along(ds):
    g = ds.add_edge("BOUGHT", "people", "orders", holder="orders", reference=["pid"])
    assert sorted(map(tuple, g["BOUGHT"].collect())) == [(1, 10), (1, 11)]
    assert "BOUGHT" not in g.delete_entity("people")


def test_edges_refuse_entity_operations(ds):
    g = ds.add_edge("BOUGHT", "people", "orders", holder="orders", reference=["pid"])
    for call in (lambda: g.split("BOUGHT", {"a": ["src"]}), lambda: g.cast_entity("BOUGHT", "graph"),
                 lambda: g.merge("BOUGHT", "people", "x"), lambda: g.copy_entity("BOUGHT", "B2"),
                 lambda: g.copy_entity("people", "p2", ("people", "orders"))):
        with pytest.raises(Skip):
            call()


def test_edge_and_back(ds):
    g = ds.add_edge("BOUGHT", "people", "orders", holder="orders", reference=["pid"],
                    drop_reference=True)
    g = g.cast_entity("people", "graph").cast_entity("orders", "graph")
    back = g.edge_to_reference("BOUGHT", "orders", "pid").cast_entity("orders", "relational")
    assert sorted(map(tuple, back["orders"].select("oid", "pid", "amount").collect())) == [
        (10, 1, 5.0), (11, 1, 6.0), (12, None, 7.0)]


def test_merge_relinks_and_first_key_wins(ds, spark):
    extra = spark.createDataFrame([(1, "m")], "pid int, sex string")
    both = ds.put({"extra": extra}, ds.contract.add(Key("extra", ("pid",))))
    out = both.merge("people", "extra", "persons", ["pid"])
    assert out.contract.of("orders", Reference)[0].parent == "persons"
    assert [k.columns for k in out.contract.of("persons", Key)] == [("pid",)]
    assert out["persons"].count() == 2


def test_split_keeps_key_only_where_whole(ds):
    out = ds.split("people", {"people": ["pid", "name"], "mails": ["pid", "email"],
                              "names": ["name"]})
    assert out.contract.primary("mails") and not out.contract.primary("names")
    assert out["people"].columns == ["pid", "name"]


def test_new_primary_key_relinks_references(ds):
    out = ds.add_key("people", ["uid"], natural=["name"])
    assert out.contract.of("orders", Reference)[0].parent_columns == ("uid",)
    assert out["people"].select("uid").distinct().count() == 2


def test_reference_upgrade_and_missing_column(ds):
    out = ds.add_reference("orders", ["pid"], "people", ["pid"], enforced=False)
    assert [r.enforced for r in out.contract.of("orders", Reference)] == [False]
    out = out.add_reference("orders", ["pid"], "people", ["pid"])
    assert [r.enforced for r in out.contract.of("orders", Reference)] == [True]
    out = out.add_reference("orders", ["helper"], "people", ["pid"], "0..1")
    assert out["orders"].schema["helper"].dataType.simpleString() == "int"


def test_constraints_come_and_go(ds):
    out = ds.add_check("orders.amount", "positive", C.compare(">", 0)).add_existence("orders.amount")
    assert out.check().where("violations > 0").count() == 0
    assert len(out.delete_constraint("orders.amount").contract.rules) == len(ds.contract.rules)
    with pytest.raises(Skip):
        ds.delete_constraint("orders.amount")


def test_recard_and_cast_constraint(ds):
    out = ds.recard("orders", ["pid"], "1..1")
    bad = {r.rule: r.violations for r in out.check().collect()}
    assert bad["reference(pid)->people(pid)"] == 1
    assert ds.cast_constraint("people", ["pid"], "node").contract.primary("people").kind == "node"


def test_partition_key_appends(ds):
    out = ds.add_key("orders", ["pid"], "partition").add_key("orders", ["amount"], "partition")
    assert [k.columns for k in out.contract.of("orders", Key) if k.kind == "partition"] == [
        ("pid", "amount")]


def test_proved_keys_follow_the_rows(ds, spark):
    known = ds.prove_keys()
    assert known.is_proved("people", ["pid"])
    assert known.rename_property("people.pid", "id").is_proved("people", ["id"])
    assert known.nest("people", "orders.buyer", {"pid": "pid"}).is_proved("orders", ["oid"])
    assert not known.cast_property("people.pid", "String").is_proved("people", ["pid"])
    assert not known.delete_property("people.pid").is_proved("people", ["pid"])
    twice = ds.put({"people": ds["people"].unionByName(ds["people"])})
    with pytest.raises(DuplicateKey):
        twice.prove_keys()


def test_steps_are_logged(ds, spark, tmp_path):
    def broken(_):
        raise RuntimeError("no luck")

    steps = [step("add_property", "people.age", "Integer", 3), step("unwind", "people.name"),
             broken, step("delete_rows", "people", F.col("pid") == 2)]
    out, log = run_steps(ds, steps, observe=["people"], strict=False)
    out["people"].write.parquet(str(tmp_path / "p"))
    got = [(r[1], r[3], r[5]) for r in log.rows(["people"])]
    assert got == [("add_property", "ok", 2), ("unwind", "skipped", None),
                   ("broken", "error", None), ("delete_rows", "ok", 1)]
    assert not log.clean
    with pytest.raises(Skip):
        run_steps(ds, [step("unwind", "people.name")])
    with pytest.raises(ValueError):
        step("no_such_operation")


def test_garbage_arguments_skip(ds):
    for call in (lambda: ds["nobody"], lambda: ds.flatten("people.name.x"),
                 lambda: ds.unflatten("people", ["zip"], "o"), lambda: ds.locate("people"),
                 lambda: ds.cast_entity("people", "spreadsheet"),
                 lambda: ds.delete_key("people", ["name"]), lambda: ds.recard("people", ["x"], "0..1"),
                 lambda: ds.add_label("people", "x"), lambda: ds.transform_to_entity("people")):
        with pytest.raises((Skip, KeyError)):
            call()


def test_d2r_contract_holds(spark, sf_dir):
    out = trade.migrate(spark, sf_dir, "d2r")
    assert out.check().where("violations > 0 AND rule NOT LIKE 'primary(order_id,line%'").count() == 0


def test_round_trip_of_directions(spark, sf_dir):
    from modelshift.operators.compare import same_rows

    before, after = trade.relational(spark, sf_dir), trade.migrate(spark, sf_dir, "c2r")
    for e in trade.ENTITIES:
        assert same_rows(before[e], after[e].select(*before[e].columns)).first().equal, e
