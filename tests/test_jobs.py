"""State-change jobs: invariants, the status machine, and order placement
against a one-by-one replay (SURVEY §5 items 3-5)."""
import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest

from stocksmith.operators import allocate, mutate as MU, validate as V
from stocksmith.operators import relations as R
from stocksmith.sources import schemas as S

REQ_SCHEMA = ("request_id long, line_no int, product_id long, quantity int, user_id long, notes string, "
              "created_at timestamp_ntz")


def _products(spark, stock: dict, deleted=()):
    rows = [(pid, None, f"p{pid}", None, Decimal("2.50"), s, 5, f"SKU-{pid}",
             dt.datetime(2020, 1, 1) if pid in deleted else None, None, None) for pid, s in stock.items()]
    return spark.createDataFrame(rows, S.PRODUCTS)


def replay(stock: dict, live: set, orders: list):
    """The application's rule, one order at a time."""
    stock = dict(stock)
    out = {}
    for rid, items in orders:
        if not items:
            out[rid] = "no_items"
        elif len({p for p, _ in items}) < len(items):
            out[rid] = "duplicate_product"
        elif any(p not in live for p, _ in items):
            out[rid] = "product_not_found"
        elif all(stock[p] >= q for p, q in items):
            for p, q in items:
                stock[p] -= q
            out[rid] = None
        else:
            out[rid] = "insufficient_stock"
    return out, stock


def _requests(spark, orders, t0=dt.datetime(2024, 1, 1)):
    rows = []
    for k, (rid, items) in enumerate(orders):
        ts = t0 + dt.timedelta(minutes=(k // 3) * 50)      # several orders share a time
        if not items:
            rows.append((rid, None, None, None, 1, None, ts))
        for ln, (p, q) in enumerate(items, 1):
            rows.append((rid, ln, p, q, 1, None, ts))
    return spark.createDataFrame(rows, REQ_SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 9, 10])
def test_place_orders_equals_sequential_replay(spark, seed):
    rnd = random.Random(seed)
    stock = {p: rnd.randint(0, 12) for p in range(1, 9)}
    deleted = {8}
    orders = []
    for rid in range(1, 61):
        k = rnd.choice([0, 1, 1, 2, 2, 3])
        items = [(rnd.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8]), rnd.randint(1, 6)) for _ in range(k)]
        orders.append((rid * 7, items))          # ids not in time order on purpose
    # the replay runs in (created_at, request_id) order, like the job
    keyed = sorted(enumerate(orders), key=lambda e: ((e[0] // 3), e[1][0]))
    exp, final = replay(stock, set(stock) - deleted, [o for _, o in keyed])
    pl = allocate.place_orders(_products(spark, stock, deleted), _requests(spark, orders))
    got = {r.request_id: r.reason for r in pl.decisions.collect()}
    assert got == exp
    new_stock = {r.id: r.stock_quantity for r in pl.products.collect()}
    assert new_stock == final
    audit = pl.audit.collect()
    assert all(r.quantity_after >= 0 for r in audit)
    # audit continuity: every row starts where the product's previous one ended
    assert R.audit_continuity(pl.audit).count() == 0
    placed = {r.id: r.total_amount for r in pl.orders.collect()}
    assert set(placed) == {k for k, v in exp.items() if v is None}


def test_placement_rounds_work_on_fewer_rows(spark):
    rng = random.Random(3)
    orders = [(i, [(p, rng.randint(1, 4)) for p in rng.sample(range(1, 9), rng.randint(1, 3))]) for i in range(1, 120)]
    pl = allocate.place_orders(_products(spark, {p: 40 for p in range(1, 9)}), _requests(spark, orders))
    assert pl.rows[-1] == 0 and pl.rows == sorted(pl.rows, reverse=True) and len(pl.rows) == pl.rounds > 1


def test_two_orders_for_the_last_unit(spark):
    pl = allocate.place_orders(_products(spark, {1: 1, 2: 5}),
                               _requests(spark, [(1, [(1, 1)]), (2, [(1, 1), (2, 1)]), (3, [(2, 5)])]))
    got = {r.request_id: r.reason for r in pl.decisions.collect()}
    # order 2 fails on product 1 and so frees product 2 for order 3
    assert got == {1: None, 2: "insufficient_stock", 3: None}


# ------------------------------------------------------------------ status machine
def _orders(spark, rows):
    return spark.createDataFrame([(i, u, s, Decimal("1.00"), None, None, None) for i, u, s in rows], S.ORDERS)


def test_all_36_status_pairs(spark):
    pairs = list(itertools.product(S.ORDER_STATUSES, S.ORDER_STATUSES))
    orders = _orders(spark, [(i, 1, a) for i, (a, _) in enumerate(pairs)])
    req = spark.createDataFrame([(i, b, 99, "admin", 1) for i, (_, b) in enumerate(pairs)],
                                "order_id long, status string, actor_id long, actor_role string, seq long")
    out = MU.advance_status(orders, req).extra["requests"].collect()
    legal = sorted((pairs[r.order_id]) for r in out if r.accepted)
    assert legal == sorted(S.transitions()) and len(legal) == 6


def test_several_requests_per_order_fold_in_seq_order(spark):
    orders = _orders(spark, [(1, 5, "pending"), (2, 5, "pending"), (3, 6, "packed")])
    req = spark.createDataFrame([
        (1, "packed", 0, "admin", 1), (1, "confirmed", 0, "admin", 2), (1, "packed", 0, "admin", 3),
        (1, "cancelled", 0, "admin", 4), (1, "shipped", 0, "admin", 5),
        (2, "cancelled", 6, "user", 1), (2, "confirmed", 5, "user", 2), (2, "cancelled", 5, "user", 3),
        (3, "cancelled", 0, "admin", 1), (4, "confirmed", 0, "admin", 1)],
        "order_id long, status string, actor_id long, actor_role string, seq long")
    res = MU.advance_status(orders, req)
    got = {(r.order_id, r.seq): r.reason for r in res.extra["requests"].collect()}
    assert got == {(1, 1): "invalid_transition", (1, 2): None, (1, 3): None, (1, 4): "invalid_transition",
                   (1, 5): None, (2, 1): "not_owner", (2, 2): "admin_only", (2, 3): None,
                   (3, 1): "invalid_transition", (4, 1): "not_found"}
    assert {r.id: r.status for r in res.table.collect()} == {1: "shipped", 2: "cancelled", 3: "packed"}
    assert {r.order_id for r in res.extra["cancelled"].collect()} == {2}


def test_cancel_returns_stock_also_to_deleted_products(spark):
    prods = _products(spark, {1: 0, 2: 4}, deleted={2})
    items = spark.createDataFrame([(10, 1, 1, 3, Decimal("1.00")), (10, 2, 2, 2, Decimal("1.00"))], S.ORDER_ITEMS)
    cancelled = spark.createDataFrame([(10, 7)], "order_id long, actor_id long")
    r = MU.cancel_orders(prods, items, cancelled)
    assert {x.id: x.stock_quantity for x in r.table.collect()} == {1: 3, 2: 6}
    assert sorted((a.product_id, a.quantity_before, a.quantity_after, a.reason) for a in r.audit.collect()) == [
        (1, 0, 3, "order_cancelled"), (2, 4, 6, "order_cancelled")]


# ------------------------------------------------------------------ other changes
def test_restock_invariants(spark):
    prods = _products(spark, {1: 5, 2: 0}, deleted={2})
    req = spark.createDataFrame([
        (1, 0, 1, 10, 3, dt.datetime(2024, 1, 2)), (2, 0, 1, 20, 3, dt.datetime(2024, 1, 1)),
        (3, 0, 1, 10001, 3, dt.datetime(2024, 1, 3)), (4, 0, 2, 5, 3, dt.datetime(2024, 1, 3)),
        (5, 0, 9, 5, 3, dt.datetime(2024, 1, 3))],
        "request_id long, line_no int, product_id long, quantity int, actor_id long, requested_at timestamp_ntz")
    r = MU.restock(prods, req)
    assert {x.id: x.stock_quantity for x in r.table.collect()} == {1: 35, 2: 0}
    assert sorted((a.ref_id, a.quantity_before, a.quantity_after) for a in r.audit.collect()) == [
        (1, 25, 35), (2, 5, 25)]
    assert {x.request_id: x.reason for x in r.rejected.collect()} == {
        3: "invalid_quantity", 4: "not_found", 5: "not_found"}


def test_upsert_modes(spark):
    cats = spark.createDataFrame([(1, "A", "a", None), (2, "B", "b", None)], S.CATEGORIES)
    batch = spark.createDataFrame([(1, "B", "b1"), (2, "C", "c"), (3, "B", "b2")],
                                  "seq long, name string, description string")
    rej = MU.upsert(cats, batch, "name", "reject")
    assert sorted((r.name, r.seq, r.reason) for r in rej.rejected.collect()) == [("B", 1, "conflict"), ("B", 3, "conflict")]
    assert sorted((r.id, r.name) for r in rej.table.collect()) == [(1, "A"), (2, "B"), (4, "C")]
    upd = MU.upsert(cats, batch, "name", "update", update_cols=["description"])
    assert sorted((r.name, r.description) for r in upd.table.collect()) == [("A", "a"), ("B", "b2"), ("C", "c")]
    ign = MU.upsert(cats, batch, "name", "ignore")
    assert sorted((r.name, r.description) for r in ign.table.collect()) == [("A", "a"), ("B", "b"), ("C", "c")]


def test_upsert_one_request_after_the_other(spark):
    """The first of a new name is stored, later ones are refused; NULL keys and bad sequence numbers are, too."""
    cats = spark.createDataFrame([(1, "A", "a", None)], S.CATEGORIES)
    batch = spark.createDataFrame([(5, "N", "first"), (6, "N", "second"), (7, None, "x"), (8, None, "y"), (None, "P", "p"),
                                   (0, "Q", "q"), (9, "R", "r"), (9, "T", "t")], "seq long, name string, description string")
    why = [("N", 6, "duplicate_in_batch"), ("P", None, "invalid_seq"), ("Q", 0, "invalid_seq"), ("R", 9, "duplicate_seq"),
           ("T", 9, "duplicate_seq"), (None, 7, "key_required"), (None, 8, "key_required")]
    r = MU.upsert(cats, batch, "name", "reject")
    assert sorted((x.id, x.name, x.description) for x in r.table.collect()) == [(1, "A", "a"), (6, "N", "first")]
    assert sorted(map(tuple, r.rejected.collect()), key=str) == sorted(why, key=str)
    r = MU.upsert(cats, batch, "name", "ignore")
    assert sorted((x.name, x.description) for x in r.table.collect()) == [("A", "a"), ("N", "first")]
    r = MU.upsert(cats, batch, "name", "update", update_cols=["description"])
    assert sorted((x.id, x.name, x.description) for x in r.table.collect()) == [(1, "A", "a"), (6, "N", "second")]


def test_each_patch_stands_or_falls_alone(spark):
    prods = spark.createDataFrame([(1, 1, "p", None, Decimal("1.00"), 0, 0, "s", None, None, None)], S.PRODUCTS)
    cats = spark.createDataFrame([(1, "A", None, None), (2, "B", None, None)], S.CATEGORIES)
    patch = lambda rows: MU.patch(prods, spark.createDataFrame(rows, "id long, seq long, category_id int, name string"),
                                  ["category_id", "name"], references={"category_id": cats})
    r = patch([(1, 1, 2, None), (1, 2, 99, None)])         # good, then bad
    assert [x.category_id for x in r.table.collect()] == [2]
    assert [tuple(x) for x in r.rejected.collect()] == [(1, 2, "unknown_category_id")]
    r = patch([(1, 1, 99, "lost"), (1, 2, 2, None)])       # the refused one's name is not applied
    assert [(x.category_id, x.name) for x in r.table.collect()] == [(2, "p")]


def test_missing_tables_are_refused(spark):
    import pytest
    from stocksmith.operators import validate as V
    cats = spark.createDataFrame([(1, "A", None, None)], S.CATEGORIES)
    for check in (R.fk_orphans, R.unique_violations, V.table_audit):
        with pytest.raises(ValueError):
            check({"categories": cats})


def test_trim_as_the_application_does(spark):
    from stocksmith.operators import validate as V
    rows = [("\t\n", "S1"), (" a\u00a0", "AB\n"), ("b", "A B"), ("c\u2003", "\tx-1 ")]
    df = spark.createDataFrame([(n, s, Decimal("1.00"), 0, 0) for n, s in rows],
                               "name string, sku string, price decimal(10,2), stock_quantity int, low_stock_threshold int")
    assert [(r.name, r.sku, r.reason) for r in V.products(df).collect()] == [
        ("", "S1", "name_required"), ("a", "AB", None), ("b", "A B", "invalid_sku"), ("c", "x-1", None)]


def test_patch_keeps_nulls_and_last_value_wins(spark):
    prods = _products(spark, {1: 5, 2: 5}, deleted={2})
    batch = spark.createDataFrame([(1, 1, "new", None), (1, 2, None, Decimal("9.99")), (1, 3, "newer", None),
                                   (2, 1, "x", None)],
                                  "id long, seq long, name string, price decimal(10,2)")
    r = MU.patch(prods, batch, ["name", "price"], live_only=True)
    row = {x.id: x for x in r.table.collect()}
    assert (row[1].name, row[1].price, row[1].updated_at is not None) == ("newer", Decimal("9.99"), True)
    assert row[2].name == "p2"
    assert {(x.id, x.reason) for x in r.rejected.collect()} == {(2, "not_found")}


def test_soft_and_hard_delete(spark):
    prods = _products(spark, {1: 5, 2: 5, 3: 5}, deleted={3})
    sd = MU.soft_delete(prods, spark.createDataFrame([(1,), (3,), (4,)], "id long"))
    assert {x.id for x in sd.table.collect() if x.deleted_at is not None} == {1, 3}
    assert sorted(x.id for x in sd.rejected.collect()) == [3, 4]
    tables = {
        "users": spark.createDataFrame([(1, "u", "u@x.io", "user", None), (2, "v", "v@x.io", "user", None)], S.USERS),
        "orders": _orders(spark, [(10, 1, "pending"), (11, 2, "pending")]),
        "order_items": spark.createDataFrame([(10, 1, 1, 1, Decimal("1.00")), (11, 1, 2, 1, Decimal("1.00"))],
                                             S.ORDER_ITEMS),
        "products": prods,
        "stock_audit_log": spark.createDataFrame([(1, 1, 0, 5, "manual_restock", None, None, None)],
                                                 S.STOCK_AUDIT_LOG),
    }
    hd = MU.hard_delete(tables, "users", spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in hd.extra["orders"].collect()] == [11]
    assert [r.order_id for r in hd.extra["order_items"].collect()] == [11]
    assert [r.changed_by for r in hd.extra["stock_audit_log"].collect()] == [None]
    hp = MU.hard_delete(tables, "products", spark.createDataFrame([(1,), (3,)], "id long"))
    assert [(r.id, r.reason) for r in hp.rejected.collect()] == [(1, "restricted")]
    assert sorted(r.id for r in hp.table.collect()) == [1, 2]
    assert hp.extra["stock_audit_log"].count() == 1      # product 1 was not deleted


def test_register_users(spark):
    users = spark.createDataFrame([(1, "u", "taken@x.io", "user", None)], S.USERS)
    batch = spark.createDataFrame([(1, " Ann ", " ANN@X.io ", None), (2, "Bob", "ann@x.io", None),
                                   (3, "Cy", "Taken@x.io", None), (4, "Di", "bad", None), (5, "Ed", "e@x.io", "admin"),
                                   (6, "  ", "f@x.io", None)], "seq long, name string, email string, role string")
    r = MU.register_users(users, batch)
    assert sorted((x.id, x.name, x.email, x.role) for x in r.table.collect()) == [
        (1, "u", "taken@x.io", "user"), (2, "Ann", "ann@x.io", "user")]
    assert {x.seq: x.reason for x in r.rejected.collect()} == {
        2: "duplicate_in_batch", 3: "email_taken", 4: "invalid_email", 5: "admin_not_allowed", 6: "name_required"}


def test_validate_orders_rules(spark):
    req = spark.createDataFrame([
        (1, None, None, None, 1, None, None), (2, 1, 0, 1, 1, None, None), (3, 1, 5, 1001, 1, None, None),
        (4, 1, 5, 1, 1, "x" * 501, None), (5, 1, 5, 1, 1, None, None), (5, 2, 5, 2, 1, None, None),
        (6, 1, 5, 1, 1, "  " + "y" * 500 + "  ", None)], REQ_SCHEMA)
    got = {r.request_id: r.reason for r in V.orders(req).collect()}
    assert got == {1: "no_items", 2: "invalid_product_id", 3: "invalid_quantity", 4: "notes_too_long",
                   5: "duplicate_product", 6: None}


def test_validate_products_and_patches(spark):
    b = spark.createDataFrame([("ok", Decimal("1.00"), "A-1_b", 0, 0), ("", Decimal("1.00"), "A", 0, 0),
                               ("n", Decimal("0.00"), "A", 0, 0), ("n", Decimal("1.00"), "A B", 0, 0),
                               ("n", Decimal("1.00"), "A", -1, 0), ("n" * 201, Decimal("1.00"), "A", 0, 0)],
                              "name string, price decimal(10,2), sku string, stock_quantity int, low_stock_threshold int")
    assert [r.reason for r in V.products(b).collect()] == [
        None, "name_required", "invalid_price", "invalid_sku", "invalid_stock_quantity", "name_too_long"]


def test_patch_rejects_unknown_category(spark):
    prods = _products(spark, {1: 5, 2: 5})
    cats = spark.createDataFrame([(3, "C", None, None)], S.CATEGORIES)
    batch = spark.createDataFrame([(1, 1, 3), (2, 1, 99)], "id long, seq long, category_id int")
    r = MU.patch(prods, batch, ["category_id"], references={"category_id": cats})
    assert {x.id: x.category_id for x in r.table.collect()} == {1: 3, 2: None}
    assert [(x.id, x.reason) for x in r.rejected.collect()] == [(2, "unknown_category_id")]


def test_placement_accepted_flag_is_never_null(spark):
    pl = allocate.place_orders(_products(spark, {1: 1}), _requests(spark, [(1, [(1, 1)]), (2, [(1, 1)]), (3, [])]))
    assert {r.request_id: r.accepted for r in pl.decisions.collect()} == {1: True, 2: False, 3: False}


def _status_replay(orders: dict, owners: dict, requests: list):
    """The controller's rule, one request at a time in seq order."""
    legal = set(S.transitions())
    state = dict(orders)
    out = {}
    for oid, target, actor, role, seq in sorted(requests, key=lambda r: r[4]):
        if oid not in state:
            out[(oid, seq)] = "not_found"
        elif role != "admin" and target != "cancelled":
            out[(oid, seq)] = "admin_only"
        elif role != "admin" and owners[oid] != actor:
            out[(oid, seq)] = "not_owner"
        elif (state[oid], target) in legal:
            state[oid] = target
            out[(oid, seq)] = None
        else:
            out[(oid, seq)] = "invalid_transition"
    return out, state


@pytest.mark.parametrize("seed", [5, 6, 7, 8])
def test_advance_status_equals_sequential_replay(spark, seed):
    rnd = random.Random(seed)
    orders = {i: rnd.choice(S.ORDER_STATUSES) for i in range(1, 25)}
    owners = {i: rnd.randint(1, 4) for i in orders}
    reqs, seq = [], 0
    for _ in range(140):
        seq += rnd.randint(1, 3)
        oid = rnd.randint(1, 26)                      # 25, 26 do not exist
        role = rnd.choice(["admin", "admin", "user"])
        reqs.append((oid, rnd.choice(S.ORDER_STATUSES), rnd.randint(1, 4), role, seq))
    exp, final = _status_replay(orders, owners, reqs)
    odf = spark.createDataFrame([(i, owners[i], s, Decimal("1.00"), None, None, None) for i, s in orders.items()],
                                S.ORDERS)
    rdf = spark.createDataFrame(reqs, "order_id long, status string, actor_id long, actor_role string, seq long")
    res = MU.advance_status(odf, rdf)
    assert {(r.order_id, r.seq): r.reason for r in res.extra["requests"].collect()} == exp
    assert {r.id: r.status for r in res.table.collect()} == final
