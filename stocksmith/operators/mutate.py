"""State changes as batch jobs over table snapshots (M1-M5, M7-M9, S2, S5).

The application changes one row per HTTP request.  Here every job takes the
current tables plus a DataFrame of requests and returns the new tables and a
``rejected`` DataFrame with a reason; nothing loops over rows on the driver.
New ids are ``max(id)`` (a scalar subquery) plus the request's own positive,
unique ``seq``, so no global numbering window is needed.  Jobs stamp rows
with one ``as_of`` time passed in, so reruns give equal output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..session import DEFAULT_AS_OF, ts_lit
from ..sources import schemas as S
from . import relations as R
from . import validate as V


@dataclass
class Result:
    table: DataFrame
    rejected: DataFrame
    audit: DataFrame | None = None
    extra: dict | None = None


def _reject(df: DataFrame, key_cols: list[str], reason: Column | str) -> DataFrame:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(*key_cols, r.alias("reason"))


def _as_of(as_of) -> Column:
    return ts_lit(as_of or DEFAULT_AS_OF)


def _next_ids(table: DataFrame, batch: DataFrame, seq: str = "seq") -> Column:
    max_id = table.select(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    return (max_id + F.col(seq)).cast("bigint")


def _conform(df: DataFrame, schema) -> DataFrame:
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ S2
def apply_defaults(df: DataFrame, table: str, as_of=None) -> DataFrame:
    """Fill the declared defaults of ``table`` where a value is missing."""
    now = _as_of(as_of)
    fill = {
        "users": {"role": F.lit(S.DEFAULTS["role"]), "created_at": now},
        "categories": {"created_at": now},
        "products": {"stock_quantity": F.lit(S.DEFAULTS["stock_quantity"]),
                     "low_stock_threshold": F.lit(S.DEFAULTS["low_stock_threshold"]),
                     "created_at": now, "updated_at": now},
        "orders": {"status": F.lit(S.DEFAULTS["status"]), "created_at": now, "updated_at": now},
        "stock_audit_log": {"changed_at": now},
    }[table]
    for c, v in fill.items():
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c), v.cast(df.schema[c].dataType)))
    return df


# ------------------------------------------------------------------ M1
def _numbered(batch: DataFrame, seq: str, within: list[str] | None = None, positive: bool = True) -> DataFrame:
    """``_bad_seq``: why a row's sequence number cannot order the batch, or its
    rows with the same ``within`` (NULL: it can)."""
    keys = [*(within or []), seq]
    invalid = F.col(seq).isNull() | (F.col(seq) < 1) if positive else F.col(seq).isNull()
    # one row for each number that stands twice; numbers that are none are not counted
    times = batch.filter(~invalid).groupBy(*keys).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    times = times.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_times")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    b = batch.join(times, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    bad = F.when(invalid, "invalid_seq").when(F.col("_times") > 1, "duplicate_seq")
    return b.withColumn("_bad_seq", bad).drop("_times")


def upsert(table: DataFrame, batch: DataFrame, key: str, on_conflict: str = "reject",
           update_cols: list[str] | None = None, seq: str = "seq", schema=None, as_of=None) -> Result:
    """Insert batch rows one after the other in ``seq`` order.

    A row whose unique ``key`` exists already, in the table or by an earlier row of
    the batch, is rejected ('conflict' or 'duplicate_in_batch', mode
    'reject'), skipped ('ignore') or sets ``update_cols`` ('update': the last row
    wins; a new key keeps the other columns of its first row).  A NULL key is
    rejected ('key_required') in every mode, so is a ``seq`` that is NULL, below 1 or
    not unique, as new ids are made from it.  ``rejected``: key, seq, reason."""
    if on_conflict not in ("reject", "update", "ignore"):
        raise ValueError(on_conflict)
    b = _numbered(batch, seq)
    bad = F.coalesce(F.when(F.col(key).isNull(), "key_required"), F.col("_bad_seq"))
    rejected = b.filter(bad.isNotNull()).select(key, seq, bad.alias("reason"))
    b = b.filter(bad.isNull()).drop("_bad_seq")
    others = [c for c in b.columns if c != key]
    per_key = b.groupBy(key).agg(F.min_by(F.struct(*others), F.col(seq)).alias("_first"),
                                 F.max_by(F.struct(*others), F.col(seq)).alias("_last"))
    cols = update_cols or [c for c in others if c not in (seq, "id") and c in table.columns]
    fresh = R.id_set_conflict(per_key, table, key, keep="new")
    new_rows = fresh.select(key, *[F.col(f"_{'last' if on_conflict == 'update' and c in cols else 'first'}.{c}").alias(c)
                                   for c in others])
    new_rows = new_rows.withColumn("id", _next_ids(table, new_rows, seq))
    if "created_at" in table.columns:
        new_rows = new_rows.withColumn("created_at", F.coalesce(
            F.col("created_at") if "created_at" in new_rows.columns else F.lit(None).cast("timestamp_ntz"),
            _as_of(as_of)))
    out = table
    if on_conflict == "update":
        upd = R.id_set_conflict(per_key, table, key, keep="conflicts")
        upd = upd.select(key, F.lit(True).alias("_m"), *[F.col(f"_last.{c}").alias(f"_new_{c}") for c in cols])
        out = table.join(upd, key, "left")
        for c in cols:
            out = out.withColumn(c, F.when(F.col("_m").isNotNull(), F.col(f"_new_{c}").cast(table.schema[c].dataType))
                                 .otherwise(F.col(c)))
        out = out.select(*table.columns)
    schema = schema or table.schema
    out = out.unionByName(_conform(new_rows, schema).select(*table.columns))
    if on_conflict == "reject":
        first = fresh.select(key, F.col(f"_first.{seq}").alias("_first_seq"))
        late = b.select(key, seq).join(first, key, "left")
        reason = F.when(F.col("_first_seq").isNull(), "conflict").when(F.col(seq) != F.col("_first_seq"), "duplicate_in_batch")
        rejected = rejected.unionByName(late.select(key, seq, reason.alias("reason")).filter("reason is not null"))
    return Result(out, rejected)


# ------------------------------------------------------------------ M2
def patch(table: DataFrame, batch: DataFrame, fields: list[str], key: str = "id", seq: str = "seq",
          live_only: bool = False, stamp: str | None = "updated_at", as_of=None,
          references: dict[str, DataFrame] | None = None) -> Result:
    """Partial updates, one after the other in ``seq`` order: a NULL field
    keeps the old value.  Each request stands or falls alone: one whose key does not
    exist (or is deleted, with ``live_only``) is rejected ('not_found'), one
    whose foreign-key field names no row of its parent table
    (``references``: field -> parent table) as 'unknown_<field>', as the database
    would refuse it, one whose ``seq`` is NULL, below 1 ('invalid_seq') or also that of another
    patch of the key ('duplicate_seq': both, as none is the later one); the others
    apply.  ``rejected``: key, seq, reason."""
    target = (table.filter(P.live()) if live_only else table).select(key, F.lit(True).alias("_found"))
    b = _numbered(batch, seq, [key]).join(target, key, "left")
    reason = F.when(F.col("_found").isNull(), "not_found").when(F.col("_bad_seq").isNotNull(), F.col("_bad_seq"))
    for f, parent in (references or {}).items():
        ids = parent.select(F.col("id").cast(table.schema[f].dataType).alias(f"_ref_{f}"), F.lit(True).alias(f"_has_{f}"))
        b = b.join(ids, b[f].cast(table.schema[f].dataType) == ids[f"_ref_{f}"], "left")
        reason = reason.when(F.col(f).isNotNull() & F.col(f"_has_{f}").isNull(), f"unknown_{f}")
    b = b.withColumn("_reason", reason)
    ok = b.filter(F.col("_reason").isNull()).groupBy(key).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f"_p_{f}") for f in fields],
        F.lit(True).alias("_patched"))
    out = table.join(ok, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_p_{f}").cast(table.schema[f].dataType), F.col(f)))
    if stamp and stamp in table.columns:
        out = out.withColumn(stamp, F.when(F.col("_patched").isNotNull(), _as_of(as_of)).otherwise(F.col(stamp)))
    rejected = b.filter(F.col("_reason").isNotNull()).select(key, seq, F.col("_reason").alias("reason"))
    return Result(out.select(*table.columns), rejected)


# ------------------------------------------------------------------ M3
def soft_delete(products: DataFrame, ids: DataFrame, as_of=None, key: str = "id") -> Result:
    """Stamp deleted_at on live products; unknown or already deleted ids are
    rejected ('not_found')."""
    req = ids.select(F.col(key).alias("id")).filter(F.col("id").isNotNull()).distinct()
    live_ids = products.filter(P.live()).select("id")
    hit = req.join(live_ids, "id", "left_semi").withColumn("_del", F.lit(True))
    out = products.join(hit, "id", "left").withColumn(
        "deleted_at", F.when(F.col("_del").isNotNull(), _as_of(as_of)).otherwise(F.col("deleted_at")))
    rejected = _reject(req.join(live_ids, "id", "left_anti"), ["id"], "not_found")
    return Result(out.select(*products.columns), rejected)


# ------------------------------------------------------------------ M4
def hard_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame, key: str = "id") -> Result:
    """Delete rows of ``table`` by id and apply the foreign-key rules of the
    schema: RESTRICT rejects ids still referenced, CASCADE deletes children
    (recursively), SET NULL clears the reference.  ``tables`` must hold every
    table that a rule reaches from ``table``: without one the delete is refused
    with an error, as its rule could not be kept.  ``Result.extra`` holds
    every new table; ``Result.table`` is the new ``table``."""
    absent = sorted(_children(table) - set(tables))
    if absent:
        raise ValueError(f"deleting from {table} needs the tables that refer to it: {', '.join(absent)}")
    req = ids.select(F.col(key).cast("bigint").alias("id")).filter(F.col("id").isNotNull()).distinct()
    blocked = None
    for child, col, parent, rule in S.FOREIGN_KEYS:
        if parent == table and rule == "restrict":
            refs = tables[child].select(F.col(col).cast("bigint").alias("id"))
            b = req.join(refs, "id", "left_semi")
            blocked = b if blocked is None else blocked.unionByName(b)
    exists = req.join(tables[table].select(F.col("id").cast("bigint").alias("id")), "id", "left_semi")
    rejected = _reject(req.join(exists, "id", "left_anti"), ["id"], "not_found")
    go = exists
    if blocked is not None:
        rejected = rejected.unionByName(_reject(blocked.distinct(), ["id"], "restricted"))
        go = exists.join(blocked, "id", "left_anti")
    new = dict(tables)
    _delete_cascade(new, table, go)
    return Result(new[table], rejected, extra=new)


def _children(table: str) -> set[str]:
    """The tables whose rows a delete from ``table`` can be refused for, change or delete."""
    found: set[str] = set()
    for child, _, parent, rule in S.FOREIGN_KEYS:
        if parent == table and child not in found:
            found |= {child} | (_children(child) if rule == "cascade" else set())
    return found


def _delete_cascade(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> None:
    """Delete ``ids`` from ``table`` and apply each FK rule to its children."""
    doomed = ids.select(F.col("id").cast("bigint").alias("_ref"), F.lit(True).alias("_hit"))
    for child, col, parent, rule in S.FOREIGN_KEYS:
        if parent != table:
            continue
        c = tables[child]
        if rule == "cascade":
            if "id" in c.columns and any(p == child for _, _, p, _ in S.FOREIGN_KEYS):
                gone = c.join(doomed, c[col].cast("bigint") == doomed["_ref"], "left_semi") \
                    .select(F.col("id").cast("bigint").alias("id"))
                _delete_cascade(tables, child, gone)
                c = tables[child]
            tables[child] = c.join(doomed, c[col].cast("bigint") == doomed["_ref"], "left_anti")
        elif rule == "set_null":
            j = c.join(doomed, c[col].cast("bigint") == doomed["_ref"], "left")
            tables[child] = j.withColumn(col, F.when(F.col("_hit").isNotNull(), F.lit(None))
                                         .otherwise(F.col(col)).cast(c.schema[col].dataType)).select(*c.columns)
        # restrict: checked before the delete by the caller
    t = tables[table]
    tables[table] = t.join(doomed, t["id"].cast("bigint") == doomed["_ref"], "left_anti")


# ------------------------------------------------------------------ M5
def restock(products: DataFrame, requests: DataFrame, as_of=None,
            max_quantity: int = S.MAX_RESTOCK_QUANTITY) -> Result:
    """Add stock to live products.  ``requests``: request_id, line_no,
    product_id, quantity, actor_id, requested_at.  Invalid quantities (V4)
    and unknown or deleted products are rejected; each accepted request
    writes an audit row with the true running stock (W3)."""
    checked = V.restocks(requests, max_quantity)
    live_ids = products.filter(P.live()).select(F.col("id").alias("product_id"))
    checked = checked.join(live_ids.withColumn("_live", F.lit(True)), "product_id", "left")
    checked = checked.withColumn("reason", F.coalesce(
        F.col("reason"), F.when(F.col("_live").isNull(), F.lit("not_found"))))
    ok, bad = V.split(checked.drop("_live"))
    moves = ok.select("product_id", F.col("actor_id").alias("changed_by"), F.col("quantity").alias("delta"),
                      F.lit(S.REASON_RESTOCK).alias("reason"), F.col("requested_at").alias("changed_at"),
                      F.col("request_id").alias("ref_id"), "line_no")
    return _apply_movements(products, moves, as_of, bad.select("request_id", "line_no", "product_id", "reason"))


def _apply_movements(products: DataFrame, moves: DataFrame, as_of, rejected: DataFrame) -> Result:
    """New stock = old + sum of movements per product (an aggregate, joined
    back), and the audit rows of the movements over the old stock."""
    start = products.select(F.col("id").alias("product_id"), "stock_quantity")
    touched = moves.groupBy("product_id").agg(F.sum("delta").alias("_d"))
    audit = R.stock_ledger(moves, start=start)
    out = products.join(touched.withColumnRenamed("product_id", "id"), "id", "left")
    out = out.withColumn("stock_quantity", (F.col("stock_quantity") + F.coalesce(F.col("_d"), F.lit(0))).cast("int"))
    if "updated_at" in products.columns:
        out = out.withColumn("updated_at", F.when(F.col("_d").isNotNull(), _as_of(as_of)).otherwise(F.col("updated_at")))
    return Result(out.select(*products.columns), rejected, audit=audit)


# ------------------------------------------------------------------ M7 / M8
STATUS_REJECT = ["invalid_seq", "duplicate_seq", "not_found", "admin_only", "not_owner", "invalid_transition"]


def _transitions(spark) -> DataFrame:
    """The 6 legal (from, to) pairs; a fixed, tiny table, safe to broadcast."""
    return F.broadcast(spark.createDataFrame(S.transitions(), "_from string, _to string"))


def advance_status(orders: DataFrame, requests: DataFrame, as_of=None) -> Result:
    """Apply status requests (order_id, status, actor_id, actor_role, seq).

    A non-admin may only cancel, and only an own order.  A legal request
    moves the order one step (or cancels it).  Several requests of one order
    apply in ``seq`` order: the next accepted request is the earliest
    eligible one after the last accepted one that is legal from the current
    status.  Every accepted step moves forward on a path of at most four
    steps, so at most four rounds settle the batch exactly.  An order that
    finds no legal request in a round can never move again, so each round
    works only on the orders that moved in the round before; each round is
    a join plus a ``min(seq)`` aggregate per order (partial aggregation; AQE
    splits skewed joins) and its small result is checkpointed.  A request whose
    ``seq`` is NULL ('invalid_seq'), or that of another request of its
    order ('duplicate_seq', all of them), has no place in that order and is refused.
    ``extra['requests']`` gives every request its outcome;
    ``extra['cancelled']`` the orders cancelled now."""
    from ..session import shared_root
    spark = orders.sparkSession
    shared_root(spark)
    trans = _transitions(spark)
    own = orders.select(F.col("id").alias("order_id"), F.col("user_id").alias("_owner"),
                        F.col("status").alias("_status0"), F.lit(True).alias("_exists"))
    r = _numbered(requests, "seq", ["order_id"], positive=False).join(own, "order_id", "left")
    pre = F.when(F.col("_bad_seq").isNotNull(), F.col("_bad_seq")).when(F.col("_exists").isNull(), "not_found") \
        .when((F.col("actor_role") != "admin") & (F.col("status") != "cancelled"), "admin_only") \
        .when((F.col("actor_role") != "admin") & ~F.col("_owner").eqNullSafe(F.col("actor_id")), "not_owner")
    r = _fresh(r.withColumn("_pre", pre).checkpoint(eager=True))
    eligible = r.filter(F.col("_pre").isNull()).select("order_id", "seq", F.col("status").alias("t_to"),
                                                        F.col("_status0").alias("_s0"))
    seq_type = requests.schema["seq"].dataType
    # round 0 state: every order with an eligible request, at its stored status
    active = eligible.groupBy("order_id").agg(F.first("_s0").alias("cur")) \
        .withColumn("last_seq", F.lit(None).cast(seq_type))
    steps = []
    for _ in range(len(S.STATUS_FLOW) - 1):
        cand = (eligible.drop("_s0").join(active, "order_id")
                .filter(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq")))
                .join(trans, (F.col("cur") == F.col("_from")) & (F.col("t_to") == F.col("_to")), "left_semi"))
        step = cand.groupBy("order_id").agg(F.min_by(F.struct("seq", "t_to"), F.col("seq")).alias("s")) \
            .select("order_id", F.col("s.seq").alias("seq"), F.col("s.t_to").alias("t_to"))
        step = _fresh(step.checkpoint(eager=True))
        steps.append(step)
        if step.isEmpty():          # no order moved: none ever will
            break
        active = step.select("order_id", F.col("t_to").alias("cur"), F.col("seq").alias("last_seq"))
    accepted = steps[0]
    for st in steps[1:]:
        accepted = accepted.unionByName(st)
    acc = accepted.select("order_id", "seq", F.lit(True).alias("_acc"))
    # accepted numbers stand once in their order
    outcome = r.join(acc, ["order_id", "seq"], "left").select(
        "order_id", "seq", "status", "actor_id", "actor_role",
        F.coalesce(F.col("_acc"), F.lit(False)).alias("accepted"),
        F.when(F.col("_acc").isNotNull(), F.lit(None)).otherwise(F.coalesce("_pre", F.lit("invalid_transition")))
        .alias("reason"))
    final = accepted.groupBy("order_id").agg(F.max_by("t_to", "seq").alias("_new"))
    out = orders.join(final.withColumnRenamed("order_id", "id"), "id", "left")
    out = out.withColumn("status", F.coalesce("_new", "status"))
    if "updated_at" in orders.columns:
        out = out.withColumn("updated_at", F.when(F.col("_new").isNotNull(), _as_of(as_of)).otherwise(F.col("updated_at")))
    cancelled = accepted.filter(F.col("t_to") == "cancelled").join(
        r.select("order_id", "seq", "actor_id"), ["order_id", "seq"])
    rejected = outcome.filter(~F.col("accepted")).select("order_id", "seq", "reason")
    return Result(out.select(*orders.columns), rejected,
                  extra={"requests": outcome, "cancelled": cancelled.select("order_id", "actor_id")})


def _fresh(df: DataFrame) -> DataFrame:
    """Re-alias columns after a checkpoint (fresh column ids for unions)."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def cancel_orders(products: DataFrame, items: DataFrame, cancelled: DataFrame, as_of=None) -> Result:   # M8
    """Give back every item's quantity of the cancelled orders (order_id,
    actor_id), also to soft-deleted products; audit reason order_cancelled
    with the true running stock.  Items of products that no longer exist
    are skipped, like the application does."""
    it = items.join(cancelled, "order_id", "inner")
    it = it.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    moves = it.select("product_id", F.col("actor_id").alias("changed_by"), F.col("quantity").alias("delta"),
                      F.lit(S.REASON_ORDER_CANCELLED).alias("reason"), _as_of(as_of).alias("changed_at"),
                      F.col("order_id").alias("ref_id"), "line_no")
    empty = cancelled.select("order_id").limit(0).withColumn("reason", F.lit(None).cast("string"))
    return _apply_movements(products, moves, as_of, empty)


# ------------------------------------------------------------------ M9
def register_users(users: DataFrame, batch: DataFrame, allow_admin: bool = False, as_of=None) -> Result:
    """New users from (seq, name, email, role): name trimmed, email trimmed
    and lower-cased, role defaults to 'user'.  Rejected: invalid fields (V5),
    'admin' unless allowed, an email already registered, or one used by an
    earlier row of the batch.  New ids are made from ``seq``: rows whose number is NULL or
    below 1 ('invalid_seq') or stands twice in the batch ('duplicate_seq') are rejected first,
    and no other row counts as a repeat of theirs."""
    b = _numbered(batch.select("seq", "name", "email", "role"), "seq").select("seq", "_bad_seq", V.clean(F.col("name")).alias("name"), F.lower(V.clean(F.col("email"))).alias("email"),
                     F.coalesce(F.col("role"), F.lit(S.DEFAULTS["role"])).alias("role"))
    b = V.users(b)
    b = b.withColumn("reason", F.coalesce(F.col("_bad_seq"), F.col("reason"), F.when(
        ~F.col("role").isin(*S.ROLES), F.lit("invalid_role")).when(
        (F.col("role") == "admin") & F.lit(not allow_admin), F.lit("admin_not_allowed"))))
    first = b.filter(F.col("reason").isNull()).groupBy("email").agg(F.min("seq").alias("_first"))
    b = b.join(first, "email", "left").withColumn("reason", F.coalesce(
        F.col("reason"), F.when(F.col("seq") != F.col("_first"), F.lit("duplicate_in_batch"))))
    existing = users.select("email").withColumn("_taken", F.lit(True))
    b = b.join(existing, "email", "left").withColumn("reason", F.coalesce(
        F.col("reason"), F.when(F.col("_taken").isNotNull(), F.lit("email_taken"))))
    ok, bad = V.split(b.drop("_first", "_taken", "_bad_seq"))
    new = ok.withColumn("id", _next_ids(users, ok)).withColumn("created_at", _as_of(as_of))
    out = users.unionByName(new.select(*users.columns))
    return Result(out, bad.select("seq", "email", "reason"))


# ------------------------------------------------------------------ S5
def seed(spark, categories: DataFrame, products: DataFrame, as_of=None) -> Result:
    """Load the starter catalogue unless a live product exists: categories
    upsert on name (the seed description wins), products insert when their
    sku is new.  The 'is anything live' test is an EXISTS subquery, so the
    decision stays inside the plan."""
    any_live = products.filter(P.live()).select(F.lit(1)).exists()
    cats = spark.createDataFrame([(i + 1, n, d) for i, (n, d) in enumerate(S.SEED_CATEGORIES)],
                                 "seq long, name string, description string").filter(~any_live)
    c = upsert(categories, cats, "name", on_conflict="update", update_cols=["description"], as_of=as_of)
    new_cats = c.table
    rows = [(i + 1, *row) for i, row in enumerate(S.SEED_PRODUCTS)]
    prods = spark.createDataFrame(rows, "seq long, sku string, name string, description string, category string, "
                                        "price decimal(10,2), stock_quantity int, low_stock_threshold int").filter(~any_live)
    prods = prods.join(new_cats.select(F.col("name").alias("category"), F.col("id").alias("category_id")),
                       "category", "left").drop("category")
    p = upsert(products, prods, "sku", on_conflict="ignore", as_of=as_of)
    return Result(p.table, p.rejected, extra={"categories": new_cats})
