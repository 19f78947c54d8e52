"""Validation jobs V1-V7: every batch row gets the first rule it breaks.

V1-V6 return the batch with a ``reason`` column (NULL = accepted);
:func:`split` turns that into (accepted, rejected).  Row rules run as
Column expressions in one pass.  V1 (per-item rules of an order) and V7
(whole-table constraints) aggregate, always with partial aggregation, so a
request with very many items or a heavily repeated key is combined
map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schemas as S
from . import audit
from . import relations as R


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule whose *failure* condition holds."""
    out = F.lit(None).cast("string")
    for cond, reason in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def split(df: DataFrame, col: str = "reason") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(col).isNull()).drop(col), df.filter(F.col(col).isNotNull())


# what the application's trim takes for white space
_WS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def clean(c: Column) -> Column:
    """``c`` without white space at its ends."""
    return F.regexp_replace(c, rf"\A{_WS}|{_WS}\z", "")


def whole(c: Column, pattern: str) -> Column:
    """``pattern`` (written ^...$) fits all of ``c``; a last newline is not passed over."""
    return c.rlike(rf"\A{pattern.removeprefix('^').removesuffix('$')}\z")


def _blank(c: Column) -> Column:
    return c.isNull() | (F.length(clean(c)) == 0)


def orders(items: DataFrame, live_products: DataFrame | None = None) -> DataFrame:   # V1
    """Order requests in flat form (request_id, line_no, product_id,
    quantity, notes; a request without items has one row with NULL item
    fields).  One row per request with its reason.

    Two aggregates and no join back: per (request, product) first, then per
    request, both with map-side partial aggregation.  With
    ``live_products`` (a DataFrame of live product ids), an item naming any
    other product gives ``product_not_found`` after the V1 rules."""
    it = items
    has_item = F.col("line_no").isNotNull()
    if live_products is not None:
        live = live_products.select(F.col("id").alias("product_id"), F.lit(True).alias("_live"))
        it = it.join(live, "product_id", "left")
        missing = has_item & F.col("_live").isNull()
    else:
        missing = F.lit(False)
    per_product = it.groupBy("request_id", "product_id").agg(
        F.count("line_no").alias("n"),
        F.count_if(has_item & (F.col("product_id").isNull() | (F.col("product_id") < 1))).alias("bad_product"),
        F.count_if(has_item & (F.col("quantity").isNull() | (F.col("quantity") < 1)
                               | (F.col("quantity") > S.MAX_ITEM_QUANTITY))).alias("bad_qty"),
        F.max(F.length(clean(F.col("notes")))).alias("notes_len"),
        F.bool_or(missing).alias("missing"))
    per_request = per_product.groupBy("request_id").agg(
        F.sum("n").alias("n_items"), F.sum("bad_product").alias("bad_product"), F.sum("bad_qty").alias("bad_qty"),
        F.max("notes_len").alias("notes_len"),
        F.max(F.when(F.col("product_id").isNotNull(), F.col("n"))).alias("max_per_product"),
        F.bool_or("missing").alias("missing"))
    reason = first_failure([
        (F.col("n_items") < 1, "no_items"),
        (F.col("bad_product") > 0, "invalid_product_id"),
        (F.col("bad_qty") > 0, "invalid_quantity"),
        (F.col("notes_len") > S.MAX_NOTES_LENGTH, "notes_too_long"),
        (F.col("max_per_product") > 1, "duplicate_product"),
        (F.col("missing"), "product_not_found"),
    ])
    return per_request.select("request_id", reason.alias("reason"))


def products(batch: DataFrame) -> DataFrame:                                          # V2
    """Accepted rows carry the trimmed name and SKU."""
    batch = batch.withColumn("name", clean(F.col("name"))).withColumn("sku", clean(F.col("sku")))
    name, sku = F.col("name"), F.col("sku")
    return batch.withColumn("reason", first_failure([
        (_blank(name), "name_required"),
        (F.length(name) > S.MAX_PRODUCT_NAME, "name_too_long"),
        (F.col("price").isNull() | (F.col("price") <= 0), "invalid_price"),
        (_blank(sku), "sku_required"),
        (F.length(sku) > S.MAX_SKU_LENGTH, "sku_too_long"),
        (~whole(sku, S.SKU_PATTERN), "invalid_sku"),
        (F.col("stock_quantity") < 0, "invalid_stock_quantity"),
        (F.col("low_stock_threshold") < 0, "invalid_low_stock_threshold"),
    ]))


def product_patches(batch: DataFrame) -> DataFrame:                                   # V3
    """Each field is checked only if present; a SKU may never be patched.
    Accepted rows carry the trimmed name."""
    batch = batch.withColumn("name", clean(F.col("name")))
    name = F.col("name")
    return batch.withColumn("reason", first_failure([
        (name.isNotNull() & (F.length(name) == 0), "name_blank"),
        (name.isNotNull() & (F.length(name) > S.MAX_PRODUCT_NAME), "name_too_long"),
        (F.col("price").isNotNull() & (F.col("price") <= 0), "invalid_price"),
        (F.col("low_stock_threshold").isNotNull() & (F.col("low_stock_threshold") < 0),
         "invalid_low_stock_threshold"),
        (F.col("sku").isNotNull(), "sku_immutable"),
    ]))


def restocks(batch: DataFrame, max_quantity: int = S.MAX_RESTOCK_QUANTITY) -> DataFrame:   # V4
    q = F.col("quantity")
    return batch.withColumn("reason", first_failure([(q.isNull() | (q < 1) | (q > max_quantity), "invalid_quantity")]))


def users(batch: DataFrame) -> DataFrame:                                             # V5
    """Accepted rows carry the trimmed name and email."""
    batch = batch.withColumn("name", clean(F.col("name"))).withColumn("email", clean(F.col("email")))
    name, email = F.col("name"), F.col("email")
    return batch.withColumn("reason", first_failure([
        (_blank(name), "name_required"),
        (F.length(name) > S.MAX_USER_NAME, "name_too_long"),
        (email.isNull() | ~whole(email, S.EMAIL_PATTERN), "invalid_email"),
        (F.length(email) > S.MAX_EMAIL, "email_too_long"),
    ]))


def categories(batch: DataFrame) -> DataFrame:                                        # V6
    """Accepted rows carry the trimmed name."""
    batch = batch.withColumn("name", clean(F.col("name")))
    return batch.withColumn("reason", first_failure([
        (_blank(F.col("name")), "name_required"), (F.length("name") > S.MAX_CATEGORY_NAME, "name_too_long")]))


def table_audit(tables: dict[str, DataFrame]) -> DataFrame:                           # V7
    """Every constraint of the schema checked over whole tables, as one
    report (table_name, rule, key_columns, key_value, rows): NOT NULL, declared
    length and CHECK per row, PRIMARY KEY and UNIQUE per key, FOREIGN KEY per
    value.  One scan of each table and one aggregate (:mod:`.audit`).  All six tables must be given."""
    R.require(tables, S.TABLES)
    return audit.violations(tables, audit.key_rules(S.TABLES) + audit.row_rules(S.TABLES), S.FOREIGN_KEYS)
