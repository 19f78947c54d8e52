"""Registered searches and pages that read structures written beside a table: trigram postings (F2), ranges with counts (G1, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..session import shared_path
from ..sources.pages import PagedList
from ..sources.trigrams import TrigramIndex
from .catalog import register


def _search(t, text: str):
    index = TrigramIndex(t.spark, shared_path(t.spark, "trigrams"), ["name", "sku"], folders=32).write(t.products)
    return index.search(t.products.filter(P.live()), text).select("id", "name", "sku")


@register("F2_search_trigrams", """
select id, name, sku from f_products where deleted_at is null and (name ilike '%ring%' or sku ilike '%ring%')""")
def f2_trigrams(t):
    """F2 by postings: the pattern is tested on the rows that hold its trigrams."""
    return _search(t, "ring")


@register("F2_search_trigrams_pieces", """
select id, name, sku from f_products where deleted_at is null and (name ilike '%LUE%r_ng%' or sku ilike '%LUE%r_ng%')""")
def f2_pieces(t):
    """Pieces between wildcards; around '_' they are too short for a trigram, 'lue' gives one."""
    return _search(t, "LUE%r_ng")


def _orders(t, range_rows: int) -> PagedList:
    rows = t.orders.select("id", "created_at", "status", "total_amount")
    return PagedList.write(rows, shared_path(t.spark, "pages"), P.sort_columns("created_at", False), range_rows)


@register("G1_seek_page", """
select id, created_at, status, total_amount from f_orders order by created_at desc nulls first, id limit 10 offset 990""")
def g1_seek(t):
    """Page 100 of the orders: one range of the written list is read."""
    return _orders(t, 500).page(100, 10)


@register("G1_seek_filtered", """
select id, created_at, status, total_amount from f_orders where status = 'pending' order by created_at desc nulls first, id limit 10 offset 70""")
def g1_filtered(t):
    """Page 8 of the pending orders, found by one count of them per range."""
    return _orders(t, 200).page(8, 10, F.col("status") == "pending")


@register("G2_seek_summary", """
select count(*) as total, 100 as page, 10 as "limit", cast(ceil(count(*) / 10.0) as bigint) as total_pages from f_orders""")
def g2_seek(t):
    """The total beside page 100, from the stored counts."""
    return _orders(t, 500).summary(100, 10)
