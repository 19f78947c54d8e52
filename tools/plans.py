"""Write PLANS.md: the physical plan tree of each headline query, with the
pushed filters and read schema of every scan.

    python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ["R3_sales_summary", "R2_top_products", "R4_customer_analytics", "R1_low_stock", "R6_dashboard_kpis",
           "R5_audit_log", "J5_order_document", "J7_sales_fact", "A2_order_totals", "W3_stock_ledger",
           "W3_stock_ledger_skew_path", "W3_stock_ledger_hot_product", "M5_restock", "M7_orders", "F6_conjunction", "G1_page"]


def explain(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarize(text: str) -> str:
    lines = text.splitlines()
    tree, details, i = [], [], 0
    while i < len(lines) and not lines[i].startswith("(1)"):
        if lines[i].strip() and not lines[i].startswith("=="):
            tree.append(lines[i])
        i += 1
    current = None
    for line in lines[i:]:
        if line.startswith("(") and ")" in line:
            current = line
        elif current and "Scan parquet" in current and line.startswith(("PushedFilters", "ReadSchema")):
            details.append(f"{current.split(')')[0]}) {line}")
    return "\n".join(tree + [""] + details)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from stocksmith.plans.catalog import queries
    from stocksmith.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=16)
    qs = queries()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plans.py` on `{sf}` (initial adaptive plans; AQE may still "
           "coalesce partitions or turn a sort-merge join into a broadcast join at run time).", ""]
    for name in QUERIES:
        df = qs[name](spark, sf)
        out += [f"## {name}", "", "```", summarize(explain(df)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
