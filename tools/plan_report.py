"""Write the physical plan trees (+ scan pushdown lines) of selected queries to stdout (markdown)."""
from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SELECTED = ["permit_daily", "accumulate", "assessment_cards", "restore_state", "lookup_fill", "keep_latest",
            "message_headers", "forecast_daily", "analyze_diff", "header_rows"]


def main() -> None:
    from tidemark.plans.queries import QUERIES
    from tidemark.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("plan-report", master="local[8]", shuffle_partitions=16)
    for name in SELECTED:
        df = QUERIES[name](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n\n")[0].replace("== Physical Plan ==\n", "")
        scans = [ln for ln in text.splitlines() if ln.startswith(("PushedFilters", "ReadSchema"))]
        print(f"### {name}\n\n```\n{tree.strip()}\n```\n")
        if scans:
            print("```\n" + "\n".join(dict.fromkeys(scans)) + "\n```\n")


if __name__ == "__main__":
    main()
