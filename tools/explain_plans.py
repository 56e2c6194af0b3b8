"""Print the physical operator tree of the headline queries (for docs/PLANS.md).

Usage: python tools/explain_plans.py [sf_dir] > docs/plans_raw.txt

Only operator lines are kept (scans with their pruned ReadSchema, exchanges,
joins, aggregates, windows, generators); expression details are cut.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from skillgrid.plans import catalog  # noqa: E402
from skillgrid.session import build_session  # noqa: E402

KEEP = ("Scan", "Exchange", "Join", "Aggregate", "Window", "Generate", "Expand", "Union", "TakeOrdered",
        "CollectLimit", "Limit")


def operator_lines(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        if not any(k in line for k in KEEP):
            continue
        line = re.sub(r"#\d+L?", "", line)
        if "FileScan" in line:
            schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
            head = line.split("FileScan")[0] + "FileScan " + line.split("FileScan")[1].split(" ")[1]
            line = f"{head} ReadSchema={schema.group(1) if schema else '?'} Pushed={pushed.group(1) if pushed else '[]'}"
        out.append(line[:220])
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    spark.conf.set("skillgrid.materialize", os.environ.get("SKILLGRID_MATERIALIZE", "false"))
    for name in HEADLINE:
        df = catalog.QUERIES[name](spark, sf_dir)
        print(f"### {name}\n```")
        print("\n".join(operator_lines(df._jdf.queryExecution().executedPlan().toString())))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
