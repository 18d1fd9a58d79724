"""Print a Markdown table of what the final plans of queries consist of.

    python tests/plan_table.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

PARTS = {
    "scans": "FileScan", "shuffles": "Exchange hashpartitioning", "broadcasts": "BroadcastExchange",
    "reused": "ReusedExchange", "sort-merge": "SortMergeJoin", "cut before shuffle": "Partial",
    "top-k": "TakeOrderedAndProject", "Arrow": "MapIn",
}


def main() -> None:
    from bench import HEADLINE
    from registra.plans.catalog import QUERIES
    from registra.session import local_session, ship_package

    ship_package()
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    print("| query | " + " | ".join(PARTS) + " |")
    print("|---|" + "---:|" * len(PARTS))
    for name in sys.argv[2:] or HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        lines = plan.splitlines()
        counts = [
            sum(word in line and (label != "cut before shuffle" or "WindowGroupLimit" in line)
                for line in lines)
            for label, word in PARTS.items()
        ]
        print(f"| {name} | " + " | ".join(str(c) if c else "" for c in counts) + " |", flush=True)


if __name__ == "__main__":
    main()
