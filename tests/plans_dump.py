"""Write PLANS.md: executed physical plans of the headline queries (sf0.01).

    python tests/plans_dump.py
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = {
    "daily_agg": "partial aggregate -> one exchange on (room, day) -> final aggregate",
    "presence_latch": "first ON per (room, block) by aggregate, joined on (room, block): no window over readings",
    "latest_per_hour": "max_by aggregate instead of row_number over a sorted series",
    "trend_slices": "one Expand + aggregate for the four slices",
    "head_tail": "WindowGroupLimit before the exchange (top-k per room)",
    "trim_history": "running sums in blocks of turns; block totals get their own small window",
    "feature_matrix": "one exchange on room for all lag / back-fill windows",
    "walk_forward": "rows dealt by room and sorted; running sums and batched solves in one Arrow pass",
}


def main() -> None:
    from aircast.session import build_session
    from __spark_entry__ import queries

    spark = build_session()
    sf = "/root/testdata/sf0.01"
    out = ["# PLANS — executed physical plans of headline queries (sf0.01, local[8], AQE final plans)", "",
           "Generated by `python tests/plans_dump.py`; expression ids stripped.", ""]
    for name, why in HEADLINE.items():
        df = queries()[name](spark, sf)
        df.collect()  # small sf0.01 results; executes this plan so AQE shows its final form
        plan = df._jdf.queryExecution().executedPlan().treeString()
        plan = re.sub(r"#\d+L?", "", plan)
        plan = re.sub(r"\n *\+?-? *== Initial Plan ==.*", "", plan, flags=re.S)  # the final one alone
        plan = "\n".join(line[:160] for line in plan.splitlines())
        out += [f"## `{name}`", "", why, "", "```", plan.strip(), "```", ""]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write("\n".join(out))


if __name__ == "__main__":
    main()
