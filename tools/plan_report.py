"""Print a one-line summary of the final (AQE) physical plan of every key:
exchanges, join strategies, top-k pruning, Python stages, reused exchanges
and the columns each scan reads. Usage: python tools/plan_report.py [sf_dir [key ...]]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
       "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "WindowGroupLimit", "TakeOrderedAndProject", "MapInPandas", "ArrowEvalPython",
       "BatchEvalPython", "ReusedExchange", "Expand")


def main() -> None:
    from regstat.session import get_session
    from regstat.plans.catalog import queries
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    wanted = set(sys.argv[2:])
    for name, fn in sorted(queries().items()):
        if wanted and name not in wanted:
            continue
        df = fn(spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("+- == Initial Plan ==")[0]
        ops = {o: final.count(o) for o in OPS if final.count(o)}
        scans = sorted({(m.group(1), len(m.group(2).split(",")))
                        for m in re.finditer(r"FileScan (\w+) \[([^\]]*)\]", final)})
        print(f"{name:26s} {ops} scans(format, columns read)={scans}")


if __name__ == "__main__":
    main()
