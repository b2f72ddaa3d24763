"""Explain every registered query and flag plan shapes that do not scale.

usage: python tools/plan_audit.py [sf_dir]
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FLAGS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
         "MapInPandas", "FlatMapGroupsInPandas", "CollectLimit")


def main() -> None:
    from tidemark.plans.queries import QUERIES
    from tidemark.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("plan-audit", master="local[4]", shuffle_partitions=8)
    for name in sorted(QUERIES):
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FLAGS if f in plan]
        n_ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan))
        n_bhj = plan.count("BroadcastHashJoin")
        n_smj = plan.count("SortMergeJoin")
        print(f"{name:22s} exchanges={n_ex:2d} bhj={n_bhj} smj={n_smj} {' '.join(hits)}")


if __name__ == "__main__":
    main()
