"""Physical-plan summary of every registered query (final AQE plans), and of
every table that a query writes on its way (rows ``query > step``, plans as
first made).

    python tests/plan_report.py [sf_dir] [query ...] > PLANS.md

Counts the operators that matter at scale: shuffles, broadcasts, aggregate
kinds (HashAggregate = map-side combine on fixed-width buffers), windows,
joins, Python nodes, and the columns each scan reads.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

PATTERNS = {
    "shuffle": r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
    "reused": r"ReusedExchange",
    "broadcast": r"BroadcastExchange",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "hash_agg": r"(?<!Object)HashAggregate",
    "sort_agg": r"SortAggregate",
    "obj_agg": r"ObjectHashAggregate",
    "window": r"\bWindow \[",
    "generate": r"\bGenerate ",
    "python": r"(MapInPandas|MapInArrow|FlatMap(?:Co)?GroupsIn(?:Pandas|Arrow)|ArrowEvalPython|BatchEvalPython)",
    "single_part": r"Exchange SinglePartition",
    "take_ordered": r"TakeOrderedAndProject",
}


def summarize(plan: str) -> dict:
    out = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    out["scan_cols"] = sorted({len(s.split(",")) for s in schemas})
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from feedlens.session import build_session
    spark = build_session("local[8]", 8)
    print(f"# Final physical plans ({os.path.basename(sf_dir)})\n")
    print("Generated by `tests/plan_report.py`. Counts per query of the final AQE plan of the "
          "returned DataFrame; a row `query > step` is a table that the query writes before, "
          "by its plan as first made (broadcasts that AQE adds are not in it)."
          + (" Named queries only; without names the report covers all." if argv[2:] else "") + "\n")
    cols = list(PATTERNS) + ["scan_cols"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---" * (len(cols) + 1) + "|")
    from pyspark.sql.readwriter import DataFrameWriter
    written: list = []
    write = DataFrameWriter.parquet

    def recorded(self, path, *a, **k):
        written.append((os.path.basename(path.rstrip("/")), self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *a, **k)

    DataFrameWriter.parquet = recorded
    for name, fn in E.queries().items():
        if argv[2:] and name not in argv[2:]:
            continue
        written.clear()
        df = fn(spark, sf_dir)
        for step, plan in written:
            s = summarize(plan)
            step = re.sub(r"^feedlens-|-[0-9a-f]{12}$", "", step)
            print(f"| {name} > {step} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main(sys.argv)
