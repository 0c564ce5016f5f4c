"""Headline-query benchmark.

with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Every query is fully evaluated through the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    from binscope.session import get_session
    spark = get_session(f"local[{cpus}]", int(cpus) * 2)

    from binscope.operators import profile as P
    from binscope.operators import ranks as R
    from binscope.operators import types as C
    from binscope.operators.binning import optimal as O
    from binscope.operators.binning import solve as S
    from binscope.operators.binning import tables as B
    from binscope.operators.longform import to_long
    from binscope.plans import analysis as A
    from binscope.plans import fixtures as X

    li = lambda: X.table(spark, sf_dir, "lineitem")
    three = ["l_quantity", "l_discount", "l_tax"]
    report = dict(max_n_prebins=S.REPORT_MAX_N_PREBINS, min_prebin_size=S.REPORT_MIN_PREBIN_SIZE,
                  max_bin_size=S.REPORT_MAX_BIN_SIZE)
    queries = {
        "get_data_types": lambda: C.get_data_types(li()),
        "profile": lambda: [P.profile_common(li()), P.profile_numeric(li(), X.LINEITEM_NUMERIC),
                            P.profile_quantiles(li(), X.LINEITEM_NUMERIC)],
        "binning_table_continuous": lambda: B.binning_table_continuous(li(), three, "l_extendedprice",
                                                                       X.REG_SPLITS),
        "optimal_binning_continuous": lambda: O.optimal_binning(li(), three, "l_extendedprice", "continuous",
                                                                **report).table,
        "optimal_binning_binary": lambda: O.optimal_binning(X.bin_documents(spark, sf_dir), ["n_chars", "lang"],
                                                            "quality", "binary").table,
        "kendall_tau_b": lambda: R.kendall_tau_b(to_long(li(), three, target="l_extendedprice")),
        "spearman": lambda: R.spearman(to_long(li(), three, target="l_extendedprice")),
        "factor_analysis_regression": lambda: A.fit_regression(li(), X.REG_X, "l_extendedprice", n_trees=50),
        "factor_analysis_classification": lambda: A.fit_classification(li(), X.BIN_X, "l_returnflag",
                                                                       n_trees=50),
        "word_frequencies": lambda: P.word_frequencies(X.table(spark, sf_dir, "documents"), ["text"]),
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]

    # warm-up: JVM, Python workers and the parquet footers
    for df in (P.profile_table(li()), R.kendall_tau_b(to_long(X.table(spark, sf_dir, "supplier"),
                                                              ["s_nationkey"], target="s_acctbal"))):
        df.write.format("noop").mode("overwrite").save()

    times = {}
    for name, build in queries.items():
        if only and name not in only:
            continue
        best = []
        for _ in range(runs):
            t0 = time.time()
            out = build()
            for df in (out if isinstance(out, list) else [out]):
                df.write.format("noop").mode("overwrite").save()
            best.append(time.time() - t0)
            spark.catalog.clearCache()
        best.sort()
        times[name] = round(best[len(best) // 2], 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
