"""Times the headline queries, the median of three runs after a warm-up; prints one JSON line."""

import json
import os
import time
from statistics import median

from planwright.session import build_session

HEADLINE = ["a01_tenant_scan", "b10_material_finder", "e01_procurement", "e03_price_trend", "i12_cost_breakdown", "d09_cost_by_material", "d10_cost_by_category", "d12_project_totals", "f02_price_order", "h30_quotation"]
EXTRA = ["d07_bill_totals", "c07_rate_waterfall", "d13_audit_breakdown", "l02_fair_claim", "i08_generate_bill", "i10_audit", "c07_priced_bill", "i08_full_bill", "i10_line_audit"]


def main() -> None:
    from planwright.plans import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    QUERIES["a01_tenant_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session's code
    for name in [n for n in HEADLINE + EXTRA if n in QUERIES]:
        runs = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(median(runs), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
