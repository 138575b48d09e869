"""Times the headline queries; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS choose tables and cores.

One row merges simulated cells by the approximate solver (the published timing is of 4566 cells by 23,699 genes);
BENCH_SIMULATED names their size as cells x genes, or nothing to leave it out. Making the cells is not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import numpy as np  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from weft.operators import merge, simulate  # noqa: E402
from weft.plans import catalogue  # noqa: E402
from weft.sources.scratch import materialize  # noqa: E402

HEADLINE = "zero_gene_cell_drop combine_intersect size_factor_norm standardize_by_batch residual_operator gene_anova_f centroid_dist_rank gram_matrix pseudo_bulk_mean factors_given_two merge_supervised merge_matched_types merge_bulk merge_bulk_one merge_supervised_named control_only seg_index_given_params".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    catalogue.queries()["library_size"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers
    for name in HEADLINE:
        began = time.time()
        catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    if size := os.environ.get("BENCH_SIMULATED", "1000x2000"):
        n_cells, n_genes = map(int, size.split("x"))
        blocks = materialize(simulate.simulate(spark, n_cells, n_genes, n_genes // 2, k=3, lam=0.5).repartition(2 * int(cpus)), "simulated")
        began = time.time()
        merge.merge_cells(blocks, np.arange(n_genes) < n_genes // 2, 20, solver="random").blocks.write.format("noop").mode("overwrite").save()
        took[f"simulated_merge_{size}"] = round(time.time() - began, 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1]) if found else None}))


if __name__ == "__main__":
    main()
