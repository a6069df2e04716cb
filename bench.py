"""Times of the headline jobs; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Orbits are made once and written, so
the times are those of the jobs themselves.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orbitsieve.operators import (  # noqa: E402
    augment, cascade, density, dbscan, distributions, filters, generate, geometry,
    histogram, kernel, moid, quality, scaling,
)
from orbitsieve.plans import domains  # noqa: E402
from orbitsieve.scratch import written  # noqa: E402
from orbitsieve.sources.fixture import orbits  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def jobs(spark, rows):
    flagged = filters.haz_by_flag(rows)
    by_moid = filters.haz_by_moid(rows)
    wqi = ["w", "q", "i"]

    def mirrored():
        doubled = augment.double_mirror(flagged, "w", 180.0)
        sink(scaling.cut_normalize(wqi, {"rows": flagged, "mirrored": doubled})[0])

    def generated():
        real = rows.filter(F.col("origin") == "real")
        fitted = distributions.fit_distributions(real, n=25)
        sink(generate.gen_orbits(spark, fitted, 200_000))

    def kernel_split():
        est = kernel.MarginSVC(gamma=40.0, C=10.0)
        sink(kernel.split_by_clf(est, ["w", "q", "e"], by_moid)[1])

    def stages():
        df = domains.prepared(by_moid, 1).withColumn("domain", F.lit(1))
        sink(quality.summary(cascade.run_cascade(df, domains.flows(1))[0]))

    def kde():
        scaled, scales = scaling.minmax_normalize(rows, ["w", "q"])
        sink(density.kde_grid(scaled, ["w", "q"], 0.05, 101, scales=scales)[0])

    return {
        "scan_filter_group_weight": lambda: sink(quality.group_weight(filters.haz_by_flag(orbits(spark, SF_DIR)))),
        "double_mirror_normalize": mirrored,
        "histograms": lambda: sink(histogram.hist_table(rows, ["a", "i", "w", "om", "q"], 25)),
        "pair_distribution": lambda: sink(histogram.pair_distribution(flagged)),
        "orbit_polyline": lambda: sink(geometry.orbit_polyline(rows)),
        "ecliptic_closest": lambda: sink(geometry.ecliptic_closest(rows)),
        "moid_coarse": lambda: sink(moid.moid_coarse(rows)),
        "moid": lambda: sink(moid.append_moid(rows)),
        "fit_and_generate": generated,
        "kernel_svm_split": kernel_split,
        "cascade_domain1": stages,
        "dbscan": lambda: sink(dbscan.dbscan(rows.select("oid", "a", "i"), ["a", "i"])),
        "kde_grid": kde,
    }


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("orbitsieve-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = written(orbits(spark, SF_DIR).repartition(int(CPUS)), "orbits")
    times = {}
    only = sys.argv[1:]
    for name, job in jobs(spark, rows).items():
        if only and name not in only:
            continue
        t = time.time()
        job()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
