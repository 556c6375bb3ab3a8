"""Times the headline queries and prints one JSON line: medians after a warm-up, first runs, and the SQL of the same queries in DuckDB; with --duckdb, that alone."""

import json
import os
import sys
import time

from lathe.plans import catalogue
from lathe.tables import session

HEADLINE = ("series_last_mean_max", "irate_last_two", "topk_per_instant", "two_sided_verdict", "bom_rollup_total", "bom_scale_total", "survivor_argmax", "keep_first_exact", "multiset_diff", "stream_dedupe")


RUNS = 3


def timed(run) -> float:
    began = time.time()
    run()
    return time.time() - began


def spark_runs(sf_dir: str, cpus: int):
    spark = session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    return {name: lambda q=catalogue.queries()[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save() for name in HEADLINE}


def duckdb_runs(sf_dir: str, cpus: int):
    import duckdb

    c = duckdb.connect(config={"threads": cpus})
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return {name: lambda q=catalogue.oracle_sql()[name]: c.sql(q).fetchall() for name in HEADLINE}


def main() -> None:
    """Each query once to warm up, then the median of RUNS; DuckDB's times of the same queries stand beside; with --duckdb they stand alone."""
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    duck = "--duckdb" in sys.argv
    median = lambda run: round(sorted(timed(run) for _ in range(RUNS))[RUNS // 2], 3)
    times, first = {}, {}
    for name, run in (duckdb_runs if duck else spark_runs)(sf_dir, cpus).items():
        first[name] = round(timed(run), 3)
        times[name] = median(run)
    out = {"metric": "headline queries, total of medians" + (", DuckDB" if duck else ""), "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "first_runs": first}
    if not duck:
        out["duckdb"] = {name: median(run) for name, run in duckdb_runs(sf_dir, cpus).items()}
    print(json.dumps(out))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
