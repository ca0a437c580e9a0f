"""python -m tidemark PATH...: checks raw exports; exit 0 if clean, 1 if a contract is broken, 2 if nothing is there."""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidemark.operators import contract
    from tidemark.sources import runs

    if not argv:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    errors = 0
    for path in argv:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            print(f"{path}: nothing there")
            return 2
        if fs.getFileStatus(p).isDirectory():
            found = runs.run_violations(spark, path)
        else:
            found = contract.file_violations(spark.read.format("binaryFile").load(path)).unionByName(
                contract.contract_violations(runs.raw_monthly(spark, path)).select("source", "check")
            ).withColumn("severity", F.lit("error"))
        found = found.groupBy("severity", "source", "check").agg(F.count(F.lit(1)).alias("n")).cache()
        errors += found.where("severity = 'error'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        for r in found.orderBy("severity", "source", "check").toLocalIterator():
            print(f"{r['severity']}: {r['source']}: {r['check']} ({r['n']})")
        found.unpersist()
    return int(errors > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
