"""Command line: ``python -m tessera [options] files``."""

import sys

from pyspark.sql import SparkSession

from .plans.options import parse
from .plans.run import run
from .shipping import ship


def main(args: list[str]) -> int:
    options = parse(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    ship(spark)
    result = run(spark, options)
    for stage, s in result.seconds.items():
        print(f"{stage}: {s:.1f} s")
    print(f"{len(result.tiles)} tiles")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
