"""Command line: ``python -m pagelattice.cli -i INPUT -c CONFIG [-o OUT] [-d]``.

INPUT is an image or, with ``-d``, a folder of images; CONFIG lists ``key=folder`` lines; results
and recognised text are written as Parquet under OUT.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pagelattice.kernels.text import recognize
from pagelattice.plans.stages import Pipeline
from pagelattice.sources.images import Config, read_images


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelattice", description=__doc__)
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("-s", "--single", action="store_true", help="one image (the default)")
    kind.add_argument("-d", "--directory", action="store_true", help="a folder of images")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-c", "--config", required=True)
    p.add_argument("-o", "--out", default="out")
    p.add_argument("--no-text", action="store_true", help="do not recognise text")
    return p


def main(argv: list[str] | None = None) -> dict[str, str]:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pagelattice").getOrCreate()
    images = read_images(spark, args.input)
    return Pipeline(Config.read(spark, args.config)).run(images, args.out, None if args.no_text else recognize)


if __name__ == "__main__":
    main()
