"""What the jobs share: configuration, logging and the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def settings(default: dict, given: dict | None) -> dict:
    """The defaults with the given values over them; an unknown name raises."""
    unknown = set(given or {}) - set(default)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return default | (given or {})


def read_settings(spark: SparkSession, path: str | None) -> dict:
    """A JSON object from a file that Spark can read."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}


def command_line(about: str, work: Callable[[SparkSession, argparse.Namespace, dict], object], *folders: tuple[str, str]) -> None:
    """Parses the folders and ``--config``, and does the work in a session of its own."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in folders:
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="a JSON file of settings; the defaults are in the folder of the job")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers
    spark = SparkSession.builder.appName(parser.prog).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, args, read_settings(spark, args.config))
    finally:
        spark.stop()
