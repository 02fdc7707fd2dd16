"""python -m siltstone FOLDER ingest PATH | search QUERY | answer QUERY | similar CHUNK | stats"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from siltstone.plans.engine import Engine


def main(args: list[str]) -> None:
    if len(args) < 2:
        sys.exit(__doc__)
    folder, command, *rest = args
    engine = Engine(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), folder)
    run = {"ingest": engine.process_folder, "search": engine.search, "answer": engine.answer, "similar": engine.similar_chunks, "stats": engine.statistics}
    run[command](*rest).show(50, truncate=120)


if __name__ == "__main__":
    main(sys.argv[1:])
