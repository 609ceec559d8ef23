"""Single text files, wherever Spark keeps them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .folders import delete


def write_lines(lines: DataFrame, path: str, front: list[str] = ()) -> None:
    """One text file: the lines in front, then the rows of ``lines`` (one text column) in the order of its partitions.

    Spark writes the rows as parts in a folder beside the file.  Their bytes are copied one part after another into a file beside it, which then takes the
    path's place; nothing is held as a whole.
    """
    spark = lines.sparkSession
    parts, whole = f"{path}.{uuid.uuid4().hex}.parts", f"{path}.{uuid.uuid4().hex}.part"
    lines.write.text(parts)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: hadoop.fs.Path(p)
    system = at(path).getFileSystem(conf)
    out = system.create(at(whole), True)
    try:
        out.write(bytearray("".join(f"{x}\n" for x in front).encode()))
        for name in sorted(s.getPath().getName() for s in system.listStatus(at(parts))):
            if name.startswith("part-"):
                part = system.open(at(f"{parts}/{name}"))
                hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()
    system.delete(at(path), False)
    system.rename(at(whole), at(path))
    delete(spark, parts)
