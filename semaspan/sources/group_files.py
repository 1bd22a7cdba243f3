"""Folders with one text file per group, the group's name as file name."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.sources.sinks import write_groups

UNSAFE = "%/~:\\\r\n"  # characters that a file name cannot hold or that mean something in it
NULL, EMPTY = "%", "%%"  # names of the groups without a name


def file_stem(group: Column) -> Column:
    """The file name of a group, without its ending: unsafe characters, and a first `.` or `_`, as %XX."""
    stem = group.cast("string")
    for c in UNSAFE:
        stem = F.replace(stem, F.lit(c), F.lit(quote(c, safe="") if c != "~" else "%7E"))
    for c, code in ((".", "%2E"), ("_", "%5F")):  # such files would be hidden
        stem = F.when(stem.startswith(c), F.concat(F.lit(code), F.substr(stem, F.lit(2)))).otherwise(stem)
    return F.when(stem == "", EMPTY).otherwise(F.coalesce(stem, F.lit(NULL)))


def _decoded(name: Column) -> Column:
    """%XX decoded; a name that is no such code stays."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def group_of(file_name: Column) -> Column:
    """The group that a file name, as Spark's `_metadata.file_name` spells it, stands for."""
    stem = F.regexp_replace(_decoded(file_name), r"(~[0-9]+)?\.txt$", "")
    return F.when(stem == EMPTY, "").when(stem != NULL, _decoded(stem))


def write_group_files(groups: DataFrame, folder: str, by: str = "construction", value: str = "sentence") -> None:
    """One file `<group>.txt` per group, and `<group>~1.txt`, `<group>~2.txt`, ... where a group is large.

    Spark writes all lines below a staging folder, large groups by many tasks, and commits them as any other
    output, so a task that fails or runs twice leaves nothing; then the files are renamed, one call a file. If
    anything fails, no staged file stays. `_SUCCESS` comes last: a folder without it is not whole.

    Defined results: a null group is written as `%.txt`, an empty name as `%%.txt`, a null line as an empty one.
    An empty table gives an empty folder. A folder that holds files already is refused. Other columns are not
    read. Lines keep no order. Names of more bytes than the file system takes fail.
    """
    spark = groups.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    if len(files.listStatus(target)):
        raise FileExistsError(folder)
    staged = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    try:
        lines = groups.select(file_stem(F.col(by)).alias("file"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("line"))
        write_groups(lines, staged, ["file"], "line")
        for part in files.listStatus(path(staged)):
            if not part.isDirectory():
                continue
            stem = unquote(part.getPath().getName().removeprefix("file="))
            names = sorted(f.getPath().getName() for f in files.listStatus(part.getPath()))
            for n, name in enumerate(names):
                to = path(target, f"{stem}~{n}.txt" if n else f"{stem}.txt")
                if not files.rename(path(part.getPath(), name), to):
                    raise OSError(f"could not rename to {to}")
        files.create(path(target, "_SUCCESS")).close()
    finally:
        files.delete(path(staged), True)
