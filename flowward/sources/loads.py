"""Loads: each has a number of its own for its row ids. Files that only one of several writers can create."""

from __future__ import annotations

from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ROW_BITS = 37
LOAD_BITS = 26


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    where, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def create_with(spark: SparkSession, path: str, content: str = "") -> bool:
    """Create a file with ``content`` that nobody else has created; False if somebody has.

    Local and mounted folders are asked themselves, as Hadoop's own check there is not one step with the creation.
    """
    where, fs = _path(spark, path)
    if fs.getScheme() == "file":
        fs.mkdirs(where.getParent())
        try:
            with open(where.toUri().getPath(), "x", encoding="utf-8") as file:
                file.write(content)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if not fs.exists(where):
            raise e
        return False
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _file(owner: str) -> str:
    """A load's name as one file name."""
    return "l-" + quote(owner, safe="").replace("%", "+")


def claim(spark: SparkSession, root: str, owner: str) -> int:
    """The number of the load ``owner`` under ``root``; a re-run of the load gets the same one.

    Numbers are given in turn by creating a file that must not exist, so two loads that
    start together get different ones. The next free number is searched in steps that double.
    """
    mine = f"{root}/_loads/owners/{_file(owner)}"
    taken = names_in(spark, mine)
    if not taken:
        numbers, low, high = f"{root}/_loads/numbers", 0, 1
        while path_exists(spark, f"{numbers}/{high - 1}"):
            low, high = high, high * 2
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if path_exists(spark, f"{numbers}/{middle}") else (low, middle)
        while not create_with(spark, f"{numbers}/{low}"):
            low += 1
        create_with(spark, f"{mine}/{low}")
        taken = names_in(spark, mine)
    number = min(int(n) for n in taken if n.isdigit())
    if number >= 2**LOAD_BITS:
        raise ValueError("Too many loads under one root")
    return number


def first_id(spark: SparkSession, root: str, owner: str) -> int:
    """The first row id of a load: no other load under ``root`` has ids of that range."""
    return claim(spark, root, owner) << ROW_BITS


def text_of(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    where, fs = _path(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The identity a checkpoint gives its stream: restarts keep it, another checkpoint has another one."""
    rows = spark.read.text(f"{checkpoint}/metadata").collect()
    return rows[0][0].split('"id":"')[1].split('"')[0]
