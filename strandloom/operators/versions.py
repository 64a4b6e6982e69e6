"""Which folders a stored table consists of.

A table is a folder with version=<id>/part=<number>/ of Parquet files that are never changed, and _log/<number>.json, of which the last whole one names
the versions of each part. A change writes a version of the parts it touches, then its entry of the log. Until that is there the table is what it was;
what a failed change left is in no entry. Of two changes that start from the same entry the second fails, as its number is taken.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

VERSION, LOG = "version", "_log"


@dataclass
class Entry:
    """k, the number of parts, the versions of each part, and the last batch of each stream or job that was taken in."""

    k: int
    partitions: int
    versions: dict[int, list[str]] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)
    number: int = -1


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, f"{path}/{LOG}") if n.endswith(".json"))


def latest(spark: SparkSession, path: str) -> Entry | None:
    """The last entry that was finished; None if the folder is no table."""
    for n in reversed(_numbers(spark, path)):
        fs, p = _fs(spark, f"{path}/{LOG}/{n:012d}.json")
        f = fs.open(p)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()
        try:
            found = json.loads(text)
        except json.JSONDecodeError:
            continue  # its writer was lost
        return Entry(found["k"], found["partitions"], {int(p): v for p, v in found["versions"].items()}, found["done"], n)
    return None


def commit(spark: SparkSession, path: str, entry: Entry, after: Entry | None) -> None:
    """The entry that takes the place of `after`; an error if another did so before."""
    number = (_numbers(spark, path) or [-1])[-1] + 1
    now = latest(spark, path)
    if (now.number if now else -1) != (after.number if after else -1):
        raise RuntimeError(f"{path} was changed by another job meanwhile; run this one again")
    fs, p = _fs(spark, f"{path}/{LOG}/{number:012d}.json")
    # Without overwriting: it fails if another job took the number.
    f = fs.create(p, False)
    f.write(json.dumps({k: v for k, v in asdict(entry).items() if k != "number"}).encode())
    f.close()


def new_version() -> str:
    return uuid.uuid4().hex


def folders(path: str, versions: dict[int, list[str]]) -> list[str]:
    return [f"{path}/{VERSION}={v}/part={part}" for part, vs in sorted(versions.items()) for v in vs]


def parts_in(spark: SparkSession, path: str, version: str) -> list[int]:
    return sorted(int(n[5:]) for n in names(spark, f"{path}/{VERSION}={version}") if n.startswith("part="))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the versions that the last entry doesn't name, and the entries before it; not while a job still reads or writes them."""
    entry = latest(spark, path)
    if entry is None:
        raise ValueError(f"{path} is no stored table")
    used = {v for vs in entry.versions.values() for v in vs}
    gone = [n for n in names(spark, path) if n.startswith(f"{VERSION}=") and n[len(VERSION) + 1 :] not in used]
    for n in gone:
        delete(spark, f"{path}/{n}")
    for n in _numbers(spark, path):
        if n < entry.number:
            delete(spark, f"{path}/{LOG}/{n:012d}.json")
    return gone
