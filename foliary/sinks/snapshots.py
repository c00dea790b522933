"""Tables under one folder, of which a commit file, written last, names the parts.

Data goes to folders with fresh names. ``_commits`` holds one small JSON file per version that lists the parts of every
table, oldest first. What a commit names is never changed, so a run that breaks at any step leaves the former tables
as they were, and its half-written folders belong to no table.

One writer at a time: of two that commit the same version the second fails. A commit file that was cut off counts for nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "_commits"
# Position of the part a row comes from; a later part is a later state.
SEQUENCE = "__part"
# So many parts of one size are merged into one of the next size.
FAN = 8


@dataclass(frozen=True)
class Part:
    """A data folder of a table. ``label`` tells which run or batch wrote it, ``level`` how often it was merged."""

    folder: str
    schema: str
    label: str = ""
    level: int = 0


Tables = dict[str, list[Part]]


@dataclass(frozen=True)
class Snapshots:
    spark: SparkSession
    target: str

    def versions(self) -> list[int]:
        """Numbers of all commit files, broken ones as well."""
        fs, folder = self._at(COMMITS)
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def tables(self, version: int | None = None) -> Tables:
        """Parts of every table as of ``version``, or of the last whole commit; empty before the first one."""
        if version is not None:
            found = self._commit_of(version)
            if found is None:
                raise ValueError(f"no commit {version} in {self.target}")
            return found
        for number in reversed(self.versions()):
            found = self._commit_of(number)
            if found is not None:
                return found
        return {}

    def write(self, rows: DataFrame, table: str, *by: str, label: str = "", level: int = 0) -> Part:
        """``rows`` as a new part, which belongs to no version yet; a folder per value of ``by``."""
        folder = f"{table}/part-{uuid.uuid4().hex}"
        (rows.write.partitionBy(*by) if by else rows.write).parquet(f"{self.target}/{folder}")
        return Part(folder, rows.schema.json(), label, level)

    def commit(self, tables: Tables) -> int:
        """Make ``tables`` the state of the folder."""
        schemas = sorted({p.schema for parts in tables.values() for p in parts})
        place = {s: i for i, s in enumerate(schemas)}
        listed = {t: [{**asdict(p), "schema": place[p.schema]} for p in parts] for t, parts in tables.items()}
        version = max(self.versions(), default=-1) + 1
        fs, path = self._at(f"{COMMITS}/{version:012d}.json")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps({"schemas": schemas, "tables": listed}).encode()))
        out.close()
        return version

    def rows(self, parts: Sequence[Part], numbered: bool = False) -> DataFrame | None:
        """Rows of the parts, with the position of their part if ``numbered``; a column that a part lacks is null there."""
        groups: dict[tuple[str, int], list[str]] = {}
        for i, part in enumerate(parts):
            groups.setdefault((part.schema, i if numbered else 0), []).append(f"{self.target}/{part.folder}")
        made: DataFrame | None = None
        for (schema, position), folders in groups.items():
            shape = T.StructType.fromJson(json.loads(schema))
            frame = self.spark.read.schema(shape).parquet(*folders).select(*[F.col(f"`{n}`") for n in shape.names])
            if numbered:
                frame = frame.withColumn(SEQUENCE, F.lit(position))
            made = frame if made is None else made.unionByName(frame, allowMissingColumns=True)
        return made

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """All rows of a table; None if no commit names it."""
        return self.rows(self.tables(version).get(table, []))

    def read_merged(
        self, table: str, keys: Sequence[str], latest: Sequence[str] = (), version: int | None = None
    ) -> DataFrame | None:
        """One row per key over all parts of a table. A filter on ``keys`` that are folders prunes the parts."""
        rows = self.rows(self.tables(version).get(table, []), numbered=True)
        return None if rows is None else merged(rows, keys, latest)

    def compacted(
        self, table: str, parts: Sequence[Part], merge: Callable[[DataFrame], DataFrame], *by: str, fan: int = FAN
    ) -> list[Part]:
        """The parts with every ``fan`` youngest ones of one level merged into one of the next.

        A row is rewritten once per level, so about log(parts) times, and a reader meets fewer than ``fan`` parts a level.
        """
        kept = list(parts)
        while kept:
            level = kept[-1].level
            young = next((i for i in range(len(kept), 0, -1) if kept[i - 1].level != level), 0)
            if len(kept) - young < fan:
                break
            rows = self.rows(kept[young:], numbered=True)
            kept[young:] = [self.write(merge(rows), table, *by, level=level + 1)]
        return kept

    def drop_obsolete(self, keep: int = 10) -> list[str]:
        """Delete parts that none of the last ``keep`` versions names, and older commits. Not while somebody writes."""
        numbers = self.versions()
        commits = {n: self._commit_of(n) or {} for n in numbers}
        whole = [n for n in numbers if commits[n]][-max(keep, 1):]
        needed = {p.folder for n in whole for parts in commits[n].values() for p in parts}
        gone = []
        for table in sorted({t for tables in commits.values() for t in tables}):
            fs, folder = self._at(table)
            for status in fs.listStatus(folder) if fs.exists(folder) else ():
                name = f"{table}/{status.getPath().getName()}"
                if status.getPath().getName().startswith("part-") and name not in needed:
                    fs.delete(status.getPath(), True)
                    gone.append(name)
        for number in numbers:
            if whole and number < whole[0]:
                fs, path = self._at(f"{COMMITS}/{number:012d}.json")
                fs.delete(path, False)
        return gone

    def _at(self, name: str) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commit_of(self, version: int) -> Tables | None:
        fs, path = self._at(f"{COMMITS}/{version:012d}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            found = json.loads(text)
        except json.JSONDecodeError:
            return None
        return {
            t: [Part(**{**p, "schema": found["schemas"][p["schema"]]}) for p in parts] for t, parts in found["tables"].items()
        }


def with_part(parts: Sequence[Part], part: Part) -> list[Part]:
    """The parts with one more, in the place of the unmerged one of the same label if there is one."""
    same = [i for i, p in enumerate(parts) if p.label == part.label and p.level == 0]
    if not same:
        return [*parts, part]
    return [part if i == same[0] else p for i, p in enumerate(parts) if i == same[0] or i not in same]


def merged(rows: DataFrame, keys: Sequence[str], latest: Sequence[str] = ()) -> DataFrame:
    """One row per key: of every column the first value that is not null, or the greatest for those in ``latest``.

    Merging merged parts in order gives the same, and a part that is merged twice changes nothing.
    Keys are aggregated before they are exchanged.
    """
    values = [c for c in rows.columns if c not in (*keys, SEQUENCE)]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(SEQUENCE))).alias(c) for c in values if c not in latest]
    made = rows.groupBy(*keys).agg(*first, *[F.max(c).alias(c) for c in latest])
    return made.select(*keys, *values)
