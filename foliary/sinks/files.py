"""Manifests and file sinks: JSON per document, package folders, rendered documents, index."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions import render
from foliary.functions.encode import tagged_json
from foliary.functions.text import folder_path, parent, stem
from foliary.operators.naming import unique_names
from foliary.operators.skew import ordinal
from foliary.operators.summary import FAILED, OK, longest_path
from foliary.session import staged


def json_target(path: Column, type_key: Column, sub: bool = True) -> Column:
    """``sub/folder/{stem}_{type}.json`` for a relative path."""
    name = F.concat(stem(path), F.lit("_"), type_key, F.lit(".json"))
    if not sub:
        return name
    folder = parent(path)
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def json_manifest(results: DataFrame, schema: T.StructType, record: str = "record") -> DataFrame:
    """(out_path, json) of every record; the type tag is always there."""
    return results.select(
        json_target(F.col("path"), F.col("type_key")).alias("out_path"),
        tagged_json(F.col("type_key"), F.col(record), schema).alias("json"),
    )


def package_manifest(results: DataFrame, ancestry: Column, base: Column, order: Sequence[str],
                     extension: str = ".pdf", existing: DataFrame | None = None) -> DataFrame:
    """Folder by type ancestry, a unique stem, and the targets of document and JSON.

    ``existing`` (see ``stems_in``) keeps a further package from overwriting the files of an earlier one.
    """
    placed = results.withColumns({"folder": folder_path(ancestry), "base": base})
    named = unique_names(placed, "folder", "base", order, existing=existing)
    return named.withColumns(
        {
            "document_target": F.concat_ws("/", "folder", F.concat("name", F.lit(extension))),
            "json_target": F.concat_ws("/", "folder", F.concat("name", F.lit(".json"))),
        }
    )


def classification_table(results: DataFrame, path: str = "selection_path") -> DataFrame:
    """file_path, model_name and path_level_1..n, n being the longest path.

    The number of columns depends on the rows, so the slim rows are written first: the classification runs once.
    """
    results = staged(results.select("path", "type_key", F.col(path).alias("__levels")), "classification")
    path = "__levels"
    longest = longest_path(results, path).first()["longest"]
    levels = [
        F.coalesce(F.get(F.col(path), i), F.lit("")).alias(f"path_level_{i + 1}") for i in range(longest)
    ]
    return results.select(F.col("path").alias("file_path"), F.col("type_key").alias("model_name"), *levels)


def rendered_manifest(records: DataFrame, schema: T.StructType, as_html: bool = False) -> DataFrame:
    """(out_path, content): each JSON record beside its Markdown or HTML form."""
    make = render.html_document if as_html else render.markdown_document
    extension = ".html" if as_html else ".md"
    target = F.concat_ws("/", F.nullif(parent(F.col("path")), F.lit("")), F.concat(stem(F.col("path")), F.lit(extension)))
    return records.select(
        target.alias("out_path"), make(F.col("record"), schema, F.col("title"), F.col("source")).alias("content")
    )


# -- index --------------------------------------------------------------------


def index_lines(docs: DataFrame, folder: str, title: str, file: str, columns: Sequence[str] = ()) -> DataFrame:
    """The Markdown index of each folder as (folder, line_no, line): heading, table head, one line per document.

    Lines are numbered across tasks, so a folder of any size becomes rows, never one value.
    """
    spark = docs.sparkSession
    heads = ["Title", *[render.label(c) for c in columns], "File"]
    head = [
        (1, f"# {render.INDEX_TITLE}"), (2, ""), (3, "| " + " | ".join(heads) + " |"),
        (4, "| " + " | ".join("---" for _ in heads) + " |"),
    ]
    types = {f.name: f.dataType for f in docs.schema.fields}
    cells = [
        F.regexp_replace(render.markdown(F.col(c), types[c]), "\n", "<br>") for c in columns
    ]
    link = F.concat(F.lit("["), F.col(file), F.lit("]("), F.col(file), F.lit(")"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(title), *cells, link), F.lit(" |"))
    rows = docs.select(folder, file, line.alias("line"))
    numbered = ordinal(rows, [folder], [file], "line_no", start=len(head) + 1).select(folder, "line_no", "line")
    head_rows = (
        docs.select(folder).distinct()
        .withColumn("h", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(t).alias("t")) for n, t in head])))
        .select(folder, F.col("h.n").alias("line_no"), F.col("h.t").alias("line"))
    )
    return head_rows.unionByName(numbered)


def index_rows_html(docs: DataFrame, title: str, file: str, columns: Sequence[str] = ()) -> DataFrame:
    """The HTML table row of every document."""
    types = {f.name: f.dataType for f in docs.schema.fields}
    cells = [F.concat(F.lit("<td>"), render.html(F.col(c), types[c]), F.lit("</td>")) for c in columns]
    name = render.escaped(F.col(file))
    row = F.concat(
        F.lit("<tr><td>"), render.escaped(F.col(title)), F.lit("</td>"), *cells,
        F.lit('<td><a href="'), F.col(file), F.lit('">'), name, F.lit("</a></td></tr>"),
    )
    return docs.withColumn("row", row)


def write_index(lines: DataFrame, folder: str, target: str) -> None:
    """Index text under one sub-folder per document folder, lines in order over ordered part files."""
    slices = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        lines.repartitionByRange(slices, folder, "line_no").sortWithinPartitions(folder, "line_no")
        .select(folder, "line").write.mode("overwrite").partitionBy(folder).text(target)
    )


# -- writing files --------------------------------------------------------------


def _placer(root: str) -> Callable[[str, Callable[[Any, str], None]], None]:
    """A function that fills ``root``/name through a part file, so that a file is whole or not there."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(_uri(root))
    made: set[str] = set()

    def place(name: str, fill: Callable[[Any, str], None]) -> None:
        target = f"{base}/{name}"
        folder = target.rsplit("/", 1)[0]
        if folder not in made:
            store.create_dir(folder, recursive=True)
            made.add(folder)
        fill(store, target + ".part")
        store.move(target + ".part", target)

    return place


def _uri(path: str) -> str:
    """Spark writes local paths as ``file:/x``, pyarrow wants ``file:///x``."""
    return "file:///" + path[len("file:/"):].lstrip("/") if path.startswith("file:/") else path


WRITTEN = "path string, status string, error_message string"


def _each_file(rows: DataFrame, root: str, filler: Callable[[Any], Callable[[Any, str], None]]) -> DataFrame:
    """(path, status, error_message) per row of (path, source): written now, once, and a file that fails is a row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _placer(root)
        for batch in batches:
            names, errors = batch.column(0).to_pylist(), []
            for name, source in zip(names, batch.column(1).to_pylist(), strict=True):
                try:
                    place(name, filler(source))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - reported as a row
                    errors.append(f"{type(exc).__name__}: {exc}")
            states = [OK if e is None else FAILED for e in errors]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(states, pa.string()), pa.array(errors, pa.string())],
                names=["path", "status", "error_message"],
            )

    return staged(rows.mapInArrow(write, WRITTEN), "written")


def write_files(manifest: DataFrame, root: str, path: str = "out_path", content: str = "content") -> DataFrame:
    """One file per row, below ``root``; gives back what became of each. A retried task writes the same files again."""

    def filler(data: Any) -> Callable[[Any, str], None]:
        def fill(store: Any, target: str) -> None:
            with store.open_output_stream(target) as out:
                out.write(data)

        return fill

    return _each_file(manifest.select(path, F.col(content).cast("binary")), root, filler)


def copy_sources(manifest: DataFrame, root: str, source: str = "path", target: str = "document_target") -> DataFrame:
    """Copy each source file to its target; gives back what became of each. Bytes stream from file to file, not through Spark."""

    def filler(origin: str) -> Callable[[Any, str], None]:
        def fill(store: Any, part: str) -> None:
            from pyarrow import fs

            files, name = fs.FileSystem.from_uri(_uri(origin))
            fs.copy_files(name, part, source_filesystem=files, destination_filesystem=store)

        return fill

    return _each_file(manifest.select(target, source), root, filler)


def write_table(enriched: DataFrame, target: str) -> None:
    enriched.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(target)
