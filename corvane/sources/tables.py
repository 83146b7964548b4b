"""Parquet tables by name, and the Markdown projection with its content hash."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import scalars as S
from corvane.session import partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_hash(fields: dict[str, Column], text: Column) -> Column:
    """A document of sorted frontmatter fields, the hash of its body, and the body. Null fields and texts count as ''."""
    text = F.coalesce(text, F.lit(""))
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(fields[k].cast("string"), F.lit(""))) for k in sorted(fields)]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines, F.concat(F.lit("content_hash: "), S.content_hash(text))), F.lit("\n---\n"), text)


def projection(holons: DataFrame, *more: str) -> DataFrame:
    """Each holon as the Markdown file it is projected to: path and document; and more of its columns."""
    fields = {c: F.col(c) for c in ("type", "kind", "layer", "scope")}
    path = F.concat(F.lit("knowledge/"), F.trim("layer"), F.lit("/"), S.slug(F.col("id")), F.lit(".md"))
    text = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return holons.select(path.alias("path"), with_hash(fields, text).alias("document"), *more)


#: Files that a task reads before it hands them on, and their bytes.
FILES, BYTES = 1000, 4 << 20


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    return fs.FileSystem.from_uri(folder)


def write_markdown(files: DataFrame, folder: str) -> None:
    """Write each document (path, document) as a file of its own, named after its path, in place of what the folder held.

    The tasks create the files themselves, one open file at a time. Each does so in a folder of its own, which it moves into
    place once it is whole, so a task that is run again leaves every file once. Rows without path or document are left out.
    """
    store, root = _located(folder)
    store.delete_dir_contents(root, missing_dir_ok=True)
    store.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _located(folder)
        mine, place, n = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{TaskContext.get().partitionId():05}", 0
        for batch in batches:
            if not n:
                store.create_dir(mine)
            for path, document in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                with store.open_output_stream(f"{mine}/{_file_name(path)}", compression=None) as out:
                    out.write(document)
            n += batch.num_rows
        if n and store.get_file_info(place).type == fs.FileType.NotFound:
            store.move(mine, place)
        elif n:  # the same files, by an attempt before
            store.delete_dir(mine)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    one = files.filter(F.col("path").isNotNull() & F.col("document").isNotNull()).groupBy("path").agg(F.max("document").alias("document"))
    one.repartition(partitions(files.sparkSession), "path").mapInArrow(write, "n long").collect()


def _file_name(path: str) -> str:
    return "path=" + path.replace("%", "%25").replace("/", "%2F").replace("\0", "%00")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, document of the files write_markdown() wrote, each read whole. Tasks list the files: the driver knows their folders only."""
    store, root = _located(folder)
    parts = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _located(folder)
        paths, documents, size = [], [], 0
        for i in (i for batch in batches for i in batch.column(0).to_pylist()):
            for x in store.get_file_info(fs.FileSelector(parts[i])):
                with store.open_input_stream(x.path, compression=None) as file:
                    documents.append(file.read())
                paths.append(unquote(x.base_name.removeprefix("path=")))
                size += len(documents[-1])
                if len(paths) == FILES or size >= BYTES:
                    yield _batch(paths, documents)
                    paths, documents, size = [], [], 0
        yield _batch(paths, documents)

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(read, "path string, document string")


def _batch(paths: list[str], documents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(documents, pa.binary()).cast(pa.string())], ["path", "document"])


def validated(files: DataFrame) -> DataFrame:
    """path, document -> body, tampered, expected, actual."""
    doc = F.col("document")
    return files.select(
        "path",
        S.body(doc).alias("body"),
        S.tampered(doc).alias("tampered"),
        F.coalesce(S.stored_hash(doc), F.lit("")).alias("expected"),
        S.content_hash(S.body(doc)).alias("actual"),
    )


def healed(files: DataFrame, holons: DataFrame) -> DataFrame:
    """Each file as it should be: a tampered document is replaced by the projection of its holon, if its path names one."""
    ours = projection(holons).select(S.holon_id_of_path(F.concat(F.lit("/"), F.col("path"))).alias("_id"), F.col("document").alias("_fresh")).filter(F.col("_id") != "").dropDuplicates(["_id"])
    bad = S.tampered(F.col("document"))
    joined = files.withColumn("_id", S.holon_id_of_path(F.col("path"))).join(ours, "_id", "left")
    return joined.select("path", F.when(bad, F.coalesce("_fresh", "document")).otherwise(F.col("document")).alias("document"), bad.alias("was_tampered"))


def changed_files(lines: DataFrame) -> DataFrame:
    """`status<TAB>path` lines, as a name-status diff prints them -> status, path. Lines of any other shape are dropped."""
    parts = F.split("value", "\t")
    return lines.filter(F.size(parts) >= 2).select(F.element_at(parts, 1).alias("status"), F.element_at(parts, -1).alias("path"))
