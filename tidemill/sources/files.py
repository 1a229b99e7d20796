"""File manifests: registration, chunked uploads, listings, copies and prefix deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

DEFAULT_LIST_LIMIT = 100


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of the files below a path; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("name"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("updated_at"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def register_datasets(files: DataFrame, owner: str) -> DataFrame:
    """One catalog row per uploaded file (``file_name``, ``size_bytes``, ``created_at``)."""
    name = F.col("file_name")
    dataset_id = F.concat(F.lit("dataset-"), F.substring(
        F.sha2(F.concat_ws("/", F.lit(owner), name), 256), 1, 12))
    return files.select(
        dataset_id.alias("dataset_id"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("name"),
        name,
        F.concat(F.lit(f"users/{owner}/datasets/"), dataset_id, F.lit("/"), name).alias("file_path"),
        "created_at",
        "size_bytes",
        F.substring_index(name, ".", -1).alias("format"),
        F.lit(None).cast("bigint").alias("samples"),
    )


def reassemble_chunks(
    chunks: DataFrame, key: str = "upload_id", chunks_per_part: int = 1024
) -> DataFrame:
    """Contents of complete uploads, chunks joined in order of their numbers.

    Complete means that every number from 0 to ``total_chunks`` - 1 is there, in whatever
    order the chunks came in; a chunk that was sent again counts once. A file comes as
    consecutive parts of ``chunks_per_part`` chunks with their byte offsets, so one huge
    upload is neither one cell nor one task; a shorter file is a single part. Binary
    content stays binary.
    """
    part = F.floor(F.col("chunk_number") / chunks_per_part)
    once = chunks.where(F.col("chunk_number") < F.col("total_chunks")).groupBy(
        key, "total_chunks", "chunk_number"
    ).agg(F.min("content").alias("content")).withColumn("part_no", part)
    sizes = once.groupBy(key, "total_chunks", "part_no").agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(F.octet_length("content")).cast("bigint").alias("__bytes"))
    upload = Window.partitionBy(key, "total_chunks")
    before = upload.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    complete = sizes.select(
        key, "total_chunks", "part_no",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.sum("__bytes").over(upload).alias("file_bytes"),
        F.sum("__n").over(upload).alias("__have"),
    ).where(F.col("__have") == F.col("total_chunks"))
    pieces = F.array_sort(F.collect_list(F.struct("chunk_number", "content")))
    parts = once.groupBy(key, "total_chunks", "part_no").agg(pieces.alias("__p"))
    if isinstance(chunks.schema["content"].dataType, BinaryType):
        content = F.unhex(F.array_join(F.transform("__p.content", F.hex), ""))
    else:
        content = F.array_join("__p.content", "")
    return parts.join(complete, [key, "total_chunks", "part_no"]).select(
        key, "part_no", "byte_offset", "file_bytes",
        content.alias("content"))


def list_files(
    manifest: DataFrame, prefix: str | None = None, limit: int = DEFAULT_LIST_LIMIT
) -> DataFrame:
    """The first names under a prefix, in order."""
    kept = manifest if prefix is None else manifest.where(F.startswith("name", F.lit(prefix)))
    return kept.orderBy("name").limit(limit)


def copyable(manifest: DataFrame, skip: str = "tmp") -> DataFrame:
    """Plain files of a folder listing, without the one named like the scratch folder."""
    return manifest.where(~F.col("is_dir") & (F.col("name") != skip))


def prefix_delete(manifest: DataFrame, prefix: str) -> DataFrame:
    """What is left after a folder is deleted; a sibling with a longer name stays."""
    inside = F.startswith("name", F.lit(prefix.rstrip("/") + "/"))
    return manifest.where(~inside & (F.col("name") != prefix.rstrip("/")))
