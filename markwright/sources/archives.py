"""Zip archives as a source, and their publication as files: idempotent, and never visible in part.

An archive is read by one task, a member at a time. Publication writes a member
under a side name and renames it; a task that is lost or repeated leaves only
side files. The manifest grows by batches that are renamed whole after their
files are in place, so a file it names is there; a run that finds nothing new
writes nothing.

Edge cases. A member that would leave its archive's folder (``..``, an absolute
or drive path, a backslash), or is a link, is ``unsafe``; one that cannot be read
(a bad checksum, a password) is ``corrupt``, and so is an archive that isn't one
(its member is null). Neither is published, and the rest of the archive is. Of
members of one name the last counts. Folders have no entry. An archive is to
fit in memory (Spark's limit on a binary value is 2 GB).
"""

from __future__ import annotations

import hashlib
import io
import stat
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import hadoop

ENTRY = "archive string, member string, status string, size long, sha256 string"
MANIFEST = "sha256 string, path string, version long"


def safe(info: zipfile.ZipInfo) -> bool:
    name = info.orig_filename
    parts = name.split("/")
    return bool(name) and "\\" not in name and "\0" not in name and ":" not in parts[0] and not name.startswith("/") and ".." not in parts and not stat.S_ISLNK(info.external_attr >> 16)


def members(content: bytes) -> Iterator[tuple[str | None, str, bytes | None]]:
    """(name, status, bytes) of an archive's files; bytes only of those that are ``ok``."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError):
        yield None, "corrupt", None
        return
    last = {i.orig_filename: i for i in archive.infolist() if not i.is_dir()}
    for name, info in last.items():
        if not safe(info):
            yield name, "unsafe", None
            continue
        try:
            data = archive.read(info)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError, ValueError, zipfile.zlib.error):
            yield name, "corrupt", None
            continue
        yield name, "ok", data


def archives(spark: SparkSession, root: str) -> DataFrame:
    """Every zip file under ``root``: archive (its path there, without the ending) and content."""
    base = str(hadoop(spark, root)[0].makeQualified(hadoop(spark, root)[1])).rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(root)
    inside = F.substring(plain(F.col("path")), F.length(plain(F.lit(base))) + 1, F.length("path"))
    return files.select(F.regexp_replace(inside, r"\.zip$", "").alias("archive"), "content")


def entries(zips: DataFrame) -> DataFrame:
    """A row a member of ``archives``: archive, member, status (ok, unsafe, corrupt), size and sha256 (of ok ones)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive"), b.column("content"), strict=True):
                rows = [(name.as_py(), m, s, None if d is None else len(d), None if d is None else hashlib.sha256(d).hexdigest()) for m, s, d in members(content.as_py())]
                if rows:
                    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], ["archive", "member", "status", "size", "sha256"])

    return zips.mapInArrow(one, ENTRY)


def manifest(spark: SparkSession, dest: str) -> DataFrame:
    """What is published: sha256 and path of each file as last written, and the version (run) that wrote it."""
    fs, at = hadoop(spark, f"{dest}/_manifest")
    if not fs.exists(at) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(at)):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{dest}/_manifest")
    last = rows.groupBy("path").agg(F.max(F.struct("version", "sha256")).alias("last"))
    return last.select("last.sha256", "path", "last.version")


def lines(published: DataFrame) -> DataFrame:
    """The manifest as sorted text lines: digest, two blanks, path."""
    return published.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value"))


def publish(spark: SparkSession, root: str, dest: str) -> int:
    """Write the members of all archives under ``root`` that ``dest`` hasn't got as they are; how many were written."""
    from pyarrow import fs as pafs

    zips, dest = archives(spark, root), dest.rstrip("/")
    known = manifest(spark, dest)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    found = entries(zips).where("status = 'ok'").withColumn("path", F.concat_ws("/", "archive", "member"))
    new = found.join(known.select("sha256", "path"), ["sha256", "path"], "left_anti").groupBy("archive").agg(F.collect_list("member").alias("members"))
    uri = dest if "://" in dest else str(hadoop(spark, dest)[1].toUri().getPath())

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
        made = set()

        def folder(path: str) -> None:
            if path not in made:
                files.create_dir(path, recursive=True)
                made.add(path)

        for b in batches:
            for name, content, wanted in zip(*(b.column(c) for c in ("archive", "content", "members")), strict=True):
                names, done = set(wanted.as_py()), []
                for member, status, data in members(content.as_py()):
                    if status != "ok" or member not in names:
                        continue
                    path, part = f"{name}/{member}", f"{base}/_parts/{uuid.uuid4().hex}"
                    folder(f"{base}/_parts")
                    folder(f"{base}/{path}".rsplit("/", 1)[0])
                    with files.open_output_stream(part) as out:
                        out.write(data)
                    files.move(part, f"{base}/{path}")
                    done.append((hashlib.sha256(data).hexdigest(), path, version))
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*done, strict=True)], ["sha256", "path", "version"])

    batch = uuid.uuid4().hex
    staged = f"{dest}/_manifest/_staged-{batch}"
    zips.join(new, "archive").mapInArrow(one, MANIFEST).write.option("compression", "zstd").parquet(staged)
    n = spark.read.schema(MANIFEST).parquet(staged).count()
    fs, source = hadoop(spark, staged)
    if not n:
        fs.delete(source, True)
    elif not fs.rename(source, hadoop(spark, f"{dest}/_manifest/batch={batch}")[1]):
        raise OSError(f"could not publish {staged}")
    return n


def read_back(spark: SparkSession, dest: str) -> DataFrame:
    """The manifest with each file's digest as it is now: sha256, path, version, found (null: no such file).

    Files are opened by the manifest's paths: Spark's own file sources leave out empty ones.
    """
    uri = dest.rstrip("/") if "://" in dest else str(hadoop(spark, dest)[1].toUri().getPath())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        files, base = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)

        def digest(path: str) -> str | None:
            held = hashlib.sha256()
            try:
                with files.open_input_stream(f"{base}/{path}") as f:
                    while data := f.read(1 << 20):
                        held.update(data)
            except FileNotFoundError:
                return None
            return held.hexdigest()

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(p.as_py()) for p in b.column("path")], pa.string())], [*b.schema.names, "found"])

    return manifest(spark, dest).repartition(parts, "path").mapInArrow(one, MANIFEST + ", found string")


def pack(df: DataFrame, path: str, archive: str, member: str, text: str) -> None:
    """Zip archives of a column's texts, one for each value of ``archive``, which is to have few enough rows for a task."""
    from pyarrow import fs as pafs

    spark = df.sparkSession
    uri = path if "://" in path else str(hadoop(spark, path)[1].toUri().getPath())

    def one(pdf):
        files, base = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
        files.create_dir(base, recursive=True)
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, value in sorted(zip(pdf.member, pdf.text, strict=True)):
                z.writestr(name, value)
        side = f"{base}/_{uuid.uuid4().hex}"
        with files.open_output_stream(side) as out:
            out.write(held.getvalue())
        files.move(side, f"{base}/{pdf.archive.iloc[0]}.zip")
        return pdf[["archive"]].head(1)

    narrow = df.select(F.col(archive).cast("string").alias("archive"), F.col(member).alias("member"), F.col(text).alias("text"))
    narrow.groupBy("archive").applyInPandas(one, "archive string").write.format("noop").mode("overwrite").save()
