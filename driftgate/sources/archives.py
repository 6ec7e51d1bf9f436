"""Tar archives on shared storage: manifest by path, and member listing by header."""

import logging
import tarfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from driftgate.settings import DEFAULT_FACTORIES, UNKNOWN

VIDEO_SUFFIX = ".mp4"
ARCHIVE_SUFFIX = ".tar"

log = logging.getLogger(__name__)


def archive_manifest(paths: DataFrame, factories=None, path="path") -> DataFrame:
    """Archives under the requested factories, with factory and worker parsed from the path.

    `factories` is the list of requested ids (a parameter, not data).
    """
    wanted = DEFAULT_FACTORIES if factories is None else list(factories)
    parts = F.split(F.col(path), "/")
    return (paths
            .withColumn("factory_id", F.element_at(parts, 1))
            .where((F.size(parts) > 1) & F.col("factory_id").isin(wanted)
                   & F.col(path).endswith(ARCHIVE_SUFFIX))
            .withColumn("worker_id", F.coalesce(F.try_element_at(parts, F.lit(3)),
                                                F.lit(UNKNOWN))))


def _shared_file(path: str):
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_shared(path: str):
    """A seekable file on any storage the path names."""
    filesystem, path = _shared_file(path)
    return filesystem.open_input_file(path)


def create_shared(path: str):
    """A new file on any storage the path names; missing folders are made."""
    filesystem, path = _shared_file(path)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    return filesystem.open_output_stream(path)


def list_members(path: str):
    """(name, size) of each video file in the archive; none if the archive cannot be read.

    Only headers are read: the reader seeks over the contents.
    """
    try:
        with open_shared(path) as source, tarfile.open(fileobj=source, mode="r:*") as archive:
            return [(m.name, m.size) for m in archive
                    if m.isfile() and m.name.endswith(VIDEO_SUFFIX)]
    except (OSError, tarfile.TarError) as error:
        log.warning("skipping archive %s: %s", path, error)
        return []


def explode_archives(manifest: DataFrame, path="path") -> DataFrame:
    """One row per video member of each archive, next to the manifest columns."""
    names = manifest.columns
    schema = T.StructType([*manifest.schema.fields, T.StructField("member", T.StringType()),
                           T.StructField("size", T.LongType())])

    def members(batches):
        for batch in batches:
            found = [(row, *member) for row, p in enumerate(batch.column(path).to_pylist())
                     for member in list_members(p)]
            rows, member, size = zip(*found) if found else ((), (), ())
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(rows) for c in names],
                 pa.array(member, pa.string()), pa.array(size, pa.int64())], names=schema.names)

    return manifest.mapInArrow(members, schema)
