"""Small files and folders on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_folder: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Without that setting a folder of this process is used in local mode, and gone at its end; on a cluster that is an error, for
    no local folder is seen by all executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp("-tables"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return "file://" + _own_folder[0]


def join(*parts: str) -> str:
    """A path below the first part, which may have a scheme."""
    return "/".join([parts[0].rstrip("/"), *(p.strip("/") for p in parts[1:])])


def is_local(path: str) -> bool:
    return not re.match(r"[a-zA-Z][\w+.-]*://", path) or path.startswith("file:")


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        """Bytes of a file or of all files in a folder."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        """Copies a folder, which may lie on another file system."""
        (a, p), (b, q) = self._at(source), self._at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, self.conf)

    def rename(self, source: str, target: str) -> None:
        """In one step, over what is there."""
        _, p = self._at(source)
        _, q = self._at(target)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.getFileSystem(self.conf).getUri(), self.conf).rename(p, q, how)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.getFileStatus(p).isDirectory()

    def folders(self, path: str) -> list[str]:
        """Paths right below a folder; none if it isn't there."""
        fs, p = self._at(path)
        return sorted(str(x.getPath().toString()).removeprefix("file:") for x in fs.listStatus(p)) if fs.exists(p) else []

    def head(self, path: str, n: int) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
        finally:
            stream.close()

    def read_bytes(self, path: str) -> bytes:
        return self.head(path, self.size(path))

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Readers see the old text or the new one, never a part."""
        tmp = f"{path}.{uuid.uuid4().hex}"
        fs, p = self._at(tmp)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.rename(tmp, path)
