"""Trees of files as records: a Python data source with one partition for each child of the root."""

from __future__ import annotations

import os
import stat as st
import zlib
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions import text as X
from quarry.operators.ordering import numbered

# Folders that builds make, and what folders are packages.
GENERATED = (".git", ".hg", ".svn", ".fozzy", ".next", ".turbo", ".cache", "target", "node_modules", "dist", "build", ".venv", "__pycache__")
PACKAGES = {
    "app": "application", "framework": "framework", "kext": "kernel-extension", "xcodeproj": "xcode-project", "xcworkspace": "xcode-project", "playground": "playground", "photoslibrary": "photos-library",
    "imovielibrary": "media-library", "theater": "media-library", "band": "media-library", "logicx": "media-library", "pages": "document-package", "numbers": "document-package", "key": "document-package", "rtfd": "document-package", "bundle": "bundle", "plugin": "bundle", "appex": "bundle",
}
SCHEMA = "volume long, node long, parent_node long, path string, name string, kind string, len long, mode int, owner int, `group` int, xattrs_digest long, created timestamp, modified timestamp, changed timestamp, hidden boolean, tags array<string>, finder_comment string, issue string"


class _Part(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"
        self.most = int(options.get("maxdepth", 1 << 30))
        self.generated = options.get("generated", "false") == "true"
        self.packages = options.get("packages", "false") == "true"
        self.hidden = options.get("hidden", "true") == "true"

    def partitions(self):
        parts = [_Part(self.root, False)]
        if self.most >= 1 and os.path.isdir(self.root):
            parts += [_Part(f"{self.root.rstrip('/')}/{n}", True) for n in sorted(os.listdir(self.root))]
        return parts

    def read(self, part):
        base = 1 if part.deep else 0
        stack = [(part.path, base)]
        while stack:
            path, depth = stack.pop()
            name = os.path.basename(path) or path
            if not self.hidden and depth and name.startswith("."):
                continue
            try:
                s = os.lstat(path)
            except OSError as e:
                yield (None,) * 3 + (path, name, None) + (None,) * 11 + (type(e).__name__,)
                continue
            kind = "dir" if st.S_ISDIR(s.st_mode) else "file" if st.S_ISREG(s.st_mode) else "link" if st.S_ISLNK(s.st_mode) else "other"
            when = lambda t: datetime.fromtimestamp(t, timezone.utc)
            issue = None
            if kind == "dir" and part.deep and depth < self.most and not (depth and name in GENERATED and not self.generated) and not (name.rpartition(".")[2].lower() in PACKAGES and "." in name and not self.packages):
                try:
                    stack += [(f"{path}/{n}", depth + 1) for n in sorted(os.listdir(path), reverse=True)]
                except OSError as e:
                    issue = type(e).__name__
            parent = os.path.dirname(path)
            try:
                up = os.lstat(parent).st_ino
            except OSError:
                up = None
            tags = _text_attribute(path, "user.xdg.tags")
            born = getattr(s, "st_birthtime", None)
            yield (
                s.st_dev, s.st_ino, up, path, name, kind, s.st_size, s.st_mode & 0o7777, s.st_uid, s.st_gid, _digest(path), None if born is None else when(born), when(s.st_mtime), when(s.st_ctime), name.startswith("."),
                [t.strip() for t in (tags or "").split(",") if t.strip()], _text_attribute(path, "user.xdg.comment"), issue,
            )


class TreeSource(DataSource):
    """format("tree"): path; maxdepth, generated, packages, hidden."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """Records of the tree, the root included, by path; rows with an issue are paths that could not be read."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("path", root)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower())
    return reader.load().orderBy("path")


def package_kind(path: Column, kind: Column) -> Column:
    """The kind of package that a folder is, or null."""
    known = F.create_map(*(F.lit(x) for pair in PACKAGES.items() for x in pair))
    return F.when(kind == "dir", F.try_element_at(known, F.lower(X.extension(path))))


def summary(records: DataFrame, *by: Column) -> DataFrame:
    """n records and their bytes by lane, kind of package or any other columns."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"))


def _digest(path: str) -> int:
    """Of a file's extended attributes, by name: 0x0 between names and values, so that none run together."""
    try:
        names = sorted(os.listxattr(path, follow_symlinks=False))
        return zlib.crc32(b"".join(os.fsencode(n) + b"\0" + os.getxattr(path, n, follow_symlinks=False) + b"\0" for n in names))
    except OSError:
        return zlib.crc32(b"")


def _text_attribute(path: str, name: str) -> str | None:
    try:
        return os.getxattr(path, name, follow_symlinks=False).decode("utf-8", "replace") or None
    except OSError:
        return None


def outside_generated(records: DataFrame, path: str = "path") -> DataFrame:
    """Records without a generated folder among their ancestors; the folder itself stays."""
    parts = X.components(F.col(path))
    return records.filter(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda c: c.isin(*GENERATED)))


def lanes(records: DataFrame, visible: list[str], burst: int = 8) -> DataFrame:
    """Order of a fair crawl: so many of the visible folders' records, then one of the rest."""
    seen = F.lit(False)
    for v in visible:
        seen = seen | (F.col("path") == v) | F.startswith("path", F.lit(v.rstrip("/") + "/"))
    rows = records.withColumn("lane", F.when(seen, "visible").otherwise("background"))
    return numbered(rows, ["lane"], ["path"]).withColumn("turn", F.floor(F.col("nth") / F.when(F.col("lane") == "visible", burst).otherwise(1)).cast("long"))
