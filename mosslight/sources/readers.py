"""Readers of documents: text, Markdown, HTML, PDF (with a parser given), repository checkouts, fetched web pages.

Every reader is a Spark plan over paths or tables, so files are listed and read by tasks, where they lie and only
when a query needs them.
"""

from __future__ import annotations

import itertools
import os
import re
import stat
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..functions.selector import selected_html

#: content type -> reader(spark, paths, options) of (file_path, content, file_size, ...)
READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    def put(f):
        READERS[name] = f
        return f

    return put


#: Bytes of a file that Spark reads as one value, at most.
MAX_BYTES = 2**31 - 1 - 2**20
#: Tasks per core that a scan of many small files is cut into.
TASKS = 4
#: Entries of a listing, files that are read, and bytes of these, that a worker holds at a time.
ENTRIES, ROWS, BYTES = 10_000, 256, 2 << 20


def any_case(ext: str) -> str:
    """A glob for file names with an extension, in lower or upper case."""
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext.lower())


def plain_path(c: Column) -> Column:
    """A path without the scheme of local files, which readers write in several ways."""
    return F.regexp_replace(c, "^file:/+", "/")


def in_tasks(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A scan of files in TASKS tasks per core at most: Spark reckons 4 MB for opening a file, so small ones would be a task for every 32."""
    return files.coalesce(TASKS * spark.sparkContext.defaultParallelism)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as readers show those of its files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def is_mounted(path: str) -> bool:
    """Whether tasks open a qualified path like any local file."""
    return path.startswith("file:/")


#: A file or folder of a listing; a folder has no length.
LISTED = "path string, modificationTime timestamp, length long"
_ENTRY = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
_OPENED = pa.schema([*_ENTRY, ("content", pa.binary()), ("load_error", pa.string())])


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _entries(folder: str, whole: bool) -> Iterator[tuple[str, int, int | None]]:
    """What lies in a folder; with `whole` the files that lie anywhere below it. What goes meanwhile is left out."""
    todo = [folder]
    while todo:
        try:
            found = os.scandir(todo.pop())
        except FileNotFoundError:
            continue
        with found:
            for e in found:
                if _hidden(e.name):
                    continue
                try:
                    own = e.stat()
                except FileNotFoundError:
                    continue
                if not stat.S_ISDIR(own.st_mode):
                    yield e.path, own.st_mtime_ns // 1_000_000 * 1_000, own.st_size
                elif whole:
                    todo.append(e.path)
                else:
                    yield e.path, own.st_mtime_ns // 1_000_000 * 1_000, None


def _listing(whole: bool):
    """Batches of a listing in which folders are replaced by what lies in them; a worker holds ENTRIES of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(2).is_valid()
            files = batch.filter(of)
            if files.num_rows:
                yield files
            for path in batch.column(0).filter(pc.invert(of)).to_pylist():
                found = _entries(path.removeprefix("file:"), whole)
                while rows := list(itertools.islice(found, ENTRIES)):
                    # a name that isn't UTF-8 is shown with U+FFFD, and can't be opened by what is shown
                    names = ["file:" + os.fsencode(r[0]).decode("utf-8", "replace") for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([r[1] for r in rows], pa.int64()).cast(_ENTRY.types[1]), pa.array([r[2] for r in rows], pa.int64())], schema=_ENTRY)

    return run


def dealt(files: DataFrame) -> DataFrame:
    """Rows of a listing in TASKS tasks per core, by their paths."""
    return files.repartition(TASKS * files.sparkSession.sparkContext.defaultParallelism, "path")


def files_below(folders: DataFrame, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of the files below folders(path), which are mounted wherever tasks run.

    Tasks list the folders, level by level, and what lies in one is dealt out before it is listed in turn: neither the driver
    nor a single task holds a list of all files.
    """
    rows = folders.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(None).cast("long").alias("length"))
    rows = rows.mapInArrow(_listing(False), LISTED)
    for whole in (False, True) if recursive else ():
        rows = dealt(rows).mapInArrow(_listing(whole), LISTED)
    # like Spark's readers, which leave out empty files
    return rows.where("length > 0")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their content, ROWS or BYTES at a time. One that is too large for a value, or can't be read, has an error instead."""
    rows, held = [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OPENED.types, strict=True)], schema=_OPENED)
    for batch in batches:
        for path, modified, size in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2))), strict=True):
            data, error = None, None
            try:
                if size <= MAX_BYTES:
                    with open(path.removeprefix("file:"), "rb") as f:
                        data = f.read(MAX_BYTES + 1)
                    size = len(data)
                if size > MAX_BYTES:
                    data, error = None, f"file of {size} bytes is too large"
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
            if rows and (len(rows) == ROWS or held + (len(data) if data else 0) > BYTES):
                yield flush()
                rows, held = [], 0
            rows.append((path, modified, size, data, error))
            held += len(data) if data else 0
    if rows:
        yield flush()


def opened(files: DataFrame) -> DataFrame:
    """files(path, modificationTime, length) with content and load_error, read by tasks that they are dealt out to."""
    return dealt(files.select("path", "modificationTime", "length")).mapInArrow(_open, f"{LISTED}, content binary, load_error string")


def _roots(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, paths))).alias("path"))


def _named(exts: list[str]) -> Column:
    return F.col("path").rlike("(?i)(" + "|".join(map(re.escape, exts)) + r")\z")


def _scanned(spark: SparkSession, paths: list[str], recursive: bool, exts: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length, content) by Spark's own reader, whose index of files is in the driver's JVM."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return in_tasks(spark, (source.option("pathGlobFilter", "{" + ",".join(map(any_case, exts)) + "}") if exts else source).load([escaped(p) for p in paths]))


def _files(spark: SparkSession, paths: list[str], recursive: bool = False, exts: list[str] | None = None, where: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """(path, modificationTime, length, content, load_error) of files, and of those below folders that have one of some extensions, for which `where` holds and whose id only(doc_id) has.

    Tasks list mounted folders and read their files. Files given by name, and other stores, are read by Spark.
    """
    own = [full for full in (qualified(spark, p) for p in paths) if is_mounted(full) and path_exists(spark, full)[1]]
    rest = [p for p in paths if qualified(spark, p) not in own]
    keep = F.lit(True) if where is None else where
    wanted = lambda files: files if only is None else files.join(only.select("doc_id"), F.xxhash64("path") == F.col("doc_id"), "left_semi")
    out = None
    if own:
        files = files_below(_roots(spark, own), recursive)
        out = opened(wanted(files.where(keep & _named(exts) if exts else keep)))
    if rest:
        raw = wanted(_scanned(spark, rest, recursive, exts).where(keep))
        # a value that is too large is never asked for
        none = lambda t: F.lit(None).cast(t)
        good = raw.where(F.col("length") <= MAX_BYTES).withColumn("load_error", none("string"))
        large = raw.where(F.col("length") > MAX_BYTES).select("path", "modificationTime", "length", none("binary").alias("content"), F.concat(F.lit("file of "), "length", F.lit(" bytes is too large")).alias("load_error"))
        out = good.unionByName(large) if out is None else out.unionByName(good).unionByName(large)
    return out


def escaped(path: str) -> str:
    """A path whose characters mean themselves: Spark takes paths as globs."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _whole(spark: SparkSession, paths: list[str], recursive: bool = False, files: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """One row per file: (file_path, content, file_size, load_error). A file too large for one value is a row with an error."""
    raw = _files(spark, paths, recursive, only=only) if files is None else files
    # bytes are decoded as UTF-8; what isn't valid becomes U+FFFD instead of failing the load
    return raw.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("file_size"), "load_error")


@reader("text")
def read_text(spark: SparkSession, paths: list[str], recursive: bool = False, files: DataFrame | None = None, only: DataFrame | None = None, **_) -> DataFrame:
    """One row per file; `files` are those of the paths, where they are listed already, only(doc_id) names those that are wanted."""
    return _whole(spark, paths, recursive, files, only)


@reader("markdown")
def read_markdown(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    return read_text(spark, paths, **options).withColumn("is_markdown", F.lit(True)).withColumn("preserve_structure", F.lit(True))


@reader("html")
def read_html(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    raw = read_text(spark, paths, **options)
    return raw.withColumn("title", H.html_title(F.col("content"), F.col("file_path"))).withColumn("content", H.html_to_text(F.col("content"))).withColumn("is_html", F.lit(True))


@reader("pdf")
def read_pdf(spark: SparkSession, paths: list[str], parser: Callable[[bytes], list[str]] | None = None, split_pages: bool = False, separator: str = "\n", recursive: bool = False, files: DataFrame | None = None, only: DataFrame | None = None, **_) -> DataFrame:
    """PDF files by a parser that gives the pages' texts; none is bundled. A file at which it raises is a row with `load_error`."""
    if parser is None:
        raise RuntimeError("reading PDF files needs parser=: a function from bytes to the texts of the pages")
    raw = (_files(spark, paths, recursive, only=only) if files is None else files).select("path", "content", "length", "load_error")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data, size, error in zip(pdf["path"], pdf["content"], pdf["length"], pdf["load_error"], strict=True):
                if data is None:
                    rows.append((path, None, size, None, error))
                    continue
                try:
                    pages = parser(bytes(data))
                except Exception as e:  # noqa: BLE001  one bad file must not end the load
                    rows.append((path, None, size, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(path, t, size, i + 1, None) for i, t in enumerate(pages)] if split_pages else [(path, separator.join(pages), size, None, None)]
            yield pd.DataFrame(rows, columns=["file_path", "content", "file_size", "page", "load_error"]).astype({"page": "Int32"})

    return raw.mapInPandas(parse, "file_path string, content string, file_size long, page int, load_error string")


@reader("github")
def read_repository(spark: SparkSession, paths: list[str], ignore: str = X.DEFAULT_IGNORE, recursive: bool = True, branch: str = "main", only: DataFrame | None = None, **_) -> DataFrame:
    """All text files of local checkouts, but for ignored paths. `branch` is recorded, not switched."""
    out = None
    for root in paths:
        base = qualified(spark, root).rstrip("/") + "/"
        relative = lambda c: F.substring(F.col(c), F.lit(len(base) + 1), F.length(c))  # noqa: B023, E731
        # ignored files are not read
        kept = ~X.ignored(relative("path"), [*X.ignore_patterns(ignore), ".git/**"])
        rows = _whole(spark, [root], files=_files(spark, [root], recursive, where=kept, only=only))
        rows = rows.withColumn("relative_path", relative("file_path")).withColumn("branch", F.lit(branch))
        out = rows if out is None else out.unionByName(rows)
    return out


@reader("web")
def read_pages(spark: SparkSession, paths: list[str], selector: str | None = None, only: DataFrame | None = None, **_) -> DataFrame:
    """Parquet tables of fetched pages (url, html, and status where known)."""
    pages = spark.read.parquet(*paths)
    return web_pages(pages if only is None else pages.join(only.select("doc_id"), F.xxhash64("url") == F.col("doc_id"), "left_semi"), selector=selector)


def web_pages(pages: DataFrame, *, url: str = "url", html: str = "html", status: str = "status", selector: str | None = None) -> DataFrame:
    """Usable pages as documents; pages behind a login or with an error are left out. A CSS selector takes the text of the elements that it names."""
    code: Column = F.col(status) if status in pages.columns else F.lit(200)
    refused = U.auth_gate(code, F.col(url), F.col(html))
    rows = pages.where(refused.isNull())
    body = F.col(html) if selector is None else selected_html(F.col(html), selector)
    return rows.select(F.col(url).alias("file_path"), H.html_to_text(body).alias("content"), F.octet_length(F.col(html)).cast("long").alias("file_size"), H.html_title(F.col(html), F.col(url)).alias("title"))


def list_files(spark: SparkSession, directory: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """Files below a directory with a supported extension, in lower or upper case."""
    full = qualified(spark, directory)
    files = files_below(_roots(spark, [full]), recursive) if is_mounted(full) else _scanned(spark, [directory], recursive)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("file_size")).where(X.extension(F.col("file_path")).isin(extensions or U.SUPPORTED))


def path_exists(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(exists, is a directory), by the path's own file system; errors mean no."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        return True, bool(status.isDirectory())
    except Exception:
        return False, False


def detect_type(path: str) -> str:
    """file_type() for one path, in the driver."""
    if re.match(U.REPOSITORY_URL, path):
        return "github"
    if re.match(r"^https?://[^/\s]+", path):
        return "web"
    ext = re.search(r"[^./\\](\.[^./\\]*)$", path)
    return {".pdf": "pdf", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html"}.get(ext[1].lower() if ext else "", "text")


def stamped(rows: DataFrame, file_type: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Add file_name, file_type, loaded_at, source, doc_id and the caller's own metadata, which wins."""
    out = rows.withColumn("file_name", X.base_name(F.col("file_path"))).withColumn("file_type", F.lit(file_type)).withColumn("loaded_at", F.current_timestamp()).withColumn("source", F.col("file_path"))
    for k, v in (metadata or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out.withColumn("doc_id", F.xxhash64("file_path"))


def _kinds(spark: SparkSession, path: str, recursive: bool, kinds: dict[str, list[str]]) -> list[str]:
    """Which kinds of files, named by their extensions, lie below a folder."""
    full = qualified(spark, path)
    if not is_mounted(full):
        return [kind for kind, exts in kinds.items() if not _scanned(spark, [path], recursive, exts).select("path").isEmpty()]
    kind = F.coalesce(*[F.when(_named(exts), F.lit(k)) for k, exts in kinds.items()])
    found = {r.kind for r in files_below(_roots(spark, [full]), recursive).select(kind.alias("kind")).distinct().collect()}
    return [k for k in kinds if k in found]


def load_documents(spark: SparkSession, paths: list[str], *, file_type: str | None = None, metadata: dict[str, str] | None = None, recursive: bool = True, only: DataFrame | None = None, **options) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(documents, failures) for files, directories and checkouts.

    Directories stand for the supported files below them. What can't be found fails by itself;
    an error is raised when nothing is left. only(doc_id) names the documents that are wanted, no other is read.
    """
    failures: list[tuple[str, str]] = []
    single: dict[str, list[str]] = {}
    folders: list[tuple[str, str, DataFrame]] = []
    kinds: dict[str, list[str]] = {}
    for ext in U.SUPPORTED:
        kinds.setdefault(file_type or detect_type(f"x{ext}"), []).append(ext)
    for path in paths:
        exists, is_dir = path_exists(spark, path)
        if not exists:
            failures.append((path, "file not found or not readable"))
        elif is_dir and file_type != "github":
            # kinds that aren't there are not read, and only PDF files that are need a parser
            own = _kinds(spark, path, recursive, kinds)
            folders += [(kind, path, _files(spark, [path], recursive, kinds[kind], only=only)) for kind in own]
            if not own:
                failures.append((path, "no supported file"))
        else:
            single.setdefault(file_type or detect_type(path), []).append(path)
    out = None
    # a folder is read as one: its files are listed by tasks and never by name here
    loads = [(kind, own, {"recursive": recursive} if kind == "github" else {}) for kind, own in single.items()]
    loads += [(kind, [root], {"recursive": recursive, "files": files}) for kind, root, files in folders]
    for kind, own, more in loads:
        rows = stamped(READERS[kind](spark, own, only=only, **options, **more), kind, metadata)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("Failed to load documents: " + "; ".join(f"{p}: {e}" for p, e in failures))
    return out, failures
