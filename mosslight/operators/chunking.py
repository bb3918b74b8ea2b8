"""Splitting documents into chunks with heading metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..config import ChunkOptions
from ..functions import text as X

#: Separators in order of preference.
RECURSIVE = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]
CODE = ["\n\n", "\nclass ", "\nfunction ", "\ndef ", "\n\n", "\n", ". ", " ", ""]
MARKDOWN = ["\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n", "\n\n***\n\n", "\n\n---\n\n", "\n\n___\n\n", "\n\n", "\n", " ", ""]
SAMPLE = 20
RANGES = 256
#: Texts, and their bytes, that are cut at a time.
ROWS, BYTES = 256, 2 << 20


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[tuple[int, int]]:
    """Spans of chunks of at most `size` characters.

    The text is cut after the first separator that occurs in it, pieces that are too long are cut
    by the next ones, then neighbours are joined up to `size`, each chunk beginning with at most
    `overlap` characters of the one before. Surrounding white space is left out of a chunk.
    """
    if overlap >= size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")
    atoms: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= size:
            atoms.append((a, b))
            continue
        while level < len(separators) and separators[level] and text.find(separators[level], a, b) < 0:
            level += 1
        sep = separators[level] if level < len(separators) else ""
        if not sep:
            step = max(1, size - overlap)
            atoms += [(i, min(i + step, b)) for i in range(a, b, step)]
            continue
        cuts, at = [a], text.find(sep, a, b)
        while at >= 0:
            cuts.append(at + len(sep))
            at = text.find(sep, at + len(sep), b)
        cuts.append(b)
        todo += [(x, y, level + 1) for x, y in reversed(list(zip(cuts, cuts[1:], strict=False))) if y > x]
    out, i = [], 0
    while i < len(atoms):
        start, j = atoms[i][0], i
        while j + 1 < len(atoms) and atoms[j + 1][1] - start <= size:
            j += 1
        end = atoms[j][1]
        body = text[start:end]
        if body.strip():
            span = (start + len(body) - len(body.lstrip()), start + len(body.rstrip()))
            # a chunk that only adds leading space to the next one's overlap is that one
            if out and out[-1][0] == span[0]:
                out.pop()
            out.append(span)
        if j + 1 >= len(atoms):
            break
        i = j + 1
        while i > 1 and i - 1 > 0 and end - atoms[i - 1][0] <= overlap and atoms[i - 1][0] > start and atoms[j + 1][1] - atoms[i - 1][0] <= size:
            i -= 1
    return out


def choose_strategy(docs: DataFrame, o: ChunkOptions, *, content: str = "content", order: str = "doc_id") -> str:
    """markdown, code or recursive, once for a load: as told, else by the first documents."""
    if o.strategy in ("markdown", "code", "recursive"):
        return o.strategy
    sample = docs.orderBy(order).limit(SAMPLE)
    markdown = F.coalesce(F.col("is_markdown"), F.lit(False)) if "is_markdown" in docs.columns else F.lit(False)
    row = sample.agg(F.max(markdown).alias("m"), F.max(X.looks_like_code(F.col(content))).alias("c")).first()
    if row.m and o.preserve_structure:
        return "markdown"
    return "code" if row.c else "recursive"


def separators(strategy: str, o: ChunkOptions) -> list[str]:
    if strategy == "markdown":
        return MARKDOWN
    if strategy == "code":
        return CODE
    return list(o.custom_separators) or RECURSIVE


def _pieces(size: int, overlap: int, seps: list[str], content: str):
    """Batches whose last column is a text, as batches of its chunks; a worker holds the chunks of ROWS texts or BYTES at a time, or of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                of: list[int] = []
                out: tuple[list, ...] = ([], [], [], [])
                for row, text in enumerate(part.columns[-1].to_pylist()):
                    line, at = 1, 0
                    for i, (a, b) in enumerate(split_text(text or "", size, overlap, seps)):
                        line += text.count("\n", at, a) if a >= at else -text.count("\n", a, at)
                        at = a
                        of.append(row)
                        for col, x in zip(out, (i, text[a:b], line, line + text.count("\n", a, b)), strict=True):
                            col.append(x)
                own = [c.take(pa.array(of, pa.int64())) for c in part.columns[:-1]]
                types = (pa.int32(), pa.string(), pa.int32(), pa.int32())
                cols = own + [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names[:-1], "chunk_index", content, "loc_lines_from", "loc_lines_to"])

    return run


def chunk_documents(docs: DataFrame, o: ChunkOptions | None = None, *, doc_id: str = "doc_id", content: str = "content", strategy: str | None = None) -> DataFrame:
    """All columns of docs with one row per chunk: chunk_index (in its document), content, chunk_size, chunk_id, headings, lines."""
    o = o or ChunkOptions()
    strategy = strategy or choose_strategy(docs, o, content=content, order=doc_id)
    seps, size, overlap = separators(strategy, o), o.chunk_size, o.chunk_overlap

    others = [c for c in docs.columns if c != content]
    piece = StructType.fromDDL("chunk_index int, content string, loc_lines_from int, loc_lines_to int")
    piece.fields[1].name = piece.names[1] = content
    schema = StructType([docs.schema[c] for c in others] + piece.fields)
    rows = docs.select(*others, content).mapInArrow(_pieces(size, overlap, seps, content), schema)
    return enrich(rows, o, doc_id=doc_id, content=content)


def enrich(rows: DataFrame, o: ChunkOptions, *, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """chunk_size, chunk_id, and heading columns of chunk rows."""
    c = F.col(content)
    rows = rows.withColumn("chunk_size", F.length(c)).withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col(doc_id).cast("string"), F.col("chunk_index").cast("string")), 256))
    if not o.include_heading_metadata:
        return rows
    title = X.heading_title(c)
    return rows.withColumn("heading_level", X.heading_level(c)).withColumn("section_title", title).withColumn("heading_path", F.when(title.isNotNull(), F.array(title)))


def fixed_windows(docs: DataFrame, size: int = 512, overlap: int = 50, *, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, chunk_index, content, chunk_size): plain windows of `size` characters, `overlap` in common."""
    n, step = F.length(content), size - overlap
    count = F.when(n <= size, F.when(n > 0, 1).otherwise(0)).otherwise(F.ceil((n - overlap) / F.lit(step))).cast("int")
    rows = docs.select(doc_id, content, count.alias("_n")).where("_n > 0").select(doc_id, content, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk_index"))
    return rows.select(doc_id, "chunk_index", F.substring(F.col(content), F.col("chunk_index") * step + 1, F.lit(size)).alias(content)).withColumn("chunk_size", F.length(content))


def global_index(chunks: DataFrame, *, doc_id: str = "doc_id", index: str = "chunk_index") -> DataFrame:
    """global_index over all documents in order of (doc_id, index), without sorting chunks in one task.

    Documents are counted, their offsets summed within ranges of documents and then over ranges. The
    ranges end at some of the ids themselves, RANGES of them at most, those with the least hashes: they are as even for
    ids of any type as a sample of that size is.
    """
    per = chunks.groupBy(doc_id).agg(F.count("*").alias("_n"))
    ends = sorted(r[0] for r in per.where(F.col(doc_id).isNotNull()).orderBy(F.xxhash64(doc_id), doc_id).limit(RANGES).select(doc_id).collect())
    below = F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col(doc_id)) if ends else F.array()
    per = per.withColumn("_range", F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(F.size(below)))
    sums = per.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(doc_id).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.withColumn("_start", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(base, "_range").select(F.col(doc_id).alias("_doc"), (F.col("_start") + F.col("_base")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(doc_id).orderBy(index)) - 1
    out = chunks.withColumn("_place", place)
    return out.join(starts, out[doc_id].eqNullSafe(starts["_doc"])).withColumn("global_index", F.col("_start") + F.col("_place")).drop("_place", "_start", "_doc")


def chunk_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Number, rounded mean, least, largest and total length; zeros without chunks."""
    n = F.length(content)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return chunks.agg(F.count("*").alias("total_chunks"), zero(F.floor(F.avg(n) + 0.5)).alias("avg_size"), zero(F.min(n)).alias("min_size"), zero(F.max(n)).alias("max_size"), zero(F.sum(n)).alias("total_chars"))


def section_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per section title; null for chunks without a heading."""
    return chunks.groupBy("section_title").agg(F.count("*").alias("chunks"))


def dump_json(chunks: DataFrame, path: str) -> None:
    """Write chunks as JSON lines, to look at."""
    chunks.write.mode("overwrite").json(path)
