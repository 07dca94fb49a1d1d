"""Office containers as tables: one row for each file, then one for each entry inside.

A container is opened once; every detector works on the same entries table. Bytes of unwanted
entries are never inflated, and the container's own bytes are not carried further.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathquarry.sources.cfb import Compound, is_compound

ENTRY = "doc_id string, suffix string, entry string, size long, data binary, error string"
#: Unless told otherwise, an entry that inflates to more bytes than this is an error row, not data (a few kB of a zip can inflate to all of a task's memory).
LARGEST_ENTRY = 512 << 20
UNWANTED = r"^word/media/"
#: Entries of small files go on together, up to about so many rows or bytes.
TOGETHER_ROWS, TOGETHER_BYTES = 1000, 4 << 20


def read_containers(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """doc_id (the path), suffix (lower case), length, sha256, content of every file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return described((reader.option("pathGlobFilter", glob) if glob else reader).load(path).withColumnRenamed("path", "doc_id"))


def described(files: DataFrame) -> DataFrame:
    """``files``: doc_id, content."""
    return files.select("doc_id", F.lower(F.regexp_extract("doc_id", r"(\.[^./\\]+)$", 1)).alias("suffix"), F.length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"), "content")


def _opened(suffix: str, data: bytes, leaf: str, unwanted: re.Pattern, largest: int | None = LARGEST_ENTRY) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as file:
            for info in {i.filename: i for i in file.infolist()}.values():
                wanted = not unwanted.search(info.filename)
                too_large = largest is not None and info.file_size > largest
                try:
                    inner = file.read(info) if wanted and not too_large else None
                    yield info.filename, info.file_size, inner, "entry too large" if too_large else None
                except Exception as problem:  # a damaged member
                    yield info.filename, info.file_size, None, f"{type(problem).__name__}: {problem}"
    elif is_compound(data):
        file = Compound(data)
        for name in file.names():
            try:
                inner = file.read(name)
                yield name, len(inner), inner, None
            except Exception as problem:
                yield name, 0, None, f"{type(problem).__name__}: {problem}"
    elif suffix in (".fodt", ".xml"):
        yield leaf, len(data), data, None
    else:
        raise ValueError("neither a zip nor a compound file")


def entries_of(containers: DataFrame, unwanted: str = UNWANTED, largest: int | None = LARGEST_ENTRY) -> DataFrame:
    """(doc_id, suffix, entry, size, data, error). A file that can't be opened is one row with an error and no entry.

    Duplicate member names keep the last. Null content is an error row, and so is an entry of more than
    ``largest`` bytes (None: no bound). Other columns are dropped.
    """
    pattern = re.compile(unwanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        names = [x.split()[0] for x in ENTRY.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                doc, suffix, data = (batch.column(c)[k].as_py() for c in range(3))
                try:
                    rows = [(doc, suffix, *x) for x in _opened(suffix or "", data or b"", (doc or "").rpartition("/")[2], pattern, largest)]
                except Exception as problem:  # not a container
                    rows = [(doc, suffix, None, None, None, f"{type(problem).__name__}: {problem}")]
                own = sum(len(r[4] or b"") for r in rows)
                if held and (len(held) + len(rows) > TOGETHER_ROWS or size + own > TOGETHER_BYTES):
                    yield made(held)
                    held, size = [], 0
                held += rows
                size += own
        if held:
            yield made(held)

    return containers.select("doc_id", "suffix", "content").mapInArrow(run, ENTRY)


def is_story(entry: Column) -> Column:
    return entry.rlike(r"^word/(document|footnotes|endnotes|comments)\.xml$|^word/(header|footer).*\.xml$") & ~entry.contains("/_rels/")


def story_type(entry: Column) -> Column:
    fixed = {"document": "main", "footnotes": "footnote", "endnotes": "endnote", "comments": "comment"}
    out = F.lit("other")
    for prefix in ("footer", "header"):
        out = F.when(entry.startswith(f"word/{prefix}") & entry.endswith(".xml"), prefix).otherwise(out)
    for name, kind in fixed.items():
        out = F.when(entry == f"word/{name}.xml", kind).otherwise(out)
    return out


def part_order(entry: Column) -> Column:
    """Main story, footnotes, endnotes, comments, headers by name, footers by name."""
    rank = F.lit("6")
    for k, start in reversed(list(enumerate(("document.xml", "footnotes.xml", "endnotes.xml", "comments.xml", "header", "footer")))):
        rank = F.when(entry.startswith(f"word/{start}"), str(k)).otherwise(rank)
    return F.concat(rank, entry)


def occurrences(data: Column, text: str) -> Column:
    """How often a byte string stands in binary data (Latin-1 on both sides)."""
    return F.coalesce(F.regexp_count(F.decode(data, "ISO-8859-1"), F.lit(re.escape(text))), F.lit(0))


_ODF_MATH, _ODF_OBJECTS = ("<math:math",), ("<draw:object", "<draw:object-ole")


def _counted(data: Column, texts: tuple[str, ...]) -> Column:
    return sum((occurrences(data, t) for t in texts[1:]), occurrences(data, texts[0]))


def story_parts(entries: DataFrame) -> DataFrame:
    """(doc_id, part_path, story_type, omml_count, ole_object_count, odf_math_count, field_code_count, graphic_reference_count).

    Parts without any count are left out, but a flat ODF file always has its one part.
    """
    e, data = F.col("entry"), F.col("data")
    none = F.lit(0)

    def shaped(rows: DataFrame, part: Column, kind: Column, **counts: Column) -> DataFrame:
        names = ("omml_count", "ole_object_count", "odf_math_count", "field_code_count", "graphic_reference_count")
        return rows.select("doc_id", "suffix", part.alias("part_path"), kind.alias("story_type"), *(counts.get(n, none).cast("int").alias(n) for n in names))

    docx = shaped(
        entries.where((F.col("suffix") == ".docx") & is_story(e)), e, story_type(e), omml_count=_counted(data, ("<m:oMath", "<m:oMathPara")), ole_object_count=occurrences(data, "<o:OLEObject"),
        field_code_count=occurrences(data, "EMBED Equation"), graphic_reference_count=_counted(data, ("<v:imagedata", "<a:blip")),
    )
    odt = shaped(
        entries.where((F.col("suffix") == ".odt") & e.rlike(r"(^|/)content\.xml$")), e, F.when(e == "content.xml", "main").otherwise("object"),
        odf_math_count=_counted(data, _ODF_MATH), graphic_reference_count=_counted(data, _ODF_OBJECTS),
    )
    flat = shaped(entries.where(F.col("suffix") == ".fodt"), e, F.lit("main"), odf_math_count=_counted(data, _ODF_MATH), graphic_reference_count=_counted(data, _ODF_OBJECTS))
    native = e.rlike(r"(^|/)Equation Native$")
    doc = (
        entries.where(F.col("suffix") == ".doc")
        .groupBy("doc_id", "suffix")
        .agg(F.count_if(native).alias("natives"), F.max(F.when(e == "WordDocument", occurrences(data, "EMBED Equation.3"))).alias("fields"))
    )
    doc = shaped(doc, F.lit("WordDocument"), F.lit("main"), ole_object_count=F.col("natives"), field_code_count=F.coalesce("fields", none))
    any_count = F.col("omml_count") + F.col("ole_object_count") + F.col("odf_math_count") + F.col("field_code_count") + F.col("graphic_reference_count") > 0
    return docx.union(odt).union(doc).where(any_count).union(flat).drop("suffix")


#: container format and package kind of each suffix that is accepted
KINDS = {".docx": ("docx", "ooxml-zip"), ".doc": ("doc", "ole-cfb"), ".odt": ("odt", "odf-zip"), ".fodt": ("fodt", "flat-xml")}


def scan(entries: DataFrame) -> DataFrame:
    """One row per document: container_format, package_kind, entry_count, and sorted lists of what is inside.

    Files of other suffixes have no format; a file that can't be opened has its error in ``notes``.
    """
    e = F.col("entry")
    listed = lambda where: F.array_sort(F.collect_list(F.when(where, e)))
    suffix = F.col("suffix")
    kind = lambda k: F.element_at(F.create_map(*[F.lit(x) for s, v in KINDS.items() for x in (s, v[k])]), suffix)
    docx = suffix == ".docx"
    native = (suffix == ".doc") & e.rlike(r"(^|/)Equation Native$")
    objects = F.when((suffix == ".odt") & e.endswith("/content.xml"), e).when(native & e.contains("/"), F.regexp_replace(e, "/[^/]*$", ""))
    return entries.groupBy("doc_id", "suffix").agg(
        F.first(kind(0)).alias("container_format"),
        F.first(kind(1)).alias("package_kind"),
        F.count(e).alias("entry_count"),
        listed(e.isNotNull()).alias("entries"),
        listed((docx & e.startswith("word/embeddings/")) | native).alias("embedding_targets"),
        listed(docx & e.startswith("word/media/")).alias("media_targets"),
        listed(docx & e.endswith(".rels")).alias("relationship_parts"),
        F.array_sort(F.collect_set(objects)).alias("object_parts"),
        F.array_sort(F.collect_set("error")).alias("notes"),
    )
