"""EPUB books: a scan of archives as item rows, metadata, and a writer of translated books."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "book_id string, item_id string, file_name string, media_type string, is_document boolean, spine_pos int, content binary"
BOOKS = "book_id string, identifier string, title string, language string, creators array<string>"
_OPF, _DC = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}"
_DOCUMENT = ("application/xhtml+xml", "text/html")


@dataclass
class Book:
    identifier: str | None = None
    title: str | None = None
    language: str | None = None
    creators: list[str] = field(default_factory=list)
    items: list[tuple[str, str, str, bytes]] = field(default_factory=list)  # id, file, media type, content
    spine: list[str] = field(default_factory=list)


def read_book(data: bytes) -> Book:
    """A book from an archive's bytes; items named in the manifest but absent from the archive are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package, base = ET.fromstring(z.read(opf)), posixpath.dirname(opf)
        first = lambda tag: next((e.text for e in package.iter(_DC + tag)), None)
        book = Book(first("identifier"), first("title"), first("language"), [e.text or "" for e in package.iter(_DC + "creator")])
        names = set(z.namelist())
        for e in package.iter(_OPF + "item"):
            path = posixpath.normpath(posixpath.join(base, e.attrib["href"]))
            if path in names:
                book.items.append((e.attrib["id"], e.attrib["href"], e.attrib.get("media-type", ""), z.read(path)))
        book.spine = [e.attrib["idref"] for e in package.iter(_OPF + "itemref")]
    return book


def write_book(book: Book) -> bytes:
    """An archive that ``read_book`` reads back."""
    from xml.sax.saxutils import escape, quoteattr

    meta = [f'<dc:identifier id="id">{escape(book.identifier or "")}</dc:identifier>', f"<dc:title>{escape(book.title or '')}</dc:title>", f"<dc:language>{escape(book.language or '')}</dc:language>"]
    meta += [f"<dc:creator>{escape(c)}</dc:creator>" for c in book.creators]
    manifest = "".join(f"<item id={quoteattr(i)} href={quoteattr(f)} media-type={quoteattr(m)}/>" for i, f, m, _ in book.items)
    spine = "".join(f"<itemref idref={quoteattr(i)}/>" for i in book.spine)
    opf = f'<?xml version="1.0"?><package xmlns="{_OPF[1:-1]}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{_DC[1:-1]}">{"".join(meta)}</metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        for _, name, _, content in book.items:
            z.writestr(f"OEBPS/{name}", content)
    return out.getvalue()


def _rows(data: bytes | None, book_id: str) -> list[tuple]:
    book = read_book(data) if data else Book()
    place = {item: i for i, item in enumerate(book.spine)}
    return [(book_id, i, f, m, m in _DOCUMENT, place.get(i), c) for i, f, m, c in book.items]


def items(files: DataFrame) -> DataFrame:
    """ITEMS of archives (path, content: as ``binaryFile`` reads them) (S1); the book is named by its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.bool_(), pa.int32(), pa.binary()]
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                columns = list(zip(*_rows(data, path))) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in ITEMS.split(", ")])

    return files.select("path", "content").mapInArrow(run, ITEMS)


def read(spark: SparkSession, path: str) -> DataFrame:
    return items(spark.read.format("binaryFile").load(path))


def documents_in_spine_order(rows: DataFrame) -> DataFrame:
    """Documents by their place in the spine, those outside it last."""
    return rows.where("is_document").orderBy("book_id", F.col("spine_pos").asc_nulls_last(), "item_id")


def resources(rows: DataFrame) -> DataFrame:
    return rows.where("not is_document")


def translated_metadata(books: DataFrame, language: str) -> DataFrame:
    """BOOKS for the translated edition: title with the language, and the language (S3)."""
    return books.withColumns({"title": F.concat("title", F.lit(f" ({language})")), "language": F.lit(language)})


def metadata(files: DataFrame) -> DataFrame:
    """BOOKS of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
        for batch in batches:
            found = [(p, read_book(d)) for p, d in zip(*(c.to_pylist() for c in batch.columns))]
            rows = [(p, b.identifier, b.title, b.language, b.creators) for p, b in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], [x.split()[0] for x in BOOKS.replace("array<string>", "a").split(", ")])

    return files.select("path", "content").mapInArrow(run, BOOKS)


def archives(books: DataFrame, rows: DataFrame) -> DataFrame:
    """(book_id, content binary): one archive a book from its metadata and items."""
    per = rows.groupBy("book_id").agg(F.collect_list(F.struct("item_id", "file_name", "media_type", "content", "spine_pos")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for r in batch.to_pylist():
                own = sorted(r["items"] or [], key=lambda i: i["item_id"])
                spine = [i["item_id"] for i in sorted((i for i in own if i["spine_pos"] is not None), key=lambda i: i["spine_pos"])]
                ids.append(r["book_id"])
                out.append(write_book(Book(r["identifier"], r["title"], r["language"], r["creators"], [(i["item_id"], i["file_name"], i["media_type"], i["content"]) for i in own], spine)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["book_id", "content"])

    return books.join(per, "book_id").mapInArrow(run, "book_id string, content binary")
