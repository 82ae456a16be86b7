"""Texts out of files: plain text, HTML, EPUB; manifests, listings and event lines."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import strip
from lectern.streaming.events import written

MAX_UPLOAD = 25 * 1024 * 1024
# Tags that end a line, and tags whose text is dropped.
BLOCK_TAGS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "blockquote")
HIDDEN_TAGS = ("script", "style", "head", "title")


def files(spark, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def decode(content: Column) -> Column:
    """UTF-8, without its mark, if the bytes are valid, else Windows-1252."""
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    body = F.when(marked, F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    return F.when(F.is_valid_utf8(body.cast("string")), F.decode(body, "UTF-8")).otherwise(_legacy(content))


# a hundred texts at a time: what a worker holds doesn't grow with the partition
@F.udf(T.StringType(), useArrow=False)
def _legacy(b):
    if b is None:
        return None
    try:
        return bytes(b).decode("cp1252")
    except UnicodeDecodeError:
        return bytes(b).decode("latin-1")


class _Events(HTMLParser):
    """A page as a list of (tag, 1 where it starts and -1 where it ends, None) and (None, 0, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str | None, int, str | None]] = []
        self.handle_starttag = lambda tag, attrs: self.seen.append((tag, 1, None))
        self.handle_endtag = lambda tag: self.seen.append((tag, -1, None))
        self.handle_data = lambda data: self.seen.append((None, 0, data))


def plain_text(html: str | None) -> str | None:
    """Text of one HTML page, a line end at both ends of a block; empty if it can't be parsed."""
    if html is None:
        return None
    page = _Events()
    try:
        page.feed(html)
        page.close()
    except Exception:  # noqa: BLE001  broken pages have no text
        return ""
    depth = accumulate((step if tag in HIDDEN_TAGS else 0 for tag, step, _ in page.seen), lambda d, step: max(0, d + step))
    return "".join("\n" if tag in BLOCK_TAGS else data or "" for (tag, _, data), hidden in zip(page.seen, depth, strict=True) if tag or not hidden)


html_text = F.udf(plain_text, T.StringType(), useArrow=False)


def spine_order(spine: DataFrame, manifest: DataFrame, names: DataFrame) -> DataFrame:
    """(file, ord, name): documents of a book in reading order that its archive holds.

    spine: file, ord, idref; manifest: file, item_id, href, base; names: file, name.
    """
    paths = spine.join(manifest, (spine["file"] == manifest["file"]) & (spine["idref"] == manifest["item_id"])).select(spine["file"], "ord", F.regexp_replace(F.concat("base", "href"), "/{2,}", "/").alias("name"))
    return paths.join(names, ["file", "name"], "left_semi").select("file", "ord", "name")


#: Members of archives with these endings are never read as pages.
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ttf", ".otf", ".woff", ".woff2", ".mp3", ".mp4", ".m4a", ".css", ".js")
MEMBER_ROWS = 1000
MEMBERS = "file string, kind string, ord int, id string, href string, content binary"


def _members(content: bytes) -> Iterator[tuple[str, int, str | None, str | None, bytes | None]]:
    """(kind, ord, id, href, content) of what an archive holds: its members, and the items, references and base of its package; nothing if it is no archive."""
    import io
    import xml.etree.ElementTree as tree
    import zipfile

    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return
    names = z.namelist()
    seen: set[str] = set()
    for i, name in enumerate(names):
        if name in seen:  # of members with one name the last is read, for all of them
            yield "again", i, None, name, None
            continue
        seen.add(name)
        try:
            page = b"" if name.lower().endswith((*BINARY, "/")) else z.read(name)
        except Exception:  # noqa: BLE001  members that can't be read are passed over
            page = None
        yield "member", i, None, name, page
    local = lambda e: e.tag.rpartition("}")[2]
    try:
        opf = next(e.get("full-path") for e in tree.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        package = list(tree.fromstring(z.read(opf)).iter()) if opf in names else []
    except Exception:  # noqa: BLE001  no table of contents that can be read
        return
    yield "base", 0, None, opf.rpartition("/")[0] + "/" if "/" in opf else "", None
    for i, e in enumerate(package):
        if local(e) in ("item", "itemref"):
            yield local(e), i, e.get("id" if local(e) == "item" else "idref"), e.get("href"), None


def members(books: DataFrame) -> DataFrame:
    """(file, kind, ord, id, href, content): archives (file, content) as a relation.

    kind member: href is its name and content its bytes (none for kinds of files that hold no text), again for a name that repeats; item and itemref: id and href of the package; base: href is
    the folder of the package.  A page at a time is unpacked, and at most 8 MB of them or MEMBER_ROWS rows are held beside it.
    """

    def work(batches):
        # a table costs more than a small book, so books share them
        out, size = [], 0
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                for row in _members(bytes(content) if content is not None else b""):
                    out.append((file, *row))
                    size += len(row[4] or b"")
                    if size > 8_000_000 or len(out) >= MEMBER_ROWS:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=columns)

    columns = ["file", "kind", "ord", "id", "href", "content"]
    return books.select("file", "content").mapInPandas(work, MEMBERS)


def with_book_texts(rows: DataFrame) -> DataFrame:
    """``rows`` (content and more) with text: that of the EPUB file in content, in reading order, pages that are not blank joined by blank lines.

    Reading order is the spine's, as far as the archive holds it, else that of the archive's pages.  Content that is no archive has an empty text, null has none.
    Equal contents are read once, so content must not change from one reading to the next; the pages of a book are told apart, ordered and joined by joins and one grouping.
    """
    key, text = "_book", "text"
    keyed = rows.withColumn(key, F.sha2("content", 256))
    books = keyed.where(F.col("content").isNotNull()).select(F.col(key).alias("file"), "content").dropDuplicates(["file"])
    page = F.when(F.col("content").isNotNull(), strip(html_text(decode(F.col("content"))))).alias("page")
    held = written(members(books).select("file", "kind", "ord", "id", "href", page), "members")
    kind = lambda k: held.where(F.col("kind") == k)
    names = held.where(F.col("kind").isin("member", "again")).select("file", "ord", F.col("href").alias("name"))
    # of items with one id the last counts
    items = kind("item").where("id <> '' and href <> ''").groupBy("file", "id").agg(F.max_by("href", "ord").alias("href")).join(kind("base").select("file", F.col("href").alias("base")), "file")
    spine = spine_order(kind("itemref").select("file", "ord", F.col("id").alias("idref")), items.select("file", F.col("id").alias("item_id"), "href", "base"), names)
    loose = names.where(F.lower("name").rlike(r"\.(xhtml|html|htm)$")).join(spine.select("file"), "file", "left_anti").select("file", "ord", "name")
    order = spine.unionByName(loose).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("order"))
    # the pages of a book meet once, as its text does, and are looked up by name
    pages = kind("member").where("page <> ''").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.col("href").alias("k"), F.col("page").alias("v")))).alias("pages"))
    read = F.filter(F.transform("order", lambda n: F.try_element_at(F.col("pages"), n)), lambda p: p.isNotNull())
    joined = pages.join(order, "file").select("file", F.array_join(read, "\n\n").alias("joined"))
    tidy = strip(F.regexp_replace(F.regexp_replace("joined", r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    texts = joined.select(F.col("file").alias(key), tidy.alias(text))
    return keyed.join(texts, key, "left").withColumn(text, F.when(F.col("content").isNotNull(), F.coalesce(text, F.lit("")))).drop(key)


def epub_texts(content: DataFrame) -> DataFrame:
    """(path, text) of EPUB files (path, content)."""
    return with_book_texts(content.select("path", "content")).select("path", "text")


def upload_texts(uploads: DataFrame) -> DataFrame:
    """Uploads (name, content and more) of a known kind and a size within bounds, with their text, which is not blank: .epub as a book, .txt decoded."""
    fit = uploads.where(F.lower("name").rlike(r"\.(txt|epub)$") & F.length("content").between(1, MAX_UPLOAD))
    book = F.lower("name").endswith(".epub")
    both = with_book_texts(fit.where(book)).unionByName(fit.where(~book).withColumn("text", strip(decode(F.col("content")))))
    return both.where(strip(F.col("text")) != "")


def _little(content: Column, at: int, size: int) -> Column:
    """A number stored lowest byte first from byte ``at`` (counted from 0) on."""
    return F.conv(F.hex(F.concat(*[F.substring(content, at + 1 + i, 1) for i in reversed(range(size))])), 16, 10).cast("long")


def wav_seconds(content: Column) -> Column:
    """Duration by the plain header of a WAV file (its data right behind the format), null for other bytes."""
    plain = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 8)) == "57415645666D7420") & (F.hex(F.substring(content, 37, 4)) == "64617461")
    return F.when(plain & (F.length(content) >= 44), _little(content, 40, 4) / F.nullif(_little(content, 28, 4), F.lit(0).cast("long")))


def voice_cache(listing: DataFrame) -> DataFrame:
    """(stem, use_cache): a cache file counts if it is newer than its recording.  listing: path, modificationTime."""
    rows = listing.select(F.regexp_extract("path", r"([^/]+)\.(?:wav|pkl)$", 1).alias("stem"), F.regexp_extract("path", r"\.(wav|pkl)$", 1).alias("kind"), "modificationTime")
    by = rows.groupBy("stem").agg(F.max(F.when(F.col("kind") == "wav", F.col("modificationTime"))).alias("wav"), F.max(F.when(F.col("kind") == "pkl", F.col("modificationTime"))).alias("pkl"))
    return by.where("wav is not null").select("stem", F.coalesce(F.col("pkl") > F.col("wav"), F.lit(False)).alias("use_cache"))


def duration(header: Column, frames: Column, rate: Column, bytes_: Column) -> Column:
    """Seconds from the header, else from decoded frames, else from the plain wave header, else null."""
    return F.coalesce(header, frames / F.nullif(rate, F.lit(0)), bytes_)


def event_lines(lines: DataFrame, schema: str = "type string, index int, voice string") -> DataFrame:
    """Events of ``data: `` lines (value) with a readable JSON body."""
    return lines.where(F.col("value").startswith("data: ")).select(F.from_json(F.expr("substring(value, 7)"), schema).alias("e")).where("e is not null").select("e.*")


_MANIFEST = "id string, created_at double, voice string, status string, settings string, chunks array<struct<index:int,text:string,status:string,duration:double>>"


def parse_manifests(texts: DataFrame, column: str = "value") -> DataFrame:
    """Job manifests of JSON texts; unreadable ones are left out, missing fields get their defaults."""
    rows = texts.select(F.from_json(column, _MANIFEST + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m")).select("m.*")
    return rows.where("id is not null and _corrupt_record is null").drop("_corrupt_record").fillna({"created_at": 0.0, "voice": "", "status": "running"})


def manifests(spark, path: str) -> DataFrame:
    """Job manifests in the files of a path."""
    return parse_manifests(spark.read.text(path, wholetext=True))
