"""Media columns (operator 8): interleaved document sequences of texts and media, payloads resolved by digest.

``parse_sequence`` turns HTML into an ordered list of text and media-reference structs; captions (figcaption, else
alt) stay with their reference, and positions count both kinds. ``interleaved`` parses a column of pages,
``resolve`` joins the references with a payload table by SHA-256 digest, and ``assemble`` puts the sequence back
in order. Payloads are kept in a content-addressed table as binary images: 8-bit RGB samples, 8 pixels a row, the
samples as they are (so stored bytes can be read back without loss).

Null HTML is an empty sequence; a reference whose digest no payload has stays, with null payload columns. Repeated
rows each get their sequence, and equal texts equal values; null texts are empty ones, which are stored as 192 blanks.
Ids are read as longs (others count as null). An empty table gives no rows, and work columns avoid the input's names.
"""

from __future__ import annotations

import hashlib
import html as markup
import zlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, stored, text_or_empty

#: Bytes of a payload unit: 8 rows of 8 pixels of 3 samples.
UNIT = 192
ROW = 24
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
PREFIX = "sha256:"


class _Sequence(HTMLParser):
    """Texts and media references in document order."""

    SKIPPED = ("script", "style", "head", "title", "noscript")
    BLOCKS = ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "table", "tr", "td", "th", "figure", "blockquote", "body", "header", "footer")
    MEDIA = ("img", "video", "audio", "source", "embed")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.captions: list[str] | None = None
        self.figure: list[dict] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.add("text", text, None, None)

    def add(self, kind: str, text: str | None, digest: str | None, caption: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": caption})
        if kind == "media" and self.figure is not None:
            self.figure.append(self.items[-1])

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.captions = []
        elif tag in self.MEDIA:
            self.flush()
            found = dict(attrs)
            source = found.get("src") or ""
            if source.startswith(PREFIX):
                self.add("media", None, source[len(PREFIX) :], found.get("alt") or None)
            elif source:
                self.add("media", source, None, found.get("alt") or None)
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            caption = " ".join("".join(self.captions or []).split())
            self.captions = None
            for item in self.figure or []:
                item["caption"] = caption or item["caption"]
            if caption and not self.figure:
                self.add("text", caption, None, None)
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.captions is None else self.captions).append(data)


def parse_sequence(page: str | None) -> list[dict]:
    """The ordered items of a page: texts, and media with digest (or, as text, the address) and caption."""
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def interleaved(page: Column) -> Column:
    """The sequence of an HTML column."""

    @F.pandas_udf(SEQUENCE)
    def sequences(pages: pd.Series) -> pd.Series:
        return pd.Series([parse_sequence(p) for p in pages], dtype=object)

    return sequences(page.cast("string"))


def padded(text: str) -> bytes:
    """UTF-8, blanks appended up to a positive multiple of UNIT."""
    data = text.encode("utf-8", "replace")
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def to_image(payload: bytes) -> bytes:
    """A binary image of 8 RGB pixels a row that holds the payload as its samples."""
    return b"P6\n8 %d\n255\n" % (len(payload) // ROW) + payload


def from_image(image: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a stored image, checked against its header."""
    kind, size, most, samples = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P6" or most != b"255" or len(samples) != 3 * width * height:
        raise ValueError("not an image that this module stored")
    return width, height, samples


def payload_page(digest: str, n_bytes: int) -> str:
    """A page of three items that depends on the payload alone: a text, the payload with its caption, a text."""
    caption = markup.escape(f"{n_bytes} bytes of text & blanks")
    return f'<article><p>The text as samples:</p><figure><img src="{PREFIX}{digest}" alt=""><figcaption>{caption}</figcaption></figure><p>End of the text.</p></article>'


def store_texts(documents: DataFrame, label: str = "media") -> DataFrame:
    """row (unique), doc_id, n_bytes, page, digest, media: every text's payload as a stored image and a page that refers to it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                image = to_image(padded(text))
                digest = hashlib.sha256(image).hexdigest()
                n = len(text.encode("utf-8", "replace"))
                rows.append((n, payload_page(digest, n), digest, image))
            n, pages, digests, images = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["row", "doc_id", "n_bytes", "page", "digest", "media"])

    made = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return stored(made.mapInArrow(run, "row long, doc_id long, n_bytes long, page string, digest string, media binary"), label)


READ = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def read_back(payloads: DataFrame) -> DataFrame:
    """One row for each digest: what the stored bytes hold, and the number of copies."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width, height, samples = from_image(image)
                means = np.frombuffer(samples, np.uint8).reshape(-1, 3).mean(axis=0)
                out.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), f"rgb {width}x{height} mean " + " ".join(f"{m:.3f}" for m in means)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", *READ])

    read = payloads.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return cut(read.groupBy("digest").agg(*[F.first(c).alias(c) for c in READ], F.count("*").alias("copies")))


#: A digest that more than this part of all references name is hot (there are at most so many), and is joined in SALTS parts.
HOT, SALTS = 1000, 32


def hot_digests(counted: DataFrame, count: str = "copies") -> DataFrame:
    """The digests (at most HOT) of over 1/HOT of all references, from their numbers."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    return counted.filter(F.col(count) * HOT > total).select("digest")


def resolve(pages: DataFrame, page: str, payloads: DataFrame, hot: DataFrame | None = None, item: str = "item") -> DataFrame:
    """The rows of ``pages`` without ``page``, one for each item of their sequence (column ``item``), with the payload's columns.

    ``payloads`` has one row for each digest and the columns digest and others that ``pages`` lacks. Rows without
    items give none. References to ``hot`` digests (at most HOT rows) are spread over copies of their payload rows.
    """
    digest, salt, own, own_salt, is_hot = fresh([*pages.columns, *payloads.columns, item], "ref", "salt", "own", "own_salt", "is_hot")
    items = pages.withColumn(item, F.explode(interleaved(F.col(page)))).drop(page).withColumn(digest, F.col(f"{item}.digest"))
    given = payloads.withColumnRenamed("digest", own)
    if hot is None:
        items, given = items.withColumn(salt, F.lit(0)), given.withColumn(own_salt, F.lit(0))
    else:
        marked = F.broadcast(hot.limit(HOT).select(F.col("digest").alias(is_hot)))
        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        items = items.join(marked, F.col(digest) == F.col(is_hot), "left").withColumn(salt, F.when(F.col(is_hot).isNotNull(), spread).otherwise(0)).drop(is_hot)
        copies = F.when(F.col(is_hot).isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        given = given.join(marked, F.col(own) == F.col(is_hot), "left").withColumn(own_salt, F.explode(copies)).drop(is_hot)
    # texts have no digest and need no payload: they do not take part in the join
    found = items.filter(F.col(digest).isNotNull()).join(given, (F.col(digest) == F.col(own)) & (F.col(salt) == F.col(own_salt)), "left").drop(digest, salt, own, own_salt)
    return found.unionByName(items.filter(F.col(digest).isNull()).drop(digest, salt), allowMissingColumns=True)


def assemble(resolved: DataFrame, key: list[str], payload: Column, item: str = "item") -> DataFrame:
    """The sequences again: ``key`` (of one page) and items (position, kind, text, digest, caption, payload) in order."""
    whole = F.struct(*[F.col(f"{item}.{c}").alias(c) for c in ("position", "kind", "text", "digest", "caption")], payload.alias("payload"))
    return resolved.groupBy(*key).agg(F.array_sort(F.collect_list(whole), lambda a, b: (a["position"] - b["position"]).cast("int")).alias("items"))  # at most a page's items


def media_columns(documents: DataFrame) -> DataFrame:
    """Every text stored as an image, referred to by a page, resolved by digest, put back in order and read.

    Beside the payload's columns: the caption that stands with the payload, its place and the number of items.
    """
    kept = store_texts(documents)
    read = read_back(kept)
    key = ["row", "doc_id", "n_bytes"]
    found = resolve(kept.select(*key, "page"), "page", read.drop("copies"), hot_digests(read))
    whole = assemble(found, key, F.struct(*READ))
    media = whole.withColumn("media", F.element_at(F.filter("items", lambda i: i["kind"] == "media"), 1))
    return media.select("doc_id", "n_bytes", *[F.col(f"media.payload.{c}").alias(c) for c in READ], F.col("media.caption").alias("caption"), F.col("media.position").alias("position"), F.size("items").alias("n_items"))
