"""Operator 5. Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of structs: runs of text, and references to media with
their digest and caption. Payloads are kept apart, one row of the media table each, in a lossless form of
8-bit samples: a portable greymap image of ``WIDTH`` samples a row. Digests join references with
what the stored images hold; each keeps its position and caption in the sequence.

Here the payload of a document is its whole text in UTF-8, filled up with bytes of 255 to a
positive multiple of 576. The stored bytes are read back, checked for their form, and give the
features: mean, deviation, entropy, and an 8 by 8 average hash of the image.

Edge cases: a null text is an empty payload (576 bytes of filling); equal texts have equal
digests and are one media object wherever they are referred to; repeated rows each give a row;
null ids stay null; unresolved references keep their place with null features; a caption
without a reference is text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only

UNIT, FILL, WIDTH, TAIL = 576, 255, 24, 32

SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


class _Sequence(HTMLParser):
    """Texts and media references in page order."""

    BREAKS = {"p", "div", "figure", "figcaption", "br", "li", "h1", "h2", "h3", "article", "section", "tr", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.figure = self.hidden = 0
        self.captioned: dict | None = None

    def flush(self) -> None:
        if words := "".join(self.held).split():
            text = " ".join(words)
            if self.captioned is not None:
                self.captioned["caption"] = text
            else:
                self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.held.clear()

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.flush()
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.figure = len(self.items) + 1
        elif tag == "figcaption" and self.figure and len(self.items) >= self.figure and self.items[-1]["kind"] == "media":
            self.captioned = self.items[-1]
        elif tag in ("img", "audio", "video", "source") and (src := dict(attrs).get("src")):
            self.flush()
            self.items.append({"kind": "media", "text": None, "digest": src.rpartition("sha256:")[2], "caption": dict(attrs).get("alt")})

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.flush()
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.captioned = None
        elif tag == "figure":
            self.figure = 0

    def handle_data(self, data):
        if not self.hidden:
            self.held.append(data)


def sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.captioned = None if parser.held and not parser.figure else parser.captioned
    parser.flush()
    return [{"position": i} | item for i, item in enumerate(parser.items)]


def interleaved(docs: DataFrame, html: str = "html") -> DataFrame:
    """``docs`` with its html parsed into a column ``sequence``."""

    @F.pandas_udf(SEQUENCE)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sequence(t) for t in texts])

    return docs.withColumn("sequence", parsed(html)).drop(html)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The bytes of a text, filled up, and how many are its own."""
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw.ljust(size, bytes([FILL])), len(raw)


def to_image(payload: bytes) -> bytes:
    """A binary greymap: each byte is a sample."""
    return f"P5\n{WIDTH} {len(payload) // WIDTH}\n255\n".encode() + payload


def from_image(stored: bytes) -> np.ndarray:
    """The samples of a greymap, by row."""
    kind, size, most, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a greymap of 8-bit samples")
    return np.frombuffer(samples, np.uint8).reshape(height, width)


def feature(image: np.ndarray) -> str:
    counts = np.bincount(image.ravel(), minlength=256)
    share = counts[counts > 0] / image.size
    level = np.arange(256)
    mean = float(counts @ level / image.size)
    deviation = float(np.sqrt(max(counts @ (level - mean) ** 2 / image.size, 0)))
    rows = np.linspace(0, image.shape[0], 9).astype(np.int64)
    columns = image.reshape(image.shape[0], 8, -1).mean(axis=2)
    cells = np.array([columns[a:b].mean(axis=0) for a, b in zip(rows, rows[1:])])
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"mean={mean:.3f};deviation={deviation:.3f};entropy={float(-(share * np.log2(share)).sum()):.4f};hash={bits}"


def store(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The media table: digest of the payload, own bytes, stored image. Written once; digests may repeat."""

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), 250):
                both = [payload_of(t) for t in rows.text.iloc[i : i + 250]]
                yield pd.DataFrame({"digest": [hashlib.sha256(p).hexdigest() for p, _ in both], "n_bytes": [n for _, n in both], "media": [to_image(p) for p, _ in both]})

    return scratch.write(docs.select("text").mapInPandas(images, "digest string, n_bytes long, media binary"), "media")


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """What each stored object holds: one row a digest and length of its own bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for digest, n, stored in zip(rows.digest, rows.n_bytes, rows.media):
                image = from_image(stored)
                payload = image.tobytes()
                found.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image)))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return media.mapInPandas(read, FEATURES).dropDuplicates(["digest", "n_bytes"])


def documents_as_sequences(docs: DataFrame) -> DataFrame:
    """A page for each document: a lead, a figure that refers to its payload, a caption, an end."""
    html = F.concat(
        F.lit("<article><p>Document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit('</p><figure><img src="sha256:'), "digest",
        F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure><p>End</p></article>"),
    )
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    n = F.octet_length(raw)
    size = F.greatest(F.lit(1), F.ceil(n / UNIT)) * UNIT
    filled = F.concat(raw, F.encode(F.lit(""), "UTF-8"), F.unhex(F.repeat(F.lit("FF"), (size - n).cast("int"))))
    return docs.select("doc_id", F.sha2(filled, 256).alias("digest"), n.cast("long").alias("n_bytes")).select("doc_id", html.alias("html"))


def resolve(sequences: DataFrame, features: DataFrame) -> DataFrame:
    """One row per media reference: the sequence's other columns, position, caption, and the object's features."""
    rest = [c for c in sequences.columns if c != "sequence"]
    refs = sequences.select(*rest, F.size("sequence").alias("n_items"), F.explode("sequence").alias("s")).where("s.kind = 'media'")
    refs = refs.select(*rest, "n_items", F.col("s.position").alias("position"), F.col("s.caption").alias("caption"), F.col("s.digest").alias("digest"))
    return refs.join(features, "digest", "left")


def media_features(docs: DataFrame) -> DataFrame:
    """A row of features for each row of ``docs``."""
    docs = only(docs, doc_id="doc_id", text="text")
    features = described(store(docs, Scratch(docs.sparkSession, "media")))
    # Texts that end in the filling's byte can't be in UTF-8, so a digest has one length.
    found = resolve(interleaved(documents_as_sequences(docs)), features)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")
