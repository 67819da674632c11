"""Non-code files: category, size, image dimensions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import paths as P
from ..functions.misc import megapixel_bucket


def _uint(content: Column, start: int, n: int, little: bool = False) -> Column:
    raw = F.hex(F.substring(content, start, n))
    if little:
        raw = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.conv(raw, 16, 10).cast("bigint")


#: Of an SVG only the opening tag counts; numbers are cut to whole ones.
_SVG_SIDE = r"""\b%s="\s*([0-9.]+)"""
_SVG_BOX = r"""\bviewBox="\s*[-0-9.]+[\s,]+[-0-9.]+[\s,]+([0-9.]+)[\s,]+([0-9.]+)"""


def _made(width: Column, height: Column, kind: str) -> Column:
    return F.struct(width.cast("bigint").alias("width"), height.cast("bigint").alias("height"), F.lit(kind).alias("format"))


def _webp_size(c: Column) -> Column:
    """Canvas of an extended file, frame of a lossy one, first bits of a lossless one."""
    kind, n = F.substring(c, 13, 4).cast("string"), F.octet_length(c)
    bits, low = _uint(c, 22, 4, True), lambda v: v.bitwiseAND(F.lit(0x3FFF))
    return (
        F.when((kind == "VP8X") & (n >= 30), _made(_uint(c, 25, 3, True) + 1, _uint(c, 28, 3, True) + 1, "webp"))
        .when((kind == "VP8 ") & (n >= 30), _made(low(_uint(c, 27, 2, True)), low(_uint(c, 29, 2, True)), "webp"))
        .when((kind == "VP8L") & (n >= 25), _made(low(bits) + 1, low(F.shiftright(bits, 14)) + 1, "webp"))
        .otherwise(_made(F.lit(None), F.lit(None), "webp"))
    )


def _svg_size(c: Column) -> Column:
    tag = F.regexp_extract(F.make_valid_utf8(c.cast("string")), r"(?s)<svg\b[^>]*>", 0)

    def side(name: str, place: int) -> Column:
        stated, box = F.regexp_extract(tag, _SVG_SIDE % name, 1), F.regexp_extract(tag, _SVG_BOX, place)
        return F.coalesce(F.nullif(stated, F.lit("")), F.nullif(box, F.lit(""))).try_cast("double")

    return F.when(tag != "", _made(side("width", 1), side("height", 2), "svg"))


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType()), StructField("format", StringType())]))
def _jpeg_size(contents: pd.Series) -> pd.DataFrame:
    """Sides from the first frame header; null contents give nulls."""
    found = [(None, None, None) if b is None else (*jpeg_sides(bytes(b)), "jpeg") for b in contents]
    return pd.DataFrame(found, columns=["width", "height", "format"]).astype({"width": "Int64", "height": "Int64"})


def jpeg_sides(b: bytes) -> tuple[int | None, int | None]:
    """Width and height of a JPEG. Segments have any number and length, so they are walked one by one.

    A frame header is FF C0..CF (bar C4, C8, CC), length, precision, height, width.
    """
    at = b.find(b"\xff", 2)
    while 0 <= at and at + 9 <= len(b):
        marker = b[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
        alone = marker == 0xFF or marker <= 0x01 or 0xD0 <= marker <= 0xD9
        step = (1 if marker == 0xFF else 2) if alone else 2 + max(2, int.from_bytes(b[at + 2 : at + 4], "big"))
        at = b.find(b"\xff", at + step)
    return None, None


def image_size(content) -> Column:
    """struct(width, height, format) from the header bytes of PNG, GIF, BMP, JPEG, WebP or SVG, else null.

    All but JPEG are expressions; only JPEG bytes are sent to Python. Sides that a known format does not state are null.
    """
    c = P.col(content)
    head = F.hex(F.substring(c, 1, 12))
    signed = lambda v: F.when(v >= 2**31, 2**32 - v).otherwise(v)
    is_png = head.startswith("89504E470D0A1A0A") & (F.hex(F.substring(c, 13, 4)) == "49484452") & (F.octet_length(c) >= 24)
    is_gif = head.rlike("^47494638(37|39)61") & (F.octet_length(c) >= 10)
    is_bmp = head.startswith("424D") & (F.octet_length(c) >= 26)
    is_jpeg = head.startswith("FFD8")
    jpeg = _jpeg_size(F.when(is_jpeg, c))
    return (
        F.when(is_png, _made(_uint(c, 17, 4), _uint(c, 21, 4), "png"))
        .when(is_gif, _made(_uint(c, 7, 2, True), _uint(c, 9, 2, True), "gif"))
        .when(is_bmp, _made(signed(_uint(c, 19, 4, True)), signed(_uint(c, 23, 4, True)), "bmp"))
        .when(is_jpeg, jpeg)
        .when(head.rlike("^52494646.{8}57454250$"), _webp_size(c))
        .otherwise(_svg_size(c))
    )


def asset_facts(files: DataFrame) -> DataFrame:
    """Everything but source code: category, media type, size, digest, lines.

    Input: path, content. Category and extension are decided before content is read.
    """
    own = files.withColumn("category", P.categorize("path")).where(F.col("category") != "code")
    body = F.make_valid_utf8(F.col("content").cast("string"))
    breaks = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    lines = F.when(body == "", 0).otherwise(breaks + F.when(body.endswith("\n"), 0).otherwise(1))
    texty = (F.col("category") == "document") | (P.ext("path") == ".svg")
    return own.select(
        "path", "category",
        F.nullif(P.ext("path"), F.lit("")).alias("ext"),
        P.mime("path").alias("mime"),
        F.octet_length("content").cast("bigint").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.when(texty, lines).cast("bigint").alias("lines"),
        image_size(F.when(F.col("category") == "image", F.col("content"))).alias("image"),
    )


def images(facts: DataFrame) -> DataFrame:
    """(path, width, height, format) of the facts that have an image.

    The generator keeps Catalyst from repeating the sniffing for every field that is read.
    """
    return facts.select("path", F.explode(F.array("image")).alias("_i")).where("_i IS NOT NULL").select("path", "_i.*")


def asset_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def image_buckets(images: DataFrame) -> DataFrame:
    """Images per megapixel bucket. Input: width, height."""
    sized = images.where((F.col("width") > 0) & (F.col("height") > 0))
    return sized.groupBy(megapixel_bucket("width", "height").alias("bucket")).agg(F.count("*").alias("images"))


def image_formats(images: DataFrame) -> DataFrame:
    return images.where(F.col("format").isNotNull()).groupBy("format").agg(F.count("*").alias("images"))


def largest(facts: DataFrame, n: int = 20) -> DataFrame:
    return facts.orderBy(F.desc("size"), "path").limit(n).select("path", "size")
