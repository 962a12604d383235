"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def align_down(value: Column, step: Column | int) -> Column:
    """The greatest multiple of ``step`` not above ``value``, for negative values too."""
    step = F.lit(step) if isinstance(step, int) else step
    return value - F.pmod(value, step)


def key_hash(collection: Column, key: Column) -> Column:
    """SHA-256 (hex) of collection, a zero byte and key."""
    return F.sha2(F.concat(collection.cast("binary"), F.unhex(F.lit("00")), key.cast("binary")), 256)


def chunk_hash(hash_hex: Column, index: Column) -> Column:
    """SHA-256 (hex) of a key hash's bytes, a zero byte and the big-endian 32-bit chunk number."""
    return F.sha2(F.concat(F.unhex(hash_hex), F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(index.cast("long")), 8, "0"))), 256)


def ring_position(text: Column) -> Column:
    """First 64 bits of SHA-256 as 16 hex digits, which order as unsigned numbers do."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def hlc(physical_ms: Column, logical: Column, node_id: Column) -> Column:
    """A hybrid logical clock value; structs compare field by field."""
    return F.struct(physical_ms.cast("long").alias("physical_ms"), logical.cast("long").alias("logical"), node_id.cast("string").alias("node_id"))


def hlc_text(h: Column) -> Column:
    return F.concat(h["physical_ms"].cast("string"), F.lit("."), h["logical"].cast("string"), F.lit("@"), h["node_id"])


def parse_hlc(text: Column) -> Column:
    """The inverse of ``hlc_text``; null where the text has another form."""
    pattern = r"^(\d+)\.(\d+)@(.*)$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.when(text.rlike(pattern), hlc(part(1).cast("long"), part(2).cast("long"), F.regexp_extract(text, pattern, 3)))


def within_skew(physical_ms: Column, now_ms: Column | int, bound_ms: int = 300_000) -> Column:
    """False for clocks more than ``bound_ms`` ahead of ``now_ms``."""
    return physical_ms <= (F.lit(now_ms) if isinstance(now_ms, int) else now_ms) + bound_ms


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def quantize(v: Column) -> Column:
    """int8 steps of 1/127 of values clamped to [-1, 1]."""
    return F.transform(v, lambda x: F.round(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 127).cast("int"))


def cosine_from_l2(distance: Column) -> Column:
    """Cosine similarity of unit vectors at Euclidean ``distance``."""
    return 1 - distance * distance / 2


_BYTES = "".join(map(chr, range(256)))


def _xor(data: Column, byte: int) -> Column:
    """Each byte of a binary column XOR ``byte``, constant if ``data`` is. ``translate`` drops what maps to character 0, so that goes through character 256."""
    flipped = "".join(chr(b ^ byte or 256) for b in range(256))
    return F.encode(F.replace(F.translate(F.decode(data, "ISO-8859-1"), _BYTES, flipped), F.lit(chr(256)), F.lit("\0")), "ISO-8859-1")


def _hmac_pads(key: Column) -> tuple[Column, Column]:
    """HMAC's inner and outer block for a key of 64 bytes at most."""
    block = F.rpad(key, 64, F.lit(b"\0"))
    return _xor(block, 0x36), _xor(block, 0x5C)


def _padded_hmac(inner: Column, outer: Column, data: Column) -> Column:
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)


def hmac_sha256(key: Column, data: Column) -> Column:
    """HMAC-SHA-256 (hex) of binary columns; longer keys than a block are hashed first."""
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    return _padded_hmac(*_hmac_pads(short), data)


def hkdf_sha256(key: Column, salt: Column, info: Column, size: int = 32) -> Column:
    """HKDF-SHA-256 (RFC 5869) as hex: ``size`` bytes, 8160 at most. The blocks are folded, so that a row makes its key's pads once."""
    if not 0 < size <= 255 * 32:
        raise ValueError("HKDF gives 1 to 8160 bytes")
    inner, outer = _hmac_pads(F.unhex(hmac_sha256(salt, key)))
    start = F.struct(inner.alias("inner"), outer.alias("outer"), F.lit(b"").alias("out"))

    def longer(s: Column, n: Column) -> Column:
        part = _padded_hmac(s["inner"], s["outer"], F.concat(F.substring(s["out"], -32, 32), info, n))
        return F.struct(s["inner"].alias("inner"), s["outer"].alias("outer"), F.concat(s["out"], F.unhex(part)).alias("out"))

    numbers = F.array(*[F.lit(bytes([n])) for n in range(1, -(-size // 32) + 1)])
    return F.aggregate(numbers, start, longer, lambda s: F.lower(F.hex(F.substring(s["out"], 1, size))))


# File categories by the start of the media type, in this order, then by extension.
MIME_CATEGORIES = (
    ("application/pdf", "pdf"),
    ("application/msword", "document"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document"),
    ("application/vnd.ms-excel", "spreadsheet"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "spreadsheet"),
    ("application/vnd.ms-powerpoint", "presentation"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "presentation"),
    ("image/", "image"),
    ("video/", "video"),
    ("audio/", "audio"),
    ("application/zip", "archive"),
    ("application/gzip", "archive"),
    ("application/x-tar", "archive"),
    ("application/x-7z-compressed", "archive"),
    ("application/x-rar-compressed", "archive"),
    ("text/csv", "spreadsheet"),
    ("text/plain", "text"),
    ("text/html", "code"),
    ("text/xml", "code"),
    ("application/json", "code"),
    ("application/xml", "code"),
)
EXTENSION_CATEGORIES = {
    "pdf": ("pdf",),
    "document": ("doc", "docx"),
    "spreadsheet": ("xls", "xlsx", "csv"),
    "presentation": ("ppt", "pptx"),
    "image": ("jpg", "jpeg", "png", "gif", "svg", "webp", "bmp", "ico"),
    "video": ("mp4", "webm", "avi"),
    "audio": ("mp3", "wav"),
    "text": ("txt",),
    "code": ("html", "htm", "json", "xml"),
    "archive": ("zip", "gz", "tar", "7z", "rar"),
}


def file_category(mime: Column, filename: Column) -> Column:
    """Category from the media type's start, else from the extension, else ``other``."""
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^.]*)$", 1))
    out = F.lit("other")
    for kind, names in EXTENSION_CATEGORIES.items():
        out = F.when(ext.isin(*names), kind).otherwise(out)
    for start, kind in reversed(MIME_CATEGORIES):
        out = F.when(F.startswith(mime, F.lit(start)), kind).otherwise(out)
    return out


def size_class(size: Column) -> Column:
    return F.when(size < 1 << 20, "small").when(size <= 10 << 20, "medium").otherwise("large")
