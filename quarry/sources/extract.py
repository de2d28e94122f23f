"""Text of common document formats from (path, bytes): a row function behind mapInPandas, one status a file.

status is extracted, skipped or quarantined, with a reason. Formats are told by the path; every reader has limits on
entries, depth and output, and a broken file is a row, never an exception.
"""

from __future__ import annotations

import bz2
import email
import email.policy
import gzip
import html
import io
import json
import lzma
import plistlib
import re
import struct
import tarfile
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schema import EXTRACTED

# Formats by extension, versions of the extractors, limits.
TEXT = "txt md markdown rst log ini cfg conf toml yaml yml xml rs py js ts c h cpp hpp java go rb sh sql css tex".split()
FORMATS = {**dict.fromkeys(TEXT, "text"), "json": "structured", "csv": "structured", "plist": "structured", "html": "rich", "htm": "rich", "rtf": "rich", "eml": "rich", "docx": "office", "xlsx": "office", "pptx": "office", "doc": "office", "xls": "office", "ppt": "office", "pdf": "pdf", **dict.fromkeys("zip jar tar tgz tbz txz gz bz2 xz rar 7z".split(), "archive")}
VERSIONS = {"text": 4, "pdf": 4, "office": 6, "rich": 6, "archive": 8, "structured": 3, "unsupported": 1}
MAX_BYTES, MAX_TEXT, MAX_ENTRIES, MAX_PARTS, MAX_DEPTH = 32 << 20, 4 << 20, 4096, 128, 8
_SIGNATURES = [bytes.fromhex(x) for x in "89504e47 ffd8ff 47494638 25504446 504b0304 1f8b 425a68 fd377a585a00 377abcaf271c 52617221 7f454c46 cafebabe cffaedfe feedface d0cf11e0 4d5a 00000100 49492a00 4d4d002a 4f676753".split()]


class Skip(Exception):
    """The file has no text to give; the reason is the message."""


class Broken(Exception):
    """The file is damaged or protected; the reason is the message."""


def is_binary(data: bytes) -> bool:
    head = data[:4096]
    if any(head.startswith(s) for s in _SIGNATURES) or b"\0" in head:
        return True
    control = sum(b < 32 and b not in b"\t\n\r\f\x1b" for b in head)
    return len(head) >= 32 and control * 100 // len(head) > 10


def clean(text: str, most: int = MAX_TEXT) -> str:
    """Control characters but line ends and tabs become spaces; cut to so many bytes at a character's edge."""
    text = re.sub(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", " ", text)
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def plain(data: bytes) -> str:
    if is_binary(data):
        raise Skip("binary")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise Skip("non-utf8") from None


def from_html(data: bytes) -> str:
    s = data.decode("utf-8", "replace")
    s = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", s)
    s = re.sub(r"(?i)</?(?:br|p|div|li|tr|h[1-3])\b[^>]*>", " ", s)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", s)).split())


_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "generator"}


def from_rtf(data: bytes) -> str:
    """Groups on a stack; destinations that are no text are passed over."""
    s, out, at, hidden = data.decode("latin-1"), [], 0, [False]
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-z]+)-?\d* ?|\\(\*)|\\([^a-z])|([{}])|([^\\{}\r\n]+)", s):
        code, uni, word, star, symbol, brace, text = m.groups()
        if brace == "{":
            hidden.append(hidden[-1])
        elif brace and len(hidden) > 1:
            hidden.pop()
        elif star or word in _RTF_SKIP:
            hidden[-1] = True
        elif hidden[-1]:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif uni:
            out.append(chr(int(uni) % 65536))
        elif word in ("par", "line", "tab"):
            out.append(" ")
        elif text or symbol:
            out.append(text or symbol)
    return " ".join("".join(out).split())


def from_mail(data: bytes) -> str:
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    out = [str(email.header.make_header(email.header.decode_header(message[k]))) for k in ("Subject", "From", "To") if message[k]]
    stack, seen = [(message, 0)], 0
    while stack and seen < MAX_PARTS:
        part, depth = stack.pop()
        seen += 1
        if part.is_multipart():
            stack += [(p, depth + 1) for p in reversed(part.get_payload()) if depth < MAX_DEPTH]
        elif part.get_content_maintype() == "text" and part.get_content_disposition() != "attachment":
            body = part.get_payload(decode=True) or b""
            text = body.decode(part.get_content_charset() or "utf-8", "replace")
            out.append(from_html(text.encode()) if part.get_content_subtype() == "html" else " ".join(text.split()))
    return " ".join(x for x in out if x)


_JSON = re.compile(r'"((?:[^"\\]|\\.)*)"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null', re.S)


def from_json(data: bytes) -> str:
    """Keys, strings and scalars in order; not a validating parser."""

    def shown(m):
        if m[1] is None:
            return m[0]
        try:
            return json.loads(f'"{m[1]}"')
        except ValueError:
            return m[1]

    return " ".join(x for x in (str(shown(m)) for m in _JSON.finditer(plain(data))) if x)


def from_csv(data: bytes) -> str:
    """Cells, unquoted and trimmed, in order."""
    cells = re.findall(r'(?:^|,|\n)\s*(?:"((?:[^"]|"")*)"|([^,\n]*))', plain(data).replace("\r", ""))
    return " ".join(x for x in ((a.replace('""', '"') or b).strip() for a, b in cells) if x)


def from_plist(data: bytes) -> str:
    try:
        root = plistlib.loads(data)
    except Exception:
        raise Broken("corrupt-plist") from None
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack += [y for k, v in reversed(list(x.items())) for y in (v, k)]
        elif isinstance(x, list):
            stack += reversed(x)
        elif not isinstance(x, (bytes, plistlib.UID)):
            out.append(str(x).lower() if isinstance(x, bool) else str(x))
    return " ".join(out)


_OFFICE_PARTS = {
    "docx": r"word/(document|header\d*|footer\d*|comments)\.xml|docProps/(core|app)\.xml", "xlsx": r"xl/(sharedStrings|worksheets/[^/]+|comments\d*)\.xml|docProps/(core|app)\.xml",
    "pptx": r"ppt/(slides/[^/]+|notesSlides/[^/]+)\.xml|docProps/(core|app)\.xml",
}


def from_ooxml(data: bytes, kind: str) -> str:
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        raise Broken("encrypted-office")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist()[:MAX_ENTRIES] if re.fullmatch(_OFFICE_PARTS[kind], n))
        parts = [z.open(n).read(MAX_BYTES).decode("utf-8", "replace") for n in names]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", " ".join(parts))).split())


def from_legacy_office(data: bytes) -> str:
    """Runs of text in the compound file: the sectors of its streams, in UTF-16 and in bytes."""
    if not data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        raise Broken("corrupt-office")
    if "EncryptedPackage".encode("utf-16-le") in data or "EncryptionInfo".encode("utf-16-le") in data:
        raise Broken("encrypted-office")
    body = data[512:]
    wide = [m[0].decode("utf-16-le") for m in re.finditer(rb"(?:[\x20-\x7e\xa0-\xff]\x00){4,}", body)]
    narrow = [m[0].decode("latin-1") for m in re.finditer(rb"[\x20-\x7e]{6,}", body)]
    return " ".join(" ".join(wide + narrow).split())


def from_pdf(data: bytes) -> str:
    """Strings of the text operators in plain and Flate streams."""
    if not data.startswith(b"%PDF"):
        raise Broken("corrupt-pdf")
    if b"/Encrypt" in data:
        raise Broken("encrypted-pdf")
    out = []
    for m in list(re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S))[:MAX_ENTRIES]:
        body = m[2]
        if re.search(rb"/(?:LZWDecode|ASCII85Decode|DCTDecode)", m[1]):
            continue
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body, MAX_BYTES)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            for text, array in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", block, re.S):
                parts = [text] if text else re.findall(rb"\(((?:[^()\\]|\\.)*)\)", array, re.S)
                raw = b"".join(parts)
                raw = re.sub(rb"\\([0-7]{1,3})", lambda x: bytes([int(x[1], 8) & 255]), raw)
                out.append(re.sub(rb"\\(.)", rb"\1", raw).decode("latin-1"))
    if not out:
        raise Skip("image-only-pdf" if b"/Image" in data else "no-text")
    return " ".join(" ".join(out).split())


def archive_entries(data: bytes, path: str) -> list[tuple[str, int]]:
    """(name, size) of an archive's entries, from its directory or headers."""
    low, base = path.lower(), path.rsplit("/", 1)[-1]
    if low.endswith((".zip", ".jar")):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, i.file_size) for i in z.infolist()[:MAX_ENTRIES]]
    if low.endswith((".tar", ".tgz", ".tbz", ".txz", ".tar.gz", ".tar.bz2", ".tar.xz")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return [(m.name, m.size) for _, m in zip(range(MAX_ENTRIES), t, strict=False)]
    if low.endswith((".gz", ".bz2", ".xz")):
        opened = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[low.rsplit(".", 1)[-1]](io.BytesIO(data))
        size = 0
        while part := opened.read(1 << 16):
            size += len(part)
            if size > MAX_BYTES:
                raise Skip("too-large")
        return [(base.rsplit(".", 1)[0], size)]
    if low.endswith(".rar"):
        return rar_entries(data)
    return seven_zip_entries(data)


def _vint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return value, at


def rar_entries(data: bytes) -> list[tuple[str, int]]:
    """File headers of versions 4 and 5."""
    out = []
    if data.startswith(b"Rar!\x1a\x07\x01\x00"):
        at = 8
        while at + 7 < len(data) and len(out) < MAX_ENTRIES:
            size, body = _vint(data, at + 4)
            kind, p = _vint(data, body)
            flags, p = _vint(data, p)
            extra, p = _vint(data, p) if flags & 1 else (0, p)
            packed, p = _vint(data, p) if flags & 2 else (0, p)
            if kind == 4:
                raise Broken("encrypted-archive")
            if kind == 2:
                file_flags, p = _vint(data, p)
                length, p = _vint(data, p)
                _, p = _vint(data, p)
                p += 4 * bool(file_flags & 2) + 4 * bool(file_flags & 4)
                _, p = _vint(data, p)
                _, p = _vint(data, p)
                n, p = _vint(data, p)
                out.append((data[p : p + n].decode("utf-8", "replace"), length))
            if kind == 5:
                break
            at = body + size + packed
        return out
    if not data.startswith(b"Rar!\x1a\x07\x00"):
        raise Broken("corrupt-archive")
    at = 7
    while at + 7 <= len(data) and len(out) < MAX_ENTRIES:
        kind, flags, size = struct.unpack_from("<xxBHH", data, at)
        if kind == 0x73 and flags & 0x80:
            raise Broken("encrypted-archive")
        more = struct.unpack_from("<I", data, at + 7)[0] if flags & 0x8000 or kind == 0x74 else 0
        if kind == 0x74:
            length, n = struct.unpack_from("<I", data, at + 11)[0], struct.unpack_from("<H", data, at + 26)[0]
            start = at + 32 + 8 * bool(flags & 0x100)
            out.append((data[start : start + n].split(b"\0")[0].decode("utf-8", "replace"), length))
        if kind == 0x7B or size < 7:
            break
        at += size + more
    return out


def _seven_number(data: bytes, at: int) -> tuple[int, int]:
    first, mask, value = data[at], 0x80, 0
    at += 1
    for k in range(8):
        if not first & mask:
            return value | (first & mask - 1) << 8 * k, at
        value |= data[at] << 8 * k
        at, mask = at + 1, mask >> 1
    return value, at


def seven_zip_entries(data: bytes) -> list[tuple[str, int]]:
    """Names of a plain header; sizes are not given by it alone and are 0. Packed headers cannot be read without a codec."""
    if not data.startswith(b"7z\xbc\xaf\x27\x1c"):
        raise Broken("corrupt-archive")
    offset, size = struct.unpack_from("<QQ", data, 12)
    head = data[32 + offset : 32 + offset + size]
    if not size:
        return []
    if head[:1] == b"\x17":
        raise Broken("encoded-header")
    at = head.find(b"\x11", head.find(b"\x05") + 1)
    if at < 0:
        return []
    n, p = _seven_number(head, at + 1)
    raw = head[p + 1 : p + n]
    return [(x, 0) for x in raw.decode("utf-16-le", "ignore").split("\0") if x][:MAX_ENTRIES]


def format_of(path: str) -> str:
    low = path.lower()
    return FORMATS.get(low.rsplit(".", 1)[-1] if "." in low.rsplit("/", 1)[-1] else "", "unsupported")


def extract_one(path: str, data: bytes | None, most: int = MAX_BYTES) -> tuple[str, str, str | None, int, str | None]:
    """format, status, reason, bytes read, text."""
    kind, data = format_of(path), data or b""
    if kind == "unsupported":
        return kind, "skipped", "unsupported-extension", 0, None
    if len(data) > most:
        return kind, "skipped", "too-large", 0, None
    ext = path.lower().rsplit(".", 1)[-1]
    readers = {"html": from_html, "htm": from_html, "rtf": from_rtf, "eml": from_mail, "json": from_json, "csv": from_csv, "plist": from_plist, "pdf": from_pdf, "doc": from_legacy_office, "xls": from_legacy_office, "ppt": from_legacy_office}
    try:
        if kind == "archive":
            text = "\n".join(f"{n} {s} bytes" for n, s in archive_entries(data, path))
        elif ext in _OFFICE_PARTS:
            text = from_ooxml(data, ext)
        else:
            text = readers.get(ext, plain)(data)
    except Skip as e:
        return kind, "skipped", str(e), len(data), None
    except Broken as e:
        return kind, "quarantined", str(e), len(data), None
    except Exception:  # whatever a damaged file makes a reader do
        return kind, "quarantined", f"corrupt-{kind}", len(data), None
    return kind, "extracted", None, len(data), clean(text)


def extract(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """path, format, status, reason, bytes_read, text of files with path and content, as the binaryFile source has them."""

    def rows(batches):
        for pdf in batches:
            got = [extract_one(p, c, most) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([(p, *g) for p, g in zip(pdf["path"], got, strict=True)], columns=["path", "format", "status", "reason", "bytes_read", "text"])

    return files.select("path", "content").mapInPandas(rows, EXTRACTED)


def format_column(path: Column) -> Column:
    """The format by the path, as an expression."""
    ext = F.regexp_extract(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.([^.]*)$", 1)
    out = F
    for kind in sorted(set(FORMATS.values())):
        out = out.when(ext.isin([e for e, k in FORMATS.items() if k == kind]), kind)
    return out.otherwise("unsupported")


def version_column(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in VERSIONS.items() for x in pair)), kind)


def scaled_limit(base: int, floor: int, *percents: Column) -> Column:
    """A limit scaled by the least of the percentages, rounded up, not below the floor."""
    return F.greatest(F.ceil(F.lit(base) * F.least(*percents) / 100), F.lit(floor)).cast("long")


def quarantine_key(files: DataFrame) -> Column:
    return F.concat_ws(":", F.concat(F.lit("v"), version_column(format_column(F.col("path")))), "path", "length", (F.unix_micros("modificationTime") * 1000).cast("string"))


def due(files: DataFrame, quarantine: DataFrame, most: int = 3) -> DataFrame:
    """Files that have not failed so many times as they are now (quarantine: key, failures)."""
    return files.withColumn("key", quarantine_key(files)).join(quarantine.filter(F.col("failures") >= most).select("key"), "key", "left_anti")


def folded_quarantine(quarantine: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Quarantine after outcomes (key, status): failures add up; anything else clears the key."""
    ok = outcomes.filter("status <> 'quarantined'").select("key").distinct()
    failed = outcomes.filter("status = 'quarantined'").groupBy("key").agg(F.count(F.lit(1)).alias("failures"))
    return quarantine.join(ok, "key", "left_anti").unionByName(failed.join(ok, "key", "left_anti")).groupBy("key").agg(F.sum("failures").alias("failures"))


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (with the cached text) and misses of a cache (key, text)."""
    keyed = files.withColumn("key", quarantine_key(files))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


def ocr_queue(extracted: DataFrame) -> DataFrame:
    """Paths worth recognising: image-only PDFs, and images named as screenshots."""
    low = F.lower("path")
    shot = low.rlike(r"(screenshot|screen shot|screen.*capture)[^/]*\.(png|jpe?g|heic|tiff?)$")
    return extracted.filter((F.col("reason") == "image-only-pdf") | shot).select("path").distinct()
