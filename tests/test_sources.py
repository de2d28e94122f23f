import bz2
import gzip
import io
import plistlib
import tarfile
import zipfile
import zlib

import pytest

from quarry.sources import tree
from quarry.sources.extract import extract, extract_one


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in files.items():
            z.writestr(n, b)
    return out.getvalue()


def tarred(mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        info = tarfile.TarInfo("dir/" + "n" * 120)
        info.size = 5
        t.addfile(info, io.BytesIO(b"12345"))
    return out.getvalue()


PDF = b"%PDF-1.4\n1 0 obj << /Length 40 /Filter /FlateDecode >> stream\n" + zlib.compress(b"BT (pdf) Tj [(nee) -20 (dle)] TJ ET") + b"\nendstream endobj"
MAIL = b"Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nFrom: a@x\nTo: b@x\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\nbWFpbG5lZWRsZQ==\n--B\nContent-Type: text/html\n\n<p>html <b>part</b></p>\n--B--\n"
SEVEN = b"\x05\x01\x11" + bytes([1 + 2 * len("a.txt\0")]) + b"\0" + "a.txt\0".encode("utf-16-le")


@pytest.mark.parametrize(("path", "data", "text"), [
    ("a.json", b'{"client":"Aperture","items":[{"name":"jsonneedle","enabled":true}],"count":7}', "client Aperture items name jsonneedle enabled true count 7"),
    ("a.csv", b'name,notes\nAda,"csvneedle, quoted"\n', "name notes Ada csvneedle, quoted"), ("a.plist", plistlib.dumps({"Owner": "plistneedle"}, fmt=plistlib.FMT_BINARY), "Owner plistneedle"),
    ("a.html", b"<p>one</p><script>x</script>two &amp; <b>th</b>ree", "one two & three"), ("a.rtf", rb"{\rtf1{\fonttbl f;}a\par b\'e9}", "a bé"), ("a.eml", MAIL, "Grüße a@x b@x mailneedle html part"),
    ("a.docx", zipped({"word/document.xml": "<w:t>docx</w:t><w:t>needle</w:t>", "other.xml": "no"}), "docx needle"), ("a.pdf", PDF, "pdf needle"), ("a.txt", "é\x01x".encode(), "é x"),
    ("a.zip", zipped({"in.txt": "12345"}), "in.txt 5 bytes"), ("a.tar", tarred("w"), "dir/" + "n" * 120 + " 5 bytes"), ("a.tgz", tarred("w:gz"), "dir/" + "n" * 120 + " 5 bytes"), ("log.gz", gzip.compress(b"1234567"), "log 7 bytes"), ("x.bz2", bz2.compress(b"12"), "x 2 bytes"),
    ("a.7z", b"7z\xbc\xaf\x27\x1c\0\4" + b"\0" * 4 + (0).to_bytes(8, "little") + len(SEVEN).to_bytes(8, "little") + b"\0" * 4 + SEVEN, "a.txt 0 bytes"),
    ("a.rar", b"Rar!\x1a\x07\x00" + b"\0\0\x74\0\x80" + (37).to_bytes(2, "little") + (3).to_bytes(4, "little") + (9).to_bytes(4, "little") + b"\0" * 11 + (5).to_bytes(2, "little") + b"\0" * 4 + b"r.txt" + b"abc" + b"\0\0\x7b\0\0\x07\0", "r.txt 9 bytes"),
    ("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 504 + "legacy words".encode("utf-16-le") + b"\0\0\1", "legacy words"),
])
def test_texts(path, data, text):
    assert extract_one(path, data)[1:3] == ("extracted", None)
    assert extract_one(path, data)[4] == text


@pytest.mark.parametrize(("path", "data", "status", "reason"), [
    ("a.bin", b"x", "skipped", "unsupported-extension"), ("a.txt", b"\x89PNG", "skipped", "binary"), ("a.txt", b"\xff\xfeab", "skipped", "non-utf8"), ("a.txt", b"x" * 100, "skipped", "too-large"),
    ("a.plist", b"bplist00junk", "quarantined", "corrupt-plist"), ("a.docx", b"\xd0\xcf\x11\xe0", "quarantined", "encrypted-office"), ("a.zip", b"no", "quarantined", "corrupt-archive"), ("a.pdf", b"%PDF /Image", "skipped", "image-only-pdf"), ("a.pdf", b"%PDF /Encrypt", "quarantined", "encrypted-pdf"), ("a.rar", b"x", "quarantined", "corrupt-archive"),
])
def test_statuses(path, data, status, reason):
    assert extract_one(path, data, 64)[1:3] == (status, reason)


def test_extract_frame(spark):
    rows = spark.createDataFrame([("/x/a.txt", bytearray(b"words")), ("/x/b.zip", None)], "path string, content binary")
    assert sorted((r.path, r.status) for r in extract(rows).collect()) == [("/x/a.txt", "extracted"), ("/x/b.zip", "quarantined")]


def test_tree(spark, tmp_path):
    for p in ("a/b/c.txt", "a/node_modules/x.js", "Tool.app/in.txt", ".hidden/y"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("12")
    short = lambda df: [r.path[len(str(tmp_path)) :] for r in df.collect()]
    got = short(tree.scan(spark, str(tmp_path)))
    assert got == ["", "/.hidden", "/.hidden/y", "/Tool.app", "/a", "/a/b", "/a/b/c.txt", "/a/node_modules"]
    assert "/a/node_modules/x.js" in short(tree.scan(spark, str(tmp_path), generated=True)) and "/Tool.app/in.txt" in short(tree.scan(spark, str(tmp_path), packages=True))
    assert short(tree.scan(spark, str(tmp_path), maxdepth=1, hidden=False)) == ["", "/Tool.app", "/a"]
    assert tree.scan(spark, str(tmp_path / "none")).first().issue == "FileNotFoundError"
