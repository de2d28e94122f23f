"""Secret scans by assignment-aware lexing.

Three base patterns (assign, access, hex) give spans as they stand. The lexer then reads source and configuration syntax:
from each assignment sign (= := => :) it takes the target name on the left and the literals on the right (quoted, bare
configuration values, concatenations, blocks of indented lines), keeps what names hold, and follows names on the right to
the literals they stand for. Markup pairs (key and value attributes, an element's name and its text) and the arguments of
calls to functions that the text defines, under their parameters' names, are read alike. A literal is scored by the words of the names it reaches and by its own form; those that pass are spans of the kind
literal, at the place where the literal is written. A span inside a base span is not repeated.

Null and empty texts have no spans; long texts are read whole; repeated rows are scanned alike; an empty table gives no
rows. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches, lean_worker

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

# What the words of a name say about what it holds.
_STRONG = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "passcode"}
#: Sensitive as a name's last word only.
_LAST = {"pass", "pw"}
_KEYED = {"api", "access", "private", "secret", "auth", "encryption", "signing", "master", "account", "session", "client"}
_HARMLESS = {"count", "length", "size", "limit", "max", "min", "name", "hint", "policy", "field", "label", "url", "uri", "path", "file", "type", "public", "id", "expiry", "ttl", "regex", "pattern", "placeholder", "example", "dummy"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|0+|1234567890?|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+\)?s?|your[-_ ].*|change[-_ ]?me.*|example.*|placeholder.*|none|null|true|false|undefined|todo.*|redacted.*)$")

_SIGN = re.compile(r"[:=]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
_NOT_FIRST = "0123456789.-"
_STRING = re.compile(r'''[bBrRuUfF]{0,2}(?:"""((?:[^\\]|\\.)*?)"""|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)''', re.S)
_REFERENCE = re.compile(r"\$?\{?([A-Za-z_][\w.]*+)\}?(?![\w(\[\"'-])", re.ASCII)
_BARE = re.compile(r"(?=[A-Za-z+/_.=~!@#%^&*-]*\d)[A-Za-z0-9+/_.=~!@#%^&*-]{8,}+(?![(\[])")
_BLANK = re.compile(r"[ \t]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: A literal is a secret from this score on: a sensitive name (2), and a form that could be one (1 at least).
THRESHOLD = 3.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def name_score(name: str) -> float:
    """2 for a sensitive name, less for harmless company, 0 for any other."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in _HARMLESS:
        return 0.0
    strong = words[-1] in _LAST or any(w in _STRONG or w.rstrip("s") in _STRONG for w in words)
    keyed = any(b in ("key", "keys") and a in _KEYED for a, b in zip(words, words[1:], strict=False))
    return (2.0 if strong or keyed else 0.0) - 0.5 * sum(w in _HARMLESS for w in words)


def literal_score(value: str) -> float:
    """From the literal's form: length, mixture of characters, bits a character; 0 for placeholders, prose and short ones."""
    if len(value) < 8 or _PLACEHOLDER.match(value) or value.count(" ") > 2 or value.startswith(("http://", "https://", "/")):
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return (1.0 if classes >= 2 and bits >= 2.5 else 0.0) + (0.5 if len(value) >= 16 else 0.0) + (0.5 if bits >= 3.5 else 0.0)


def _right(text: str, at: int, held: dict, own: list) -> list[tuple[int, int]]:
    """The spans of the literals that the expression at this place is made of; own gets those that stand in it."""
    found: list[tuple[int, int]] = []
    while True:
        at = _BLANK.match(text, at).end()
        if m := _STRING.match(text, at):
            k = m.lastindex or 2
            inner = _REFERENCE.fullmatch(m[k].strip()) if "$" in m[k] else None
            found += held.get(inner[1], []) if inner else [m.span(k)]
            own += [] if inner else [m.span(k)]
        elif (m := _REFERENCE.match(text, at)) and m[1].rpartition(".")[2] in held:
            found += held[m[1].rpartition(".")[2]]
        elif not found and (m := _BARE.match(text, at)):
            own.append(m.span())
            return [m.span()]
        else:
            return found
        at = _BLANK.match(text, m.end()).end()
        if text[at : at + 1] not in ("+", ".", "&"):
            return found
        at += 1


#: A name with its type, left of "=".
_TYPED_LEFT = re.compile(r"(?<![\w.])([A-Za-z_][\w.]*+)[\"'`]?\s*[?!]?\s*:\s*(?:&\s*)?(?:'\w+\s+)?(?:mut\s+|readonly\s+)?[A-Za-z_][\w.:]*+(?:\[[\w., |\[\]]*+\]?|<[\w., |<>&']*+)?(?:\s*\|\s*[A-Za-z_][\w.]*+)*+\s*$")
_BLOCK_HEAD = re.compile(r"[ \t]*[|>][-+0-9]{0,2}[ \t]*(?:#[^\n]*)?\r?\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)(?:\n|\Z)")
_ATTRIBUTES = re.compile(r"""\b(?:key|name|id)\s*=\s*(?:"([^"\n]*)"|'([^'\n]*)')\s+(?:[\w:-]+\s*=\s*(?:"[^"\n]*"|'[^'\n]*')\s+)*?value\s*=\s*(?:"([^"\n]*)"|'([^'\n]*)')""", re.I)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*([^<>\s][^<>]*?)\s*</\1\s*>")
_DEFINED = re.compile(r"\b(?:def|function|func|fn|sub|void)\s+([A-Za-z_]\w*+)\s*\(([^()]*+)\)", re.ASCII)
_PARAMETER = re.compile(r"[A-Za-z_$][\w$]*+", re.ASCII)


def _name_left(text: str, low: int, at: int) -> str:
    """The name that ends at this place, but for white space, a quote and a bracket; empty if there is none."""
    while at > low and text[at - 1] in " \t":
        at -= 1
    if at > low and text[at - 1] == "]":
        at -= 1
    if at > low and text[at - 1] in "\"'`":
        at -= 1
    end = at
    while at > low and text[at - 1] in _NAME_CHARS:
        at -= 1
    return text[at:end].lstrip(_NOT_FIRST)


def _block(text: str, at: int) -> list[tuple[int, int]]:
    """The lines of a block scalar behind a colon: those indented as its first."""
    head = _BLOCK_HEAD.match(text, at)
    if not head:
        return []
    out, at, indent = [], head.end(), None
    while at < len(text):
        line = _LINE.match(text, at)
        if line[2].strip():
            if indent is None:
                indent = len(line[1])
            if not indent or len(line[1]) < indent:
                break
            out.append((line.start(2), line.start(2) + len(line[2].rstrip())))
        at = line.end()
    return out


def _calls(text: str, held: dict):
    """Arguments of calls to functions that the text defines, under the names of their parameters."""
    defined: dict[str, list[str]] = {}
    heads = set()
    for m in _DEFINED.finditer(text):
        names = [_PARAMETER.search(p.partition("=")[0].partition(":")[0].strip().rpartition(" ")[2]) for p in m[2].split(",")]
        names = [n[0] if n else "" for n in names]
        defined[m[1]] = names[1:] if names[:1] == ["self"] else names
        heads.add(m.start(1))
    if not any(name_score(n) > 0 for names in defined.values() for n in names if n):
        return
    for m in re.finditer(r"\b(" + "|".join(map(re.escape, defined)) + r")\s*\(", text):
        if m.start(1) in heads:
            continue
        at = m.end()
        for name in defined[m[1]]:
            literals = _right(text, at, held, [])
            if literals and name:
                yield name, literals
            after = _ARGUMENT.match(text, at)
            if not after or after[1] != ",":
                break
            at = after.end()


_ARGUMENT = re.compile(r"""(?:[^"'`(),\n]|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)*+\s*([,)])""")


def pairs(text: str):
    """Each assignment's name and the spans of the literals that reach it; names are followed, later ones too."""
    held: dict[str, list[tuple[int, int]]] = {}
    while True:
        known = len(held)
        out = list(_pairs(text, held))
        if len(held) == known:  # no name is new: a further pass would find nothing more
            break
    if "(" in text:
        out += _calls(text, held)
    if "</" in text or "/>" in text:
        out += [(m[1] or m[2] or "", [m.span(3) if m[3] is not None else m.span(4)]) for m in _ATTRIBUTES.finditer(text)]
        out += [(m[1], [m.span(2)]) for m in _ELEMENT.finditer(text)]
    return out


def _pairs(text: str, held: dict):
    """One pass; held has the literals of names from the pass before and gets those of this one."""
    seen: set[str] = set()
    end = typed = 0
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if at < end:  # inside a literal, or the second sign of := or ==
            continue
        name = ""
        if text[at] == "=":
            # A type stands between the sign before, or the line's start, and this one.
            low = max(end, typed, text.rfind("\n", typed, at) + 1)
            if text.find(":", low, at) >= 0 and (left := _TYPED_LEFT.search(text, low, at)):
                name = left[1]
            typed = at + 1
        name = name or _name_left(text, end, at)
        if not name:
            continue
        begin = at + (2 if text[at : at + 2] in (":=", "=>") else 1)
        if text[at : at + 2] == "==" or text[at : at + 3] == "://":
            continue
        short = name.rpartition(".")[2]
        before = held.pop(short, None) if short not in seen else None  # its own later value isn't part of it
        own: list[tuple[int, int]] = []
        literals = _right(text, begin, held, own)
        if not literals and text[at] == ":" and (literals := _block(text, begin)):
            own = literals
        if literals:
            held[short] = literals
            seen.add(short)
            yield name, literals
            end = max((b for _, b in own), default=end)
        elif before is not None:
            held[short] = before


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed."""
    base = base_spans(text)
    more = set()
    if any(c in text for c in "=:<("):
        for name, literals in pairs(text):
            known = name_score(name)
            if known > 0 and known + literal_score("".join(text[a:b] for a, b in literals)) >= THRESHOLD:
                more |= {(a, b) for a, b in literals if b > a}
    # A literal lies in a base span if one that begins no later ends no sooner.
    starts, ends = [], []
    for a, b, _ in sorted(base):
        starts.append(a)
        ends.append(max(b, ends[-1] if ends else 0))
    inside = lambda a, b: (k := bisect_right(starts, a)) and ends[k - 1] >= b
    out = base + [(a, b, "literal") for a, b in more if not inside(a, b)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every stretch of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, b, _ in secret_spans(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, found (array of kind, start, end in code points)."""
    lean_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def found(texts: pd.Series) -> pd.Series:
        lean_worker()
        return texts.map(lambda t: [{"kind": k, "start": a, "end": b} for a, b, k in secret_spans(t)])

    return docs.select(F.col(id_col).alias("doc_id"), found(F.coalesce(F.col(text), F.lit(""))).alias("found"))


def redacted(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with secrets in the text replaced by a mark; texts without any, and nulls, stay as they are."""
    lean_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        lean_worker()
        return texts.map(lambda t: t if t is None else redact(t))

    out = docs.withColumn(text, clean(F.col(text)))
    return out.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType)) if chars and chars in docs.columns else out


def op9_secrets(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    listed = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = F.expr(listed("filter(found, s -> s.kind <> 'literal')"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), F.expr(listed("found")).alias("spans"))
