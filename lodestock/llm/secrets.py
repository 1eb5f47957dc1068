"""Operator 2: secret scans.

An Aho-Corasick automaton finds the keywords in one pass; an anchored regular expression looks only
where a keyword begins; kinds of token that carry a checksum are kept only if it holds. Lower-case
hexadecimal runs have no keyword, so the text is mapped to two classes, in which 24 class letters in a
row are the literal to look for.

Spans are (kind, start, end) in code points, end exclusive. Within a kind matches are leftmost and do
not overlap, as in one scan over the whole text: a match that is too short is passed over as a whole.

Cases: null and empty texts have no span; null and repeated doc_ids are kept, a row each; an empty table
gives no row; other columns are not read by the scan and kept as they are by `redact`.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.llm.common import free_names, mapped, sliced, strings

#: The order of kinds that begin at one place; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "age")
LEAST = {"assign": 6, "access": 20, "hex": 24}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
AGE = re.compile(r"AGE-SECRET-KEY-1([02-9AC-HJ-NP-Z]{58})(?![0-9A-Z])")

#: Keyword in lower case -> the kind whose expression is anchored there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "age-secret-key-1": "age",
}
#: The digits of base 62 in the order token checksums use, and bech32's alphabet and generator.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

_CLASSES = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
_RUN = b"x" * LEAST["hex"]
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_AUTOMATON = None


def base62_crc32(payload: str) -> str:
    """CRC-32 of the payload as six base-62 digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def bech32_holds(prefix: str, data: str) -> bool:
    check = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(BECH32.index, data)]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check == 1


def _checked(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


#: Kind -> expression, and whether a match of it counts.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= LEAST["assign"]),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST["access"]),
    "github": (GITHUB, _checked),
    "npm": (NPM, _checked),
    "age": (AGE, lambda m: bech32_holds("age-secret-key-", m[1])),
}


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        found = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            found.add_word(word, (len(word) - 1, kind))
        found.make_automaton()
        _AUTOMATON = found
    return _AUTOMATON


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by the order of KINDS."""
    lower = text.lower()
    if len(lower) != len(text):  # letters that lower to two move what follows
        lower = text.translate(_LOWER)
    starts: dict[str, list[int]] = {}
    for end, (back, kind) in _automaton().iter(lower):
        starts.setdefault(kind, []).append(end - back)
    spans = []
    for kind, at in starts.items():
        expression, counts = RULES[kind]
        free = 0
        for start in sorted(at):
            if start >= free and (m := expression.match(text, start)):
                free = m.end()
                if counts(m):
                    spans.append((kind, start, free))
    classes = text.encode("latin-1", "replace").translate(_CLASSES)
    start = classes.find(_RUN)
    while start >= 0:
        end = HEX.match(text, start).end()
        spans.append(("hex", start, end))
        start = classes.find(_RUN, end)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for _, start, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every row."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in strings(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "spans": pa.array(found, kinds)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, scan, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars (where there is one) counted anew in rows that changed."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    if "n_chars" not in docs.columns:
        return mapped(docs, change, docs.schema)
    (chars,) = free_names(docs, "chars")
    before = docs.withColumn(chars, F.char_length("text"))
    out = mapped(before, change, before.schema)
    moved = F.char_length("text") != F.col(chars)
    return out.withColumn("n_chars", F.when(moved, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(spans: list) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(s["kind"], s["start"], s["end"]) for s in row] for row in batch.column(1).to_pylist()]
            base = [[s for s in row if s[0] in LEAST] for row in found]
            count = {f"n_{k}": pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in LEAST}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | count | {"base_sha256": pa.array([hashlib.sha256(line(row).encode()).hexdigest() for row in base], pa.string()), "spans": pa.array(list(map(line, found)), pa.string())})

    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mapped(found, digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
