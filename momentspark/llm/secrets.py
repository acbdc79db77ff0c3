"""Secret scans (dealt operator 2): patterns, and strings that a primed zstandard dictionary cannot compress.

Base spans are those of three patterns. In addition, all strings of 16 or more token characters that follow a sensitive word
closely are candidates, and after a novel one those of the following lines. For each, zstandard is primed with the text around it
(without it) and with common identifiers; its marginal bytes are what the compressed size grows by. What the surroundings,
the identifiers or its own repeats explain costs few bytes; random keys cost nearly what random text of their
alphabet does and are reported as kind `novel`.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "novel")
# on UTF-8 bytes; ASSIGN and SENSITIVE on bytes with A-Z lowered
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
SENSITIVE = re.compile(rb"passw|pwd|secret|token|api[_-]?key|private|credential|bearer|authoriz|signing|access[_-]?key")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
# a key's next line (line breaks may be escaped, lines quoted), and the rest of a key before its end mark
NEXT_LINE = re.compile(rb"[\x20\t\"',]*(?:\\r|\\n|\r|\n)+[\x20\t\"',]*")
LAST_LINE = re.compile(rb"[A-Za-z0-9+/=]+(?=[\x20\t\"',]*(?:\\r|\\n|\r|\n)+[\x20\t\"',]*-----END)")
#: Names that stand in code and configuration beside secrets and are none themselves.
IDENTIFIERS = b" ".join(
    rb"""password passwd secret token api_key apikey access_key_id secret_access_key client_secret client_id private_key public_key
authorization bearer basic credential credentials username user_name hostname localhost database connection_string environment variable
configuration settings application service account project production development staging example placeholder changeme your_token_here
getElementById addEventListener XMLHttpRequest JSON.stringify self.assertEqual __init__ System.out.println public static final String
begin rsa private key end certificate ssh-rsa ssh-ed25519 sha256 sha512 md5 base64 utf-8 application/json text/plain content-type
http://www. https://www. .com .org .net .example github.com localhost:8080 127.0.0.1 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
0123456789abcdef 00000000000000000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX""".split()
)


class Novelty(NamedTuple):
    """A candidate is reported if it costs `share` of the bytes of random text of its alphabet or more. `reach`: bytes after a
    sensitive word in which it may start; `around`: bytes of text on each side that prime the dictionary."""

    share: float = 0.85
    reach: int = 48
    around: int = 1024


@lru_cache(1)
def _frame_bytes() -> int:
    import zstandard

    return len(zstandard.ZstdCompressor(level=19, write_content_size=False).compress(b""))


def marginal_bytes(candidate: bytes, around: bytes) -> int:
    """Compressed bytes of the candidate, primed with what is around it and the identifiers, less an empty frame's."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False).compress(candidate)) - _frame_bytes()


def base_spans(data: bytes, low: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes: leftmost non-overlapping matches of each kind that are long enough."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 12]
    if b"AKIA" in data:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(data)]


def random_bytes(text: bytes) -> float:
    """What random text of this length costs at the least, by the kinds of characters in this one (letters to f count as hexadecimal)."""
    low, high = re.findall(rb"[a-z]", text), re.findall(rb"[A-Z]", text)
    size = 10 * bool(re.search(rb"[0-9]", text)) + len(set(re.findall(rb"[^A-Za-z0-9]", text)))
    size += (low != []) * (6 if all(c <= b"f" for c in low) else 26) + (high != []) * (6 if all(c <= b"F" for c in high) else 26)
    return len(text) * math.log2(max(2, size)) / 8


def novel_spans(data: bytes, low: bytes, taken: list[tuple[int, str, int]], rule: Novelty) -> list[tuple[int, str, int]]:
    """Candidates apart from the taken spans, with letters and digits, that the primed dictionary does not explain."""
    out, done = [], 0

    def novel(a: int, z: int) -> bool:
        if any(s < z and a < e for s, _, e in taken):
            return False
        return marginal_bytes(data[a:z], data[max(0, a - rule.around) : a] + data[z : z + rule.around]) >= rule.share * random_bytes(data[a:z])

    for word in SENSITIVE.finditer(low):
        limit = word.end() + rule.reach
        while m := CANDIDATE.search(data, max(word.end(), done), limit + 15):
            a, z = m.start(), CANDIDATE.match(data, m.start()).end()  # whole, also beyond the reach
            done = z
            if not (re.search(rb"[0-9]", data[a:z]) and re.search(rb"[A-Za-z]", data[a:z]) and novel(a, z)):
                continue
            out.append((a, "novel", z))
            while gap := NEXT_LINE.match(data, z):
                a = gap.end()
                if last := LAST_LINE.match(data, a):
                    z = last.end()
                elif (line := CANDIDATE.match(data, a)) and not line[0].startswith(b"-----") and novel(a, line.end()):
                    z = line.end()
                else:
                    break
                done = z
                out.append((a, "novel", z))
    return out


def spans(text: str | None, rule: Novelty = Novelty()) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then in the order of KINDS."""
    data = (text or "").encode("utf-8", "surrogatepass")
    low = data.lower()  # of bytes: A-Z only
    found = base_spans(data, low)
    found += novel_spans(data, low, found, rule)
    found.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    if len(data) == len(text or ""):
        return [(k, a, z) for a, k, z in found]
    points, at, count = {}, 0, 0
    for p in sorted({x for a, _, z in found for x in (a, z)}):
        count += len(data[at:p].decode("utf-8", "surrogatepass"))
        points[p], at = count, p
    return [(k, points[a], points[z]) for a, k, z in found]


def find_secrets(docs: DataFrame, rule: Novelty = Novelty(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, secrets array<struct<kind,start,end,value>>) for each row; null and empty texts have none.

    Each row is scanned by itself, whatever its id; other columns are ignored.
    """

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
        for b in slices(batches, "t"):
            out = [[{"kind": k, "start": a, "end": z, "value": t[a:z]} for k, a, z in spans(t, rule)] for t in b.column("t").to_pylist()]
            yield pa.record_batch([b.column("i"), pa.array(out, pa.list_(kind))], names=["i", "secrets"])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"i {slim.schema['i'].dataType.simpleString()}, secrets array<struct<kind:string,start:long,end:long,value:string>>").withColumnRenamed("i", id_col)


def redact_text(text: str | None, rule: Novelty = Novelty(), mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at, last = [], 0, 0
    for _, a, z in spans(text, rule):
        if a >= last:
            out += [text[at:a] if a > at else "", mark]
        last = at = max(last, z)
    return text if not last else "".join(out) + text[at:]


def redact(docs: DataFrame, rule: Novelty = Novelty(), text_col: str = "text") -> DataFrame:
    """`docs` with secrets in the text replaced by `[SECRET]`; no row is dropped, and null texts stay null."""

    def run(batches):
        for b in slices(batches, text_col):
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, text_col, pa.array([redact_text(t, rule) for t in b.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)
