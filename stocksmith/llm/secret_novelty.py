"""Secret scans with dictionary-primed zstandard novelty (operator 2).

Fixed patterns find assigned secrets, access keys and long hex strings.  Beyond
them, each string that starts shortly after a sensitive word is a candidate:
it is compressed with a zstandard dictionary of common code identifiers and the
code around it, and the bytes it adds to an empty frame are set against those
that a random string of its length and alphabet adds.  Strings that the dictionary
cannot shorten are reported as ``novel``; identifiers, paths and text that occur
nearby compress away.  The body of a key block is one candidate over all its lines.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_rows, text_slices

KINDS = ("assign", "access", "hex", "novel")

# Fixed patterns; assign's keywords are the only letters that match in either case.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this drops the shorter ones

SENSITIVE = re.compile(r"(?<![A-Za-z])(?i:password|passwd|passphrase|pwd|secret|token|api_?key|apikey|auth|authorization|bearer|credentials?|private|signature|access|key)(?![a-z])", re.ASCII)
STARTS, RUN, SHORTEST = re.compile(r"[A-Za-z0-9+/_=.-]"), re.compile(r"[A-Za-z0-9+/_=.-]+"), 16

#: Key blocks: the first line, and lines of base64 one below the other (\\n: a line end in quoted text).
BLOCK = re.compile(r"-----BEGIN ([^\n-]*)-----")
BODY = re.compile(r"""(?:(?<=\\)[nr])?([A-Za-z0-9+/=]{16,}+(?:["',;+\x20\t]*+(?:(?:\\r)?\\n|\s)["'>\s]*+[A-Za-z0-9+/=]++(?=["',;\x20\t]*+(?:[\r\n\\-]|\Z)))*+)""")
LINE_ENDS = re.compile(r"(?:\\[nr]|[^A-Za-z0-9+/=])+")

#: Words that code is full of; they prime every dictionary.
IDENTIFIERS = (
    "abstract address append array async await authorization base64 boolean buffer bytes callback certificate char class client "
    "com config connect const constructor content context continue controller count create credentials data database default "
    "delete description development directory document element encoding environment error example exception export extends "
    "false filename final float format from function getElementById github handler header hidden host http https identifier implements "
    "import include index initialize input instance integer interface internal isinstance iterator javascript json key "
    "language length library listener localhost location logger manager message method module namespace nextElement null "
    "number object option org output package parameter parent password path performance placeholder port private process production "
    "property protected provider public query random receiver redirect register repository request resource response "
    "return router schema script secret self server service session settings signature source standard static status "
    "string struct subprocess super system table template test timestamp token transaction true undefined update url user "
    "username utf-8 validate value variable vector version virtual void while window www.example.com xml "
    "0123456789 ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz"
)

#: A candidate starts at most REACH code points after a sensitive word; AROUND code points on each side prime it.
REACH, AROUND, LEVEL = 48, 512, 9
#: Random strings have 8 / 6 = 1.33 (16 letters: 2) at any length; strings of known words about 1 or less.
LEAST = 1.15
CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/")


def marginal_bytes(candidate: str, around: str) -> int:
    """Bytes that ``candidate`` adds to a zstandard frame primed with the identifiers and ``around``."""
    primer = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_checksum=False)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


@lru_cache(maxsize=4096)
def random_bytes(length: int, letters: str) -> int:
    """Marginal bytes of a random string; long ones have fewer than ``length``, as zstandard codes their letters."""
    return marginal_bytes("".join(random.Random(length).choices(letters, k=length)), "")


def novelty(candidate: str, around: str) -> float:
    """Marginal bytes over those of a random string of that length and alphabet, times 8 / 6 (16 letters: 8 / 4); LEAST or more: incompressible."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate):
        letters, bits = string.hexdigits[:16], 4
    else:
        have = set(candidate)
        letters, bits = "".join(c for c in CLASSES if not have.isdisjoint(c)) or "+/", 6
        if not have <= set(letters):
            letters += "".join(sorted(have - set(letters)))
    return marginal_bytes(candidate, around) / random_bytes(len(candidate), letters) * 8 / bits


def _around(text: str, a: int, b: int) -> str:
    """The code on both sides of a candidate, without copies of it: a secret that is written twice stays new."""
    far = AROUND + b - a
    return text[max(0, a - far):a].replace(text[a:b], "")[-AROUND:] + "\n" + text[b:b + far].replace(text[a:b], "")[:AROUND]


def _blocks(text: str, least: float) -> list[tuple[int, int]]:
    """(start, end) of the incompressible bodies of key blocks; without an END line, of the lines right below."""
    out = []
    for m in BLOCK.finditer(text):
        if not SENSITIVE.search(m[1]):
            continue
        following = text.find("-----BEGIN ", m.end())
        stop = text.find("-----END ", m.end(), following if following >= 0 else len(text))
        for body in BODY.finditer(text, m.end(), stop if stop >= 0 else following if following >= 0 else len(text)):
            if stop < 0 and not re.fullmatch(r"""(?:[\s"',;+>]|\\[nr]?)*""", text[m.end():body.start()]):
                break
            a, b = body.span(1)
            if novelty(LINE_ENDS.sub("", body[1]), _around(text, a, b)) >= least:
                out.append((a, b))
            if stop < 0:
                break
    return out


def _inside(a: int, b: int, starts: list[int], reach: list[int]) -> bool:
    """Does one of the sorted findings hold all from a to b? One that starts by a and goes as far as b does."""
    k = bisect_right(starts, a) - 1
    return k >= 0 and reach[k] >= b


def spans(text: str, least: float = LEAST) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every finding, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    novel, to = set(), 0
    found.sort()
    reach = list(accumulate((b for *_, b in found), max))  # how far the findings up to each one go
    starts = [a for a, *_ in found]
    if "-----BEGIN " in text:
        blocks = [(a, b) for a, b in _blocks(text, least) if not _inside(a, b, starts, reach)]
        novel.update((a, 3, b) for a, b in blocks)
    else:
        blocks = []
    block_starts, block_ends = [a for a, _ in blocks], [b for _, b in blocks]
    for s in SENSITIVE.finditer(text):
        at = max(s.end(), to)
        while near := STARTS.search(text, at, s.end() + REACH):
            at = to = (c := RUN.match(text, near.start())).end()
            if at - c.start() < SHORTEST:
                continue
            k = bisect_left(block_starts, c.end()) - 1  # the last block that starts before the candidate ends; blocks do not overlap
            if _inside(c.start(), c.end(), starts, reach) or k >= 0 and c.start() < block_ends[k]:
                continue
            if novelty(c[0], _around(text, *c.span())) >= least:
                novel.add((c.start(), 3, c.end()))
    return sorted({*found, *novel})


def scan(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of each row of ``docs``.

    ``least`` is the novelty from which a string in a sensitive context is
    reported; a context goes over line ends, and
    the body of a key block is one string.  Strings inside a pattern's span are not reported again.  Spans are
    sorted by start, kind (assign, access, hex, novel) and end.  Null or empty text: no
    spans.  Null ids and repeated rows pass through, one row out for each in; an
    empty table gives an empty result; further columns are ignored."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for part in text_slices(batches, 1):
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, least)] if t else [] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return text_rows(docs, doc_id, text).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def as_text(spans_: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def masked(text: str, mark: str, least: float = LEAST) -> str:
    """``text`` with each finding, or run of findings that overlap, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans(text, least):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]", least: float = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; nulls stay null, all other columns stay as they are."""
    ship(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for part in text_slices(batches, place):
            texts = [masked(t, mark, least) if t else t for t in part.column(place).to_pylist()]
            yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
