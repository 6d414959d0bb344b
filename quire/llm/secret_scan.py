"""Secret scans: fixed patterns, and novelty against a dictionary-primed compressor."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, types as T

from quire.llm.batches import mapped, texts_of, widened, with_columns

#: The base kinds in order, each with its pattern, the group that is measured, and
#: how many characters that must have.
BASE = (
    ("assign", re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    ), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = [kind for kind, *_ in BASE] + ["novel"]

#: What may be a secret of no known form: long runs of the letters of keys, and shorter runs with
#: other signs, as in passphrases. Which of them are looked at says ``_unnamed``.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PASSPHRASE = re.compile(r"(?<!\S)[\x21-\x7e]{12,256}(?!\S)")
SENSITIVE = re.compile(
    r"passw|passphrase|secret|token|api.?key|access.?key|private.?key|credential|bearer|auth|signature", re.I | re.A
)

#: A line of a longer secret that goes over several, as keys in armour do.
LINE = re.compile(r"\n([A-Za-z0-9+/=]{4,})(?=\r?\n|$)")

#: What is long and holds digits, but is a name: identifiers of universal form, and words that are
#: joined as in paths.
WORDS = re.compile(r"[/_=-]*([A-Za-z]?[a-z]+|[A-Z]+)[0-9]{0,4}([/_=-]+(([A-Za-z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,4}))+[/_=-]*")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

#: Fixed value: names that code around secrets is full of; they are no news to the compressor.
IDENTIFIERS = (
    b"password passwd passphrase secret token api_key apikey access_key private_key client_secret "
    b"credential credentials authorization Authorization Bearer bearer signature session_token "
    b"username user_name user_id client_id account_id tenant_id request_id correlation_id endpoint "
    b"config configuration settings environment getenv os.environ process.env application "
    b"localhost example.com http:// https:// /usr/local/bin /home/ /etc/ import export const "
    b"default false true null none undefined function return string integer boolean "
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0123456789abcdef"
)

#: Characters before a candidate, or after it on its line, in which a sensitive word must be, and
#: those around it that prime.
NEAR, AROUND = 48, 512

#: Least length of what is reported of a candidate that a base span covers in part.
REST = 8

#: Most bytes that are compressed together: so few that the compressor finds known runs only. It
#: would code the letters of 64 and more by their frequency and make random ones shorter, too.
STRETCH = 48


def novelty(candidate: str, before: str, after: str, enough: float = float("inf")) -> float:
    """The bytes that the candidate adds to its surroundings, as a share of its length.

    The compressor is primed with the identifiers and what stands around; the candidate's cost is
    what it takes beyond a run of as many bytes that the dictionary holds already. A long candidate
    is cut evenly into stretches of at most ``STRETCH`` bytes, and the newest of them counts; those
    after one that reaches ``enough`` aren't looked at."""
    primed = zstandard.ZstdCompressionDict(
        IDENTIFIERS + after.encode() + b"\n" + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    press = zstandard.ZstdCompressor(
        level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    data, nothing = candidate.encode(), len(press.compress(b""))
    parts = max(1, -(-len(data) // STRETCH))
    cuts = [len(data) * at // parts for at in range(parts + 1)]
    most = 0.0
    for start, end in zip(cuts, cuts[1:]):
        most = max(most, (len(press.compress(data[start:end])) - nothing) / max(end - start, 1))
        if most >= enough:
            break
    return most


def scan(text: str, threshold: float = 0.9) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start and kind; positions are code points, ends exclusive."""
    spans = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        for match in pattern.finditer(text):
            if len(match[group]) >= least:
                spans.append((match.start(), order, match.end()))
    base = _merged([(start, end) for start, _, end in spans])
    for start, end in _candidates(text):
        for a, b in _uncovered(start, end, base):
            rest = text[a:b]
            if b - a < end - start and (b - a < REST or not _unnamed(rest)):
                continue
            if novelty(rest, *_around(text, a, b), threshold) >= threshold:
                spans.append((a, len(BASE), b))
    return [(KINDS[order], start, end) for start, order, end in sorted(spans)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def _uncovered(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What covered stretches, in order and apart, leave of one."""
    rests, at = [], start
    for a, b in covered[bisect_right(covered, (start, start)) - 1 if bisect_right(covered, (start, start)) else 0:]:
        if a >= end:
            break
        if b > at:
            if a > at:
                rests.append((at, a))
            at = max(at, b)
    return [*rests, (at, end)] if at < end else rests


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a stretch, without copies of it: a secret that a text holds
    twice is no less of one."""
    value, reach = text[start:end], AROUND + end - start
    before = text[max(0, start - reach):start].replace(value, "")
    after = text[end:end + reach].replace(value, "")
    return before[-AROUND:], after[:AROUND]


def _unnamed(value: str) -> bool:
    """Whether a long run may be a secret: letters and digits, but not as names have them, or letters
    whose case changes as often as chance changes it."""
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    if letters and digits:
        return not (UUID.fullmatch(value) or len(value) <= 256 and WORDS.fullmatch(value))
    changes = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
    return changes * 5 >= len(value) * 2


def _mixed(value: str) -> bool:
    """Whether a run has small and large letters, digits and a sign that words don't have."""
    return (
        any(c.islower() for c in value) and any(c.isupper() for c in value) and any(c.isdigit() for c in value)
        and any(c in "!@#$%^&*" for c in value) and "://" not in value
    )


def _candidates(text: str) -> list[tuple[int, int]]:
    """Runs that may be secrets and have a sensitive word soon before them, or after them on their
    line, and the lines that go on from one; apart and in order. Every run is looked at once."""
    words = [(word.start(), word.end()) for word in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [start for start, _ in words], sorted(end for _, end in words)

    def sensitive(start: int, end: int) -> bool:
        at = bisect_right(ends, start)
        if at and start - ends[at - 1] <= NEAR:
            return True
        at = bisect_left(starts, end)
        return at < len(starts) and starts[at] - end <= NEAR and "\n" not in text[end:starts[at]]

    found = [
        match.span() for pattern, fits in ((CANDIDATE, _unnamed), (PASSPHRASE, _mixed)) for match in pattern.finditer(text)
        if sensitive(*match.span()) and fits(match[0])
    ]
    apart: list[tuple[int, int]] = []
    for start, end in _merged(found):
        if apart and start < apart[-1][1]:
            continue  # a line of the run before
        apart.append((start, end))
        while line := LINE.match(text, apart[-1][1] + (text[apart[-1][1]:apart[-1][1] + 1] == "\r")):
            apart.append(line.span(1))
    return apart


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a note in place of each stretch that spans cover."""
    parts, at = [], 0
    for kind, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], f"[{kind} removed]"]
        at = end
    return "".join([*parts, text[at:]])


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(
    docs: DataFrame, text: str = "text", threshold: float = 0.9, redacted: str | None = None,
) -> DataFrame:
    """``docs`` with ``spans``: what looks like a secret in each whole text, an array of ``kind``,
    ``start`` and ``end`` in code points, by start and then kind. Where ``redacted`` names a column,
    it gets the text with notes in place of the spans.

    The kinds ``assign``, ``access`` and ``hex`` are fixed patterns, leftmost and not overlapping
    within a kind. ``novel`` are other strings near a sensitive word that the primed compressor can't
    shorten below ``threshold`` bytes a character: runs of 16 and more of the letters of keys with
    letters and digits, or letters of changing case, and runs of 12 and more with letters, digits and
    other signs; not those that are built as names are (words joined by dashes, slashes or underscores,
    universal identifiers). The word may be before the run or behind it on its line. Lines that hold
    nothing but key letters right below such a run are measured, too. Of a run that base spans
    cover in part, what is left is reported; novel spans overlap no other span. Copies of a string
    nearby don't count as known: each is looked at without the others. Long ones are measured in
    stretches, so that length alone makes nothing known. Time grows with the text.
    Null and empty texts have no spans (a redacted null stays null). Rows stay as they are; columns
    of the new names are replaced.
    """
    kinds: dict[str, T.DataType] = {"spans": SPANS}
    if redacted:
        kinds[redacted] = T.StringType()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(text).to_pylist()
        found = [scan(value or "", threshold) for value in values]
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in found]
        columns: dict[str, pa.Array] = {"spans": pa.array(spans, _ARROW)}
        if redacted:
            clean = [value and redact(value, own) for value, own in zip(values, found)]
            columns[redacted] = pa.array(clean, pa.string())
        return with_columns(batch, columns)

    return mapped(docs, run, widened(docs.schema, **kinds))
