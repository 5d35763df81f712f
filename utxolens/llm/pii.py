"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, URL schemes and identifier
cues. At each anchor a deterministic parser expands to the boundaries of what it could be and
validates it: domain labels around an at-sign, address parts up to 255, Luhn sums, digit counts,
the value behind an account cue. Regions between anchors are never parsed.

The base kinds (email, ip, card, phone) are exactly the leftmost non-overlapping matches of their
patterns; url and account spans are added beside them. Offsets count code points, ends exclusive.

Defined results: null and empty texts have no spans; null ids stay null; repeated rows are scanned
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

#: Kinds in the order that breaks ties of equal starts; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
# Words that announce an account or secret, and schemes of URLs.
CUES = ("iban", "account", "acct", "ssn", "passport", "password", "passwd", "token", "secret", "api_key", "apikey", "api-key")
SCHEMES = ("http://", "https://", "ftp://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_REGION = re.compile(r"[0-9.\x20-]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_ACCOUNT = re.compile(r"(?:[ \t]*+(?:no|nr|number|id|code)\b\.?)?[ \t]*+[:=#]?[ \t]*+[\"']?([A-Za-z0-9][A-Za-z0-9_+/.-]*[A-Za-z0-9])", re.IGNORECASE)
_AUTOMATON = None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word in ("@", "+", *"0123456789"):
            a.add_word(word, (word if word in "@+" else "0", 1))
        for word in SCHEMES:
            a.add_word(word, ("url", len(word)))
        for cue in CUES:
            for word in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(word, ("cue", len(word)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _addresses(text: str, at: int, end: int):
    """Four runs of digits joined by single dots; each run is read once, so long runs cost what they are long."""
    parts: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text, at, end):
        if parts and not (m.start() == parts[-1][1] + 1 and text[m.start() - 1] == "."):
            parts = []
        parts.append(m.span())
        if len(parts) == 4:
            values = [text[a:b].lstrip("0") for a, b in parts]
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                yield parts[0][0], 1, parts[3][1]
            parts = []


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, in order."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    mail_end = region_end = account_end = url_end = 0
    for last, (what, n) in _automaton().iter(text):
        at = last - n + 1
        if what == "0":
            if at < region_end:
                continue
            region = _REGION.match(text, at)
            region_end = region.end()
            if region_end - at < 7:
                continue
            out += _addresses(text, at, region_end)
            for m in _CARD.finditer(text, at, region_end):
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        elif what == "@":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                out.append((start, 0, mail_end))
        elif what == "+":
            if (m := _PHONE.match(text, at)) and 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((at, 3, m.end()))
        elif what == "url":
            if at >= url_end and (at == 0 or not text[at - 1].isalnum()):
                end = _URL.match(text, last).end()
                while text[end - 1] in ".,;:!?)'":
                    end -= 1
                url_end = end
                if end > last + 1:
                    out.append((at, 4, end))
        elif at >= account_end and (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
            value = m[1]
            if m.start(1) > last + 1 and len(value) >= 6 and sum("0" <= c <= "9" for c in value) >= 3:
                account_end = m.end(1)
                out.append((m.start(1), 5, account_end))
    out.sort()
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, kinds: tuple[str, ...] = KINDS) -> str | None:
    """The text with each span of these kinds, or run of overlapping ones, replaced by its first kind in angle brackets."""
    if not text:
        return text
    parts, done, kind = [], 0, None
    for a, k, b in find_spans(text):
        if KINDS[k] not in kinds:
            continue
        if a < done and kind is not None:
            done = max(done, b)
            continue
        parts += [text[done:a], f"<{KINDS[k].upper()}>"]
        done, kind = b, k
    return "".join(parts) + text[done:]


def redacted(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """A column's texts with personal data of these kinds replaced."""

    def run(texts):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [pa.array([redact(t, kinds) for t in b.column(0).to_pylist()], pa.string()) for b in text_slices([batch], 4 << 20, text=0)]
        return pa.concat_arrays(parts or [pa.array([], pa.string())])

    return F.arrow_udf(run, "string")(text.cast("string"))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base kinds and the text form of all spans, for each row."""

    def run(batches):
        import pyarrow as pa

        for b in text_slices(batches, 4 << 20):
            found = [find_spans(t) for t in b.column(1).to_pylist()]
            base = [[s for s in spans if s[1] < len(BASE)] for spans in found]
            out = {"doc_id": b.column(0)}
            for k, kind in enumerate(BASE):
                out[f"n_{kind}"] = pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64())
            out["base_sha256"] = [hashlib.sha256(spans_text(spans).encode()).hexdigest() for spans in base]
            out["spans"] = [spans_text(spans) for spans in found]
            yield pa.RecordBatch.from_pydict(out)

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return source.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
