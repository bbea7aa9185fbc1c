"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.registry import query, table
from stowage.llm.words import chunks

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

SPANS = "array<struct<kind:string,start:int,stop:int,score:double>>"

# Each part runs to its end or fails, so no start inside a run of digits can succeed where the run's
# own start failed: the look-behind and the possessive marks only keep the search linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2})[0-9]{2})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an account number by country (ISO 13616).
LENGTHS = {code: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}.items() for code in codes.split()}
_SIZED = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(LENGTHS.values())}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a confirmed span, what a context word in the ``NEAR`` characters before it adds, and the words.
NEAR, NEEDED = 40, 0.6
SCORES = {"email": (0.9, 0.1), "ip": (0.7, 0.2), "card": (0.8, 0.2), "phone": (0.7, 0.2), "iban": (0.8, 0.2),
          "ssn": (0.4, 0.4)}
CONTEXT = {kind: re.compile(rf"(?<![A-Za-z])(?:{words})(?![A-Za-z])", re.I) for kind, words in {
    "email": "e-?mail|mail|contact", "ip": "ip|host|server|address", "card": "card|visa|mastercard|credit|pay",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account", "ssn": "ssn|social|security|tax"}.items()}


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for at, digit in enumerate(map(int, reversed(digits))):
        doubled = digit * 2 if at % 2 else digit
        total += doubled - 9 if doubled > 9 else doubled
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without blanks leaves 1 modulo 97, country and check digits last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place of the kind in ``KINDS``, start, stop) of e-mail, IP, card and phone, in code points."""
    found = [(0, *span) for span in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass mod 97: of their country's length, or else as far as groups of capitals and digits go."""
    done = 0
    for start in _ACCOUNT.finditer(text):
        if start.start() < done:
            continue
        for rule in filter(None, (_SIZED.get(LENGTHS.get(start[1])), _IBAN)):
            m = rule.match(text, start.start())
            if m and mod97(m[0].replace(" ", "")):
                yield m.span()
                done = m.end()
                break


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """Account numbers that pass mod 97, and social security numbers."""
    found = [(4, *span) for span in _accounts(text)]
    return found + [(5, *m.span()) for m in _SSN.finditer(text)]


def spans_of(text: str) -> list[tuple[int, int, int, float]]:
    """All spans with their score, by kind and start. Base kinds stay whatever their score."""
    found = []
    for kind, start, stop in base_spans(text) + added_spans(text):
        name = KINDS[kind]
        score, more = SCORES[name]
        if CONTEXT[name].search(text, max(0, start - NEAR), start):
            score += more
        if kind < len(BASE_KINDS) or score >= NEEDED:
            found.append((kind, start, stop, round(score, 3)))
    return found


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns ``key`` and ``spans`` (kind, start, stop, score; code points, ``stop`` exclusive) per row.

    A null or empty text has no spans. Rows are judged alone: repeated rows come out repeated, an
    empty table gives an empty one, and other columns are not looked at.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [[{"kind": KINDS[k], "start": a, "stop": b, "score": s} for k, a, b, s in spans_of(t or "")]
                        for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows, _SPAN_TYPE)], ["key", "spans"])

    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("key", kind)]).add("spans", _ddl(SPANS)))
    return found.withColumnRenamed("key", key)


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                                 ("score", pa.float64())]))


def _ddl(kind: str) -> T.DataType:
    return T.StructType.fromDDL(f"x {kind}")["x"].dataType


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Replaces each span by its kind in angle brackets, in a table whose columns stay as they are.

    Overlapping spans become one mark, that of the first. Null stays null; ``length`` is set to the
    new text's length where the table has it and the text changed.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                old = part.column(text).to_pylist()
                new = [None if t is None else masked(t) for t in old]
                columns = {n: part.column(n) for n in names}
                columns[text] = pa.array(new, pa.string())
                if length in names:
                    kept = columns[length].to_pylist()
                    columns[length] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)],
                                               columns[length].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str) -> str:
    out, done = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b, _ in spans_of(text)):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, stop)
    return "".join([*out, text[done:]])


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    base = "filter(spans, s -> s.kind IN ('email', 'ip', 'card', 'phone'))"
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
              for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined(base)), 256).alias("base_sha256"),
                        F.expr(_joined("spans")).alias("spans"))
