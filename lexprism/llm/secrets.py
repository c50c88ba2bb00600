"""Secret scans with multipart credential linking.

Strong findings stand on their own. Weak parts (an account name, an opaque
string, an address) say nothing alone; they are reported only where parts that
complete each other lie in one scope, within reach of one another if a reach is given.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, their least lengths and their order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
BASE = ("assign", "access", "hex")
LINKED = ("linked_id", "linked_secret", "linked_endpoint")
ORDER = {kind: place for place, kind in enumerate(BASE + LINKED)}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Weak parts.
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])"
                    r"[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
SHORT_SECRET = re.compile(
    r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passwd|password|secret|token|auth|credential)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%-]{6,})""",
    re.IGNORECASE | re.ASCII,
)
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.ASCII)
SCOPE_END = re.compile(r"\n[\x20\t]*\n")

Finding = tuple[int, int, str, int]  # start, end, kind, start of the secret value


def base_findings(text: str) -> list[Finding]:
    found: list[Finding] = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), m.end(), "assign", m.start(2)))
    if "AKIA" in text:
        found += [(*m.span(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(*m.span(), "hex", m.start()) for m in HEX.finditer(text)]  # runs are maximal: the least length may stand in the pattern
    return found


def linked_findings(text: str, base: list[Finding], reach: int | None) -> list[Finding]:
    """Weak parts completed by another part of the same scope, at most ``reach`` characters away if that is given.

    A weak secret needs an identifier or an endpoint; a weak identifier or an
    endpoint needs a secret, weak or strong. Parts inside a base finding's value
    are that finding and not reported again.
    """
    marked = "://" in text
    if not base and not marked and ":" not in text and "=" not in text:
        return []
    identifiers = [m.span() for m in IDENTIFIER.finditer(text)]
    endpoints = [m.span() for m in ENDPOINT.finditer(text)] if marked else []
    strong_ids = [(a, b) for a, b, kind, _ in base if kind == "access"]
    strong_secrets = [(a, b) for a, b, kind, _ in base if kind != "access"]
    if not (identifiers or endpoints or strong_ids):
        return []
    covered = sorted((a, b) for a, b, *_ in base)

    def apart(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
        begins = [a for a, _ in others]
        highest, ends = 0, []
        for _, b in others:
            highest = max(highest, b)
            ends.append(highest)
        out = []
        for a, b in spans:
            k = bisect_left(begins, b)
            if k == 0 or ends[k - 1] <= a:
                out.append((a, b))
        return out

    opaque = apart([m.span() for m in OPAQUE.finditer(text)], identifiers)  # an account's own value does not complete it
    weak = sorted({*opaque, *(m.span() for m in SHORT_SECRET.finditer(text))})
    weak = apart(apart(weak, covered), sorted(endpoints))
    identifiers = apart(identifiers, covered)
    breaks = [m.start() for m in SCOPE_END.finditer(text)]
    reach = len(text) if reach is None else reach

    def near(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Interval join: spans with one of the others in the same scope and within reach."""
        others = sorted(others)
        begins, ends = [a for a, _ in others], sorted(b for _, b in others)
        out = []
        for a, b in spans:
            scope = bisect_right(breaks, a)
            low = max(breaks[scope - 1] if scope else 0, a - reach)
            high = min(breaks[scope] if scope < len(breaks) else len(text), b + reach)
            # others that end after low, less those that begin at or after high
            if len(ends) - bisect_right(ends, low) - (len(begins) - bisect_left(begins, high)) > 0:
                out.append((a, b))
        return out

    linked_weak = near(weak, identifiers + endpoints + strong_ids)
    secrets = linked_weak + strong_secrets
    found = [(a, b, "linked_secret", a) for a, b in linked_weak]
    if secrets:
        found += [(a, b, "linked_id", a) for a, b in near(identifiers, secrets)]
        found += [(a, b, "linked_endpoint", a) for a, b in near(endpoints, secrets)]
    return found


def findings(text: str | None, reach: int | None = None) -> list[dict]:
    text = text or ""
    base = base_findings(text)
    every = sorted(base + linked_findings(text, base, reach), key=lambda f: (f[0], ORDER[f[2]], f[1]))
    return [{"kind": kind, "start": a, "end": b, "value_start": v} for a, b, kind, v in every]


FINDINGS = "array<struct<kind: string, start: long, end: long, value_start: long>>"


def secret_findings(text: Column | str, reach: int | None = None) -> Column:
    """All findings of a whole text, by start, then kind; positions are code points, ends exclusive.

    Kinds ``assign``, ``access`` and ``hex`` are the base patterns, the
    ``linked_`` kinds weak parts that complete one another within one
    scope (a stretch without an empty line), however long it is unless ``reach``
    bounds the characters between them. A null or empty text has none. Each row is judged alone: nothing is shuffled or gathered.
    """

    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([findings(text, reach) for text in texts], dtype=object)

    scan.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    column = (F.col(text) if isinstance(text, str) else text).cast("string")
    return F.pandas_udf(scan, FINDINGS).asNondeterministic()(column)


def span_list(found: Column) -> Column:
    """kind:start:end of findings, joined by commas."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int | None = None) -> DataFrame:
    """``keep`` columns and ``findings`` of every row; repeated rows repeat, an empty table stays empty."""
    return df.select(*keep, secret_findings(text, reach).alias("findings"))


def redact_secrets(df: DataFrame, text: str = "text", reach: int | None = None, label: str = "[SECRET]") -> DataFrame:
    """``df`` with the value of every finding replaced by ``label``; all rows and columns stay.

    Only the value of an assignment goes, its name stays. Overlapping findings
    are replaced as one stretch. Null texts stay null; texts without findings
    are unchanged.
    """

    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for content in texts:
            if content is not None:
                spans = sorted((f["value_start"], f["end"]) for f in findings(content, reach))
                pieces, at = [], 0
                for begin, end in spans:
                    if begin >= at:
                        pieces += [content[at:begin], label]
                    at = max(at, end)
                content = "".join([*pieces, content[at:]])
            out.append(content)
        return pd.Series(out, dtype=object)

    redact.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return df.withColumn(text, F.pandas_udf(redact, "string").asNondeterministic()(F.col(text).cast("string")))
