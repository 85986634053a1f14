"""Secret scan by assignment-aware lexing.

Three plain patterns give the base spans. Beside them each text is lexed as source or configuration: name-literal
pairs (``name = "..."``, ``"name": "..."``, ``name => value``, ``name := value``, ``<name>value</name>``, ``--name value``,
YAML blocks), values joined of several parts, and references (``NAME``, ``$NAME``, ``${NAME}``). All definitions of a text
are collected first. A name is as sensitive as its own words or as any name that takes its value, directly or through
others, so definitions may follow their use; every name is settled once, the most sensitive first, and
no value is copied, so time and memory stay linear however often a constant is used. A joined value is scored as one
and marks every fragment that it is built from (resolved up to ``JOINED`` characters; beyond that its parts are scored
alone). Literals that reach ``MIN_SCORE`` and that no base span covers are added as ``literal`` spans.

Offsets are code points, end exclusive. Null and empty texts have no spans; bytes that are no UTF-8 count as one
replacement character each run, as Python decodes them; repeated rows give repeated rows; an empty table gives no rows;
only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_texts

#: Kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Sensitivity of the words of a name; pairs of neighbouring words count as one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "api key": 1.0, "private key": 1.0, "access key": 1.0, "signing key": 0.9, "encryption key": 0.9, "auth key": 0.9,
    "secret key": 1.0, "auth": 0.6, "bearer": 0.8, "pass": 0.7, "pat": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|change_?me|example.*|your[_-].*|none|null|true|false|todo|dummy|test|secret|password|token)$")
MIN_SCORE = 0.5
MIN_LITERAL = 6
REDACTED = "[secret]"

JOINED = 512
PHRASES = ("passphrase", "mnemonic", "seed")  # names whose value may be several words

_QUOTED = r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'"""
_ASSIGNED = re.compile(
    rf"""(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]++)(?:\[?["']\]?)?[ \t]*(?::=|=>|[:=])[ \t]*"""
    rf"""(?P<value>(?:{_QUOTED}|\$\{{\w++\}}|[A-Za-z0-9_./+$][A-Za-z0-9_./+=-]*)(?:[ \t]*(?:(?:\+|\.(?=[ \t]))[ \t]*(?:{_QUOTED}|\$\{{\w++\}}|[A-Za-z_$][A-Za-z0-9_.]*)|[ \t](?:{_QUOTED})))*)"""
)
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)>(?P<value>[^<\n]++)</(?P=name)>")
_FLAG = re.compile(rf"""(?<!\S)--?(?P<name>[A-Za-z][A-Za-z0-9_-]*+)[ \t]++(?P<value>{_QUOTED}|[^\s"'-][^\s"']*+)""")
_BLOCK = re.compile(r"(?m)^[ \t]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+):[ \t]*+[|>][+-]?[ \t]*+\n(?P<value>(?:[ \t]++\S[^\n]*+(?:\n|\Z))+)")
_PART = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|(?:\$\{(\w++)\})|([^\s"'+][^\s"']*?)(?=[ \t]*(?:\+[ \t]|\.[ \t]|["']|$))""")
_REFERENCE = re.compile(r"\$?([A-Za-z_][A-Za-z0-9_.]*)")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """The highest sensitivity among the words of a name and pairs of neighbouring words."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    return max([SENSITIVE.get(w, 0.0) for w in [*words, *map(" ".join, zip(words, words[1:]))]], default=0.0)


def literal_score(value: str, phrase: bool = False) -> float:
    """0 to 1: long, varied and mixed literals score high, placeholders and prose score 0; ``phrase`` allows words."""
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value):
        return 0.0
    if " " in value.strip():
        words = value.split()
        return 0.6 if phrase and len(words) >= 3 and len(set(words)) == len(words) else 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(t(c) for c in value) for t in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    return min(1.0, 0.4 + 0.1 * bits + 0.1 * (classes - 1)) if bits >= 1.5 else 0.2


class Assignment:
    """A name and the parts of its value: literal spans (start, end) and, as strings, names that it may refer to."""

    __slots__ = ("name", "parts")

    def __init__(self, name: str, parts: list[tuple[int, int] | str]):
        self.name, self.parts = name, parts


def lexed(text: str) -> list[Assignment]:
    """Every assignment of a text; a bare word counts as a reference if the text defines its name."""
    found: list[tuple[str, list[tuple[int, int, bool]]]] = []
    for pattern in (_ASSIGNED, _FLAG):
        if pattern is _FLAG and "--" not in text and " -" not in text:
            continue
        for m in pattern.finditer(text):
            base, spans = m.start("value"), []
            for part in _PART.finditer(m["value"]):
                group = part.lastindex
                if part.end(group) > part.start(group):
                    spans.append((base + part.start(group), base + part.end(group), group > 2))
            if spans:
                found.append((m["name"], spans))
    if "</" in text:
        found += [(m["name"], [(m.start("value"), m.end("value"), False)]) for m in _ELEMENT.finditer(text)]
    if "|\n" in text or ">\n" in text or "|" in text:
        for m in _BLOCK.finditer(text):
            spans, at = [], m.start("value")
            for line in m["value"].split("\n"):
                if line.strip():
                    start = at + len(line) - len(line.lstrip())
                    spans.append((start, start + len(line.strip()), False))
                at += len(line) + 1
            found.append((m["name"], spans))
    names = {name for name, _ in found}

    def part(start: int, end: int, bare: bool) -> tuple[int, int] | str:
        m = _REFERENCE.fullmatch(text, start, end) if bare else None
        return m[1] if m and m[1] in names else (start, end)

    return [Assignment(name, [part(*s) for s in spans]) for name, spans in found]


def _spread(best: dict[str, float], uses: dict[str, set[str]]) -> dict[str, float]:
    """The highest score that reaches each name: from its own, along ``uses``. Every name is settled once."""
    settled: dict[str, float] = {}
    for start in sorted(best, key=best.get, reverse=True):
        waiting = [start]
        while waiting:
            name = waiting.pop()
            if name not in settled:
                settled[name] = best[start]
                waiting.extend(uses.get(name, ()))
    return settled


def literals(text: str) -> dict[tuple[int, int], float]:
    """The score of each literal span under a sensitive name."""
    found = lexed(text)
    uses: dict[str, set[str]] = {}
    of: dict[str, list[Assignment]] = {}
    for a in found:
        of.setdefault(a.name, []).append(a)
        uses.setdefault(a.name, set()).update(p for p in a.parts if isinstance(p, str))
    own = {name: score for name in of if (score := name_score(name)) > 0}
    if not own:
        return {}
    named = _spread(own, uses)
    phrase = _spread({n: 1.0 for n in own if any(p in n.lower() for p in PHRASES)}, uses)
    values: dict[str, str | None] = {}  # of a name's first definition; None: under way, too long or cyclic

    def joined(a: Assignment) -> str | None:
        out, size = [], 0
        for p in a.parts:
            piece = values.get(p) if isinstance(p, str) else text[p[0] : p[1]]
            size += len(piece or "")
            if piece is None or size > JOINED:
                return None
            out.append(piece)
        return "".join(out)

    for start in named:  # definitions before their users, without recursion
        waiting = [start]
        while waiting:
            name = waiting[-1]
            if name not in values:
                values[name] = None
                waiting += [p for p in uses.get(name, ()) if p in of and p not in values]
            else:
                waiting.pop()
                if values[name] is None:
                    values[name] = joined(of[name][0])
    scores: dict[tuple[int, int], float] = {}
    whole: dict[str, float] = {}  # best score of a joined value that a name is part of
    for a in found:
        if (sensitive := named.get(a.name, 0.0)) > 0:
            value = joined(a) if len(a.parts) > 1 else None
            together = sensitive * literal_score(value, a.name in phrase) if value else 0.0
            for p in a.parts:
                if isinstance(p, str):
                    whole[p] = max(whole.get(p, 0.0), together)
                else:
                    scores[p] = max(scores.get(p, 0.0), together, sensitive * literal_score(text[p[0] : p[1]], a.name in phrase))
    for name, score in _spread({n: s for n, s in whole.items() if s > 0}, uses).items():
        for a in of.get(name, ()):
            for p in a.parts:
                if not isinstance(p, str):
                    scores[p] = max(scores.get(p, 0.0), score)
    return scores


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three plain patterns."""
    spans = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the literals that the lexer adds."""
    if not any(c in text for c in "=:<-"):
        return base
    starts, ends = [a for a, _, _ in base], list(accumulate([b for _, _, b in base], max))

    def covered(start: int, end: int) -> bool:
        before = bisect_right(starts, start)
        return before > 0 and ends[before - 1] >= end

    added = [(start, 3, end) for (start, end), score in literals(text).items() if score >= MIN_SCORE and not covered(start, end)]
    return sorted([*base, *added])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def _found(raw: bytes) -> tuple[int, int, int, str, str]:
    text = raw.decode("utf-8", "replace")
    base = base_spans(text)
    count = Counter(k for _, k, _ in base)
    return count[0], count[1], count[2], hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(text, base))


def _redacted(raw: bytes) -> tuple[str, int]:
    text = raw.decode("utf-8", "replace")
    out, at = [], 0
    for start, _, end in all_spans(text, base_spans(text)):
        if end > at:
            out += [text[at:start], REDACTED] if start >= at else []
            at = end
    clean = "".join(out) + text[at:] if out else text
    return clean, len(clean)


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, counts of the base kinds, the base spans' digest and all spans."""
    fields = [("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    return map_texts(df, [id_col], lambda: _found, fields, text)


def redact(df: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``df`` with every span replaced by a mark (overlapping spans by one); a null text stays
    null. ``length`` names a column that holds the number of code points, to be renewed."""
    rest = [c for c in df.columns if c not in (text, length)]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("")).alias("rest"), F.col(text).isNull().alias("none"), F.col(text).alias("given"))
    made = map_texts(packed, ["rest", "none"], lambda: _redacted, [("clean", "string"), ("size", "bigint")], "given")
    new = {text: F.when(~F.col("none"), F.col("clean")), length: F.when(~F.col("none"), F.col("size"))}
    return made.select(*[new[c].alias(c) if c in new else F.col("rest")[c].alias(c) for c in df.columns])
