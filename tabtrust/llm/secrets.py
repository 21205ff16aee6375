"""Secret scans by assignment-aware lexing.

Three patterns find the plain cases. Beside them a lexer reads a text as source code or configuration: names, quoted
or bare literals, and the operators between them, giving (name, literal) pairs. Constants are propagated: a name that
was given a literal stands for it where it is assigned to another name (also through `+`), so that
`k = "..."; api_secret = k` marks the literal of k. A literal is scored by the most sensitive name it reaches, its
length and its variety of characters; literals above the threshold are spans of kind `literal`.

Defined results: a null text is empty and has no spans; offsets count code points. A document is scanned whole;
time and memory are linear in its length. Extra columns are not read (`redact` keeps them as they are).
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrust.llm.scratch import light, quoted, trimmed

#: The three base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # maximal runs, so those of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: How strongly parts of a target name speak for a secret.
NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "private": 0.5, "access": 0.4, "key": 0.5, "api": 0.4, "client": 0.2, "session": 0.4, "cookie": 0.4,
    "signature": 0.5, "signing": 0.5, "encryption": 0.5, "salt": 0.5, "jwt": 0.8, "pin": 0.5, "cert": 0.3, "webhook": 0.4, "dsn": 0.4,
}
THRESHOLD = 1.0
LEX = re.compile(
    r"""(?P<line>\n|;|\#[^\n]*|//[^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*(?:\[["'][A-Za-z0-9_.-]+["']\])?)|(?P<op>:=|=>|==|!=|<=|>=|[=:])|(?P<plus>\+|\.\.)|(?P<space>[ \t\r]+)|(?P<other>.)"""
)
BARE = re.compile(r"[^\s,;#\"'<>(){}\[\]]+")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """Sum of the weights of the name's parts, split at case and punctuation."""
    parts = [p.lower() for p in PART.findall(name)]
    whole = sum(NAMES.get("".join(pair), 0.0) for pair in zip(parts, parts[1:], strict=False))
    return whole + sum(NAMES.get(p, 0.0) for p in parts)


def variety(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def score(names: set[str], value: str) -> float:
    """Most sensitive name, times what the literal's form allows: at least 6 characters, no white space, not a placeholder."""
    if len(value) < 6 or any(c.isspace() for c in value) or len(set(value)) < 4 or value.startswith(("${", "{{", "<", "%(")):
        return 0.0
    return max(map(sensitivity, names), default=0.0) * min(1.5, 0.5 + variety(value) / 4 + (0.25 if any(c.isdigit() for c in value) else 0.0))


#: A line can only hold a pair if an operator of assignment stands in it after a name.
PAIR = re.compile(r"""[A-Za-z0-9_\]"'][ \t]*(?::=|=>|[=:])(?!=)[ \t]*\S""")


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(target name, parts of its value); a part is (text, start, end), a name where start is -1.

    The value of an entry of configuration (`name: X` and `value: Y`, or `key="X" value="Y"`) goes to the name X.
    """
    entry = ""
    for name, parts in _lines(text):
        word = name.lower()
        if word == "value" and entry:
            yield entry, parts
        yield name, parts
        entry = parts[0][0] if word in ("name", "key") and len(parts) == 1 else ""


def _lines(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    at = 0
    while m := PAIR.search(text, at):
        start = max(text.rfind("\n", at, m.start()), text.rfind(";", at, m.start()), at - 1) + 1
        stop = text.find("\n", m.start())
        stop = len(text) if stop < 0 else stop
        yield from _line(text, start, stop)
        at = max(stop, m.end() if stop <= m.start() else stop)


def _line(text: str, at: int, stop: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    name, target, value, joined, unclosed, last = "", "", [], False, "", ""
    while at < stop:
        if text[at] in unclosed:
            at += 1
            continue
        m = LEX.match(text, at, stop)
        kind, word, end = m.lastgroup, m.group(), m.end()
        if kind == "op" and word in (":=", "=", ":", "=>") and name and not (target and value and not joined and word == ":"):
            if target and value:
                yield target, value
            # after a colon a name may be the type of a typed constant, whose literal follows
            typed = word == "=" and last == ":" and len(value) == 1 and value[0][1] < 0
            target, value, joined, name, last = max(target if typed else "", name, key=sensitivity) or name, [], True, "", word
            bare = BARE.match(text, m := _skip(text, end, stop), stop)
            if bare and (literal := bare.group().rstrip(".")) and text[m] not in "\"'" and not literal.startswith((":", "=")) and (any(c.isdigit() for c in literal) or not re.fullmatch(r"[A-Za-z_][\w.]*", literal)) and "=" not in literal.rstrip("="):
                value, joined, end = [(literal, m, m + len(literal))], False, m + len(literal)
        elif kind == "string":
            if target and joined:
                value.append((word[1:-1], at + 1, end - 1))
                joined = False
            else:
                if target and value:
                    yield target, value
                    target, value = "", []
                name = word[1:-1]
        elif kind == "name":
            if target and joined:
                value.append((word, -1, -1))
                joined, name = False, word
            else:
                if target and value:
                    yield target, value
                    target, value = "", []
                name = word
        elif kind == "other" and word in "\"'":
            # no later one of the line closes either, as this search ran over all of them as escaped ones
            unclosed += word
        elif kind == "plus":
            joined = bool(target and value)
        elif kind == "line" or (kind == "other" and word in ",)}{(&|"):
            if target and value:
                yield target, value
            name, target, value, joined = "", "", [], False
        at = end
    if target and value:
        yield target, value


def _skip(text: str, at: int, stop: int) -> int:
    while at < stop and text[at] in " \t":
        at += 1
    return at


def literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Spans of literals whose score reaches the threshold."""
    # a value is a node of its own literals and the nodes of the constants in it; nodes are shared, so all are linear in the text
    nodes: list[tuple[list[tuple[int, int]], list[int]]] = []
    best: list[str] = []
    values: dict[str, int] = {}
    for name, parts in pairs(text):
        own = [(s, e) for w, s, e in parts if s >= 0]
        used = [values[w] for w, s, _ in parts if s < 0 and w in values]
        if own or used:
            values[name] = len(nodes)
            nodes.append((own, used))
            best.append(name)
    # names reach what their value is made of: later nodes hold earlier ones only
    weight = [sensitivity(n) for n in best]
    reached: dict[tuple[int, int], tuple[float, str]] = {}
    for i in range(len(nodes) - 1, -1, -1):
        own, used = nodes[i]
        for k in used:
            if weight[i] > weight[k]:
                weight[k], best[k] = weight[i], best[i]
        for span in own:
            reached[span] = max(reached.get(span, (-1.0, "")), (weight[i], best[i]))
    return sorted((s, e, "literal") for (s, e), (_, name) in reached.items() if score({name}, text[s:e]) >= threshold)


def base(text: str) -> list[tuple[int, int, str]]:
    """Matches of the three patterns, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    return sorted(base(text) + literals(text, threshold), key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])


@F.pandas_udf(T.ArrayType(SPAN))
def scan(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": s, "end": e, "kind": k} for s, e, k in spans(t or "")])


def redacted(text: str, mask: str = "[{}]") -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of its first."""
    out, at = [], 0
    for s, e, k in spans(text):
        if s >= at:
            out += [text[at:s], mask.format("literal" if k == "literal" else k)]
        at = max(at, e)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
@trimmed
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else redacted(t))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in their text replaced by [kind]; all rows and other columns stay."""
    return light(docs).withColumn(text_col, _redact(quoted(text_col)))


DIGEST = T.StructType([T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


@F.pandas_udf(DIGEST)
@trimmed
def _digest(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = spans(text or "")
        own = [x for x in found if x[2] != "literal"]
        count = Counter(k for _, _, k in own)
        rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(found)))
    return pd.DataFrame(rows, columns=DIGEST.names)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans as kind:start:end."""
    found: Column = _digest(quoted(text_col))
    return light(docs).select(quoted(id_col).alias("doc_id"), found.alias("x")).select("doc_id", "x.*")
