"""Base patterns against their plain reading; pairs, constants and masks."""

import hashlib
import random
import re

from tabtrust.llm import secrets

PLAIN = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base(text):
    found = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(PLAIN) for m in p.finditer(text or "") if ok(m)]
    return [(PLAIN[i][0], s, e) for s, i, e in sorted(found)]


def compare(rows, out):
    assert len(rows) == len(out)
    out = sorted(map(tuple, out), key=str)
    for (d, text), got in zip(sorted(rows, key=lambda r: str((r[0], *()))), sorted(out, key=lambda r: str((r[0], *()))), strict=True):
        want = base(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        counts = tuple(sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex"))
        assert got[:5] == (d, *counts, hashlib.sha256(joined.encode()).hexdigest())
        spans = [x for x in got[5].split(",") if x]
        assert [x for x in spans if not x.startswith("literal")] == [x for x in joined.split(",") if x]


def test_documents(tables):
    docs = tables("documents").select("doc_id", "text")
    compare([tuple(r) for r in docs.collect()], secrets.digest(docs).collect())


def test_random(spark):
    rng = random.Random(4)
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "-", "😀"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(30)))) for i in range(600)]
    compare(rows, secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_constants():
    text = 'k = "qX9vR2mL8pT4"\nclient_credential = k\ncolor = "blue7green9red"\n'
    found = secrets.spans(text)
    assert [(text[s:e], k) for s, e, k in found] == [("qX9vR2mL8pT4", "literal")]
    assert secrets.spans('title = "A quiet morning"\n') == []
    assert secrets.redacted("token=abcdef123456 rest") == "[assign] rest"


def test_typed_constants_and_entries():
    """Types between a name and its literal, and names and values of configuration entries."""
    found = lambda text: [text[a:b] for a, b, _ in secrets.literals(text)]
    assert found("auth_token: str = 'Ab1234567'") == ["Ab1234567"]
    assert found('const apiSecret: string = "zX98aa77";') == ["zX98aa77"]
    assert found('<add key="ClientSecretProd" value="Zx81kq99"/>') == ["Zx81kq99"]
    assert found("- name: DB_PASSWORD\n  value: s3cr3tval\n- name: COLOUR\n  value: blue42green") == ["s3cr3tval"]
    assert found("name: COLOUR\nsize: 12\nvalue: s3cr3tval") == found("kind: str = 'Ab1234567'") == found("value: s3cr3tval") == []


def test_odd_rows(spark):
    rows = [(None, "secret=abcdef"), (1, None), (2, ""), (3, "x = y + " * 20000), (4, "a" * 200000), (5, "token: 12345"), (5, "token: 123456")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, x long, Spans string")
    assert sorted(r["n_assign"] for r in secrets.digest(docs).collect()) == [0, 0, 0, 0, 0, 1, 1]
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == len(rows)
    assert secrets.digest(docs.where("false")).collect() == []


def test_values_of_many_literals():
    parts = [f"qX9vR2mL8p{i:02d}" for i in range(40)]
    joined = " + ".join(f'"{p}"' for p in parts)
    for text in (f"client_credential = {joined}\n", f"k = {joined}\nclient_credential = k\n", "".join(f'{"k" * (i + 1)} = "{p}"\n' for i, p in enumerate(parts)) + "client_credential = " + " + ".join("k" * (i + 1) for i in range(40))):
        assert [text[s:e] for s, e, _ in secrets.spans(text)] == parts
    grown = "".join(f'x = x + "qX9vR2mL{i:05d}"\n' for i in range(20_000)) + "credential = x\n"
    assert len(secrets.spans(grown.replace("x = x + ", "x = ", 1))) == 20_000


def test_long_literals():
    value = "qX9vR2mL8pT4" * 1000
    for text in (f'private_key_auth = "{value}"\n', f"credentials: '{value}'\n"):
        assert [(text[s:e], k) for s, e, k in secrets.spans(text)] == [(value, "literal")]
    assert secrets.spans('x = ' + '"\\' * 200_001 + "\n" + "y = '\\" + "\\\"" * 200_000) == []


def plain_literals(text):
    """Every assignment in turn, with all spans that a name stands for, and all names that each span has reached."""
    held, reached = {}, {}
    for name, parts in secrets.pairs(text):
        own = {(s, e) for _, s, e in parts if s >= 0}
        known = [held[w] for w, s, _ in parts if s < 0 and w in held]
        if own or known:
            held[name] = own.union(*known)
            for span in held[name]:
                reached.setdefault(span, set()).add(name)
    return sorted((s, e, "literal") for (s, e), names in reached.items() if secrets.score(names, text[s:e]) >= secrets.THRESHOLD)


def test_constants_against_plain_version():
    rng = random.Random(9)
    names = ["a", "b", "k", "title", "api_secret", "client_credential", "password_hash", "color", "jwt", "x.y"]
    found = 0
    for _ in range(400):
        lines = []
        for _ in range(rng.randint(1, 12)):
            parts = [rng.choice(names) if rng.random() < 0.5 else '"' + "".join(rng.choices("qX9vR2mL8pT4aB", k=rng.randint(3, 20))) + '"' for _ in range(rng.randint(1, 3))]
            lines.append(f"{rng.choice(names)} {rng.choice(['=', ':=', ':'])} {' + '.join(parts)}")
        text = rng.choice(["\n", ";\n"]).join(lines)
        got = secrets.literals(text)
        assert got == plain_literals(text), text
        found += len(got)
    assert found > 300


def test_many_lines_are_linear():
    import time

    began = time.process_time()
    assert len(secrets.spans("".join(f"client_credential = qX9vR2mL{i:06d}\n" for i in range(160_000)))) == 160_000
    assert time.process_time() - began < 30
