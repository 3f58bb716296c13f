import hashlib
import random
import re

import pytest

from corrente.llm import secrets

PATTERNS = {
    "assign": re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
MORE = {r[0]: (re.compile(r[1]), r[2]) for r in secrets.RULES[secrets.BASE :]}


def base(text):
    found = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            n = len(m.group(2)) if kind == "assign" else m.end() - m.start()
            if n >= (8, 16, 32)[k]:
                found.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def text_of(rng):
    bits = ["password", "PassWd", "api_key", "apikey", "API_KEY", "token", "secret", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "日本", "\n", "x", "_", "ghp_", "a1B2c3D4e5F6g7H8i9J0" * 2, "sk_live_", "xoxb-", "AIza", "eyJ", ".", "-----BEGIN ", "RSA PRIVATE KEY-----", "passpassword", "value1234+/="]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))


def test_spans_are_those_of_regular_expressions():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [text_of(rng) for _ in range(3000)] + [None, "", "password=" + "a" * 200_000, "f" * 100_000, "\n" * 5000, "tokentoken: abcdefgh", "password = 'a' token=12345678"]
    found = dict(secrets.find(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        got = [(secrets.RULES[k][0], a, b) for a, b, k in found.get(i, [])]
        assert [x for x in got if x[0] in PATTERNS] == base(t), repr(t)
        for kind, (p, least) in MORE.items():
            assert [x[1:] for x in got if x[0] == kind] == [m.span() for m in p.finditer(t or "") if m.end() - m.start() >= least], (kind, t)


@pytest.mark.parametrize("pattern", ["a(b|cd)*e?", "[a-c]{2,4}d", "(ab|a)(c|bcd)", "x+y?z{3}", "a{0,2}b"])
def test_automata_agree_with_the_library(pattern):
    """Longest match from the start, and all starts of matches, over all strings of a small alphabet."""
    import itertools

    dfa, back = secrets.Dfa([pattern], search=False), secrets.Dfa([pattern], search=True, backward=True)
    p = re.compile(pattern)
    for s in map("".join, itertools.chain.from_iterable(itertools.product("abcdexyz", repeat=n) for n in range(5))):
        longest = max((n for n in range(1, len(s) + 1) if p.fullmatch(s[:n])), default=0)
        assert dfa.longest(s.encode(), 0) == longest, s
        starts = [i for i in range(len(s)) if any(p.fullmatch(s[i:j]) for j in range(i + 1, len(s) + 1))]
        assert [i for i, _ in back.starts(s.encode())] == starts, s


def test_automaton_is_minimal():
    dfa = secrets.Dfa(["(a|b)*abb"], search=False)
    assert dfa.n_states == 5  # four, and the dead one for all other bytes


def test_time_is_linear_in_lines_that_nearly_match():
    import time

    import pyarrow as pa

    def seconds(n):
        lines = ["eyJ" * n + ".a", "eyJa." * n, "xoxb-" * n, "password" * n, "secret" + " " * n, "-----BEGIN " * n, "AIza" * n, "ghp_" * n]
        t = time.perf_counter()
        secrets.find(pa.array(lines))
        return time.perf_counter() - t

    seconds(10)
    a, b = min(seconds(20_000) for _ in range(2)), seconds(160_000)
    assert b < 20 * a, (a, b)  # 8 times the text


def test_own_columns_stay(docs):
    out = secrets.scan_secrets(docs, keep=("doc_id", "a.b", "digest"))
    assert out.columns[:3] == ["doc_id", "a.b", "digest"] and out.count() == docs.count()


def test_report(spark, docs, texts, none):
    key = "AKIA" + "Q7" * 8
    rows = [(1, f"é {key} and api_key: 'abcdefgh1'"), (1, f"é {key} and api_key: 'abcdefgh1'"), (None, None), (3, "")]
    out = secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    whole = ",".join(f"{k}:{a}:{b}" for k, a, b in base(rows[0][1]))
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in out) == sorted([(1, 1, 1, 0, digest(whole), whole)] * 2 + [(0, 0, 0, 0, digest(""), ""), (3, 0, 0, 0, digest(""), "")])
    assert secrets.report(docs).count() == len(texts)
    assert secrets.report(none).count() == 0


def test_all_documents_against_regular_expressions(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in secrets.report(frame).collect()}
    for r in frame.select("doc_id", "text").collect():
        assert out[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(r.text)).encode()).hexdigest()
