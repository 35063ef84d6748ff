import hashlib
import random
import re
import time

import corpus_cases
import pyarrow as pa
from gridsight.llm import secret_scan as ss

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(spans)]


def some_texts(n):
    pick = random.Random(4)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "'", '"', " ", ":", "=", "=",
             "abcdefgh", "x1", "AKIA", "AKIAABCDEFGH1234567", "0" * 31, "a" * 32, "deadbeef" * 5, "é", "中", "\n",
             "ſecret", "toKen=", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(n)]


def test_queries_of_patterns():
    assert ss.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert ss.trigram_query("[0-9a-f]+") is True
    assert ss.trigram_query("ab(c|d)e") == ("or", (("and", ("abc", "bce")), ("and", ("abd", "bde"))))
    assert ss.trigram_query("x?abc") == "abc" or "abc" in ss.trigrams_of(ss.trigram_query("x?abc"))
    assert ss.trigram_query("(abc)*") is True
    assert ss.trigram_query("abc|.") is True
    assign = ss.trigrams_of(ss.trigram_query(ss.BASE_RULES[0].pattern))
    assert {"pas", "ord", "sec", "oke", "api", "i_k", "pik"} <= assign


def test_no_match_lacks_its_trigrams():
    for rule in ss.RULES:
        wanted = ss.trigram_query(rule.pattern)
        pattern = re.compile(rule.pattern, re.A | (re.I if rule.any_case else 0))

        def holds(q, text):
            if q is True or isinstance(q, str):
                return q is True or q in text
            return (all if q[0] == "and" else any)(holds(x, text) for x in q[1])

        for text in some_texts(400):
            if pattern.search(text):
                folded = "".join(c.lower() if c.isascii() else c for c in text)
                assert holds(wanted, folded)


def test_postings_match_plain_search():
    texts = [t or "" for t in [*some_texts(300), "", "AK", "IA", "éab", "x" * 5 + "AKI", "", "A"]]
    wanted = {"aki", "kia", "sec", "pas", "é中", "éab", "éac", "-be"}
    for size in (7, ss.SLICE):
        ss.SLICE, before = size, ss.SLICE
        index = ss.Trigrams({t for t in wanted if len(t) == 3}).postings(pa.array(texts[:1] + texts)[1:])
        ss.SLICE = before
        for t, bits in index.items():
            plain = [t in "".join(c.lower() if c.isascii() else c for c in x) for x in texts]
            # Beyond ASCII a posting may hold more texts, never fewer.
            assert all(b >= p for b, p in zip(bits.to_pylist(), plain))
            assert not t.isascii() or bits.to_pylist() == plain
    assert ss.Trigrams(set()).postings(pa.array(["abc"])) == {}


def test_jwt_spans_and_time():
    rule = next(r for r in ss.RULES if r.kind == "jwt")
    plain = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")

    def spans(pattern, group, text):
        return [m.span() for m in pattern.finditer(text) if m[group] is not None and len(m[group]) >= rule.least]

    pick = random.Random(9)
    parts = ["eyJ", "eyJ", ".", ".eyJ", "a" * 9, "_-", " ", "\n", "é"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 20)))
        assert spans(ss.compiled(rule), 1, text) == spans(plain, 0, text)
    start = time.monotonic()
    assert spans(ss.compiled(rule), 1, "eyJ" * 350_000 + " .eyJa") == []
    assert spans(ss.compiled(rule), 1, "eyJa.eyJ" * 130_000 + " ") == []
    assert time.monotonic() - start < 5


def test_spans_match_brute_force(spark, sf_dir):
    texts = [*some_texts(1500), None, "", corpus_cases.LONG]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = corpus_cases.plain(spark, list(enumerate(texts)))
    for r in ss.find_secrets(docs, ss.BASE_RULES).collect():
        assert [tuple(s) for s in r.spans] == brute(texts[r.doc_id])


def test_added_rules_keep_base_spans(spark):
    texts = some_texts(600)
    docs = corpus_cases.plain(spark, list(enumerate(texts)))
    added = 0
    for r in ss.find_secrets(docs).collect():
        base = [tuple(s) for s in r.spans if s.kind in ("assign", "access", "hex")]
        assert base == brute(texts[r.doc_id])
        added += len(r.spans) - len(base)
    assert added > 20


def test_query_columns(spark, tmp_path):
    path = corpus_cases.folder(spark, str(tmp_path / "t"))
    rows = {r.doc_id: r for r in ss.op1_secret_scan(spark, path).collect()}
    for doc_id, text in {r[0]: r[1] for r in corpus_cases.ROWS}.items():
        base = brute(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        row = rows[doc_id]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and row.spans == joined
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(
            sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))


def test_redaction(spark):
    key = corpus_cases.KEY
    docs = corpus_cases.plain(spark, [
        (1, f'é token = "{key}" 中 AKIAABCDEFGH1234567!'), (2, "clean"), (3, None), (4, ""), (5, key)])
    rows = {r.doc_id: r.text for r in ss.redact(docs).collect()}
    # The hex run lies inside the assignment.
    assert rows == {1: 'é [assign]" 中 [access]!', 2: "clean", 3: None, 4: "", 5: "[hex]"}
    awkward = ss.redact(corpus_cases.rows(spark))
    assert awkward.columns == corpus_cases.rows(spark).columns and awkward.count() == 12


def test_private_keys_are_cut_out_whole(spark):
    body = "\n".join(["MIIEowIBAAKCAQEA" + c * 48 for c in "abcd"] + ["Xw=="])
    mark = "-----{} RSA PRIVATE KEY-----"
    begin, end = mark.format("BEGIN"), mark.format("END")
    pgp = f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2\n\n{body}\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----"
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    quoted = "".join(f'"{line}\\n" +\n' for line in body.split("\n"))
    texts = {
        f"a\n{begin}\n{body}\n{end}\nb": "a\n[private_key]\nb",
        f"a\r\n{begin}\n{fields}{body}\n{end}\nb": "a\r\n[private_key]\nb",
        f"a {pgp} b": "a [private_key] b",
        f'{{"key": "{begin}\\n{body}\\n{end}\\n"}}': '{"key": "[private_key]\\n"}',
        # Without an END marker the key-like lines go; the text after them stays.
        f"a\n{begin}\n{body}\n\nThis text stays.": "a\n[private_key]\n\nThis text stays.",
        f"a\n{begin}\n{fields}{body}": "a\n[private_key]",
        f"{begin}\n> {body[:40]}\n> {body[:30]}": "[private_key]",
        f"{begin}\nMIIE": "[private_key]",
        f'k = "{begin}\\n" +\n{quoted}"x y"': 'k = "[private_key]\\n" +\n"x y"',
        f"{begin}\n{body}\n\nb\n{begin}\n{body}\n{end}": "[private_key]\n\nb\n[private_key]",
        f"{begin} opens such a file.\nNote: it is text": "[private_key] opens such a file.\nNote: it is text",
        "-----BEGIN PUBLIC KEY-----\nx\n-----END PUBLIC KEY-----":
            "-----BEGIN PUBLIC KEY-----\nx\n-----END PUBLIC KEY-----",
    }
    docs = corpus_cases.plain(spark, list(enumerate(texts)))
    rows = {r.doc_id: r.text for r in ss.redact(docs).collect()}
    assert rows == dict(enumerate(texts.values()))


def test_many_markers_are_read_once():
    [rule] = [r for r in ss.ADDED_RULES if r.kind == "private_key"]
    text = ("-----BEGIN PRIVATE KEY-----\n" + "word " * 20) * 20_000 + "-" * 100_000
    assert len(ss.compiled(rule).findall(text)) == 20_000
