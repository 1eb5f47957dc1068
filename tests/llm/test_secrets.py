import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestock.llm.secrets import ACCESS, ASSIGN, HEX, base62_crc32, bech32_holds, find_secrets, redact, redacted, scan_secrets

PAYLOAD = "abcdefghijABCDEFGHIJ0123456789"
GOOD = PAYLOAD + base62_crc32(PAYLOAD)
BAD = PAYLOAD + "000000"


def brute(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


PIECES = ["password", "PassWd", "secret", "TOKEN", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abcdef", "x", "AKIA", "akia", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "İ", "ſ", "K", "日", "\n", ".", "-"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_base_is_a_scan_of_the_whole_text(text):
    assert [s for s in find_secrets(text) if s[0] in ("assign", "access", "hex")] == brute(text)


def test_checksums_decide():
    text = f"a ghp_{GOOD} b ghp_{BAD} c npm_{GOOD} ghp_{GOOD}9"
    assert [s[0] for s in find_secrets(text)] == ["github", "npm"]
    key = "AGE-SECRET-KEY-1QQPQQQSQQZQQRQQYQQ9QQXQQ8QQGQQFQQ2QQTQQVQQDQQWQQ0QQSQQ3QQ"
    data = key[16:]
    alphabet = "QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"
    assert not bech32_holds("age-secret-key-", data)
    # a valid string from BIP-173: only the checksum routine is at test here
    assert bech32_holds("a", "2uel5l".upper()) and set(data) <= set(alphabet)


def test_rows_and_cases(spark):
    rows = [(1, "my password=hunter22 ok"), (2, None), (3, ""), (None, "AKIA" + "A" * 16), (1, "my password=hunter22 ok"), (4, "ab " * 50_000 + "f" * 24)]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, spans string, n_chars long")
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.spans]) for r in scan_secrets(docs).collect())
    assert got == sorted((i or 0, brute(t or "")) for i, t in rows)
    out = {r.doc_id: r for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns and out[1].text == "my [SECRET] ok" and out[1].n_chars == 14
    assert out[2].text is None and out[2].n_chars == 5 and out[3].text == "" and out[None].text == "[SECRET]"
    assert scan_secrets(docs.limit(0)).count() == 0
    assert redacted("secret=token=abcdef0123456789abcdef0123") == "[SECRET]"
    assert not find_secrets(redacted(f"x ghp_{GOOD} password: abcdefgh"))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and re.fullmatch("[0-9A-Za-z]{6}", GOOD[-6:])


def test_redacting_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "my password=hunter22 ok", "a", "b", 23), (2, "plain", "c", "d", 5)], "doc_id long, text string, _chars string, __chars string, n_chars long")
    assert sorted(map(tuple, redact(docs).collect())) == [(1, "my [SECRET] ok", "a", "b", 14), (2, "plain", "c", "d", 5)]
