import hashlib
import random
import re

from helpers import ODD, docs

from foliospark.llm.pii import base_spans, find_pii, find_spans, luhn, mod97, pii_digest


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_against_the_plain_expressions():
    r = random.Random(5)
    for _ in range(20_000):
        text = "".join(r.choice("a1.@@.-+ 9(2)%é4") for _ in range(r.randint(0, 40)))
        assert base_spans(text) == brute(text), text


def test_digest(spark):
    rows = ODD + [(50, "mail a.b@c.de, call +1 (626) 555-5759 from 10.0.0.1 or 999.1.1.1; card 4785380592391139 and 4785380592391138")]
    got = {(r["doc_id"], r["spans"]): r for r in pii_digest(find_pii(docs(spark, rows))).collect()}
    assert sum(1 for _ in got) <= len(rows)
    r = next(v for v in got.values() if v["doc_id"] == 50)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(rows[-1][1]))
    assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"] == line
    clean = next(v for v in got.values() if v["doc_id"] == 2)
    assert clean["spans"] == "" and clean["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii_digest(find_pii(docs(spark, []))).collect() == []


def test_checks_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89370400440532013000") and not mod97("DE89370400440532013001")
    kinds = lambda t: [(s["kind"], s["value"]) for s in find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("ssn 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == []
    assert kinds("call (626) 555-5759 now") == [("phone", "(626) 555-5759")] and kinds("sum (626) 555-5759 now") == []


def test_account_numbers_before_other_words():
    found = lambda t: [s["value"] for s in find_spans(t) if s["kind"] == "iban"]
    for number in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for after in ("", " BIC COBADEFF", " EUR 50", " 12 times", " A B C D E F G H I J K L M N O P", " is mine"):
            assert found(f"pay {number}{after}") == [number], (number, after)
        assert found(f"AB12 REF {number} BIC COBADEFF and {number}") == [number] * 2
    assert found("DE89 3704 0044 0532 0130 01 BIC COBADEFF") == []


def test_long_runs_take_linear_time():
    assert find_spans("a" * 300_000 + "@") == [] and find_spans("1" * 300_000) == [] and find_spans("1." * 100_000) != [1]


def test_many_spans_take_linear_time():
    import time

    one = "call 030 1234567 or 040 7654321, mail a@b.de, "
    seconds = []
    for n in (2_000, 16_000):
        began = time.perf_counter()
        assert len(find_spans(one * n)) == 3 * n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 24 * seconds[0]
