import hashlib
import random
import re

from rfmspark.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for r, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            n = sum(c.isdigit() for c in m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= n <= 19 and luhn(m[0])) \
                    or kind == "phone" and not 9 <= n <= 15:
                continue
            out.append((m.start(), r, kind, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "x@y", "1.2.3.4", "256.1.2.3.4", "0000001.2.3.255", "4111 1111 1111 1111", "4532-0151-1283-0366", "12345678901234567890123",
              "+1 (555) 555-3296", "+", "+12", " ", "-", ".", "é", "😀", "9", "0", "_", "%", "a", "@", "(", ")", "4524132264652876", "password=f8cb0ab732d29a210e"]
    texts = [None, "", "a" * 3000 + "@", "1." * 2000, "4" * 5000, "x@a" + ".b" * 3000, "a@b.c_x@d.e", "a@b.c@d.e"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    rows = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        spans = brute(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        r = rows[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t, joined, r["spans"])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[2] == k for x in spans) for k in PLAIN]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_weak_supervision_adds_secrets_and_redacts(spark):
    word = "Plain words come here and there, nothing more. "
    texts = [word + f"password={hashlib.md5(str(i).encode()).hexdigest()} " + word for i in range(40)]
    texts += [word + f"chapter{i} of volume{i}x " + word for i in range(40)] + [word] * 5
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], "doc_id long, text string, kind string, maybe string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert all("secret:" in got[i] for i in range(40)) and not any(got[i] for i in range(40, 85))
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[0] == word + "password=[SECRET] " + word and red[80] == word


def test_reliabilities_favour_the_agreeing_labelers():
    post, rates = pii.reliabilities({"111": 50, "000": 200, "110": 5, "001": 20})
    assert post["111"] > 0.9 > 0.1 > post["000"] and rates[0][0] > 0.8 and rates[2][1] < rates[2][0]


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
