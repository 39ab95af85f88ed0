import hashlib
import re

from quillon.llm import weak_pii
from tests.llm.frames import listed, no_documents, odd_documents

TEXTS = [
    "", None, "a@b.com_z@w.org x%y@z.q a@b a.b@c.d.e. @x.y", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0255.1 1.2.3.255 1.2.3.256 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 2 4012888888881881 0000000000000000 12345678901234567890",
    "+1 (743) 555-3824 +49 30 123456 +12 +1      + 5555555555 +123456789012345678 +1+2 345 678 901.",
    "Dear Mr John Smith, call 212-555-0187 at 12 Baker Street now. SSN 123-45-6789", "é ü +44 20 7946 0958 ß x@y.de 🙂 q@r.st",
    "IBAN DE89 3704 0044 0532 0130 00 version 555-12-9999", "5" * 3000 + " " + "a" * 3000 + "@ " + "1-" * 3000, "a.b" * 3000,
    "1.1.1.1" * 300, "contact: Mrs Anna Meyer, phone 415-555-2671, release 123-45-6789 build 900-11-0000",
]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        if 12 <= len(number) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    base = ",".join(f"{weak_pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))
    return [sum(k == i for _, k, _ in out) for i in range(4)], base


def check(docs):
    rows = {}
    for r in docs.collect():
        counts, base = brute(r.text)
        rows.setdefault(str(r.doc_id), set()).add((*counts, hashlib.sha256(base.encode()).hexdigest()))
    out = weak_pii.detect(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) in rows[str(r.doc_id)]
    return out


def test_base_spans_against_another_engine(spark):
    frame = spark.createDataFrame([*enumerate(TEXTS), (None, TEXTS[6]), (6, TEXTS[6])], "doc_id long, text string")
    out = {r.doc_id: r.spans for r in check(frame)}
    for doc_id, text in enumerate(TEXTS):
        base = [s for s in brute(text)[1].split(",") if s]
        assert set(base) <= set(out[doc_id].split(","))
    assert out[6] == "name:5:18,local_phone:25:37,address:41:56,national_id:66:77"


def test_test_tables(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_learned_reliabilities_find_the_bad_labeler():
    # labelers 0 and 2 agree with the truth, 1 never has an opinion, 3 and 4 say yes to everything
    patterns = [(4, (1, 0, 1, 1, 1), 60), (4, (-1, 0, 0, 1, 1), 30), (4, (-1, 0, -1, 1, 1), 30)]
    posterior = weak_pii.reliabilities(patterns)
    assert posterior[4, (1, 0, 1, 1, 1)] > 0.9
    assert posterior[4, (-1, 0, -1, 1, 1)] < 0.2


def test_classifier_follows_the_evidence(spark):
    good = [f"please phone me: 415-555-{1000 + i} thanks" for i in range(40)]
    bad = [f"order invoice serial x{100 + i}.155.{1000 + i}x build" for i in range(40)]
    out = weak_pii.detect(spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")).collect()
    assert all(("local_phone" in r.spans) == (r.doc_id < 40) for r in out)


def test_odd_rows(spark):
    check(odd_documents(spark, clashes=True))
    assert listed(weak_pii.detect(no_documents(spark))) == []
