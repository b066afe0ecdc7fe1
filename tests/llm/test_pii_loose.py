"""Planted loose items must be found, look-alikes must not; strict spans stay in any case."""

from larkspur.llm import pii

REAL = [
    ("email", "please write to {}", ["anna.b (at) mail.example (dot) org", "joe[at]example.com", "sue at example dot net", "k.w [at] uni-x.de"]),
    ("ip", "login from host {}", ["81.2[.]69[.]142", "93.184.216(.)34", "151 dot 101 dot 1 dot 140", "8.8.4[dot]4"]),
    ("card", "pay by card {}", ["4111.1111.1111.1111", "5500  0000  0000  0004", "4012/8888/8888/1881", "4222_2222_2222_2220"]),
    ("phone", "call me, phone {}", ["030 123 456 78", "(415) 555 2671", "01 23 45 67 89", "0172 555 9031"]),
]
FALSE = ["order 2024.1234.5678.9013 was sent", "version 300.1[.]2[.]3 is out", "on 12.03.2024 and 2024-03-12", "invoice # 1999 10 20 30", "we met at noon dot", "serial 0000/1111/2222/3333"]


def test_planted(spark):
    rows, want = [], {}
    for kind, cue, items in REAL:
        for item in items * 5:
            text = cue.format(item) + " soon"
            rows.append((len(rows), text))
            want[rows[-1][0]] = (kind, text.index(item), text.index(item) + len(item))
    strict = [(len(rows) + k, t) for k, t in enumerate(["mail a@b.co", "ip 1.2.3.4", "+49 30 1234567", "card 4111 1111 1111 1111"] * 10)]
    lookalikes = [(1000 + k, t) for k, t in enumerate(FALSE * 6)]
    docs = spark.createDataFrame(rows + strict + lookalikes + [(5000, None), (5001, "")], "doc_id long, text string")
    found = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.pii] for r in pii.find_pii(docs).collect()}
    hits = sum(want[i] in found[i] for i in want)
    false = [(i, found[i]) for i, _ in lookalikes if found[i]]
    assert hits / len(want) >= 0.9, [(i, rows[i][1], found[i]) for i in want if want[i] not in found[i]]
    assert len(false) / len(lookalikes) <= 0.1, false
    assert all(len(found[i]) == 1 for i, _ in strict) and found[5000] == found[5001] == []


def test_added_spans_overlap_nothing_and_columns_stay(spark):
    text = "card 4111.1111.1111.1111 " * 50 + "ip 10.1.1.1 call 030 123 456 78 or +49 30 123 456 78 " * 50
    r = pii.find_pii(spark.createDataFrame([("mine", text)], "pii string, text string"), carry=("pii",)).first()
    spans = sorted((s.start, s.end) for s in r.pii_)
    assert r.pii == "mine" and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(s.base for s in r.pii_) == 100
