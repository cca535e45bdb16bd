import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillveil.functions import patterns, pseudonym
from quillveil.functions.spans import claim, find_all, span, stitch
from quillveil.operators.detect import coalesce_runs, counts, detect, redact, write_runs
from quillveil.policy import Policy

CASES = [
    ("Contact us at help.desk@example.com for details.", {"email": ["help.desk@example.com"]}, []),
    *((f"You can contact us at {p} for help.", {"phone": [p]}, []) for p in ("9876543210", "98765 43210", "+91 9876543210", "+91-9876543210", "+91 98765 43210", "81234 56789", "022-61234567", "+91 22 6123 4567")),
    ("We issued 123456789012 shares.", {}, ["phone"]),
    ("The page number is 243.", {}, ["phone"]),
    ("The total cost is INR 98,76,54,321.", {}, ["phone"]),
    ("Please quote Order No 9876543210 in the ticket.", {}, ["phone"]),
    ("The server IP is 192.168.1.100 for internal use.", {"ip": ["192.168.1.100"]}, []),
    ("His PAN is ABCDE1234F as per records.", {"pan": ["ABCDE1234F"]}, []),
    ("The SSN on file is 123-45-6789.", {"ssn": ["123-45-6789"]}, []),
    ("Paid with card number 4532015112830366 today.", {"credit_card": ["4532015112830366"]}, []),
    ("Corporate Identity Number: U12345MH2001PLC123456", {}, ["credit_card"]),
    ("Date of Birth: 12/04/2025 as recorded.", {"dob": ["12/04/2025"]}, []),
    ("The resolution was passed on 12/04/2025 by the Board.", {}, ["dob"]),
    ("Aadhaar Number: 2345 6789 0123 as per UIDAI records.", {"aadhaar": ["2345 6789 0123"]}, []),
    ("The invoice total was 1234 5678 9012 rupees only.", {}, ["aadhaar"]),
    ("This offer follows SEBI ICDR Regulations and is listed on NSE and BSE.", {}, ["company"]),
    ("For further details, see page 243 of this document.", {}, ["phone", "aadhaar", "credit_card"]),
    ("Registered Office at Plot 45, Residency Road, Pune 411001, India.", {"address": 1}, []),
    ("Registered Office: Quarry Road, Pune, Maharashtra, India", {"address": 1}, []),
    ("Corporate Office:\nAcme Labs Private Limited,\nc/o Rahul Sharma, Plot No 12, Sector 14,\nGurgaon - 122001", {"address": 1}, ["name", "company"]),
    ("Send mail to registered office at PIN Code 110001 today.", {"address": 1}, []),
    *((t, {}, ["address"]) for t in ("He lives in Pune.", "Maharashtra is a state.", "The code is 411045.", "Refer to Page 41 of the documentation.", "The invoice amount was ₹4,11,045 only.", "Order No. 411045 has been processed.", "The date is 10/12/2025.")),
    ("Promoters:\nRahul Sharma / Priya Gupta / Amit Kumar", {"name": ["Rahul Sharma", "Priya Gupta", "Amit Kumar"]}, []),
    ("Managing Director:\nRahul Sharma", {"name": ["Rahul Sharma"]}, []),
    ("Father's Name: Rohan Verma", {"name": ["Name", "Rohan Verma"]}, []),
    ("In January 2026, the board of SEBI and NSE reviewed the RHP of the company.", {}, ["name"]),
    ("card 4532 0151 1283 0366 x", {"phone": ["0151 1283 0366"]}, ["credit_card"]),
    ("Kabir Sethi was appointed as the head of sales.", {"name": ["Kabir Sethi"]}, []),
    ("A supply agreement with Lotus Valley Engineering Private Limited.", {"company": ["Lotus Valley Engineering Private Limited"]}, []),
    ("", {}, ["email"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, text string")
    for row in redact(df).collect():
        _, expect, forbid = CASES[row.i]
        found = {}
        for d in row.detections:
            assert row.text[d.start : d.end] == d.value
            found.setdefault(d.category, []).append(d.value.rstrip())  # a card can take one blank after it
        for category, values in expect.items():
            assert len(found.get(category, [])) == values if isinstance(values, int) else found.get(category) == values, (row.text, found)
        assert not set(forbid) & set(found), (row.text, found)
        starts = [(d.start, d.end) for d in row.detections]
        assert all(a[1] <= b[0] for a, b in zip(starts, starts[1:]))
        assert len(row.redacted) == len(row.text) - sum(d.end - d.start for d in row.detections) + sum(len(d.replacement) for d in row.detections)


def test_null_text_has_no_spans(spark):
    row = redact(spark.createDataFrame([(None,)], "text string")).first()
    assert row.detections == [] and row.redacted is None


def test_safe_precedence_keeps_cards_whole(spark):
    df = spark.createDataFrame([("card 4532 0151 1283 0366 x",)], "text string")
    assert [d.category for d in detect(df, precedence="safe").first().detections] == ["credit_card"]


def test_policy_prunes_the_plan(spark):
    df = spark.createDataFrame([("a@b.com 10.0.0.1",)], "text string")
    out = detect(df, policy=Policy.only("email"), found=None)
    assert [d.category for d in out.first().detections] == ["email"]
    assert r"25[0-5]" not in out._jdf.queryExecution().optimizedPlan().toString()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1 é😀@.\n", max_size=30), min_size=1, max_size=30))
def test_offsets_slice_back(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", find_all(F.col("text"), r"[a1]+", "x").alias("s"), stitch(F.col("text"), find_all(F.col("text"), r"[a1]+", "x"), lambda s: F.lit("#")).alias("o")).collect():
        import re

        assert [(s.start, s.end) for s in row.s] == [m.span() for m in re.finditer("[a1]+", row.text)]
        assert row.o == re.sub("[a1]+", "#", row.text)


def test_many_matches_take_time_in_proportion(spark):
    import time

    text = spark.createDataFrame([("a1 " * 60_000 + "😀 a1",)], "text string")
    start = time.perf_counter()
    found = text.select(F.size(find_all(F.col("text"), r"a1")).alias("n"), F.element_at(find_all(F.col("text"), r"a1"), -1).alias("last"), F.length(stitch(F.col("text"), find_all(F.col("text"), r"a1"), lambda s: F.lit("#"))).alias("out")).first()
    assert (found.n, found.last.start, found.last.end, found.out) == (60_001, 180_002, 180_004, 120_003)
    assert time.perf_counter() - start < 60  # copying an array at each match took minutes


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6)), max_size=8), min_size=1, max_size=40))
def test_claim_is_greedy(spark, groups):
    df = spark.createDataFrame([([(a, a + n) for a, n in g],) for g in groups], "c array<struct<s:int,e:int>>")
    got = [[(s.start, s.end) for s in r[0]] for r in df.select(claim(F.transform("c", lambda x: span(x["s"], x["e"], "x", F.lit(""))))).collect()]
    for g, out in zip(groups, got):
        taken = []
        for a, n in g:
            if all(not (a < e and s < a + n) for s, e in taken):
                taken.append((a, a + n))
        assert out == sorted(taken)


def test_pseudonyms_are_stable_and_of_the_same_form(spark):
    df = spark.createDataFrame([("Rahul Sharma", "+91 98765-43210", "12/04/1990", "April 3, 1990")], "n string, p string, d string, m string")
    row = df.select(pseudonym.name(F.col("n")).alias("n"), pseudonym.name(F.upper("n")).alias("n2"), pseudonym.phone(F.col("p")).alias("p"), pseudonym.dob(F.col("d")).alias("d"), pseudonym.dob(F.col("m")).alias("m"), patterns.luhn_valid(pseudonym.credit_card(F.col("n"))).alias("c")).first()
    assert row.n == row.n2 and row.c
    import re

    assert re.fullmatch(r"\+[6-9]\d \d{5}-\d{5}", row.p) and re.fullmatch(r"\d\d/\d\d/\d{4}", row.d) and re.fullmatch(r"[A-Z][a-z]+ \d\d, \d{4}", row.m)


def test_runs(spark):
    df = spark.createDataFrame([(["Rah", "ul ", "Sharma works at Infosys."],)], "runs array<string>").withColumn("c", coalesce_runs(F.col("runs")))
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement")) for a, b, r in ((0, 12, "Alex Morgan"), (22, 29, "Acme Corp"))))
    row = df.select("c.text", write_runs(F.col("c.runs"), spans).alias("w")).first()
    assert row.text == "Rahul Sharma works at Infosys."
    assert [r.text for r in row.w] == ["Alex Morgan", "", " works at Acme Corp."]
    empty = spark.createDataFrame([(["A", "", "B", None],)], "runs array<string>").select(coalesce_runs(F.col("runs")).alias("c")).first().c
    assert [(r.run_index, r.start, r.end) for r in empty.runs] == [(0, 0, 1), (2, 1, 2)]


@pytest.mark.parametrize("category,n", [("email", 186), ("ip", 180), ("credit_card", 177)])
def test_regression_counts(spark, category, n):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert {r.category: r.n for r in counts(detect(df, policy=Policy.only(category), found=None)).collect()} == {category: n}
