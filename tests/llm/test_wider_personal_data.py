"""Spans that labelers add beyond the base patterns, and look-alikes that they leave."""

SPANS = {
    "call 212-555-0199": "phone:5:17",
    "call (212) 555-0199.": "phone:5:19",
    "my account 123456789012.": "account:11:23",
    "token=" + "a1B2" * 100 + " end": "secret:0:406",
    "password: p@ssw0rd!x ok": "secret:0:20",
    "IBAN DE89 3704 0044 0532 0130 00 thanks": "iban:5:32",
    "passport no: X1234567": "passport:0:21",
    "ssn 123-45-6789.": "ssn:4:15",
    "john.smith (at) example (dot) co (dot) uk now": "email:0:41",
    "page 12 of 1234567890123": "",
    "version 1.2.3": "",
    "": "",
}


def test_wider_spans(spark):
    from gneiss.llm.pii import personal_data_digest

    rows = [(i, t) for i, t in enumerate([*SPANS] * 20 + [None])]
    got = personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["spans"]) for r in got) == [(i, SPANS.get(t, "")) for i, t in rows]


def test_account_checksum(spark):
    from gneiss.llm.pii import mod97

    df = spark.createDataFrame([("DE89 3704 0044 0532 0130 00", 1), ("GB82WEST12345698765432", 1), ("GB82WEST12345698765433", 0)], "t string, ok int")
    assert all((r[0] == 1) == bool(r[1]) for r in df.selectExpr(mod97("t"), "ok").collect())
