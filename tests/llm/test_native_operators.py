"""Source mixing, license scans and personal data against plain versions of their contracts."""

import hashlib
import random
import re

import duckdb
import pytest

from gneiss.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_text_operators import empty, odd, texts  # noqa: F401


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for _, s, t in rows:
        totals[s] = totals.get(s, 0) + size(t)
    ranked = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ranked)}
    full, target = set(), dict.fromkeys(totals, 0.0)
    while True:
        rest = [s for s in totals if s not in full]
        left = sum(totals.values()) - sum(3 * totals[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * level > 3 * totals[s]}
        if not over:
            return totals, {s: 3.0 * totals[s] if s in full else weight[s] * level for s in totals}, size
        full |= over


@pytest.mark.parametrize("where", ["sf", "odd", "empty"])
def test_mixing(spark, where, request):
    path = request.getfixturevalue(where)
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", "text").collect()]
    totals, target, size = plain_mix(rows)
    whole = [tuple(r) for r in QUERIES["op3_source_mixing"](spark, path).collect()]
    got = [r[:5] for r in whole]
    assert all(0 <= at <= 1 and copies <= 4 and (copies > 0) == (k > 0) or not n for *_, n, _, _, k, copies, at in whole)
    assert sorted(((d, n, s, round(t, 6)) for d, n, s, t, _ in got), key=str) == sorted(((d, size(x), totals[s], round(target[s], 6)) for d, s, x in rows), key=str)
    assert all(0 <= k <= 3 * n for _, n, _, _, k in got)
    assert abs(sum(k for *_, k in got) - sum(target.values())) <= len(target)
    assert sorted(whole, key=str) == sorted(map(tuple, QUERIES["op3_source_mixing"](spark, path).collect()), key=str)


def test_mixing_by_source_and_over_time(spark, sf):
    from gneiss.llm.mixing import in_training_order, mixing_plan

    plan = mixing_plan(spark.read.parquet(f"{sf}/documents.parquet"))
    taken = {}
    for r in plan.collect():
        t = taken.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
        assert 0 <= r["position"] <= 1
    assert all(abs(a - b) <= 1 for a, b in taken.values())
    copies = [tuple(r) for r in in_training_order(plan).select("position", "source", "class", "words").collect()]
    assert [c[0] for c in copies] == sorted(c[0] for c in copies)
    for source, (want, _) in taken.items():
        own = [c for c in copies if c[1] == source]
        assert sum(c[3] for c in own) == want
        early = sum(c[3] for c in own if c[0] < 0.5) / max(want, 1)
        if want > 10000:
            assert abs(early - (0.625, 0.5, 0.375)[own[0][2]]) < 0.1


def test_mixing_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op3_source_mixing"]).fetchall()
    got = sorted(map(tuple, QUERIES["op3_source_mixing"](spark, sf).collect()))
    assert [r[:6] for r in got] == [r[:6] for r in sorted(want)]
    assert all(abs(a[6] - b[6]) < 1e-6 for a, b in zip(got, sorted(want), strict=True))


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


LICENSED = [
    "Released UNDER the MIT-License. cc by nc cc by-nc/cc by nc",
    "under the mit license under the mit license",
    "This work is licensed under the GNU General Public Licence, version 3.",
    "This work is licensed under the very GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this new software and associated documentation files, to deal in the Software",
    "apache license version 2 " * 400,
    "apacKe license version 2 under the mİt license K",
    None,
    "cc by",
]


@pytest.fixture(scope="module")
def licensed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("licensed"))
    rows = [(i, t) for i, t in enumerate(LICENSED)] + [(0, LICENSED[0]), (0, LICENSED[1]), (None, LICENSED[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("where", ["sf", "odd", "empty", "licensed"])
def test_licenses(spark, where, request):
    path = request.getfixturevalue(where)
    got = [tuple(r) for r in QUERIES["op8_license_scan"](spark, path).collect()]
    assert sorted((r[:6] for r in got), key=str) == sorted(((d, *plain_places(t)) for d, t in texts(spark, path)), key=str)
    assert all(set(filter(None, r[5].split(","))) <= set(r[6].split(",")) and 0 <= r[7] <= 1 for r in got)


def test_licenses_adds_notices(spark, licensed):
    got = {r["doc_id"]: r["labels"] for r in QUERIES["op8_license_scan"](spark, licensed).collect() if r["doc_id"] not in (None, 0)}
    assert got[3] == "gpl-3" and got[4] == "mit" and got[8] == "" and got[5] == "apache-2"


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


PERSONAL = [
    "a@b.c%x@d.e mail me.at+x@mail.example.com. x@y é😀z a@b..c @ a@b.c.d-",
    "1.2.3.4.5 255.255.255.255 256.1.1.1 00255.1.1.1 1.2.3.4 0.0.0.0.1.2.3.4",
    "4465758382889437 4465758382889437 ok 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111",
    "+1 (017) 555-7713 +44 20 7946 0958. +1 23 +123456789012345678 call (212) 555-0199 now",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" password: hunter2hunter',
    "9" * 30000,
    "a" * 30000 + "@x.y",
    "é" * 50 + " a@b.cd " * 700,
    "jane.doe (at) example (dot) com",
]


@pytest.fixture(scope="module")
def personal(spark, tmp_path_factory):
    path, r = str(tmp_path_factory.mktemp("personal")), random.Random(4)
    noise = ["".join(r.choice("aZ0123456789.@+-() %é😀") for _ in range(60)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(PERSONAL + noise)] + [(0, PERSONAL[0]), (None, PERSONAL[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("where", ["sf", "odd", "empty", "personal"])
def test_personal_data(spark, where, request):
    path = request.getfixturevalue(where)
    got = [tuple(r) for r in QUERIES["op9_personal_data"](spark, path).collect()]
    want = []
    for d, t in texts(spark, path):
        spans = plain_spans(t)
        flat = [f"{k}:{a}:{b}" for k, s in spans.items() for a, b in s]
        want.append((d, *map(len, spans.values()), hashlib.sha256(",".join(flat).encode()).hexdigest()))
    assert sorted((r[:6] for r in got), key=str) == sorted(want, key=str)
    kinds = ["email", "ip", "card", "phone", "account", "iban", "passport", "secret", "ssn"]
    for r in got:
        spans = [(kinds.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, r[6].split(",")))]
        assert spans == sorted(spans) and len(spans) >= sum(r[1:5])


def test_personal_data_adds(spark, personal):
    got = {r["doc_id"]: r["spans"] for r in QUERIES["op9_personal_data"](spark, personal).collect()}
    assert got[2].count("account") == 3 and "secret:0:" in got[4] and got[4].count("secret") >= 1
    assert "phone:" in got[3] and got[8].startswith("email")


def test_estimate_recovers_reliabilities():
    from gneiss.llm.pii import estimate

    r, counts, truth = random.Random(2), {}, {}
    for _ in range(20000):
        real = r.random() < 0.4
        v = tuple(int(real if r.random() < a else not real) if r.random() < 0.9 else None for a in (0.95, 0.8, 0.7, 0.9))
        counts[v] = counts.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + real
    post = estimate([("card", v, n) for v, n in counts.items()])
    right = sum(max(truth[v], n - truth[v]) for v, n in counts.items())
    own = sum(truth[v] if post["card", v] >= 0.5 else n - truth[v] for v, n in counts.items())
    assert own >= 0.98 * right
