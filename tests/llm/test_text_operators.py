"""SimHash, token files, SentencePiece and quality rules against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from gneiss.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string"
ODD = [None, "", " ", "\n\n", "one", "one two three four", "A a " * 3000, "x" * 20000, "é ▁▁ 中文 \x00 <s> <|endoftext|> \t 😀", "  lead and  double   spaces  ", "tail \n next\n", "Foo,bar. baz! 12 34"]


def odd_rows():
    rows = [(i, t, "en", "s", 0, 7, "clash") for i, t in enumerate(ODD)]
    return rows + rows[4:6] + [(None, "one", None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def texts(spark, path):
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(rows):
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


@pytest.mark.parametrize("where", ["sf", "odd", "empty"])
def test_simhash(spark, where, request):
    path = request.getfixturevalue(where)
    got = QUERIES["op1_simhash_near_dedup"](spark, path).collect()
    assert sorted(map(tuple, got), key=str) == components([(d, fingerprint(t)) for d, t in texts(spark, path)])


def near_prints(seed, n):
    r = random.Random(seed)
    centre = r.getrandbits(64)
    out = set()
    while len(out) < n:
        f = centre if r.random() < 0.6 else r.getrandbits(64)
        for b in r.sample(range(24), r.randint(0, 7)):
            f ^= 1 << b
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("plan", [[(list(range(0, 22)), 1), (list(range(22, 43)), 1), (list(range(43, 64)), 0)], [(list(range(32)), 2), (list(range(32, 64)), 1)], None])
@pytest.mark.parametrize("hot", [8192, 64])
def test_links_keep_components(spark, monkeypatch, plan, hot):
    from gneiss.llm import simhash
    from gneiss.plans.components import connected_components

    monkeypatch.setattr(simhash, "HOT", hot)
    prints = near_prints(3, 400)
    reps = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(prints)], "fp long, rep long")
    found = connected_components(simhash.links(reps, plan or simhash.plan_search(reps, len(prints))))
    got = {}
    for r in found.collect():
        got.setdefault(r["component"], set()).add(r["node"] % 2**64)
    want = {}
    for d, f, c in components([(i, f) for i, f in enumerate(prints)]):
        want.setdefault(c, set()).add(int(f, 16))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


@pytest.mark.parametrize("where", ["sf", "odd", "empty"])
def test_token_files(spark, where, request):
    from tokenizers import Tokenizer

    path = request.getfixturevalue(where)
    tok = Tokenizer.from_file(vocabulary(BYTE_BPE))
    got = [tuple(r) for r in QUERIES["op4_token_files"](spark, path).collect()]
    ids = [(d, tok.encode(t, add_special_tokens=False).ids + [0]) for d, t in texts(spark, path)]
    want = sorted(((d, len(i), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in i))) for d, i in ids), key=str)
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == want
    at = 0
    order = sorted(got, key=lambda r: r[1])
    for d, start, n, _ in order:
        assert start == at
        at += n
    assert [r[0] for r in order] == sorted((r[0] for r in got), key=lambda d: (d is not None, d))


def test_token_words_match_whole_texts():
    from tokenizers import Tokenizer

    from gneiss.llm.token_files import WordTokenizer

    tok, words, r = Tokenizer.from_file(vocabulary(BYTE_BPE)), WordTokenizer(vocabulary(BYTE_BPE)), random.Random(5)
    for _ in range(4000):
        t = "".join(r.choice([" ", " ", "\n", "\n", "\r", "$", "-", "\t", "a", "Foo", "'s", "'", ",", ".", "12", "é", "\xa0", "　", "中", "|", "<|endoftext|>", "\x1c", "\x85", "😀"]) for _ in range(r.randint(0, 14)))
        assert words.encode(t) == words.pack(tok.encode(t, add_special_tokens=False).ids), repr(t)


@pytest.mark.parametrize("where", ["sf", "odd", "empty"])
def test_sentencepiece(spark, where, request):
    import sentencepiece

    path = request.getfixturevalue(where)
    spm = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in texts(spark, path):
        ids = spm.encode(t, add_eos=True)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(spm.decode(ids))))
    got = QUERIES["op5_sentencepiece"](spark, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_prefix_table_matches_library():
    import sentencepiece

    from gneiss.llm.sentencepieces import PrefixEncoder

    spm, own, r = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE)), PrefixEncoder(vocabulary(PIECE_BPE)), random.Random(6)
    for _ in range(4000):
        t = "".join(r.choice(" ▁\tab\n thehelloAB12.,!<s></s>é中文\x00😀ﬁ　\xa0  ing") for _ in range(r.randint(0, 25)))
        assert own.encode(t) == spm.encode(t), repr(t)


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    triples = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {i + k for i in range(n - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dups = text.split("\n"), 0
    for i, line in enumerate(lines):
        dups += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


@pytest.mark.parametrize("where", ["sf", "odd", "empty"])
def test_quality(spark, where, request):
    path = request.getfixturevalue(where)
    got = QUERIES["op7_quality_rules"](spark, path).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((d, *plain_quality(t)) for d, t in texts(spark, path)), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_separates_labels(spark):
    path = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality_rules"](spark, path)
    pairs = [tuple(r) for r in got.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("quality", "kept", "base_failed").collect()]
    good = [k for q, k, b in pairs if q == 1 and not b]
    bad = [k for q, k, _ in pairs if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)
