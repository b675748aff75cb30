"""The few functions that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T


def stable_id_of(kind: str, parts: list[str]) -> str:
    """kind- and the first 12 hex digits of BLAKE2b-128 over the parts, a NUL after each."""
    digest = hashlib.blake2b(digest_size=16)
    for p in parts:
        digest.update(p.encode() + b"\x00")
    return f"{kind}-{digest.hexdigest()[:12]}"


@F.pandas_udf(T.StringType())
def stable_id(kind: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else stable_id_of(k, list(p)) for k, p in zip(kind, parts, strict=True)])


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_count(path: str | None = None):
    """UDF counting byte-pair tokens; the vocabulary is a file, one encoder a worker."""

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        import public_tokenizers

        encoding = _encoding(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        return pd.Series([len(encoding.encode_ordinary(t or "")) for t in text], dtype="int64")

    return count


ACRONYM, CAMEL = re.compile(r"([A-Z]+)([A-Z][a-z])"), re.compile(r"([a-z0-9])([A-Z])")


@lru_cache(maxsize=1)
def _words():
    import regex

    return regex.compile(r"(?w)\b(?=\w).+?\b")


def content_tokens_of(text: str) -> list[str]:
    """Words by Unicode boundaries: compatibility forms, split case and underscores, lower case, one-letter elisions off."""
    text = unicodedata.normalize("NFKC", text).replace("’", "'")
    text = CAMEL.sub(r"\1 \2", ACRONYM.sub(r"\1 \2", text))
    out = []
    for word in _words().findall(text):
        for part in word.lower().split("_"):
            head, mark, tail = part.partition("'")
            part = tail if mark and len(head) == 1 else part
            if len(part) > 1:
                out.append(part)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def content_tokens(text: pd.Series) -> pd.Series:
    return pd.Series([content_tokens_of(t or "") for t in text])


@F.arrow_udf(T.IntegerType())
def content_token_count(text: pa.Array) -> pa.Array:
    """How many content_tokens a text has; the words of one text at a time are held."""
    return pa.array((len(content_tokens_of(t.as_py() or "")) for t in text), pa.int32())


ASCII_WORDS, UNDIVIDED = re.compile(r"[a-z0-9_']{2,}"), ("ss", "us", "is")


@lru_cache(maxsize=1 << 16)
def stem_of(term: str) -> str:
    """What functions.text.stem gives for an ASCII term; words are remembered, as a text repeats few of them."""

    def undouble(base: str) -> str:
        return base[:-1] if base[-1] == base[-2] else base

    def endings(word: str, plural: str) -> str:
        if word.endswith("ies") and len(word) >= 6:
            return word[:-3] + "y"
        if word.endswith("ing") and len(word) >= 7:
            return undouble(word[:-3])
        return undouble(word[:-2]) if word.endswith("ed") and len(word) >= 6 else plural

    def plural(word: str) -> bool:
        return word.endswith("s") and len(word) >= 5 and not word.endswith(UNDIVIDED)

    inner = term
    if plural(term):
        base = term[:-1]
        inner = endings(base, endings(base[:-1], base[:-1]) if plural(base) else base)
    return endings(term, inner)


def term_counts(unhelpful: tuple[str, ...]):
    """UDF of the stems of a lower-cased text and how often each occurs, without unhelpful words and stems."""
    left_out = frozenset(unhelpful)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])))
    def count(text: pa.Array) -> pa.Array:
        terms, counts, ends = [], [], [0]
        for t in text:
            found: dict[str, int] = {}
            for word, n in Counter(ASCII_WORDS.findall(t.as_py() or "")).items():
                if word not in left_out and (stem := stem_of(word)) not in left_out:
                    found[stem] = found.get(stem, 0) + n
            terms.extend(found)
            counts.extend(found.values())
            ends.append(len(terms))
        rows = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["term", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return count


LINE_FACTS = ("total", "code", "comment", "blank", "prose", "fenced")


def count_lines_of(text: str, mark: str) -> tuple[int, ...]:
    """The line facts of one text whose comment lines start with mark."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    code = comment = blank = fenced = fences = 0
    in_comment = in_fence = False
    for line in lines:
        bare = line.strip(" \t\r\f\v")
        if not bare:
            blank += 1
        elif in_comment:
            comment += 1
            in_comment = "*/" not in bare
        elif bare.startswith(mark):
            comment += 1
        elif bare.startswith("/*"):
            comment += 1
            in_comment = "*/" not in bare
        else:
            code += 1
        if line.lstrip(" ").startswith("```"):
            fences += 1
            in_fence = not in_fence
        elif in_fence:
            fenced += 1
    return len(lines), code, comment, blank, len(lines) - fences - fenced, fenced


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in LINE_FACTS]))
def count_lines(text: pa.Array, mark: pa.Array) -> pa.Array:
    rows = [count_lines_of(t or "", m) for t, m in zip(text.to_pylist(), mark.to_pylist(), strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * len(LINE_FACTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(LINE_FACTS))


def looks_binary_of(data: bytes) -> bool:
    """A NUL in the first 4,096 bytes, or over 1 % control bytes in windows at the head, middle and tail; byte-order marks are text.

    Tabs and line ends are no control bytes; a byte that several windows cover counts in each.
    """
    if not data or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    if b"\x00" in data[:4096]:
        return True
    middle = max(len(data) // 2 - 2048, 0)
    sample = data[:4096] + data[middle : middle + 4096] + data[-4096:]
    control = sum(b < 32 and b not in (9, 10, 13) for b in sample)
    return control * 100 > len(sample)


def decode_of(data: bytes) -> str | None:
    """Text of UTF-8 or of UTF-16 with a byte-order mark, with LF line ends; None if it is neither."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"", "utf-8")):
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name).replace("\r\n", "\n")
            except UnicodeDecodeError:
                return None
    return None


@F.arrow_udf(T.BooleanType())
def looks_binary(data: pa.Array) -> pa.Array:
    return pa.array([None if not d.is_valid else looks_binary_of(d.as_py()) for d in data], pa.bool_())


@F.arrow_udf(T.StringType())
def decode(data: pa.Array) -> pa.Array:
    return pa.array([decode_of(d.as_py()) if d.is_valid else None for d in data], pa.string())


def truncate_utf8_of(text: str, n: int) -> str:
    return text.encode()[:n].decode(errors="ignore")


@F.pandas_udf(T.StringType())
def truncate_utf8(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else truncate_utf8_of(t, int(k)) for t, k in zip(text, n, strict=True)])


def mask_quotes_of(text: str) -> str:
    """Quoted strings become str between spaces; an apostrophe inside a word is none, an open quote runs to the end."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        inside = c == "'" and 0 < i < n - 1 and text[i - 1].isalnum() and text[i + 1].isalnum()
        if c not in "\"'`" or inside:
            out.append(c)
            i += 1
            continue
        i += 1
        while i < n and text[i] != c:
            i += 2 if text[i] == "\\" else 1
        i += 1
        out.append(" str ")
    return "".join(out)


@F.pandas_udf(T.StringType())
def mask_quotes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else mask_quotes_of(t))
