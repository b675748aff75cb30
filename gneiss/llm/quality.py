"""Line-first quality rules: lines are judged one by one, then what is left of the document."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, types as T

from gneiss.llm.arrow import map_texts

SYMBOLS = "#*$%&|<>"
#: Fixed phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
    "use of cookies",
)
SENTENCE_MARKS = re.compile(r"[.,;:!?…。！？،؛।]")
LETTERS = re.compile(r"[^\W\d_]")
LETTERS_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]")
#: Words that separate the entries of a menu or a path: | > and, in UTF-8, the two closing guillemets, middle dot and bullet.
SEPARATORS = (b"|", b">", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2")
#: A line fails at more than this share of navigation separators or symbol-laden words, of capitals, or of one repeated word.
SEPARATOR_SHARE, SYMBOL_SHARE, CAPITAL_SHARE, REPEAT_SHARE = 0.2, 0.3, 0.6, 0.3
#: Words from which the shares of a line are taken to mean anything.
FEW = 6
#: A document is rejected if it loses more than this share of its words.
MOST_LOST = 0.3
MIN_WORDS = 50


def line_fails(words: list[bytes], line: str) -> str:
    """The rule that a line with at least one word breaks, or the empty string."""
    low = line.lower()
    if len(words) <= 30 and any(p in low for p in BOILERPLATE):
        return "boilerplate"
    n = len(words)
    if n < FEW:
        return ""
    if sum(map(words.count, SEPARATORS)) > SEPARATOR_SHARE * n:
        return "navigation"
    if any(c in line for c in SYMBOLS) and sum(any(c in SYMBOL_BYTES for c in w) for w in words) > SYMBOL_SHARE * n:
        return "symbols"
    capitals = len(LETTERS_UPPER.findall(line))
    if capitals > n and capitals > CAPITAL_SHARE * len(LETTERS.findall(line)):
        return "capitals"
    most = max(REPEAT_SHARE * n, FEW)
    if n - len(set(words)) + 1 > most and Counter(words).most_common(1)[0][1] > most:
        return "repetition"
    if not SENTENCE_MARKS.search(line):
        return "punctuation"
    return ""


SYMBOL_BYTES = frozenset(SYMBOLS.encode())


def measure(text: str) -> tuple[int, int, int, int, int, bool, bool, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text without failing lines)."""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        counts = Counter(triples)
        covered = 0  # words before this index are counted
        for i, t in enumerate(triples):
            if counts[t] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    seen: set[str] = set()
    duplicates, lost, good, lines = 0, 0, [], text.split("\n")
    for line in lines:
        own = line.encode().split()
        if own:
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
            if line_fails(own, line):
                lost += len(own)
                continue
        good.append(line)
    failed = n < MIN_WORDS or 100 * repeated > 50 * n
    kept = not failed and lost <= MOST_LOST * n
    return n, word_chars, symbols, duplicates, repeated, failed, kept, text if len(good) == len(lines) else "\n".join(good)


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), cleaned: bool = True) -> DataFrame:
    """Counts, verdict and (cleaned) the text without its failing lines, for every row of docs.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed and kept (boolean) and cleaned_text. A null text has no words
    and fails the base rules, as does an empty one. Repeated rows get equal
    verdicts; each row is judged alone, so order, ties and other columns do not
    matter. An empty table gives an empty result.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [(n, T.LongType()) for n in names] + [("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    if cleaned:
        fields.append(("cleaned_text", T.StringType()))

    def factory():
        return lambda texts: [list(c) for c in list(zip(*map(measure, texts), strict=True))[: len(fields)]]

    return map_texts(docs, text, list(keep), fields, factory)
