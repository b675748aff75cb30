"""SentencePiece byte-pair encoding through a prefix table, and decoding.

A byte-pair encoding is the only token sequence in which every neighbouring
pair encodes to itself. So each prefix of a text has one possible last token:
among the vocabulary entries that end there (found by an automaton), the one
that is compatible with the last token of the prefix before it. The table of
those last tokens is filled from left to right and the ids are read backwards.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from gneiss.llm.arrow import map_texts

SPACE = "▁"
#: Distinct words, stems without their closing marks, and pairs of tokens that a worker remembers; later ones are worked out each time.
REMEMBERED = 200_000
MARKS = ".,;:!?"


class PrefixEncoder:
    """Encodes exactly as the library does for a BPE model with identity normalisation and byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as messages

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = messages.ModelProto()
        proto.ParseFromString(self.processor.serialized_model_proto())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with identity normalisation and byte fallback")
        self.dummy = SPACE if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after a word's end")
        self.scores = [p.score for p in proto.pieces]
        self.lengths = [len(p.piece) for p in proto.pieces]
        self.pieces = [p.piece for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.end = self.processor.eos_id()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        #: Closing marks that no piece joins to a letter before them: a word can be cut there.
        self.marks = "".join(c for c in MARKS if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p in self.ids))
        #: A line feed that no piece holds is written as a byte, and nothing is merged across it.
        self.cut_lines = not any("\n" in p for p in self.ids)
        self.line_feed = (self.bytes[10],)
        self.pairs: dict[int, bool] = {}
        #: At most two entries a token.
        self.spines: dict[tuple[int, bool], list[tuple[str, float]]] = {}
        self.alone = [i in own and self.merged(p) == [i] for own in [set(self.ids.values())] for i, p in enumerate(self.pieces)]
        self.words: dict[str, tuple[int, ...]] = {}
        self.stems: dict[str, tuple[int, ...]] = {}
        self.decimals = list(map(str, range(len(proto.pieces))))

    def merged(self, text: str) -> list[int]:
        """The ids of a short text of known characters by merging the best pair, leftmost first."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best = max(((scores[i], -k) for k in range(len(parts) - 1) if (i := ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ids[p] for p in parts]

    def spine(self, token: int, right: bool) -> list[tuple[str, float]]:
        """The pieces that stand at one end of a token while it is put together, each with the score of the merge that ends it."""
        key = token, right
        found = self.spines.get(key)
        if found is None:
            parts, ids, scores, out = list(self.pieces[token]), self.ids, self.scores, []
            own = -1 if right else 0
            while len(parts) > 1:
                score, k = max((scores[i], -k) for k in range(len(parts) - 1) if (i := ids.get(parts[k] + parts[k + 1])) is not None)
                k = -k
                if k == (len(parts) - 2 if right else 0):
                    out.append((parts[own], score))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            found = self.spines[key] = [*out, (parts[0], float("-inf"))]
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens next to each other stay as they are: no piece across their border is merged before its two parts have gone.

        Merges happen in the order of their scores, the leftmost first; both
        tokens must be what their own text is encoded to.
        """
        if not (self.alone[left] and self.alone[right]):
            return False
        ids, scores = self.ids, self.scores
        ends, starts = self.spine(left, True), self.spine(right, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = ends[i], starts[j]
            across = ids.get(x + y)
            if across is not None and scores[across] > x_ends and scores[across] >= y_ends:
                return False
            if x_ends >= y_ends:
                i += 1
                if i == len(ends):
                    return True
            else:
                j += 1

    def known(self, text: str) -> list[int]:
        """The ids of a text whose characters are all in the vocabulary."""
        last = [-1] * (len(text) + 1)
        lengths, pairs, compatible, alone = self.lengths, self.pairs.get, self.compatible, self.alone
        done = -1
        for end, token in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - lengths[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs(before << 32 | token)
                if fits is None:
                    fits = compatible(before, token)
                    if len(self.pairs) < REMEMBERED:
                        self.pairs[before << 32 | token] = fits
            else:
                fits = alone[token]
            if fits:
                last[end + 1] = token
                done = end
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def chunk(self, text: str) -> tuple[int, ...]:
        """The ids of a run of spaces and the word after it."""
        out, start, ids = [], 0, self.ids
        for k, c in enumerate(text):
            if c not in ids:
                if start < k:
                    out += self.known(text[start:k])
                out += [self.bytes[b] for b in c.encode()]
                start = k + 1
        if start < len(text):
            out += self.known(text[start:])
        return tuple(out)

    def stem(self, text: str) -> tuple[int, ...]:
        found = self.stems.get(text)
        if found is None:
            found = self.chunk(text)
            if len(self.stems) < REMEMBERED and len(text) < 64:
                self.stems[text] = found
        return found

    def part(self, space: str, word: str) -> tuple[int, ...]:
        """The ids of a word up to a line's end, with the space before it if it has one."""
        head = word.rstrip(self.marks)
        return self.stem(space + head) + self.stem(word[len(head) :]) if head and head[-1].isalpha() else self.chunk(space + word)

    def look(self, word: str) -> tuple[int, ...]:
        """The ids of a space and a word."""
        first, *more = word.split("\n") if self.cut_lines else [word]
        ids = self.part(SPACE, first)
        for line in more:
            ids = ids + self.line_feed + self.part("", line)
        if len(self.words) < REMEMBERED and len(word) < 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text or not self.dummy:
            runs = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", self.dummy + text.replace(" ", SPACE))
            return list(chain.from_iterable(map(self.chunk, runs)))
        get, look = self.words.get, self.look
        return list(chain.from_iterable([get(w) or look(w) for w in text.split(" ")]))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PrefixEncoder:
    return PrefixEncoder(model_file)


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = True) -> DataFrame:
    """Ids with an end id, and the text decoded from them, for every row of docs.

    Adds ids array<int> and decoded string (full), n_tokens long, ids_sha256 and
    decoded_sha256 strings. Null and empty texts have the end id alone and
    decode to the empty string. Repeated rows stay repeated; other columns, whatever
    their names, are left out unless kept. Memory is bounded by a few hundred
    texts and the words a worker remembers, so a very long text costs only itself.
    """

    def factory():
        spm = encoder(model_file)

        def work(texts: list[str]) -> list[list]:
            counts, hashes, decoded, flat, ends = [], [], [], [], [0]
            for t in texts:
                ids = [*spm.encode(t), spm.end]
                counts.append(len(ids))
                hashes.append(hashlib.sha256(spm.decimal(ids).encode()).hexdigest())
                decoded.append(spm.processor.decode(ids))
                if full:
                    flat.append(pa.array(ids, pa.int32()))
                    ends.append(ends[-1] + len(ids))
            digests = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
            if not full:
                return [counts, hashes, digests]
            return [counts, hashes, digests, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(flat)), decoded]

        return work

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if full:
        fields += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return map_texts(docs, text, list(keep), fields, factory)
