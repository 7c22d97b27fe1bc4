"""SentencePiece encoding and decoding by one pass over an Aho-Corasick automaton.

The automaton holds every piece. As it reads a text, its output links give all pieces that
end at each position, and each relaxes the best score there: best[end] from best[start]
plus the piece's score. What a Viterbi step may follow on depends on the model's kind. In
a unigram model any piece may follow any other, and the best sum of scores wins. In a BPE
model a piece may only follow one beside which the merge order leaves it standing; then at
most one piece can end at each position, and the path is what merging by rank gives.

Texts are cut in front of each run of word marks, and between letters and other characters,
where no piece crosses such a cut, so that each distinct segment is solved once and looked
up afterwards.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words and segments kept in each of two generations, and the characters of one that is kept: some 20 MB each.
SEGMENTS, SEGMENT_CHARS = 100_000, 64
#: Pairs of neighbours kept: some 20 MB.
PAIRS = 500_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = raw[at]
            at += 1
            value |= (c & 127) << shift
            if c < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + size]
            at += size


class Cache(dict):
    """What ``solve`` gives for a key, kept in two generations; this dictionary is the younger."""

    def __init__(self, solve: Callable[[str], bytes]):
        super().__init__()
        self.solve, self.older = solve, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.solve(key)
        if len(key) <= SEGMENT_CHARS:
            if len(self) >= SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Codec:
    """A model's pieces and rules, its automaton, and the two directions."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.types, self.kind, self.prefix, self.squeeze = [], [], [], UNIGRAM, True, True
        name = b"identity"
        for n, v in fields(model):
            if n == 1:
                x = dict(fields(v))
                self.pieces.append(x.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(x[2], "<f4")[0]) if 2 in x else 0.0)
                self.types.append(x.get(3, NORMAL))
            elif n == 2:
                self.kind = dict(fields(v)).get(3, UNIGRAM)
            elif n == 3:
                x = dict(fields(v))
                name, self.prefix, self.squeeze = x.get(1, name), bool(x.get(3, 1)), bool(x.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or name != b"identity":
            raise ValueError("only unigram and BPE models without character normalisation are known")
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER) and self.pieces[i]]
        self.ids = {self.pieces[i]: i for i in usable}
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[int, list[int | str]] = {}
        for i in usable:
            parts = [] if self.kind == UNIGRAM else self.merged(self.pieces[i], 2)
            if len(parts) == 2:
                self.halves[i] = [self.ids.get(x, x) for x in parts]
            if len(parts) <= 2:
                # The last holds what has been found on which pieces may follow.
                self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i, self.scores[i], {}))
        self.automaton.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        # Pieces of a rank that others share, or merged before a half of theirs, and what is made of such pieces.
        shared = Counter(self.scores[i] for i in usable)
        self.unranked = {i for i in usable if shared[self.scores[i]] > 1 and len(self.pieces[i]) > 1}
        for i, two in sorted(self.halves.items(), key=lambda x: len(self.pieces[x[0]])):
            if any(isinstance(x, str) or x in self.unranked or len(self.pieces[x]) > 1 and (x not in self.halves or self.scores[x] <= self.scores[i]) for x in two):
                self.unranked.add(i)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(self.types) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        self.floor = min((self.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.separable = not any(MARK in self.pieces[i].lstrip(MARK) for i in usable)
        other = rf"[^\p{{L}}\p{{M}}{MARK}]"
        crossing = regex.compile(rf"[\p{{L}}\p{{M}}]{other}|{other}[\p{{L}}\p{{M}}]")
        fine = not any(crossing.search(self.pieces[i]) for i in usable)
        # Such cuts beside Latin letters and ASCII are found at once, the others in words that aren't known yet.
        latin, signs = "A-Za-zÀ-ÖØ-öø-ÿ", r"\x00-\x1f!-@\[-`{-\x7f"
        self.words = re.compile((f" *[{latin}]++(?![^{signs} ])| *[{signs}]++(?![^{latin} ])|" if fine else "") + " *[^ ]+| +")
        self.cut = regex.compile(rf"{MARK}*[\p{{L}}\p{{M}}]+|{MARK}*{other}+|{MARK}+") if fine else None
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types)]
        self.start = (0, "", 0.0, {})
        self.lone: dict[str, tuple] = {}
        self.pairs = 0
        self.cache = Cache(self.word)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """What merging neighbours by rank, leftmost first, leaves of a short text, or the first ``least`` parts that it comes to."""
        parts = list(text)
        while len(parts) > least:
            best = max(((self.scores[self.ids[parts[k] + parts[k + 1]]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.ids), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stands(self, left: tuple, right: tuple) -> bool:
        """Whether the merge order leaves the two pieces side by side; kept with the left one."""
        found = left[3].get(right[1])
        if found is None:
            if self.pairs >= PAIRS:
                self.pairs = 0
                self.lone.clear()
                for entry in self.automaton.values():
                    entry[3].clear()
            found = left[3][right[1]] = self.apart(left[1], right[1])
            self.pairs += 1
        return found

    def apart(self, left: int | str, right: int | str) -> bool:
        """Whether merging by rank leaves the two pieces side by side.

        Where pieces are merged after their halves, the later of the two is undone time and
        again: the parts that then meet must not have merged before it.
        """
        if isinstance(left, str) or isinstance(right, str) or left in self.unranked or right in self.unranked:
            first, second = (x if isinstance(x, str) else self.pieces[x] for x in (left, right))
            return self.merged(first + second) == [first, second]
        ids, pieces, scores, halves = self.ids, self.pieces, self.scores, self.halves
        limit, ahead = -np.inf, False
        while True:
            both = ids.get(pieces[left] + pieces[right])
            if both is not None and (scores[both] > limit or ahead and scores[both] == limit):
                return False
            one, two = halves.get(left), halves.get(right)
            if one is None and two is None:
                return True
            # Of equal merges the leftmost is first.
            ahead = one is None or two is not None and scores[left] >= scores[right]
            if ahead:
                limit, right = scores[right], two[0]
            else:
                limit, left = scores[left], one[1]

    def alone(self, character: str) -> tuple:
        """The step over a character that has no piece of its own."""
        found = self.lone.get(character)
        if found is None:
            if len(self.lone) > 100_000:  # characters without a piece are many
                self.lone.clear()
            found = self.lone[character] = (1, character, self.floor, {})
        return found

    def viterbi(self, text: str, plain: bool) -> list[int | str]:
        """The best pieces of a text; characters that no piece covers stand alone, as themselves. plain: each character is a piece."""
        back: list[tuple | None] = [self.start] + [None] * len(text)
        if plain and self.kind == BPE:
            # One piece at most ends at a position, whatever its score.
            first = self.start
            for end, entry in self.automaton.iter(text):
                end += 1
                if back[end] is None:
                    size, piece, _, _ = entry
                    left = back[end - size]
                    if left is first:
                        back[end] = entry
                    elif left is not None:
                        found = left[3].get(piece)
                        if found or found is None and self.stands(left, entry):
                            back[end] = entry
        else:
            self.relax(text, back)
        out, at = [], len(text)
        while at:
            size, piece, _, _ = back[at]
            out.append(piece)
            at -= size
        out.reverse()
        return out

    def relax(self, text: str, back: list[tuple | None]) -> None:
        """The relaxation by scores, in which characters without a piece of their own are steps too."""
        best = [0.0] * (len(text) + 1)
        bpe, stands, done = self.kind == BPE, self.stands, 0

        def lone(to: int) -> int:
            for k in range(done, to):
                if back[k] is not None and text[k] not in self.ids:
                    score = best[k] + self.floor
                    if back[k + 1] is None or score > best[k + 1]:
                        best[k + 1], back[k + 1] = score, self.alone(text[k])
            return to

        for end, entry in self.automaton.iter(text):
            if done < end:
                done = lone(end)
            start = end + 1 - entry[0]
            left, now = back[start], back[end + 1]
            if left is None:
                continue
            total = best[start] + entry[2]
            if bpe:
                if now is not None or start and not stands(left, entry):
                    continue
            elif now is not None and total <= best[end + 1]:
                continue
            best[end + 1], back[end + 1] = total, entry
        lone(len(text))

    def solve(self, segment: str) -> bytes:
        plain = self.single.issuperset(segment)
        found = self.viterbi(segment, plain)
        if not plain:
            out = []
            for p in found:
                if not isinstance(p, str):
                    out.append(p)
                elif self.bytes:
                    out += [self.bytes[b] for b in p.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
            found = out
        return struct.pack(f"<{len(found)}i", *found)

    def word(self, word: str) -> bytes:
        """The ids of a word with the blanks in front of it; if it is of several segments, they are looked up."""
        marked = word.replace(" ", MARK)
        if self.cut is None or word.strip(" ").isalpha():
            return self.solve(marked)
        found = self.cut.findall(marked)
        return self.solve(marked) if len(found) == 1 else b"".join(self.cache[x.replace(MARK, " ")] for x in found)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text's pieces."""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return np.empty(0, "<i4")
        # A mark in the text is a blank to the format.
        blank = " " * self.prefix + text.replace(MARK, " ")
        out = map(self.cache.__getitem__, self.words.findall(blank)) if self.separable else [self.solve(blank.replace(" ", MARK))]
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def coded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id_col, ids (array<int>), n_tokens, round_trip (whether decoding ids gives the text).

    Null texts have null ids and null round_trip and no tokens; empty texts have no
    tokens. A text that holds the word mark itself, which the format can't tell from a
    blank, doesn't come back. Rows with null or repeated ids each keep their own row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                ids = [None if t is None else c.encode(t) for t in texts]
                back = [None if t is None else c.decode(i.tolist()) == t for t, i in zip(texts, ids)]
                sizes = np.array([0 if i is None else len(i) for i in ids], np.int32)
                ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.array([i is None for i in ids] + [False]))
                flat = np.concatenate([i for i in ids if i is not None] + [np.empty(0, "<i4")])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(sizes), pa.array(back, pa.bool_())], ["id", "ids", "n_tokens", "round_trip"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return map_batches(own, run, f"id {kind}, ids array<int>, n_tokens int, round_trip boolean").withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """All documents by the model at ``path``, which the driver reads."""
    return coded(docs, Path(path).read_bytes())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, decoded again as a check."""
    return encode_documents(read(spark, sf_dir, "documents"))
