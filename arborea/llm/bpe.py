"""BPE encoding and decoding with a bounded lookahead.

The encoder reads a text from left to right. White space ends every word, so at most one word is open at a time;
words are looked up in a bounded cache. A word longer than the merge list's *sufficient lookahead* is itself read
through a window: tokens that end at least the lookahead before the end of the window can't change any
more (what follows reaches them through no chain of merges) and are emitted; the window then starts anew at
the last emitted boundary. Memory stays constant however long a word is.

Decoding is a state machine over ids: between two tokens it emits the separator that the vocabulary's file asks for.

Supported files: BPE over the byte alphabet with an end-of-word suffix, NFC, white space folding and lower case, no
decoder (tokens are joined by one space). Special tokens are found in the raw text, as the file asks.

Defined cases: a null text counts as empty and has no ids; ids of repeated rows repeat; a null doc_id stays null; a very long text is encoded
whole, its ids in memory; U+001C to U+001F are no white space, unlike in Python; other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import bounded_batches

#: Words in a worker's cache (about 200 bytes a word); it starts anew when full.
CACHE_WORDS = 600_000
#: Ids take 20 bits; no pair has this rank.
_ID, _NONE = (1 << 20) - 1, 1 << 62
_ODD_CONTROLS = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the vocabulary's rule
_FOLD = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def class_ranges(name: str) -> str:
    """The characters of a class of the file's own pattern language, as ranges for ``re``: each library has the tables
    of some Unicode version, and the ids depend on it."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    runs = pre_tokenizers.Split(Regex(f"[{name}]+"), "removed", invert=True).pre_tokenize_str(every)
    ends = [(r[0], r[-1]) for run, _ in runs for r in ([run] if not run[0] < "\ud800" < run[-1] else [(run[0], "\ud7ff"), ("\ue000", run[-1])])]
    return "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in ends)


@lru_cache(maxsize=1)
def character_classes() -> tuple[str, str, str]:
    """White space, letters, numbers; the driver makes them once and tasks get them as text."""
    return tuple(map(class_ranges, (r"\s", r"\p{L}", r"\p{N}")))


def _patterns(white: str, letter: str, number: str) -> tuple[re.Pattern, re.Pattern]:
    """White space, and the pieces of what stands between white space."""
    return re.compile(f"[{white}]+"), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{white}{letter}{number}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge list and ids of one tokenizer file."""

    def __init__(self, path: str, classes: tuple[str, str, str]):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] or model.get("byte_fallback"):
            raise ValueError(f"{path}: not a BPE with an end-of-word suffix and without a decoder")
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_alphabet()
        self.first = [ids[c] for c in letters]
        self.last = [ids[c + suffix] for c in letters]
        size = max(ids.values()) + 1
        self.tokens = [""] * size
        for token, i in ids.items():
            self.tokens[i] = token
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = []
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            pairs.append((ids[a], ids[b], ids[a + b]))
            self.merges[pairs[-1][:2]] = (rank, pairs[-1][2])
        self.ranked = {a << 20 | b: rank << 20 | made for (a, b), (rank, made) in self.merges.items()}
        lengths = [len(t.removesuffix(suffix)) for t in self.tokens]
        self.lookahead = sufficient_lookahead(pairs, lengths)
        self.lengths = lengths
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens += [""] * (i + 1 - len(self.tokens))
            self.tokens[i] = token
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.white, self.split = _patterns(*classes)
        self.cache = _Chunks(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merge list: always the leftmost pair of the lowest rank."""
        if len(ids) > 40:
            return self._merge_long(ids)
        get, none = self.ranked.get, _NONE
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != none:
            i, new = ranks.index(low), low & _ID
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if found := get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (found := get((ids[p], ids[q]))):
                    heapq.heappush(heap, (found[0], p, ids[p], ids[q], found[1]))
        return [x for x in ids if x >= 0]

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word of the pre-tokenizer, in UTF-8."""
        width = 4 * self.lookahead
        if len(raw) <= width:
            return self.merge([self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]])
        out, at = [], 0
        while len(raw) - at > width:
            stable, end = at + width - self.lookahead, at
            for x in self.merge([self.first[b] for b in raw[at : at + width]]):
                if end + self.lengths[x] > stable:
                    break
                out.append(x)
                end += self.lengths[x]
            at = end
        return out + self.merge([self.first[b] for b in raw[at:-1]] + [self.last[raw[-1]]])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_split and "<" in text and len(parts := self.special_split.split(text)) > 1:
            return b"".join(self.special[x].to_bytes(4, "little") if i % 2 else self.encode(x) for i, x in enumerate(parts))
        if is_latin(text):
            text = text.lower()  # fewer distinct chunks
        chunks = filter(None, self.white.split(text)) if _ODD_CONTROLS.search(text) else text.split()
        return b"".join(map(self.cache.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        return "".join(self.pieces(np.frombuffer(ids, "<u4")))

    def pieces(self, ids: np.ndarray):
        """The decoder's output in bounded pieces: nothing before the first token, one space before any other."""
        started = False
        for a in range(0, len(ids), 65536):
            part = " ".join(map(self.tokens.__getitem__, ids[a : a + 65536].tolist()))
            yield " " + part if started else part
            started = True


def is_latin(text: str) -> bool:
    """Whether no character is beyond U+00FF: there composition changes nothing, and case is folded one by one, alike in every library."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


#: What often ends a word and is a piece of its own after a letter up to U+00FF, whose classes don't change.
_ENDS = frozenset(".,;:!?")


class _Chunks(dict):
    """Ids of what stands between white space; starts anew when it is full. A word and the mark after it are looked up apart until the word comes again."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.marks = {x: self._word(x) for x in _ENDS}

    def _word(self, piece: str) -> bytes:
        return b"".join(map(self.v.packed.__getitem__, self.v.word(piece.encode("utf-8", "surrogatepass"))))

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1] in _ENDS and len(chunk) > 1 and chunk[-2] <= "\u00ff" and chunk[-2].isalpha():
            if (known := self.get(chunk[:-1])) is None:
                return self[chunk[:-1]] + self.marks[chunk[-1]]
            found = known + self.marks[chunk[-1]]
        elif is_latin(chunk):
            low = chunk.lower()
            if low.isalpha():
                if low != chunk:
                    return self[low]
                found = self._word(low)
            elif not low.isascii():
                found = b"".join(map(self._word, self.v.split.findall(low)))
            else:
                # a piece of ASCII is a chunk of its own with the same ids
                pieces = self.v.split.findall(low)
                found = b"".join(map(self.__getitem__, pieces)) if len(pieces) > 1 else self._word(pieces[0])
        else:
            found = b"".join(map(self._word, self.v.split.findall(_FOLD.normalize_str(chunk))))
        if len(chunk) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = found
        return found


def sufficient_lookahead(pairs: list[tuple[int, int, int]], lengths: list[int]) -> int:
    """Characters after which what follows can't change a token.

    The right context decides whether a rule takes its left part; that part, or the token made, may in turn be the
    right part of a later rule, which so reaches further left. The longest such chain, with ranks rising, bounds how
    far a change travels. Rules are met from the last to the first."""
    reach_of: dict[int, int] = {}  # of a token that a later rule may take as its right part
    most = 0
    for a, b, made in reversed(pairs):
        reach = max(reach_of.get(a, 0), reach_of.get(made, 0))
        most = max(most, lengths[made] + reach)
        reach_of[b] = max(reach_of.get(b, 0), lengths[a] + reach)
    return most + max(lengths)


@lru_cache(maxsize=4)
def vocabulary(path: str, classes: tuple[str, str, str] | None = None) -> Vocabulary:
    return Vocabulary(path, classes or character_classes())


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded (text) for every row."""
    bounded_batches(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    classes = character_classes()

    def run(batches):
        v = vocabulary(path, classes)
        for batch in batches:
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = v.encode(t)
                yield pa.RecordBatch.from_pydict({"doc_id": [key], "ids": [ids], "decoded": [v.decode(ids)]}, schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def encoding_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode_documents`` gives, digested where it is made."""
    bounded_batches(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    classes = character_classes()

    def run(batches):
        v = vocabulary(path, classes)
        for batch in batches:
            rows = []
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = v.encode(t.as_py())
                decoded = hashlib.sha256()
                for piece in v.pieces(np.frombuffer(ids, "<u4")):
                    decoded.update(piece.encode("utf-8"))
                rows.append((key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
