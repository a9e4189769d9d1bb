"""BPE as a bounded-lookahead transducer, and an incremental decoder.

Text arrives in chunks. Words end at word boundaries; inside a word, tokens are handed on as soon as no later
symbol can change them. How many symbols that takes is computed from the merge list (`sufficient_lookahead`):
a token changes only through a chain of merges, each stealing the right edge of the one before and each of a
lower rank, so the longest such chain bounds how far to look. A word longer than the window is merged window by
window; memory stays constant however long the word or the text is.

Null text counts as empty: no ids, and the empty string back. Nothing depends on other rows, so repeated rows,
empty tables and extra columns need no care.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache
from operator import itemgetter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = 1 << 20
CACHE = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """The number of symbols past a token's end after which nothing can change the token any more.

    `steals[x]` is the farthest that merges with x on their left, seen so far, reach past x. A merge (a, b) can be
    undone from the right by whatever steals b, or steals the right edge of b before b itself was built; only
    merges of lower rank count, so one pass in rank order finds the longest chain.
    """
    steals: dict[str, int] = {}
    edge: dict[str, int] = {}
    most, longest = 0, 1
    size = lambda s: len(s.replace("</w>", "")) or 1
    for a, b in merges:
        reach = max(steals.get(b, 0), edge.get(b, 0))
        steals[a] = max(steals.get(a, 0), size(b) + reach)
        edge[a + b] = max(edge.get(a + b, 0), reach)
        most, longest = max(most, steals[a]), max(longest, size(a + b))
    return most + longest


class Transducer:
    """Encoder and decoder of one vocabulary file of the tokenizers library (BPE with word ends, lower case)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.surface = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.lookahead = sufficient_lookahead(merges)
        self.window = max(256, 4 * self.lookahead)
        self.letter = byte_letters()
        split = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split, self.words, self.late_lower = split, None, {}
        self.ascii_words = re.compile(split.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}a-z0-9]"))
        # texts of Latin letters and common punctuation, without superscript digits and fractions, need no Unicode tables
        latin = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
        self.beyond_latin = re.compile("[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2000-\u206f]")
        self.latin_words = re.compile(split.replace(r"[\p{L}]", f"[{latin}]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{latin}0-9]"))
        self.marks = re.compile("|".join(f"({re.escape(s)})" for s in self.special) or "(?!)")
        self.safe = re.compile(f"[{SPACE}]")
        self.memo: dict[str, bytes] = {}

    # -- encoding ---------------------------------------------------------

    def _merged(self, parts: list[str]) -> list[str]:
        """All merges of a short run of symbols: the lowest rank first, the leftmost of equals."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap, for runs in which scanning anew after each merge would be slow."""
        rank, n = self.rank, len(parts)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] >= 0 and (r := rank.get((parts[k], parts[nxt[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[nxt[k]]))
        return [p for p in parts if p]

    def word_tokens(self, word: str) -> Iterator[str]:
        """Tokens of one word, each as soon as it is stable; at most a window of symbols is held."""
        letter = self.letter
        raw = word.encode()
        held: list[str] = []
        for at in range(0, len(raw), self.window):
            held += [letter[b] for b in raw[at : at + self.window]]
            if at + self.window >= len(raw):
                break
            tokens = self._merged_long(held.copy())
            end, stable = 0, 0
            for t in tokens:
                if end + len(t) > len(held) - self.lookahead:
                    break
                end += len(t)
                stable += 1
            yield from tokens[:stable]
            held = held[end:]
        if held:
            held[-1] += self.suffix
            yield from self._merged(held) if len(held) < 24 else self._merged_long(held)

    def _known(self, word: str) -> bytes:
        """Ids of one word as little-endian bytes, kept for the next time it comes."""
        tokens = list(self.word_tokens(word))
        got = struct.pack(f"<{len(tokens)}I", *(self.vocab[t] for t in tokens))
        if len(word) <= 64:
            if len(self.memo) >= CACHE:
                self.memo.clear()
            self.memo[word] = got
        return got

    def _chunks(self, text: str) -> Iterator[str]:
        """The text in pieces that end before white space, where no word and no composed character reaches across."""
        at = 0
        while len(text) - at > CHUNK:
            m = self.safe.search(text, at + CHUNK)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            from tokenizers import normalizers  # its tables of combining marks are older than the standard library's

            text = normalizers.NFC().normalize_str(text)
        text = text.replace("Σ", "σ").lower()
        if not self.beyond_latin.search(text):
            return self.latin_words.findall(text)
        self.words = self.words or self._all_words()
        return self.words.findall(text.translate(self.late_lower) if self.late_lower else text)

    def _all_words(self) -> regex.Pattern:
        """The splitting pattern over all of Unicode. Characters that are letters or digits to the regex library and not yet to the standard library are as old as the tokenizers library says."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        new = [c for c in map(chr, range(0x250, 0x110000)) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
        lower = normalizers.Lowercase()
        self.late_lower = str.maketrans({c: x for c in new if (x := lower.normalize_str(c)) != c})
        inside = {x for x, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str("".join(new))}
        late = "".join(regex.escape(c) for c in new if c not in inside)
        known = lambda kind: f"[[\\p{{{kind}}}]--[{late}]]" if late else f"[\\p{{{kind}}}]"
        other = f"[[^{SPACE}\\p{{L}}\\p{{N}}]||[{late}]]" if late else f"[^{SPACE}\\p{{L}}\\p{{N}}]"
        return regex.compile(self.split.replace(r"[^\s\p{L}\p{N}]", other).replace(r"[\p{L}]", known("L")).replace(r"[\p{N}]", known("N")), regex.V1)

    def pieces(self, text: str | None) -> Iterator[list[str] | int]:
        """The words of a text, stretch by stretch, and between them the ids of special tokens."""
        for chunk in self._chunks(text or ""):
            at = 0
            for m in self.marks.finditer(chunk) if "<" in chunk else ():
                yield self._words(chunk[at : m.start()])
                yield self.special[m[0]]
                at = m.end()
            yield self._words(chunk[at:] if at else chunk)

    def stream(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text as little-endian bytes, one stretch of it after another."""
        memo, known = self.memo, self._known
        for part in self.pieces(text):
            if isinstance(part, int):
                yield struct.pack("<I", part)
            else:
                yield b"".join([memo.get(w) or known(w) for w in part])

    def encode_bytes(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text pieces for ids, as they come; see Decoder."""
        state = Decoder(self)
        for i in ids:
            yield state.surfaces((i,)).decode()

    def readable(self, ids: Iterable[int]) -> Iterator[str]:
        """The words themselves, as far as their characters are whole; see Decoder."""
        state = Decoder(self)
        for i in ids:
            yield state.text((i,))
        yield state.text((), final=True)

    @cached_property
    def surface_bytes(self) -> list[bytes | None]:
        """The surface of each id; None where the vocabulary has a gap."""
        return [self.surface[i].encode() if i in self.surface else None for i in range(max(self.surface) + 1)]

    @cached_property
    def text_bytes(self) -> list[bytes | None]:
        """What each id stands for: its letters back to bytes, the end of a word to a space."""
        byte = {c: b for b, c in enumerate(self.letter)}
        out: list[bytes | None] = [None] * (max(self.surface) + 1)
        for i, s in self.surface.items():
            ends = bool(self.suffix) and s.endswith(self.suffix)
            out[i] = bytes(byte[c] for c in (s[: -len(self.suffix)] if ends else s)) + b" " * ends
        return out

    def digests(self, text: str | None) -> tuple[int, str, str, str]:
        """Number of ids, SHA-256 of the ids, of what the library decodes them to, and of the text they stand for. Each stretch is decoded from its ids as it comes, in constant memory but for the stretch in hand."""
        ids, out, plain, n, state = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), 0, Decoder(self)
        for part in self.stream(text):
            ids.update(part)
            numbers = memoryview(part).cast("I").tolist()
            out.update(state.surfaces(numbers))
            plain.update(state.text(numbers).encode())
            n += len(numbers)
        plain.update(state.text((), final=True).encode())
        return n, ids.hexdigest(), out.hexdigest(), plain.hexdigest()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        return self.digests(text)[:3]


class Decoder:
    """Ids to text, as they come. Ids outside the vocabulary stand for nothing.

    Two states are carried from one stretch of ids to the next: whether a token came before, as the library puts a
    space between the surfaces of tokens (the vocabulary file names no decoder); and the bytes of a character that is
    not whole yet, where tokens are turned back into the text they stand for.
    """

    def __init__(self, t: Transducer):
        self.surface, self.bytes = t.surface_bytes, t.text_bytes
        self.started, self.open = False, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def surfaces(self, ids: Sequence[int]) -> bytes:
        """What the library's decode adds for these ids, in UTF-8."""
        try:
            got = itemgetter(*ids)(self.surface) if len(ids) > 1 else [self.surface[i] for i in ids]
            out = b" ".join(got)
        except (IndexError, TypeError):  # ids outside the vocabulary
            got = [self.surface[i] for i in ids if 0 <= i < len(self.surface) and self.surface[i] is not None]
            out = b" ".join(got)
        lead = b" " if self.started and got else b""
        self.started = self.started or bool(got)
        return lead + out

    def text(self, ids: Sequence[int], final: bool = False) -> str:
        """The characters that these ids make whole."""
        try:
            raw = b"".join(itemgetter(*ids)(self.bytes)) if len(ids) > 1 else b"".join([self.bytes[i] for i in ids])
        except (IndexError, TypeError):
            raw = b"".join([self.bytes[i] for i in ids if 0 <= i < len(self.bytes) and self.bytes[i] is not None])
        return self.open.decode(raw, final=final)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each Python worker."""
    return Transducer(path)


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array<int> column of ids."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        import numpy as np

        t = transducer(path)
        return pd.Series([np.frombuffer(t.encode_bytes(x), dtype="<i4") for x in s])

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, vocabulary: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text that the library's decode gives for a column of ids (null: empty)."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        t = transducer(path)
        return pd.Series(["".join(t.decode(map(int, x))) if x is not None else "" for x in s])

    return docs.withColumn(out, text(F.col(ids)))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256 of every whole text; the last is of the words that the ids stand for, each with a space after it."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string")
    def both(s: pd.Series) -> pd.DataFrame:
        t = transducer(path)
        return pd.DataFrame([t.digests(x) for x in s], columns=["n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"])

    return docs.select("doc_id", both(F.col("text")).alias("d")).select("doc_id", "d.*")
