"""Licence scans: exact phrases, and a fuzzy search for short notices.

A notice of n characters may differ in up to a tenth of them. Cut into one piece more than the errors allowed, at
least one piece must stand in the text unchanged (pigeonhole), so an Aho-Corasick automaton over all pieces finds
every place where a notice can be; the regex library's bounded-error matching then checks the stretch around each
seed and gives the span and the number of edits.

Only A-Z are lower-cased. Null texts count as empty: no words, no labels, a score of 0. Texts are judged one by one,
so repeated rows, empty tables and extra columns need no care; texts of any length are searched whole. Matches that start
at the same place come by their end, then in the order of the notices; of the same label each counts once in `labels`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the apache license, version 2.0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by-nc 4.0", "cc-by-nc"),
    ("creative commons attribution-noncommercial 4.0", "cc-by-nc"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
)
ERRORS = 0.1
WORD = rb"0-9a-z\x80-\xff"
IS_WORD = np.zeros(256, dtype=np.int8)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Notice:
    text: str
    label: str
    errors: int = 0
    pieces: list[tuple[str, int]] = field(default_factory=list)
    check: regex.Pattern | None = None


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES, errors: float = ERRORS):
        import ahocorasick

        self.phrases = [(re.compile(rb"(?<![" + WORD + rb"])" + (rb"[^" + WORD + rb"]+").join(re.escape(w.encode()) for w in p.split()) + rb"(?![" + WORD + rb"])"), label) for p, label in phrases]
        self.notices, self.automaton = [], ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (text, label) in enumerate(notices):
            n = Notice(text, label, int(len(text) * errors))
            at = [round(k * len(text) / (n.errors + 1)) for k in range(n.errors + 2)]
            n.pieces = [(text[a:b], a) for a, b in zip(at, at[1:])]
            n.check = regex.compile(rf"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={n.errors}}}")
            for piece, a in n.pieces:
                seeds.setdefault(piece, []).append((i, a))
            self.notices.append(n)
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def spans(self, low: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, notice number) of every notice in a lower-cased text, by position."""
        around: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(low):
            for i, a in where:
                n = self.notices[i]
                start = end + 1 - size - a
                lo, hi = max(0, start - n.errors), min(len(low), start + len(n.text) + n.errors)
                if hi - lo < len(n.text) - n.errors:
                    continue
                runs = around.setdefault(i, [])
                if runs and lo <= runs[-1][1]:
                    runs[-1] = [min(lo, runs[-1][0]), max(hi, runs[-1][1])]
                else:
                    runs.append([lo, hi])
        found = []
        for i, runs in around.items():
            n = self.notices[i]
            for lo, hi in runs:
                for m in n.check.finditer(low, lo, hi):
                    found.append((n.label, m.start(), m.end(), sum(m.fuzzy_counts), i))
        return sorted(found, key=lambda x: (x[1], x[2], x[4]))

    def scan(self, text: str | None) -> tuple:
        """The columns of `scans` but doc_id."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        word = IS_WORD[np.frombuffer(raw, dtype=np.uint8)]
        begins = np.flatnonzero(np.diff(word, prepend=np.int8(0)) == 1) if len(raw) else np.zeros(0, dtype=np.int64)
        places, base = [], set()
        for pattern, label in self.phrases:
            for m in pattern.finditer(raw):
                places.append(int(np.searchsorted(begins, m.start())))
                base.add(label)
        found = self.spans(raw.decode("utf-8", "surrogatepass"))
        score = max([1.0 if places else 0.0, *(1 - edits / len(self.notices[i].text) for _, _, _, edits, i in found)])
        labels = base | {f[0] for f in found}
        spans = [{"label": f[0], "start": f[1], "end": f[2], "edits": f[3]} for f in found]
        return len(begins), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


@lru_cache(maxsize=4)
def scanner(notices: tuple[tuple[str, str], ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES, errors: float = ERRORS) -> Scanner:
    """One for each Python worker and set of notices."""
    return Scanner(notices, phrases, errors)


def scans(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES, errors: float = ERRORS) -> DataFrame:
    """With any (lower-case text, label) notices and phrases, and the share of a notice that may differ: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, end, edits; in characters) of every whole text."""
    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, edits: int>>"
    names = [c.split()[0] for c in kind.split(", ")[:8]]

    @F.pandas_udf(kind)
    def scanned(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scanner(notices, phrases, errors).scan(t) for t in s], columns=names)
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        return out

    return docs.select("doc_id", scanned("text").alias("s")).select("doc_id", "s.*")
