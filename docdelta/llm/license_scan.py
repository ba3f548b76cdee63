"""License scans: a generalised suffix automaton over licence word sequences.

All phrases and notices go into one automaton. Each document's words are streamed through it, which gives
the matching statistics: the longest licence passage that ends at each word. Long matches are chained,
in order in the text and in the notice, into the span that a notice covers.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import arrow_map, utf8

# Phrases that name a licence when their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Licence texts and notices, in words, and the words that tell a licence from its like.
_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_ENDORSE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GNU = "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation either version {2} of the license or at your option any later version {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1}general public license for more details"
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ()),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ()),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ()),
    ("bsd-2", f"{_BSD} {_AS_IS}", ()),
    ("bsd-3", f"{_BSD} {_ENDORSE} {_AS_IS}", ("neither the name",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ()),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("license version 2",)),
    *((f"{name}-{version.replace(' ', '.').removesuffix('.0')}", _GNU.format("this program" if name == "gpl" else "this library" if name == "lgpl" else "this program", kind, version), (f"either version {version}", f"gnu {kind}general"))
      for name, kind, versions in (("gpl", "", ("2", "3")), ("lgpl", "lesser ", ("2 1", "3")), ("agpl", "affero ", ("3",))) for version in versions),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("license v 2",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ()),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ()),
    ("mit", "released under the mit license", ("mit",)),
    ("apache-2", "licensed under the apache license version 2 0", ("version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("noncommercial",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("attribution 4",)),
    *((f"{name}-{version}", f"licensed under the gnu {kind}general public license version {version}", (f"version {version}", f"gnu {kind}general"))
      for name, kind, versions in (("gpl", "", "23"), ("lgpl", "lesser ", "23"), ("agpl", "affero ", "3")) for version in versions),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("v 2",)),
    *((label, f"spdx license identifier {words}", (f"identifier {words}",)) for label, words in (("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("isc", "isc"), ("mpl-2", "mpl 2 0"))),
    ("mit", "licensed under the terms of the mit license", ("the mit",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("sharealike",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("by sa",)),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ("noderivatives",)),
    # How the whole texts begin.
    ("gpl-2", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", ("license version 2 june 1991",)),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu general public license version 3",)),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc", ("version 2 1 february 1999",)),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu lesser general public license version 3",)),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", ("version 3 19 november",)),
    ("mpl-2", "mozilla public license version 2 0 1 definitions", ("public license version 2",)),
    *((f"{name}-{version.replace(' ', '.').removesuffix('.0')}", f"{name} {version} {more}", (f"{name} {version} {more}",))
      for name, versions in (("gpl", ("2 0", "3 0")), ("lgpl", ("2 1", "3 0")), ("agpl", ("3 0",))) for version in versions for more in ("only", "or later")),
]

# Identifiers in SPDX expressions, in words.
SPDX = {
    "mit": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "apache 2 0": "apache-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "mpl 2 0": "mpl-2",
    "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3",
    "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd",
}
_SPDX = {tuple(words.encode().split()): label for words, label in SPDX.items()}
_SPDX_LENGTHS = sorted({len(words) for words in _SPDX}, reverse=True)

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return text.lower().translate(_TO_SPACE).split()


class Automaton:
    """Suffix automaton of several word sequences. It holds the licences only, never a document."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set] = [set()]  # (sequence, place of its last word)
        for number, words in enumerate(sequences):
            at = 0
            for place, word in enumerate(words):
                at = self._extend(at, word)
                self.ends[at].add((number, place))
        for state in sorted(range(len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        self.words = set().union(*map(set, sequences)) if sequences else set()
        self.whole: list[list[int]] = [[] for _ in self.next]  # sequences that are this state's longest string
        for number, words in enumerate(sequences):
            at = 0
            for word in words:
                at = self.next[at][word]
            self.whole[at].append(number)

    def ending(self, state: int, length: int) -> Iterator[int]:
        """Sequences that stand as a whole at the end of a match: those on the state's suffix links."""
        while state > 0:
            if self.length[state] <= length:
                yield from self.whole[state]
            state = self.link[state]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state for ``word`` after ``at`` with exactly one word more than ``at``."""
        old = self.next[at][word]
        if self.length[old] == self.length[at] + 1:
            return old
        new = self._state(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def _extend(self, at: int, word: bytes) -> int:
        if word in self.next[at]:
            return self._split(at, word)
        new = self._state(self.length[at] + 1, {}, 0)
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest match that ends there), where that length is not 0."""
        state = length = 0
        moves, link, longest, known = self.next, self.link, self.length, self.words
        for i, word in enumerate(words):
            if word not in known:
                state = length = 0
                continue
            while state and word not in moves[state]:
                state = link[state]
                length = longest[state]
            state = moves[state].get(word, 0)
            length = length + 1 if state else 0
            if state:
                yield i, state, length


def chain_ends(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """For each of the sorted matches (text start, notice start, length) the best chain that ends with it: (words
    covered, first word, last word)."""
    best: list[tuple[int, int, int]] = []
    reach = gap + max((n for _, _, n in matches), default=0)
    for k, (t, p, n) in enumerate(matches):
        own = (n, t, t + n - 1)
        for j in range(k - 1, -1, -1):
            t0, p0, n0 = matches[j]
            if t0 < t - reach:  # matches are sorted; what starts earlier ends too early
                break
            if t0 + n0 <= t <= t0 + n0 + gap and p0 + n0 <= p and best[j][0] + n >= own[0]:
                own = (best[j][0] + n, best[j][1], t + n - 1)
        best.append(own)
    return best


def chained(matches: list[tuple[int, int, int]], gap: int, least: float) -> tuple[int, list[tuple[int, int, int]]]:
    """Most words that a chain covers, and (words covered, first word, last word) of chains that cover ``least`` or more.

    These do not overlap: the best goes first, of equal ones the earliest. What it leaves is chained anew on each side of it.
    """
    most, spans = 0, []
    parts = [sorted(matches)]
    while parts:
        part = parts.pop()
        best = chain_ends(part, gap)
        most = max(most, max((covered for covered, _, _ in best), default=0))
        taken: list[tuple[int, int]] = []
        for covered, first, last in sorted((x for x in best if x[0] >= least), key=lambda x: (-x[0], x[1])):
            at = bisect(taken, (first, last))
            if (not at or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                taken.insert(at, (first, last))
                spans.append((covered, first, last))
        if taken:
            left: dict[int, list] = {}
            for t, p, n in part:
                at = bisect(taken, (t + n - 1, math.inf))
                if not at or taken[at - 1][1] < t:
                    left.setdefault(at, []).append((t, p, n))
            parts += left.values()
    return most, sorted(spans, key=lambda x: x[1:])


def best_notices(spans: list[tuple[int, int, int, float, int]]) -> list[tuple[int, int, int, float, int]]:
    """Of spans (words covered, first word, last word, share covered, notice) that overlap, the one that covers most
    words stays, then that of the greatest share, then the earliest of the first notice."""
    taken: list[tuple[int, int, int, float, int]] = []
    starts: list[tuple[int, int]] = []
    for span in sorted(spans, key=lambda x: (-x[0], -x[3], x[1], x[4])):
        _, first, last, _, _ = span
        at = bisect(starts, (first, last))
        if (not at or starts[at - 1][1] < first) and (at == len(starts) or last < starts[at][0]):
            starts.insert(at, (first, last))
            taken.append(span)
    return taken


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    """Whether the words of a phrase stand consecutively."""
    return any(words[k : k + len(phrase)] == phrase for k, word in enumerate(words) if word == phrase[0])


def spdx_expressions(words: list[bytes]) -> Iterator[tuple[str, int, int]]:
    """(label, first word, last word) of every identifier of the expressions behind ``spdx`` or ``spdx license identifier``."""
    for start, word in enumerate(words):
        if word != b"spdx":
            continue
        at = start + 3 if words[start + 1 : start + 3] == [b"license", b"identifier"] else start + 1
        while at < len(words):
            size = next((n for n in _SPDX_LENGTHS if tuple(words[at : at + n]) in _SPDX), 0)
            if not size:
                break
            yield _SPDX[tuple(words[at : at + size])], at, at + size - 1
            at += size
            at += 1 if words[at : at + 1] == [b"only"] else 2 if words[at : at + 2] == [b"or", b"later"] else 0
            if words[at : at + 1] not in ([b"or"], [b"and"]):
                break
            at += 1


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: list[tuple[str, str, tuple[str, ...]]] = NOTICES,
    least: int = 4,
    gap: int = 12,
    coverage: float = 0.7,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text); other columns are left out.

    Phrases count at every place where they stand. A notice (label, words, needed phrases) is found where chained
    matches of ``least`` or more words, at most ``gap`` words apart, cover ``coverage`` of it and all its needed
    phrases stand in the span or the three words behind it. Of notices found at overlapping places the best one
    counts (``best_notices``) and gives its label and a span, so a notice that stands often has many. Identifiers of
    SPDX expressions are labels too. ``score`` is the best share covered of any notice whose needed phrases stand in
    the text, 1 where a phrase or an identifier stands. Spans are (label, first word, last word) as
    ``label:first-last``, joined by semicolons. A null or empty text has no words, labels or spans and the score
    0; a null doc_id is kept; repeated rows give repeated results.
    """
    for text in (*phrases, *(n[1] for n in notices)):
        if not text.split():
            raise ValueError("a phrase or notice has no words")
    needed = [[x.encode().split() for x in n[2]] for n in notices]
    notices = [n[:2] for n in notices]
    order = [*phrases.items(), *((text, label) for label, text in notices)]
    sequences = [text.encode().split() for text, _ in order]
    n_phrases = len(phrases)
    shortest = min(map(len, sequences[:n_phrases]), default=1)
    machine = Automaton(sequences)

    def scan(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            words = words_of(text)
            places: list[tuple[int, int]] = []
            peaks: list[tuple[int, int, int]] = []
            for i, state, length in machine.statistics(words):
                if length >= least:
                    if peaks and peaks[-1][0] == i - 1 and peaks[-1][2] == length - 1:
                        peaks.pop()
                    peaks.append((i, state, length))
                if length >= shortest:
                    places += [(i + 1 - len(sequences[n]), n) for n in machine.ending(state, length) if n < n_phrases]
            by_notice: dict[int, list] = {}
            for i, state, length in peaks:
                for n, p in machine.ends[state]:
                    if n >= n_phrases:
                        by_notice.setdefault(n, []).append((i + 1 - length, p + 1 - length, length))
            chains, score = [], 1.0 if places else 0.0
            for n, matches in by_notice.items():
                size = len(sequences[n])
                most, spans = chained(matches, gap, coverage * size - 1e-9)
                if most > score * size and all(holds(words, phrase) for phrase in needed[n - n_phrases]):
                    score = min(1.0, most / size)
                for covered, first, last in spans:
                    near = words[first : last + 4]
                    if all(holds(near, phrase) for phrase in needed[n - n_phrases]):
                        chains.append((covered, first, last, covered / size, n))
            found = [(order[n][1], first, last) for _, first, last, _, n in best_notices(chains)]
            identifiers = list(spdx_expressions(words)) if b"spdx" in words else []
            found += identifiers
            score = 1.0 if identifiers else score
            base = sorted({order[n][1] for _, n in places})
            labels = sorted({*base, *(label for label, _, _ in found)})
            starts = [p for p, _ in places]
            yield (
                doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels),
                float(score), ";".join(f"{x}:{a}-{b}" for x, a, b in sorted(set(found), key=lambda f: (f[1], f[2], f[0]))),
            )

    return arrow_map(
        docs.select("doc_id", utf8()), scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string",
    )
