"""Operator 2: license scans by template-markup matching.

Templates are license texts and notices with markup: ``[[ ... ]]`` is optional wording, ``{{n}}`` a
replaceable region of at most n words; regions may be nested in optional wording. Each template
compiles into a token automaton over words. A place matches when a run of words from there is
accepted, that is, when all mandatory wording stands there exactly; the words of a replaceable
region are free. A text is read once: hashed words find the places where a template can begin, and
only there the automaton runs.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The base labels are fixed phrases whose
words stand consecutively; the templates add labels. A null or empty text has no words and no
label, score 0. Rows that repeat get the same answer; other columns pass through, result columns
take a spare name where the input has one of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skywatch.llm.common import LETTERED, LOWER, U64, find_words, rows_of, spare_name, text_bytes, word_hashes

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Wording of public licenses and notices, with markup.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{20}} BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND {{12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1.]] Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    "apache-2-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {{6}} except in
        compliance with the License. You may obtain a copy of the License at""",
    "apache-2": "[[Licensed | Released | Distributed]] under the [[terms of the]] Apache License, [[Version]] 2[[.0]]",
    "mit": "[[Licensed | Released | Distributed]] under the [[terms of the]] MIT [[(Expat)]] License",
    "gpl": """under the [[terms of the]] GNU [[Lesser | Affero]] General Public License [[as published by the Free Software
        Foundation]] [[, either]] version {{1}}""",
    "cc-by-nc": "[[licensed]] under [[a | the]] [[Creative Commons]] CC BY-NC [[{{2}}]]",
    "cc-by-nc-text": "Creative Commons Attribution-NonCommercial [[{{2}}]] License",
    "all-rights-reserved": "All rights reserved",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1.]] Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. [[ [[3.]] Neither the name of {{12}} nor the names of
        [[its | their]] contributors may be used to endorse or promote products derived from this software without
        specific prior written permission. ]] THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
        IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND {{12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will {{8}} be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: [[1.]] The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. [[2.]] Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. [[3.]] This notice may not be removed or
        altered from any source distribution.""",
    "apache-2-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {{6}} except in
        compliance with the License. You may obtain a copy of the License at {{8}} Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-text": """{{3}} is free software[[:|;]] you can redistribute it and/or modify it under the terms of the GNU
        [[Lesser | Affero | Library]] General Public License as published by the Free Software Foundation[[,]] either
        version {{2}} of the License, or (at your option) any later version. {{3}} is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU [[Lesser | Affero | Library]] General Public License for more details.""",
    "mpl-2-text": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
    "cc-by-text": "licensed under [[a | the]] Creative Commons Attribution [[ShareAlike]] {{1}} {{1}} [[International | Unported]] License",
}

#: Words of matched wording that score one half.
WORDING = 10

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def hashes_of(words: list[str]) -> list[int]:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    return word_hashes(raw, ends - np.array([len(d) for d in data]), ends).tolist() if data else []


# -- templates to automata -----------------------------------------------------------------------


@dataclass
class Automaton:
    """States with moves on a word (by hash), on any word, and without one."""

    on: list[dict[int, int]] = field(default_factory=list)
    on_any: list[int] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    accept: int = 0

    def state(self) -> int:
        self.on.append({})
        self.on_any.append(-1)
        self.free.append([])
        return len(self.on) - 1

    def reach(self, states) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo.extend(self.free[s])
        return frozenset(seen)

    def first_words(self) -> set[int]:
        return {h for s in self.reach([0]) for h in self.on[s]}

    def match(self, words: np.ndarray, at: int, end: int) -> int:
        """Words of the longest accepted run from ``at`` (0: none)."""
        now, best = self.reach([0]), 0
        for i in range(at, end):
            following = set()
            word = int(words[i])
            for s in now:
                t = self.on[s].get(word)
                if t is not None:
                    following.add(t)
                if self.on_any[s] >= 0:
                    following.add(self.on_any[s])
            if not following:
                break
            now = self.reach(following)
            if self.accept in now:
                best = i + 1 - at
        return best


def compile_template(text: str) -> Automaton:
    """The automaton of one template. ``[[a | b]]`` takes either wording, or none."""
    out = Automaton()
    out.state()
    parts = re.split(r"(\[\[|\]\]|\||\{\{\d+\}\})", text)
    here = 0
    open_: list[tuple[int, list[int]]] = []  # start of each open region, ends of its wordings
    for part in parts:
        if part == "[[":
            open_.append((here, [here]))
        elif part == "|" and open_:
            open_[-1][1].append(here)
            here = open_[-1][0]
            start = out.state()
            out.free[here].append(start)
            here = start
        elif part == "]]":
            _, ends = open_.pop()
            last = out.state()
            for e in {*ends, here}:
                out.free[e].append(last)
            here = last
        elif part.startswith("{{"):
            last = out.state()
            out.free[here].append(last)
            for _ in range(int(part[2:-2])):
                following = out.state()
                out.on_any[here] = following
                out.free[following].append(last)
                here = following
            here = last
        else:
            for h in hashes_of(words_of(part)):
                following = out.state()
                if h in out.on[here] or out.on_any[here] >= 0:
                    branch = out.state()
                    out.free[here].append(branch)
                    here = branch
                out.on[here][h] = following
                here = following
    if open_:
        raise ValueError("an optional region is not closed")
    out.accept = here
    if out.accept in out.reach([0]):
        raise ValueError("a template needs mandatory wording")
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases = [(np.array(hashes_of(words_of(p)), U64), label) for p, label in phrases.items()]
        self.automata = [(label, compile_template(t)) for label, t in templates.items()]
        begins = [a.first_words() for _, a in self.automata]
        needs = [set(self._mandatory(t)) for t in templates.values()]
        #: All words that matter, in order of their hashes; below, words are their places in it.
        self.named = np.array(sorted({*(int(p[0]) for p, _ in self.phrases)}.union(*begins, *needs)), U64)
        where = {int(w): k for k, w in enumerate(self.named)}
        #: The words that a match of each template can begin with, and those it cannot lack.
        self.begins = [(label, a, [where[w] for w in b]) for (label, a), b in zip(self.automata, begins)]
        self.needs = [[where[w] for w in sorted(n)] for n in needs]

    @staticmethod
    def _mandatory(template: str) -> list[int]:
        depth, out = 0, []
        for part in re.split(r"(\[\[|\]\]|\{\{\d+\}\})", template):
            if part == "[[":
                depth += 1
            elif part == "]]":
                depth -= 1
            elif depth == 0 and not part.startswith("{{"):
                out += hashes_of(words_of(part))
        return out

    def scan(self, raw: np.ndarray, offsets: np.ndarray):
        """Per text: words, base places, first and last base place, base labels, all labels, score."""
        raw = LOWER[raw]
        starts, ends, first = find_words(raw, offsets, LETTERED)
        h = word_hashes(raw, starts, ends)
        rows = len(offsets) - 1
        n_words = np.diff(first)
        # Places of words that any phrase or template names, and the texts that hold each.
        name = np.minimum(np.searchsorted(self.named, h), len(self.named) - 1)
        place = np.flatnonzero(self.named[name] == h)
        name = name[place]
        row = rows_of(place, first)
        order = np.argsort(name, kind="stable")
        cut = np.searchsorted(name[order], np.arange(len(self.named) + 1))

        def places(word: int) -> np.ndarray:
            """Indexes into ``place`` of one named word, in order."""
            return order[cut[word] : cut[word + 1]]

        count, low, high = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        base: dict[int, set[str]] = {}
        longest = np.zeros(rows, np.int64)  # words of the longest wording found
        for phrase, label in self.phrases:
            k = len(phrase)
            at = place[places(int(np.searchsorted(self.named, phrase[0])))]
            at = at[at + k <= len(h)]
            for j in range(1, k):
                at = at[h[at + j] == phrase[j]]
            r = rows_of(at, first)
            whole = at + k <= first[r + 1]
            at, r = at[whole], r[whole]
            np.add.at(count, r, 1)
            np.minimum.at(low, r, at - first[r])
            np.maximum.at(high, r, at - first[r])
            for i in np.unique(r).tolist():
                base.setdefault(i, set()).add(label)
            longest[r] = np.maximum(longest[r], k)
        found: dict[int, set[str]] = {}
        holders: dict[int, np.ndarray] = {}

        def texts_with(word: int) -> np.ndarray:
            if word not in holders:
                holders[word] = np.unique(row[places(word)])
            return holders[word]

        for (label, automaton, begin), needs in zip(self.begins, self.needs):
            # A text must hold every mandatory word; the word of the fewest texts is checked first.
            sets = sorted((texts_with(w) for w in needs), key=len)
            texts = sets[0]
            for more in sets[1:]:
                if not len(texts):
                    break
                texts = np.intersect1d(texts, more, assume_unique=True)
            if not len(texts):
                continue
            tried = np.sort(np.concatenate([places(w) for w in begin]))
            tried = tried[np.isin(row[tried], texts)]
            for i, r in zip(place[tried].tolist(), row[tried].tolist()):
                if label not in found.get(r, ()) and (run := automaton.match(h, i, int(first[r + 1]))):
                    found.setdefault(r, set()).add(label)
                    longest[r] = max(longest[r], run)
        labels = [base.get(i, set()) | found.get(i, set()) for i in range(rows)]
        score = (longest / (longest + WORDING)).tolist()
        return n_words, count, low, high, [",".join(sorted(base.get(i, ()))) for i in range(rows)], [",".join(sorted(x)) for x in labels], score


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words``, base places (``n_base``, ``first_word``, ``last_word``), ``base_labels``,
    ``labels`` and ``score``: how much wording matched, ``n / (n + WORDING)`` for the n words of the longest
    run that a template (at its first place in the text) or a base phrase accepted."""
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.DoubleType())
    names = [spare_name(r, docs.columns) for r in RESULTS]
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(batches):
        scanner = Scanner(phrases, templates)
        for whole in batches:
            at = text_bytes(whole.column(text_col))[1]
            i = 0
            while i < whole.num_rows:
                j = min(max(int(np.searchsorted(at, at[i] + (2 << 20), "right")) - 1, i + 1), whole.num_rows)
                batch = whole.slice(i, j - i)
                n_words, count, low, high, base, labels, score = scanner.scan(*text_bytes(batch.column(text_col)))
                none = count == 0
                made = [
                    pa.array(n_words, pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(low, pa.int64(), mask=none),
                    pa.array(high, pa.int64(), mask=none),
                    pa.array(base, pa.string()),
                    pa.array(labels, pa.string()),
                    pa.array(score, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)
                i = j

    return docs.mapInArrow(run, schema)
