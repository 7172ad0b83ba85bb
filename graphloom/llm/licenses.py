"""License scans by template-markup matching.

A template is a license's wording with marked regions: `[[optional words]]` may be left
out, `{{name;words}}` may be replaced by one to `REPLACEMENT` other words; where one stands
before the first mandatory word, the nearest word that it can begin at is reported, as the
words before that match as well. Regions don't nest: such a template is an error. Each
template is compiled to an automaton over tokens, simulated as a set of states: mandatory words
step to the next state, optional regions may be jumped over, replaceable ones may loop.
A text is accepted where all mandatory wording stands word for word.

An automaton runs only from the places of a template's first mandatory words, and only
in texts that hold the template's rarest mandatory phrase, so most texts cost a
substring search. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased.

Cases: null and empty texts have no words and no labels; overlapping and repeated
notices each count; an empty table gives no rows; repeated rows are scanned as often as
they occur; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, arrow_map, text_bytes

# The phrases of the base scan, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices in template markup, by label.
TEMPLATES = {
    "mit-notice": "{{verb;released}} under the [[terms of the]] MIT license",
    "apache-2.0-notice": "licensed under the apache license [[version]] 2.0",
    "gpl-3.0-notice": "licensed under the [[terms of the]] gnu general public license [[version]] 3 [[or later]]",
    "gpl-2.0-notice": "licensed under the [[terms of the]] gnu general public license [[version]] 2 [[or later]]",
    "cc-by-nc-4.0": "licensed under [[the]] [[a]] cc by nc 4.0",
    "cc-by-4.0": "licensed under [[the]] [[a]] cc by 4.0",
    "all-rights-reserved": "all rights reserved",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-grant": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
}
# Whole license texts in template markup, by label.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{holder;THE AUTHORS OR COPYRIGHT HOLDERS}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
[[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY {{holder;THE COPYRIGHT HOLDERS AND CONTRIBUTORS}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{holder;THE COPYRIGHT HOLDER OR CONTRIBUTORS}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "mit-text": _MIT_BODY,
    "bsd-2-clause-text": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause-text": _BSD_HEAD
    + """[[3.]] Neither the name of {{holder;the copyright holder}} nor the names of [[its]] [[any]] contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
    + _BSD_TAIL,
    "isc-text": """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND {{holder;THE AUTHOR}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{holder;THE AUTHOR}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0-header-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the author[[s]] be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
[[1.]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
[[2.]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
[[3.]] This notice may not be removed or altered from any source distribution.""".replace("author[[s]]", "{{holder;authors}}"),
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
#: Words that may stand in a replaceable region.
REPLACEMENT = 8

_TABLE = bytes(32 if NOT_WORD[LOWER[b]] else int(LOWER[b]) for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """steps[i]: ("word", w) goes to i+1 on w; ("any", n) takes 1 to n words; ("skip", j) goes on or to j."""

    label: str
    steps: list[tuple] = field(default_factory=list)
    lead: int = 0  # replaceable regions before the first mandatory word
    anchor: bytes = b""  # the longest run of mandatory words
    first: bytes = b""  # the first mandatory word
    starts: frozenset[bytes] = frozenset()  # the words that a match may begin with, but for replaceable ones

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        out = cls(label)
        bare = re.sub(r"\[\[(?:(?!\[\[|\{\{|\]\]).)*\]\]|\{\{(?:(?!\[\[|\{\{|\}\}).)*\}\}", " ", template, flags=re.S)
        if re.search(r"[\[\]{}]", bare):
            raise ValueError(f"template {label} has a region inside another, or one that isn't closed")
        runs: list[list[bytes]] = [[]]
        for part in re.findall(r"(?s)\[\[.*?\]\]|\{\{.*?\}\}|[^\[{]+", template):
            if part.startswith("[["):
                inner = words(part.encode())
                out.steps += [("skip", len(out.steps) + 1 + len(inner)), *(("word", w) for w in inner)]
                runs.append([])
            elif part.startswith("{{"):
                out.steps.append(("any", REPLACEMENT))
                runs.append([])
                out.lead += not out.first
            else:
                found = words(part.encode())
                out.steps += [("word", w) for w in found]
                runs[-1] += found
                out.first = out.first or next(iter(found), b"")
        out.anchor = b" ".join(max(runs, key=lambda r: len(b" ".join(r))))
        if not out.anchor:
            raise ValueError(f"template {label} has no mandatory words")
        out.starts = frozenset(out.steps[i][1] for i in out._close({0: 0}) if i < len(out.steps) and out.steps[i][0] == "word")
        return out

    def _close(self, states: dict[int, int]) -> dict[int, int]:
        """With the states that skips lead to; the value counts words in the present replaceable region."""
        todo = list(states)
        while todo:
            i = todo.pop()
            if i < len(self.steps) and self.steps[i][0] == "skip":
                for j in (i + 1, self.steps[i][1]):
                    if j not in states:
                        states[j] = 0
                        todo.append(j)
        return states

    def match(self, tokens: list[bytes], at: int) -> int | None:
        """The end of the longest match that begins at a word, or None."""
        states, end = self._close({0: 0}), None
        for k in range(at, len(tokens) + 1):
            if len(self.steps) in states:
                end = k
            if k == len(tokens) or not states:
                break
            new: dict[int, int] = {}
            for i, n in states.items():
                if i == len(self.steps):
                    continue
                kind, x = self.steps[i]
                if kind == "word" and tokens[k] == x:
                    new[i + 1] = 0
                elif kind == "any":
                    new.setdefault(i + 1, 0)
                    if n + 1 < x:
                        new[i] = min(new.get(i, n + 1), n + 1)
            states = self._close(new)
        return end

    def find(self, tokens: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of every place where a match begins."""
        out = []
        for k, w in enumerate(tokens):
            if w == self.first or w in self.starts or self.lead and k + self.lead < len(tokens) and tokens[k + self.lead] == self.first:
                # Replaceable leads are tried with one word each, the nearest: more words match where these do.
                if (end := self.match(tokens, k)) is not None:
                    out.append((k, end))
        return out


def phrase_places(tokens: list[bytes], flat: bytes, phrase: list[bytes]) -> list[int]:
    """Words at which the phrase's words stand consecutively."""
    if b" ".join(phrase) not in flat:
        return []
    n, out, k = len(phrase), [], -1
    try:
        while True:
            k = tokens.index(phrase[0], k + 1)
            if tokens[k : k + n] == phrase:
                out.append(k)
    except ValueError:
        return out


def scan(text: bytes, automata: list[Automaton], base: dict[str, str] = BASE) -> tuple:
    """(n_words, n_base, first, last, base labels, labels, score, spans) of a text.

    score: the share of the text's words that matched wording covers, 0 without words.
    """
    flat = text.translate(_TABLE)
    tokens = flat.split()
    places, labels, spans = [], set(), []
    suspects = [a for a in automata if a.anchor.split(b" ", 1)[0] in flat]
    if suspects or any(p.split(" ")[0].encode() in flat for p in base):
        flat = b" ".join(tokens)
        for phrase, name in base.items():
            ws = phrase.encode().split(b" ")
            at = phrase_places(tokens, flat, ws)
            places += at
            spans += [(k, k + len(ws), name) for k in at]
            labels |= {name} if at else set()
        base_labels = ",".join(sorted(labels))
        for a in suspects:
            if a.anchor in flat:
                found = a.find(tokens)
                spans += [(i, j, a.label) for i, j in found]
                labels |= {a.label} if found else set()
    else:
        base_labels = ""
    covered, reach = 0, 0
    for i, j, _ in sorted(spans):
        covered += max(0, j - max(i, reach))
        reach = max(reach, j)
    score = covered / len(tokens) if tokens else 0.0
    return len(tokens), len(places), min(places, default=None), max(places, default=None), base_labels, ",".join(sorted(labels)), score, [f"{i}-{j}:{name}" for i, j, name in sorted(spans)]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES | TEXTS, base: dict[str, str] = BASE) -> DataFrame:
    """One row per row of docs; spans are "start-end:label" in words."""

    def run(it):
        import pyarrow as pa

        automata = [Automaton.compile(*x) for x in templates.items()]
        i64, s = pa.int64(), pa.string()
        for b in it:
            rows = [scan(t, automata, base) for t in text_bytes(b.column(1))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (i64, i64, i64, i64, s, s, pa.float64(), pa.list_(s)))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)
