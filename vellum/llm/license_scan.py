"""License scans by template-markup matching.

A template is wording with regions: ``<<optional>>...<</optional>>`` may be missing, ``<<any:2-6>>`` stands for so many
words of any kind. It's compiled into an automaton over words, which accepts a stretch of a text whose mandatory
wording matches exactly. Automata are started where a word stands that some template can begin with.

Defined cases: null and empty texts have no words and no places; repeated rows are scanned each; an empty table gives
an empty result; further columns are kept as they are, but for ones named license_words or license_spans, which are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import raw, slices, text_column

#: Separators become blanks, A-Z lower case; digits and all bytes of other characters stay.
_WORDS = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MARK = re.compile(r"<<(optional|/optional|any:(\d+)-(\d+))>>")

#: Phrases that name a license.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

_ANY_HOLDER = "<<any:1-8>>"
_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with"
    " the software or the use or other dealings in the software"
)
_BSD_CONDITIONS = (
    "redistribution and use <<optional>>of <<any:1-6>><</optional>> in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " <<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " <<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_ENDORSEMENT = f" <<optional>>3<</optional>> neither the name of {_ANY_HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = (
    " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall the copyright <<any:1-4>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption"
    " however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)


def _gnu(name: str, form: str) -> str:
    return (
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version <<any:1-2>> of the license or <<optional>>at your option<</optional>> any later version"
        f" <<any:1-6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details <<optional>>{form}<</optional>>"
    )


#: The wording of licenses and of the notices that licenses ask for, whole. A template begins with wording,
#: so the names that notices of the GNU licenses begin with are left out.
TEMPLATES = {
    "mit": f"permission is hereby granted free of charge to any person obtaining a copy of <<any:1-6>> and associated documentation files <<optional>>the <<any:1-2>><</optional>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software {_WARRANTY}",
    "isc": "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any:1-6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:1-6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD_CONDITIONS + _BSD_ENDORSEMENT + _BSD_DISCLAIMER,
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:5-8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": _gnu("general public license", "you should have received a copy of the gnu general public license along with <<any:1-12>>"),
    "lgpl": _gnu("lesser general public license", "you should have received a copy of the gnu lesser general public license along with <<any:1-12>>"),
    "agpl": _gnu("affero general public license", "you should have received a copy of the gnu affero general public license along with <<any:1-12>>"),
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<any:4-8>>",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<optional>>1<</optional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<optional>>2<</optional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<optional>>3<</optional>> this notice may not be removed or altered from any source distribution",
    "cc-by-4.0": "this work is licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution 4 0 international license <<optional>>to view a copy of this license visit <<any:4-9>><</optional>>",
    "cc-by-sa-4.0": "this work is licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution sharealike 4 0 international license",
    "cc0-1.0": "to the extent possible under law <<any:1-8>> has waived all copyright and related or neighboring rights to <<any:1-8>>",
}
#: Short forms that name a license in passing, and the openings of whole ones: they say less than the wording itself.
MENTIONS = {
    "apache-2.0": "licensed under the apache license <<optional>>version<</optional>> 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of <<any:1-6>> and associated documentation files <<optional>>the <<any:1-2>><</optional>> to deal in the software without restriction",
    "bsd": "redistribution and use <<optional>>of <<any:1-6>><</optional>> in source and binary forms with or without modification are permitted",
    "mit-short": "<<optional>>released<</optional>> under the mit license",
    "gpl-version": "gnu <<optional>>lesser<</optional>> <<optional>>affero<</optional>> general public license <<optional>>as published by the free software foundation either<</optional>> version <<any:1-1>>",
    "cc-by-version": "<<optional>>licensed under<</optional>> cc by <<any:1-1>> 0",
}


@dataclass
class Automaton:
    """States are positions in the wording; a state has words that lead on, and states it also stands for."""

    steps: list[dict[bytes | None, set[int]]]
    also: list[set[int]]

    @classmethod
    def compiled(cls, template: str) -> Automaton:
        steps: list[dict] = [{}]
        also: list[set[int]] = [set()]
        opened: list[int] = []

        def state() -> int:
            steps.append({})
            also.append(set())
            return len(steps) - 1

        at = 0
        for m in re.finditer(r"<<[^>]*>>|[^\s<]+", template):
            if (mark := _MARK.fullmatch(m[0])) is None:
                for word in m[0].encode().translate(_WORDS).split():
                    steps[at].setdefault(word, set()).add(at := state())
            elif mark[1] == "optional":
                opened.append(at)
            elif mark[1] == "/optional":
                also[opened.pop()].add(at)
            else:
                ends = []
                for i in range(int(mark[3])):
                    if i >= int(mark[2]):
                        ends.append(at)
                    steps[at].setdefault(None, set()).add(at := state())
                for e in ends:
                    also[e].add(at)
        if opened:
            raise ValueError(f"an optional region isn't closed: {template}")
        return cls(steps, also)

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for y in self.also[todo.pop()] - out:
                out.add(y)
                todo.append(y)
        return out

    def first_words(self) -> set[bytes]:
        found = {w for s in self.closed({0}) for w in self.steps[s]}
        if None in found or len(self.steps) - 1 in self.closed({0}):
            raise ValueError("a template has to begin with wording")
        return found

    def matched(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest stretch from there that is accepted."""
        states, last, final = self.closed({0}), None, len(self.steps) - 1
        for i in range(at, len(words)):
            states = self.closed({y for s in states for w in (words[i], None) for y in self.steps[s].get(w, ())})
            if not states:
                break
            if final in states:
                last = i + 1
        return last


@dataclass
class Scanner:
    """Templates by label; a text's places are (label, first word, end)."""

    templates: dict[str, str]

    def __post_init__(self):
        self.automata = {k: Automaton.compiled(t) for k, t in self.templates.items()}
        self.begins: dict[bytes, list[str]] = {}
        for k, a in self.automata.items():
            for w in a.first_words():
                self.begins.setdefault(w, []).append(k)

    def places(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        begins = self.begins
        return [(k, i, end) for i, w in enumerate(words) if w in begins for k in begins[w] if (end := self.automata[k].matched(words, i)) is not None]


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def scan(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, mentions: dict[str, str] = MENTIONS, templates: dict[str, str] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """docs with license_words (how many words) and license_spans: label, kind (phrase, mention or whole), first and end word."""
    docs = docs.drop(*{"license_words", "license_spans"} - {text_col})
    names = docs.columns
    at = names.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    span = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    every = {(kind, k): t for kind, own in (("phrase", phrases), ("mention", mentions), ("whole", templates)) for k, t in own.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(every)
        for batch in batches:
            texts = text_column(batch.column(at))
            for lo, hi in slices(texts):
                data, ends = raw(texts.slice(lo, hi - lo))
                clean = data.tobytes().translate(_WORDS)
                counts, spans = np.zeros(hi - lo, dtype="i8"), []
                for i in range(hi - lo):
                    words = clean[ends[i] : ends[i + 1]].split()
                    counts[i] = len(words)
                    spans.append([{"label": k[1], "kind": k[0], "first": a, "end": b} for k, a, b in scanner.places(words)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts), pa.array(spans, pa.list_(span))], [*names, "license_words", "license_spans"])

    return docs.mapInArrow(run, f"{fields}, license_words long, license_spans array<struct<label:string,kind:string,first:bigint,end:bigint>>")


def summary(scanned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: 1 with whole wording, 0.8 with a mention, 0.5 with phrases only, else 0."""
    spans = F.col("license_spans")
    base = F.filter(spans, lambda s: s["kind"] == "phrase")
    firsts = F.transform(base, lambda s: s["first"])
    has = lambda kind: F.exists(spans, lambda s: s["kind"] == kind)
    shown = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    return scanned.select(
        F.col(id_col).alias("doc_id"), F.col("license_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        shown(base).alias("base_labels"), shown(spans).alias("labels"), F.when(has("whole"), 1.0).when(has("mention"), 0.8).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )
