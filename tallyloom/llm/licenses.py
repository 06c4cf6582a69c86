"""License scans by template markup.

A template is a license's wording with regions in double angle brackets:
``<<optional>> ... <</optional>>`` may be absent, and ``<<var a b>>`` stands for a
to b words of any kind (names of holders, versions, list marks). The wording is cut
into words by the rule of the texts, so case, punctuation, line breaks and comment
marks do not matter. Templates are compiled into automata over tokens; a text is
accepted at a place where all the mandatory wording follows exactly. Runs start
only where the leading words of a template stand.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD_BYTES

def _gnu_header(name: str) -> str:
    """The notice that the GNU licenses ask for at the head of a file."""
    return f"""
        free software <<var 0 1>> you can redistribute it and/or modify it under the terms of the GNU
        {name} Public License as published by
        the Free Software Foundation, <<optional>> either <</optional>> version <<var 1 2>>
        <<optional>> of the License <</optional>> <<optional>> or (at your option) any later version <</optional>>.
        <<var 1 6>> distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        {name} Public License for more details.
        <<optional>> You should have received a copy of the GNU
        {name} Public License along with <<var 1 6>>
        <<optional>> if not see <<var 1 6>> <</optional>> <</optional>>
    """


# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Clauses that the BSD licenses share.
_BSD_CLAUSES = """
    Redistribution and use in source and binary forms, with or without modification, are permitted
    provided that the following conditions are met: <<var 0 1>>
    Redistributions of source code must retain the above copyright notice, this list of conditions and
    the following disclaimer. <<var 0 1>>
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
    the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_DISCLAIMER = """
    THIS SOFTWARE IS PROVIDED BY <<var 1 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
    IN NO EVENT SHALL <<var 1 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
    USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
    THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
# Templates by label; whole texts, the notices that stand in source files, and one-line notices.
TEMPLATES = {
    "apache-2.0-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        <<optional>> <<var 1 1>>://www.apache.org/licenses/LICENSE-2.0 <<optional>> .txt <</optional>> <</optional>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.
    """,
    "apache-notice": "licensed under the apache license <<optional>> version <<var 1 2>> <</optional>>",
    "bsd-2-clause": _BSD_CLAUSES + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD_CLAUSES
    + """
        <<var 0 1>> Neither the name of <<var 1 20>> nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.
    """
    + _BSD_DISCLAIMER,
    "boost-1.0": """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
        permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this
        restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
        part, and all derivative works of the Software, unless such copies or derivative works are solely in the
        form of machine-executable object code generated by a source language processor.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT.
        IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER
        LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE.
    """,
    "cc-by-notice": """
        licensed under <<optional>> a creative commons license <</optional>> cc by <<optional>> nc <</optional>>
        <<optional>> sa <</optional>> <<optional>> nd <</optional>> <<var 1 2>>
    """,
    "gpl-header": _gnu_header("General"),
    "lgpl-header": _gnu_header("Lesser General"),
    "agpl-header": _gnu_header("Affero General"),
    "gpl-notice": """
        is licensed under the gnu general public license
        <<optional>> as published by the free software foundation <</optional>> <<optional>> either <</optional>>
        version <<var 1 2>> <<optional>> or any later version <</optional>>
    """,
    "isc-text": """
        Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with
        or without fee is hereby granted, provided that the above copyright notice and this permission notice appear
        in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var 2 12>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 1 12>> BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
    """,
    "mit-notice": "released under the mit license",
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice
        <<optional>> (including the next paragraph) <</optional>> shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var 1 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
        OR OTHER DEALINGS IN THE SOFTWARE.
    """,
    "unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.
        <<optional>> In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
        and all copyright interest in the software to the public domain. <</optional>>
    """,
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will <<var 1 12>> be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: <<var 0 1>> The origin of this software must not be misrepresented; you
        must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
        <<optional>> (see the following) <</optional>> in the product documentation would be appreciated but is not
        required. <<var 0 1>> Altered source versions must be plainly marked as such, and must not be misrepresented as
        being the original software. <<var 0 1>> This notice may not be removed or altered from any source distribution.
    """,
}


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Automaton:
    """States 0 .. end; ``steps[s]`` holds (word or None for any, next) and ``free[s]`` the states reached without a word."""

    def __init__(self, template: str):
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        self.lead: list[bytes] = []
        plain = True
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<optional>>":
                opened.append(self._last())
                plain = False
            elif part == "<</optional>>":
                if not opened:
                    raise ValueError("an optional region is not open")
                self.free[opened.pop()].append(self._last())
            elif part.startswith("<<var"):
                least, most = map(int, part[5:-2].split())
                plain = False
                leave = []
                for n in range(most):
                    if n >= least:
                        leave.append(self._last())
                    self._add(None)
                for s in leave:
                    self.free[s].append(self._last())
            elif part.startswith("<<"):
                raise ValueError(f"unknown markup {part}")
            else:
                for word in words_of(part):
                    self._add(word)
                    if plain:
                        self.lead.append(word)
        if opened:
            raise ValueError("an optional region is not closed")
        if not self.lead:
            raise ValueError("a template must begin with mandatory words")

    def _last(self) -> int:
        return len(self.steps) - 1

    def _add(self, word: bytes | None) -> None:
        self.steps[-1].append((word, len(self.steps)))
        self.steps.append([])
        self.free.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], at: int) -> int:
        """Words of the longest match that starts at ``at``; 0: none."""
        now, longest, end = self._closed({0}), 0, self._last()
        for n, word in enumerate(words[at : at + len(self.steps)], 1):
            now = self._closed({t for s in now for w, t in self.steps[s] if w is None or w == word})
            if not now:
                break
            if end in now:
                longest = n
        return longest


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word indices at which ``phrase`` stands in ``joined``, words with a space before and after each."""
    out, word, done = [], 0, 0
    target = b" " + phrase + b" "
    at = joined.find(target)
    while at >= 0:
        word += joined.count(b" ", done, at)
        done = at
        out.append(word)
        at = joined.find(target, at + 1)
    return out


def scan(text: str | None, automata: dict[str, Automaton]) -> tuple:
    """One text's (n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = [(at, len(p.split()), label) for p, label in PHRASES.items() for at in places(joined, p.encode())]
    spans = []
    for label, automaton in automata.items():
        for at in places(joined, b" ".join(automaton.lead)):
            if n := automaton.accepts(words, at):
                spans.append((at, at + n, label))
    reach, merged = -1, []
    for lo, hi, _ in sorted(spans):
        reach = max(reach, hi)
        merged.append((lo, reach))
    base_labels = {label for _, _, label in base}
    begins = [lo for lo, _ in merged]
    within = 0
    for at, n, _ in base:
        before = bisect_right(begins, at)
        within += bool(before) and at + n <= merged[before - 1][1]
    score = within / len(base) if base else float(bool(spans))
    starts = [at for at, _, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {label for _, _, label in spans})), score,
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``score`` is the share of base places that begin inside the wording of accepted
    templates and end before it does; without base places it is 1 if any template
    is accepted, else 0. Null and empty texts have no words; texts of any length are
    read whole. Word places are null where there is no base phrase. Repeated rows
    and rows with null or equal ids each get their line; an empty table has none.
    Other columns are ignored, whatever their names.
    """
    automata = {label: Automaton(t) for label, t in templates.items()}
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([scan(x, automata) for x in texts], columns=names)
            yield out.astype({n: "Int64" for n in names[:4]} | {"score": "float64"})

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("s")).select("id", "s.*")
