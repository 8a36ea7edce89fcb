"""License scans by template matching.

A template is wording with marked regions: `[[ ... ]]` may be left out, `{{n}}` stands for up to n words of any
kind, `{{a|b}}` for one of some wordings. Case and punctuation count for nothing. It is compiled to an automaton over words, and a text has the template's
label if somewhere in it the mandatory wording stands exactly, word for word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.shared import map_batches, table

#: Fixed phrases and their labels (base places).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license wording, whole texts of the short licenses and the standard notices of the long ones: (label, template).
TEMPLATES = (
    # one-line notices
    ("mit", "{{released|licensed|distributed|available}} under the [[terms of the]] MIT License"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] [[either]] version 3"),
    ("gpl-2.0", "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] [[either]] version 2"),
    ("cc-by-nc-4.0", "licensed under [[a]] {{CC|Creative Commons}} {{BY NC|Attribution NonCommercial}} 4.0"),
    ("cc-by-4.0", "licensed under [[a]] {{CC BY|Creative Commons Attribution}} 4.0"),
    # whole texts
    ("mit-text", """[[{{The MIT License|MIT License}} [[MIT]]]] [[Copyright {{12}}]] [[All rights reserved.]]
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the {{2}}), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions:
        The above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the Software.
        The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
        merchantability, fitness for a particular purpose and {{noninfringement|non-infringement}}. In no event shall the {{8}} be liable
        for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in
        connection with the software or the use or other dealings in the software."""),
    ("bsd-2-clause", """[[Copyright {{12}}]] [[All rights reserved.]]
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.
        This software is provided by {{8}} "as is" and any express or implied warranties, including, but not limited to, the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall {{8}} be liable for any
        direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of
        substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of
        liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of
        this software, even if advised of the possibility of such damage."""),
    ("bsd-3-clause", """[[Copyright {{12}}]] [[All rights reserved.]]
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.
        [[3]] Neither the name of {{12}} nor the names of {{6}} may be used to endorse or promote products derived from this software
        without specific prior written permission.
        This software is provided by {{8}} "as is" and any express or implied warranties, including, but not limited to, the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall {{8}} be liable for any
        direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of
        substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of
        liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of
        this software, even if advised of the possibility of such damage."""),
    ("isc", """[[Copyright {{12}}]] [[All rights reserved.]]
        Permission to use, copy, modify, {{and|and/or}} distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.
        The software is provided "as is" and {{4}} disclaims all warranties with regard to this software including all implied warranties
        of merchantability and fitness. In no event shall {{4}} be liable for any special, direct, indirect, or consequential damages or
        any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious
        action, arising out of or in connection with the use or performance of this software."""),
    ("zlib", """[[Copyright {{12}}]] This software is provided 'as-is', without any express or implied warranty. In no event will the
        {{author|authors}} be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: [[1]] The origin of this software must not be misrepresented; you
        must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. [[2]] Altered source versions must be plainly marked as such, and must not
        be misrepresented as being the original software. [[3]] This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
        the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
        heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
        rights to this software under copyright law.
        The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
        merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors be liable for any claim,
        damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the
        software or the use or other dealings in the software. [[For more information, please refer to {{6}}]]"""),
    ("bsl-1.0", """[[Boost Software License Version 1.0 {{6}}]]
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
        and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
        subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
        Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
        language processor."""),
    # standard notices
    ("apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at {{8}}
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
    ("gpl-notice", """is free software[[:]] you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, {{either version 2|either version 3|version 2|version 3}}
        of the License [[or (at your option) any later version]].
        {{6}} distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl-notice", """is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU {{Lesser|Library}} General
        Public License as published by the Free Software Foundation, {{either version 2|either version 2.1|either version 3|version 2.1|version 3}}
        of the License [[or (at your option) any later version]]"""),
    ("agpl-notice", """is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, {{either version 3|version 3}} of the License [[or (at your option) any later version]]"""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at {{6}}"""),
)

#: Bytes to words: A-Z become a-z; digits, letters and all bytes from 0x80 on make words, the rest separates them.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


@dataclass
class Automaton:
    """States 0..n-1; moves by word, by any word, or by no word; `final` accepts."""

    label: str
    by_word: list[dict[bytes, set[int]]]
    by_any: list[set[int]]
    free: list[set[int]]
    final: int
    mandatory: frozenset[bytes]
    starts: frozenset[bytes] | None = None

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts_from(self, words: list[bytes], at: int) -> int | None:
        """The end of the shortest accepted run of words that begins at `at`."""
        states = self.closure({0})
        while self.final not in states:
            if at == len(words) or not states:
                return None
            states = self.closure(set().union(*(self.by_word[s].get(words[at], set()) | self.by_any[s] for s in states)))
            at += 1
        return at


_MARK = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|[^\[\]{}]+", re.S)


def parts(template: str) -> list:
    """A template as a list of words, nested lists (may be left out), numbers (so many words) and tuples of choices."""
    stack: list[list] = [[]]
    for m in _MARK.findall(template):
        if m == "[[":
            stack.append([])
        elif m == "]]":
            inner = stack.pop()
            if inner:  # a mark of punctuation alone holds no words
                stack[-1].append(inner)
        elif m.startswith("{{"):
            body = m[2:-2]
            stack[-1].append(int(body) if body.isdigit() else tuple([w.decode() for w in words_of(c)] for c in body.split("|")))
        else:
            stack[-1] += [w.decode() for w in words_of(m)]
    return stack[0]


def compile_template(label: str, template: str) -> Automaton:
    by_word: list[dict[bytes, set[int]]] = [defaultdict(set)]
    by_any: list[set[int]] = [set()]
    free: list[set[int]] = [set()]
    mandatory: set[bytes] = set()

    def state() -> int:
        by_word.append(defaultdict(set))
        by_any.append(set())
        free.append(set())
        return len(free) - 1

    def run(sequence: list, at: int, needed: bool) -> int:
        for part in sequence:
            if isinstance(part, list):
                end = run(part, at, False)
                free[at].add(end)
            elif isinstance(part, int):
                end = state()
                for _ in range(part):
                    free[at].add(end)
                    after = state()
                    by_any[at].add(after)
                    at = after
                free[at].add(end)
            elif isinstance(part, tuple):
                end = state()
                for choice in part:
                    free[run(choice, at, False)].add(end)
            else:
                end = state()
                by_word[at][part.encode()].add(end)
                if needed:
                    mandatory.add(part.encode())
            at = end
        return at

    final = run(parts(template), 0, True)
    made = Automaton(label, by_word, by_any, free, final, frozenset(mandatory))
    first = made.closure({0})
    if not any(made.by_any[s] for s in first):
        made.starts = frozenset(w for s in first for w in by_word[s])
    return made


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                  text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with license_words, license_base and license_matches.

    license_words: the number of words of the whole text. license_base: array<struct<label, word>>, every place of
    a phrase by its first word's number. license_matches: array<struct<label, word, until>>, the first accepted run
    of each template. Null and empty texts have no words and no places; repeated rows are scanned each for itself;
    columns of docs of these names are replaced. No rows in, no rows out.
    """
    added = ("license_words long, license_base array<struct<label:string,word:long>>, "
             "license_matches array<struct<label:string,word:long,until:long>>")
    docs = docs.drop("license_words", "license_base", "license_matches")
    keep = docs.columns if keep is None else keep

    def make():
        automata = [compile_template(*t) for t in templates]
        wanted = [(label, [w.encode() for w in p.split()]) for p, label in phrases.items()]

        def work(batch):
            columns = [[], [], []]
            for t in batch.column(text).to_pylist():
                words = words_of(t)
                present = set(words)
                base = [{"label": label, "word": at} for label, p in wanted if present.issuperset(p) for at in _places(words, p)]
                found = []
                for a in automata:
                    if not present >= a.mandatory:
                        continue
                    for at in range(len(words)):
                        if (a.starts is None or words[at] in a.starts) and (end := a.accepts_from(words, at)) is not None:
                            found.append({"label": a.label, "word": at, "until": end})
                            break
                for c, v in zip(columns, (len(words), base, found)):
                    c.append(v)
            return None, columns

        return work

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, added, keep)


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 1 where a template's wording stands exactly, 0.5 where only a base phrase does, else 0."""
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    words = F.transform("license_base", lambda p: p["word"])
    base = F.transform("license_base", lambda p: p["label"])
    matched = F.transform("license_matches", lambda p: p["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size("license_base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, matched)).alias("labels"),
        F.when(F.size("license_matches") > 0, 1.0).when(F.size("license_base") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def as_regex(sequence: list) -> str:
    """The parts of a template as a regular expression over words that each follow one space."""
    out = []
    for part in sequence:
        if isinstance(part, list):
            out.append(f"({as_regex(part)})?")
        elif isinstance(part, int):
            out.append(f"( [^ ]+){{0,{part}}}")
        elif isinstance(part, tuple):
            out.append("(" + "|".join(map(as_regex, part)) + ")")
        else:
            out.append(f" {part}")
    return "".join(out)


def _sql() -> str:
    places = " || ".join(
        f"list_transform(list_filter(range(1, len(w) + 1), lambda i: "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + f"), lambda i: {{'at': i - 1, 'label': '{label}'}})"
        for p, label in PHRASES.items())
    found = ", ".join(f"CASE WHEN regexp_matches(j, '{as_regex(parts(t))}( |$)') THEN '{label}' END" for label, t in TEMPLATES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    listed = "array_to_string(list_sort(list_distinct({})), ',')"
    return rf"""WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') AS j, {places} AS p FROM a),
  c AS (SELECT doc_id, w, p, list_transform(p, lambda x: x.label) AS base, list_filter([{found}], lambda x: x IS NOT NULL) AS m FROM b)
  SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word,
    {listed.format('base')} AS base_labels, {listed.format('base || m')} AS labels, CASE WHEN len(m) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM c"""


SQL = _sql()
