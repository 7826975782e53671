"""License scans by patience alignment of texts with license templates.

Words that occur once in the template's stretch and once in the text's are anchors; the longest
increasing run of anchors is kept, equal neighbours of an anchor are taken along, and each gap
between anchors is aligned in the same way. The share of a template's words that is aligned is
its coverage.
"""

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa

from prefloom.llm.common import documents, steps, texts_of

# The notices that are looked for.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-license-notice": "Licensed under the MIT License.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "bsd-2-clause-notice": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-notice": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version."
    ),
    "lgpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so."
    ),
}
# Words without which a stretch is another license or another version of it.
NEEDS = {
    "mit-notice": ("mit",),
    "mit-license-notice": ("mit",),
    "apache-2.0-notice": ("apache", "2.0"),
    "gpl-2.0-notice": ("gnu", "2"),
    "gpl-3.0-notice": ("gnu", "3"),
    "lgpl-2.1-notice": ("lesser", "2.1"),
    "lgpl-3.0-notice": ("lesser", "3"),
    "agpl-3.0-notice": ("affero", "3"),
    "mpl-2.0-notice": ("mozilla", "2.0"),
    "bsd-2-clause-notice": ("bsd", "2-clause"),
    "bsd-3-clause-notice": ("bsd", "3-clause"),
    "cc-by-4.0-notice": ("cc", "by", "4.0"),
    "cc-by-sa-4.0-notice": ("cc", "by-sa", "4.0"),
    "cc-by-nc-4.0-notice": ("cc", "by-nc", "4.0"),
    "cc-by-nd-4.0-notice": ("cc", "by-nd", "4.0"),
    "cc-by-nc-sa-4.0-notice": ("cc", "by-nc-sa", "4.0"),
    "cc-by-nc-nd-4.0-notice": ("cc", "by-nc-nd", "4.0"),
    "lgpl-2.1": ("lesser",),
    "lgpl-3.0": ("lesser",),
    "agpl-3.0": ("affero",),
    "mpl-2.0": ("mozilla",),
    "bsd-3-clause": ("neither", "endorse"),
    "bsl-1.0": ("organization",),
}
# Versions in longer texts. One may be missing, but no other number may stand for it.
VERSIONS = {
    "apache-2.0": ("2.0",),
    "gpl-2.0": ("2",),
    "gpl-3.0": ("3",),
    "lgpl-2.1": ("2.1",),
    "lgpl-3.0": ("3",),
    "agpl-3.0": ("3",),
    "mpl-2.0": ("2.0",),
}
# Words that turn a stretch into something else where the template lacks them, and
# those that do so for one license only.
NEGATIONS = ("not", "never", "cannot", "lesser", "affero")
WITHOUT = {"gpl-2.0-notice": ("library",), "gpl-3.0-notice": ("library",), "gpl-2.0": ("library",), "gpl-3.0": ("library",)}
COVERAGE = 0.8
# A stretch of text may hold so many words for each word of the template.
SLACK = 2
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text):
    """Lower-case words; marks around them do not count."""
    return _WORD.findall(text.lower())


def increasing(values):
    """Places of a longest increasing run of distinct values, by patience sorting."""
    tops, piles, before = [], [], [-1] * len(values)
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            piles.append(place)
        else:
            tops[pile], piles[pile] = value, place
        before[place] = piles[pile - 1] if pile else -1
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _once(words, start, end):
    places = {}
    for place in range(start, end):
        places[words[place]] = -1 if words[place] in places else place
    return {word: place for word, place in places.items() if place >= 0}


def align(a, b):
    """Aligned places (i, j), rising in both, of two lists of words.

    Common words at both ends of a stretch are aligned first, so a stretch whose words all repeat
    still aligns what it begins and ends with.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        mine, theirs = _once(a, a0, a1), _once(b, b0, b1)
        both = sorted((place, theirs[word]) for word, place in mine.items() if word in theirs)
        anchors = [both[i] for i in increasing([j for _, j in both])]
        i0, j0 = a0, b0
        for i, j in anchors:
            found.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        if anchors:
            todo.append((i0, a1, j0, b1))
    return sorted(found)


class Scanner:
    """Finds every stretch of a text that covers a template."""

    def __init__(self, templates=TEMPLATES, coverage=COVERAGE):
        if not 0.5 < coverage <= 1:
            raise ValueError("coverage is above a half and at most 1")
        self.templates = {name: words for name, text in templates.items() if (words := words_of(text))}
        self.coverage = coverage
        self.needs, self.versions, self.against = {}, {}, {}
        for name, words in self.templates.items():
            self.needs[name] = [place for place, word in enumerate(words) if word in NEEDS.get(name, ())]
            self.versions[name] = [place for place, word in enumerate(words) if word in VERSIONS.get(name, ())]
            self.against[name] = {*NEGATIONS, *WITHOUT.get(name, ())}
        # A stretch has every needed word. Without one, a stretch that covers a template holds one of any words that are more than the rest it may
        # lack: the scan starts only where one of the rarest of them stands.
        uses = {}
        for words in self.templates.values():
            for word in set(words):
                uses[word] = uses.get(word, 0) + 1
        self.starts = {}
        for name, words in self.templates.items():
            order = sorted(set(words), key=lambda w: (uses[w], -len(w), w))
            if self.needs[name]:
                needed = {words[place] for place in self.needs[name]}
                self.starts[name] = {next(word for word in order if word in needed)}
                continue
            lacking = int(len(words) * (1 - coverage) + 1e-9)
            count, rare = 0, set()
            for word in order:
                rare.add(word)
                count += words.count(word)
                if count > lacking:
                    break
            self.starts[name] = rare
        self.keys = set().union(*self.starts.values()) if self.starts else set()
        self.vocabulary = {name: set(words) for name, words in self.templates.items()}
        self.known = set().union(*self.vocabulary.values()) if self.starts else set()
        self.quick = re.compile("|".join(sorted(map(re.escape, self.keys), key=len, reverse=True)) or r"(?!)")

    def scan(self, text):
        """(template, coverage, first word, words spanned) of each stretch, in order."""
        lower = text.lower()
        if not self.quick.search(lower):
            return []
        words = _WORD.findall(lower)
        present = self.keys.intersection(words)
        if not present:
            return []
        spots = [(place, word) for place, word in enumerate(words) if word in self.known]
        found = []
        for name, template in self.templates.items():
            if present.isdisjoint(self.starts[name]):
                continue
            own = self.vocabulary[name]
            places = [place for place, word in spots if word in own]
            found += self._stretches(name, template, words, places)
        return sorted(found, key=lambda x: (x[2], x[0]))

    def _stretches(self, name, template, words, places):
        """Template words that lie close together are aligned as one stretch; what is left, again."""
        reach = SLACK * len(template)
        groups, start = [], 0
        for at in range(1, len(places) + 1):
            if at == len(places) or places[at] - places[at - 1] > reach:
                groups.append(places[start:at])
                start = at
        found = []
        while groups:
            group = groups.pop()
            at = next((i for i, place in enumerate(group) if words[place] in self.starts[name]), None)
            if at is None or len(group) < self.coverage * len(template):
                continue
            # The stretch around the first start word, as long as a covering one can be.
            first = group[at]
            near = group[bisect_left(group, first - reach) : bisect_left(group, first + reach + 1)]
            best = self._best(name, template, words, near)
            if best is None:
                rest = group[at + 1 :]
            else:
                matched, low, high = best
                found.append((name, matched / len(template), low, high - low + 1))
                rest = group[bisect_left(group, high + 1) :]
            if rest:
                groups.append(rest)
        return found

    def _best(self, name, template, words, near):
        """(aligned words, first, last place) of the first alignment with the words at `near` that counts.

        Copies in one stretch make its words repeat; then the copy is sought from each of its
        possible first words on.
        """
        stretch = [words[place] for place in near]
        if sum((Counter(template) & Counter(stretch)).values()) < self.coverage * len(template):
            return None
        lead = set(template[: int(len(template) * (1 - self.coverage) + 1e-9) + 1])
        starts = [0, *(low for low, word in enumerate(stretch) if word in lead)]
        for turn, low in enumerate(starts):
            part = stretch[low : low + SLACK * len(template)] if turn else stretch
            pairs = align(template, part)
            if len(pairs) >= self.coverage * len(template):
                placed = [(i, near[low + j]) for i, j in pairs]
                if self._agrees(name, template, words, placed):
                    return len(placed), placed[0][1], placed[-1][1]
        return None

    def _agrees(self, name, template, words, placed):
        """Every needed word is aligned, and no word against it stands unaligned in the stretch or
        right before where the whole template would begin."""
        mine, theirs = {i for i, _ in placed}, {j for _, j in placed}
        if any(place not in mine for place in self.needs[name]):
            return False
        (lead, first), (end, last) = placed[0], placed[-1]
        for place in self.versions[name]:
            if place in mine:
                continue
            after = bisect_left(placed, (place, -1))
            low = placed[after - 1][1] + 1 if after else max(0, first - lead)
            high = placed[after][1] if after < len(placed) else last + len(template) - end
            if any(c.isdigit() for word in words[low:high] for c in word):
                return False
        against = self.against[name]
        return not any(words[j] in against and j not in theirs for j in range(max(0, first - lead - 1), last + 1))


def scan_licenses(frame, templates=TEMPLATES, coverage=COVERAGE, id_column="doc_id", text_column="text"):
    """Per row: its id and every stretch that covers a template, with coverage and word bounds.

    `best` and `best_coverage` name the template of the highest coverage, of equal ones the longest,
    then the first by name; both are null where nothing is covered. A stretch that lacks a word of
    NEEDS (a version, a license's name), has another number for one of VERSIONS or holds one of NEGATIONS or WITHOUT that its template lacks
    there, is none: another version or a negated notice is not reported. Every row gives a row, equal
    ones alike; a null text has no stretch. Other columns are left out. Whole texts are scanned
    where they are read.
    """
    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    length = {name: len(words_of(text)) for name, text in templates.items()}

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in steps(batches):
            found = [scanner.scan(text) for text in texts_of(batch).to_numpy(zero_copy_only=False)]
            best = [min(x, key=lambda m: (-m[1], -length[m[0]], m[0])) if x else (None, None) for x in found]
            listed = [[dict(zip(("license", "coverage", "first_word", "n_words"), m)) for m in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([b[0] for b in best], pa.string()),
                    pa.array([b[1] for b in best], pa.float64()),
                    pa.array(listed, pa.list_(match)),
                ],
                ["doc_id", "best", "best_coverage", "matches"],
            )

    rows = frame.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS doc_id", f"CAST(`{text_column}` AS STRING) AS text")
    return rows.mapInArrow(
        run,
        "doc_id BIGINT, best STRING, best_coverage DOUBLE, "
        "matches ARRAY<STRUCT<license:STRING, coverage:DOUBLE, first_word:BIGINT, n_words:BIGINT>>",
    )


def op9_license_scan(spark, folder):
    return scan_licenses(documents(spark, folder))
