"""License scans: patience alignment of windows of a text with license templates.

Words that are unique in both window and template are anchors; a longest increasing subsequence of them is kept, and the
gaps between are aligned in the same way. Coverage is the share of the template's words that are aligned. The words that
tell a license from its relatives (``MUST``) have to stand in the window as they stand in the template, and are the first
anchors. A gap without anchors, or whose anchors cross, gives its longest common subsequence, so coverage is
exact: no alignment of the window that keeps to ``MUST`` covers more.

Windows lie around the seed words of a template and are of bounded size, so a text of any length is scanned
in linear time. Seeds are as many words of the template as an alignment may leave out, and one more, so that no
alignment with enough coverage is without one. Every start is tried, and for each number of matched words the
shortest windows count. Of a template there are as many disjoint places as possible, so any number of copies may follow
each other, and each then has the best coverage that leaves the others theirs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, small_batches, with_columns

# Public license notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "EPL-1.0": ("All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-3.0": ("Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "Zlib": (
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",),
    "WTFPL": ("This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",),
}
# Phrases that tell a license from its relatives. Each one that a notice of the license holds must stand in the text word for word.
MUST = {
    "MIT": ("MIT License", "without restriction", "substantial portions"),
    "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0"),
    "Apache-1.1": ("Apache License Version 1.1",),
    "GPL-3.0": ("GNU General Public License", "version 3"),
    "GPL-2.0": ("GNU General Public License", "version 2"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "version 2.1"),
    "AGPL-3.0": ("GNU Affero General Public License", "version 3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License v 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "EPL-1.0": ("Eclipse Public License v1.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike 4.0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Attribution-NonCommercial-NoDerivatives 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Attribution-NonCommercial 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Attribution-ShareAlike 4.0"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Attribution-ShareAlike 3.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Attribution-NoDerivatives 4.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Attribution 4.0"),
    "CC-BY-3.0": ("CC BY 3.0", "Attribution 3.0"),
    "CC0-1.0": ("CC0 1.0",),
    "ISC": ("ISC License", "with or without fee", "permission notice appear"),
    "BSD-2-Clause": ("BSD 2-Clause License", "source and binary forms"),
    "BSD-3-Clause": ("BSD 3-Clause License", "source and binary forms", "endorse or promote"),
    "Zlib": ("zlib License", "plainly marked"),
    "BSL-1.0": ("Boost Software License Version 1.0", "derivative works"),
    "Unlicense": ("unencumbered software",),
    "PostgreSQL": ("without a written agreement",),
    "WTFPL": ("Want To Public License",),
}
#: Licenses whose notice begins with the notice of another: a place of the other there is none of its own.
LONGER = {"BSD-2-Clause": "BSD-3-Clause"}
# Words that are no seeds as long as a template has enough others: this is about speed, results don't depend on it.
COMMON = frozenset("a above all and any are at be by conditions copies copy following for free from in is it may must not of on or person provided purpose subject that the this to under use whom with without work you".split())
WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORDS.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    ends: list[int] = []
    tails: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both; words of gaps without anchors are left out."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in place]
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not anchors:
            continue
        out += anchors
        p, q = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            stack.append((p, i, q, j))
            p, q = i + 1, j + 1
    return sorted(out)


def common(a: list[str], b: list[str]) -> int:
    """The length of a longest common subsequence, bit-parallel (public: Hyyro)."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for w in b:
        u = free & masks.get(w, 0)
        free = (free + u | free - u) & full
    return len(a) - free.bit_count()


def aligned(a: list[str], b: list[str]) -> int:
    """Words of ``a`` aligned with words of ``b``: patience where it aligns all that either side has, else the exact number."""
    if not a or not b:
        return 0
    found = len(patience(a, b))
    return found if found == min(len(a), len(b), sum((Counter(a) & Counter(b)).values())) else common(a, b)


def covered(template: list[str], phrases: list[tuple[int, int]], window: list[str]) -> int:
    """Words of the template aligned with the window's, with each phrase (start, length) word for word; 0 if that can't be."""
    best = 0
    stack = [(0, 0, 0, 0)]  # phrases placed, template and window words done, words aligned
    while stack:
        k, i, j, n = stack.pop()
        if k == len(phrases):
            best = max(best, n + aligned(template[i:], window[j:]))
            continue
        start, size = phrases[k]
        phrase = template[start : start + size]
        for at in range(j, len(window) - size + 1):
            if window[at] == phrase[0] and window[at : at + size] == phrase:
                stack.append((k + 1, start + size, at + size, n + size + aligned(template[i:start], window[j:at])))
    return best


class Spans:
    """Disjoint (first, last), in order."""

    def __init__(self):
        self.firsts: list[int] = []
        self.lasts: list[int] = []

    def meets(self, first: int, last: int) -> range:
        """The indexes of those that overlap."""
        return range(bisect_left(self.lasts, first), bisect_right(self.firsts, last))

    def add(self, first: int, last: int) -> bool:
        if self.meets(first, last):
            return False
        i = bisect_right(self.firsts, last)
        self.firsts.insert(i, first)
        self.lasts.insert(i, last)
        return True


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8, must: dict[str, tuple[str, ...]] = MUST):
        self.least = least
        self.templates = [(name, words(t)[0]) for name, texts in sorted(templates.items()) for t in texts]
        self.need = [max(1, next((m for m in range(len(t) + 1) if m / len(t) >= least), len(t) + 1)) for _, t in self.templates]
        self.seeds = [sorted(sorted(range(len(t)), key=lambda i: (t[i] in COMMON, -len(t[i]), i))[: len(t) - need + 1]) for (_, t), need in zip(self.templates, self.need)]
        self.words = {t[i] for (_, t), seeds in zip(self.templates, self.seeds) for i in seeds}
        # of the rare words of a template an alignment leaves out as many as of all: the others are in each window
        rare = [[i for i, w in enumerate(t) if w not in COMMON] for _, t in self.templates]
        left = [len(t) - need for (_, t), need in zip(self.templates, self.need)]
        self.rare = [({t[i] for i in r}, len(r) - n) if len(r) > n else ({t[i] for i in seeds}, 1) for (_, t), r, n, seeds in zip(self.templates, rare, left, self.seeds)]
        self.rare_words = set().union(*(r for r, _ in self.rare))
        self.phrases: list[list[tuple[int, int]]] = []
        for name, t in self.templates:
            phrases = [words(p)[0] for p in must.get(name, ())]
            self.phrases.append(sorted((i, len(p)) for p in phrases for i in range(len(t) - len(p) + 1) if t[i : i + len(p)] == p))
        self.must = [sum(1 << i for start, size in phrases for i in range(start, start + size)) for phrases in self.phrases]
        self.masks: list[dict[str, int]] = []
        for _, t in self.templates:
            self.masks.append({})
            for i, w in enumerate(t):
                self.masks[-1][w] = self.masks[-1].get(w, 0) | 1 << i
        # a text without a match has no seed; a match may be a part of a longer word
        self.pattern = "(?:^|[^a-z0-9])(?:" + "|".join(sorted(map(re.escape, self.words))) + ")(?:[^a-z0-9]|$)"

    def windows(self, k: int, tokens: list[str], places: list[int]) -> list[tuple[int, int, int]]:
        """(matched words, first, last) of the windows that no window within them equals; ``places`` are those of rare words."""
        n, need, masks, most, must = len(self.templates[k][1]), self.need[k], self.masks[k], self.rare[k][1], self.must[k]
        template, phrases = self.templates[k][1], self.phrases[k]
        if need > n:
            return []
        width = 2 * n + 5
        hits: list[tuple[int, int]] = []  # (place, template positions as bits) of template words, in dense parts
        done = 0
        for i in range(len(places) - most + 1):
            if places[i + most - 1] - places[i] < width:
                lo, hi = max(done, places[i + most - 1] - width + 1), min(len(tokens), places[i] + width)
                hits += [(j, m) for j in range(lo, hi) if (m := masks.get(tokens[j]))]
                done = max(done, hi)
        full, early = (1 << n) - 1, (1 << n - need + 1) - 1
        out = []
        ends = [len(tokens)] * (n + 1)  # the least last place by matched words (or more), of later starts
        for x in range(len(hits) - need, -1, -1):
            first, m = hits[x]
            if not m & early or bisect_left(places, first + width) - bisect_left(places, first) < most:
                continue
            free, count, missing, done = full, 0, must, 0  # the bits of a bit-parallel longest common subsequence
            for y in range(x, len(hits)):
                last, m = hits[y]
                if last - first >= width or ends[n] <= last:
                    break
                u = free & m
                missing &= ~m
                if u:
                    free = (free + u | free - u) & full
                    count = n - free.bit_count()
                # words that could be aligned are enough, more than before, and those of the phrases are there: align
                if count >= need and count > done and not missing and ends[count] > last:
                    window = tokens[first : last + 1]
                    now = n if window == template else covered(template, phrases, window)
                    done = now if now == count else done  # where phrases cost words a longer window may do better
                    if now >= need and ends[now] > last:
                        out.append((now, first, last))
                        for v in range(now, 0, -1):
                            if ends[v] <= last:
                                break
                            ends[v] = last
        return out

    def places(self, k: int, windows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Disjoint windows, as many as possible: whole copies, then those that end first, each widened to its best coverage."""
        n, cores, out, taken = len(self.templates[k][1]), Spans(), [], Spans()
        for m, first, last in sorted(windows, key=lambda x: x[1]):
            if m == n == last - first + 1:
                cores.add(first, last)
        for _, first, last in sorted(windows, key=lambda x: (x[2], -x[1])):
            cores.add(first, last)
        done = set()
        for m, first, last in sorted(windows, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            met = cores.meets(first, last)
            i = met.start
            if len(met) == 1 and i not in done and first <= cores.firsts[i] and cores.lasts[i] <= last and taken.add(first, last):
                done.add(i)
                out.append((m, first, last))
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of each place with enough coverage, best first; places don't overlap.

        At one place the greatest coverage counts, then the longer template, then the name. No window beside all
        places has enough coverage.
        """
        tokens, spans = words(text)
        at: dict[str, list[int]] = {}
        for j, w in enumerate(tokens):
            if w in self.rare_words:
                at.setdefault(w, []).append(j)
        windows = {}
        for k, (rare, most) in enumerate(self.rare):
            rare_at = sorted(j for w in rare for j in at.get(w, ()))
            if len(rare_at) >= most:
                windows[k] = self.windows(k, tokens, rare_at)
        for k, (name, _) in enumerate(self.templates):
            if windows.get(k) and name in LONGER:
                longer = [x for j, w in windows.items() if self.templates[j][0] == LONGER[name] for x in w]
                windows[k] = [x for x in windows[k] if not any(y[1] <= x[2] and x[1] <= y[2] for y in longer)]
        found, taken = [], Spans()
        while any(windows.values()):
            new = [(-m / len(self.templates[k][1]), -len(self.templates[k][1]), self.templates[k][0], first, last) for k, w in windows.items() for m, first, last in self.places(k, w)]
            found += [x for x in sorted(new) if taken.add(*x[3:])]
            windows = {k: [x for x in w if not taken.meets(*x[1:])] for k, w in windows.items()}
        return [(name, -cov, spans[first][0], spans[last][1]) for cov, _, name, first, last in sorted(found)]


def scan_licenses(docs: DataFrame, text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``docs`` with ``license`` (best covered, or null), ``coverage`` (0 without one), ``n_found`` and ``places`` appended.

    ``places`` lists (license, coverage, start, end), offsets in characters. Null and empty texts have none; texts of any
    length are scanned whole. A notice whose name, version or clause differs from all templates has no license here. Of
    equal coverages the longer template wins, then the first name. Repeated rows get equal answers; other
    columns pass through (input columns named like the outputs are replaced); an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("license", "coverage", "n_found", "places")
    place = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least=least)
        for batch in batches:
            for piece in slices(batch, text_col):
                column = pc.fill_null(piece.column(text_col), "")
                maybe = pc.match_substring_regex(column, scanner.pattern, ignore_case=True).to_pylist() if scanner.words else [False] * len(column)
                hits = [scanner.scan(t.as_py()) if m else [] for t, m in zip(column, maybe)]
                more = [
                    pa.array([h[0][0] if h else None for h in hits], pa.string()),
                    pa.array([h[0][1] if h else 0.0 for h in hits], pa.float64()),
                    pa.array([len(h) for h in hits], pa.int32()),
                    pa.array([[dict(zip(("license", "coverage", "start", "end"), x)) for x in h] for h in hits], place),
                ]
                yield pa.RecordBatch.from_arrays([*piece.columns, *more], [*piece.schema.names, "license", "coverage", "n_found", "places"])

    return docs.mapInArrow(run, with_columns(docs, "license string, coverage double, n_found int, places array<struct<license:string,coverage:double,start:int,end:int>>"))
