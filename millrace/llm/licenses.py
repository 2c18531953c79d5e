"""License scans: texts against license notices by the Dice coefficient over word bigrams.

Native column expressions only, and no shuffle: a row is scanned where it is read. A
text is one run of normalised words (lower case, letters and digits) across its line
ends, so where lines break has no say. A window of it and a template are bags of
bigrams. With a threshold t, bags of sizes a and b can only match if
t / (2 - t) * b <= a <= (2 - t) / t * b: windows outside these bounds, and such with
fewer bigrams of the template than the bound asks for, are pruned before any bags are
compared, with two look-ups for each place a window may begin at.

A window begins where a run of the template's bigrams begins, or with the template's
first bigram, and ends where a run ends, or with the template's last one: any bigram
of the template that stands next to a window makes it a better one. It must hold the
words of the template that the license's name holds too ("mit", "apache", "4", "0"), and
none of ``KINDS`` that the template lacks ("affero", "sa"): so "licensed under CC BY-SA",
whatever follows, is not version 4.0 of it. Of windows that overlap the one with most
bigrams in common stays, then the one of the larger coefficient, then of the first
template, the first start and the first end.

Texts that hold none of the ``anchors`` can't hold a window that matches, and cost no more
than that look.

Defined results: null and empty texts have no notice, nor has a text of one word; a
window counts for the line it begins in; repeated rows are scanned each; an empty table
gives an empty result; other columns are not read. Whole texts are scanned, whatever
their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# License names and the notices by which texts commonly state them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Standard headers, which windows are compared with besides the notices.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Words that make another license of a notice.
KINDS = ("affero", "lesser", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike")
#: What normalisation turns into one space; the same pattern in Spark and in the oracle.
BREAK = "[^a-z0-9]+"


def bigrams(text: str) -> list[str]:
    w = re.sub(BREAK, " ", text.lower()).strip().split(" ")
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Of a template of n bigrams: the largest window, and the least bigrams in common with any."""
    least = math.ceil(threshold / (2 - threshold) * n - 1e-9)
    return math.floor((2 - threshold) / threshold * n + 1e-9), math.ceil(threshold * (least + n) / 2 - 1e-9)


def marks(name: str, body: str) -> tuple[list[str], list[str]]:
    """Words that a window of the template must hold, and those that it must not."""
    has = {w for g in bigrams(body) for w in g.split(" ")}
    return sorted(has & set(re.split(BREAK, name.lower()))), sorted(set(KINDS) - has)


def anchors(threshold: float = 0.8, templates: tuple = TEMPLATES + HEADERS) -> list[str]:
    """Words one of which is in every window that matches: of each template, so many of its
    longest words that no more bigrams are without one than such a window may lack."""
    out: set[str] = set()
    for _, body in templates:
        grams = [g.split(" ") for g in bigrams(body)]
        spare = len(grams) - bounds(len(grams), threshold)[1]
        for word in sorted({w for g in grams for w in g}, key=lambda w: (w not in out, -len(w), w)):
            if sum(1 for g in grams if out & set(g)) > spare:
                break
            out.add(word)
    return sorted(out)


def _list(words: list[str]) -> str:
    return f"array({', '.join(map(_quote, words))})" if words else "cast(array() AS array<string>)"


def _windows_of(k: int, name: str, body: str, threshold: float) -> str:
    """array<struct<less, far, k, start, end, line>>, as SQL: the windows of one template among
    ``seen``, the text's bigrams that any template has, and ``a``, its words."""
    grams = bigrams(body)
    bag = Counter(grams)
    n = len(grams)
    most, need = bounds(n, threshold)
    must, never = marks(name, body)
    twice = "".join(f" + greatest(least(size(filter(b, x -> x = {_quote(g)})), {c}) - 1, 0)" for g, c in bag.items() if c > 1)
    common = f"element_at(transform(array(transform(slice(h, k + 1, j + 1), x -> x.g)), b -> size(array_distinct(b)){twice}), 1)"
    begins = f"(s.g = {_quote(grams[0])} OR k = 0 OR get(h, k - 1).p < s.p - 1)"
    enough = f"coalesce(get(h, k + {need - 1}).p - s.p < {most}, false)"
    ends = f"(e.g = {_quote(grams[-1])} OR coalesce(get(h, k + j + 1).p > e.p + 1, true))"
    window = f"named_struct('less', -{common}, 'size', e.p - s.p + 1, 'start', s.p, 'end', e.p, 'line', s.i)"
    some = f"transform(slice(h, k + 1, {most}), (e, j) -> CASE WHEN j >= {need - 1} AND e.p - s.p < {most} AND {ends} THEN {window} END)"
    every = f"flatten(filter(transform(h, (s, k) -> CASE WHEN {enough} AND {begins} THEN filter({some}, x -> x IS NOT NULL) END), y -> y IS NOT NULL))"
    scored = f"transform({every}, x -> named_struct('less', x.less, 'far', 2D * x.less / (x.size + {n}), 'k', {k}, 'start', x.start, 'end', x.end, 'line', x.line))"
    words = "transform(slice(a, x.start + 1, x.end - x.start + 2), y -> y.w)"
    marked = f"size(array_intersect({_list(must)}, {words})) = {len(must)} AND NOT arrays_overlap({words}, {_list(never)})"
    found = f"filter({scored}, x -> x.far <= -{threshold!r}D AND {marked})"
    return f"element_at(transform(array(filter(seen, s -> s.g IN ({', '.join(map(_quote, bag))}))), h -> {found}), 1)"


def notices(text: str = "text", threshold: float = 0.8, templates: tuple = TEMPLATES + HEADERS) -> str:
    """array<struct<line, license, dice>>, as SQL: the notices of a text, in the order of their lines."""
    any_ = f"exists(array(lower(`{text}`)), low -> {' OR '.join(f'contains(low, {_quote(a)})' for a in anchors(threshold, templates))})"
    words = f"filter(split(regexp_replace(lower(line), '{BREAK}', ' '), ' '), x -> x <> '')"
    run = f"flatten(transform(split(`{text}`, '\\n'), (line, i) -> transform({words}, x -> named_struct('i', i, 'w', x))))"
    known = ", ".join(_quote(g) for g in sorted({g for _, body in templates for g in bigrams(body)}))
    seen = f"filter(transform(slice(a, 2, greatest(size(a) - 1, 0)), (y, p) -> named_struct('p', p, 'i', a[p].i, 'g', concat(a[p].w, ' ', y.w))), s -> s.g IN ({known}))"
    every = f"concat({', '.join(_windows_of(k, name, body, threshold) for k, (name, body) in enumerate(templates))})"
    apart = "aggregate(sort_array(c), filter(c, x -> false), (acc, x) -> CASE WHEN exists(acc, o -> x.start <= o.end AND o.start <= x.end) THEN acc ELSE concat(acc, array(x)) END)"
    pick = f"element_at(transform(array({every}), c -> {apart}), 1)"
    got = f"element_at(transform(array({run}), a -> element_at(transform(array({seen}), seen -> {pick}), 1)), 1)"
    none = "cast(array() AS array<struct<line: int, license: string, dice: double>>)"
    names = _list([name for name, _ in templates])
    return f"CASE WHEN {any_} THEN array_sort(transform({got}, x -> named_struct('line', x.line, 'license', {names}[x.k], 'dice', -x.far))) ELSE {none} END"


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, notices array<struct<line, license, dice>>) of every row."""
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).select(F.col("id").alias(id), F.expr(notices("text", threshold)).alias("notices"))


def oracle(threshold: float = 0.8, templates: tuple = TEMPLATES + HEADERS) -> str:
    """The digest of op4 in DuckDB: words unnested, every window joined with the bigrams in it, the best taken in turn."""
    grams, of = [], []
    for k, (name, body) in enumerate(templates):
        own = bigrams(body)
        most, need = bounds(len(own), threshold)
        must, never = marks(name, body)
        lists = ", ".join("[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]" for ws in (must, never))
        of.append(f"({k}, '{name}', {len(own)}, {most}, {need}, '{own[0]}', '{own[-1]}', {lists})")
        grams += [f"({k}, '{g}', {c})" for g, c in Counter(own).items()]
    return f"""
WITH RECURSIVE t(k, name, n, most, need, head, tail, must, never) AS (VALUES {", ".join(of)}),
tg(k, g, m) AS (VALUES {", ".join(grams)}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
parts AS (SELECT doc_id, i, string_split(trim(regexp_replace(lower(line), '{BREAK}', ' ', 'g')), ' ') AS w FROM lines),
words AS (SELECT doc_id, i, unnest(w) AS w, generate_subscripts(w, 1) AS j FROM parts),
placed AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS p FROM words WHERE w <> ''),
paired AS (SELECT doc_id, i, p, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM placed),
h AS (SELECT doc_id, k, i, p, g, m, row_number() OVER o AS x, lag(p) OVER o AS before, lead(p) OVER o AS after
      FROM paired JOIN tg USING (g) WINDOW o AS (PARTITION BY doc_id, k ORDER BY p)),
win AS (SELECT s.doc_id, s.k, s.i AS line, s.p AS b, e.p AS e FROM h s JOIN t ON t.k = s.k
        JOIN h e ON e.doc_id = s.doc_id AND e.k = s.k AND e.x - s.x >= t.need - 1 AND e.p - s.p BETWEEN 0 AND t.most - 1
        WHERE (s.g = t.head OR coalesce(s.before < s.p - 1, true)) AND (e.g = t.tail OR coalesce(e.after > e.p + 1, true))),
held AS (SELECT win.doc_id, win.k, win.line, win.b, win.e, least(count(*), any_value(h.m)) AS c
         FROM win JOIN h ON h.doc_id = win.doc_id AND h.k = win.k AND h.p BETWEEN win.b AND win.e GROUP BY win.doc_id, win.k, win.line, win.b, win.e, h.g),
scored AS (SELECT held.doc_id, held.k, line, b, e, sum(c) AS c, 2.0::DOUBLE * sum(c)::DOUBLE / (e - b + 1 + any_value(t.n)) AS dice
           FROM held JOIN t USING (k) GROUP BY held.doc_id, held.k, line, b, e),
told AS (SELECT s.doc_id, s.k, s.line, s.b, s.e, s.c, s.dice, list(p.w) AS ws FROM scored s JOIN placed p ON p.doc_id = s.doc_id AND p.p BETWEEN s.b AND s.e + 1
         WHERE s.dice >= {threshold} GROUP BY s.doc_id, s.k, s.line, s.b, s.e, s.c, s.dice),
cand AS (SELECT doc_id, name, line, b, e, dice, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, dice DESC, k, b, e) AS turn
         FROM told JOIN t USING (k) WHERE list_has_all(ws, must) AND NOT list_has_any(ws, never)),
pick AS (SELECT doc_id, 1::BIGINT AS turn, [{{'b': b, 'e': e, 'name': name, 'line': line, 'dice': dice}}] AS kept FROM cand WHERE turn = 1
         UNION ALL
         SELECT r.doc_id, c.turn, CASE WHEN len(list_filter(r.kept, lambda o: c.b <= o.e AND o.b <= c.e)) > 0 THEN r.kept
                ELSE list_append(r.kept, {{'b': c.b, 'e': c.e, 'name': c.name, 'line': c.line, 'dice': c.dice}}) END
         FROM pick r JOIN cand c ON c.doc_id = r.doc_id AND c.turn = r.turn + 1),
best AS (SELECT doc_id, unnest(max_by(kept, turn)) AS x FROM pick GROUP BY doc_id)
SELECT d.doc_id, count(x)::BIGINT AS n_notices,
       coalesce(string_agg(DISTINCT x.name, ',' ORDER BY x.name), '') AS licenses,
       round(coalesce(max(x.dice), 0), 6) AS best_dice, coalesce(min(x.line), -1)::BIGINT AS first_line
FROM documents d LEFT JOIN best USING (doc_id) GROUP BY d.doc_id
"""
