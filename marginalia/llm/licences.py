"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

A licence can be the whole text or a notice inside it, whole, with words put in, or in part, so the words of a text are
compared in windows of all widths that can match.  A window of w bigrams and a template of t bigrams reach the
least Dice coefficient D only if w lies within t D / (2 - D) and t (2 - D) / D, and if they share D (w + t) / 2
bigrams; templates whose bounds no part of a text meets are left out before anything is compared.  A window that starts
or ends with a bigram that the template lacks is worse than the window without it, so only windows from one shared bigram
to another are formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import slices
from marginalia.llm.vectors import runs, sequence_hash, sums_by_text, word_hashes

LEAST_DICE = 0.8

# Public licence notices and texts.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed-line": "Licensed under the MIT License.",
    "BSD-3-line": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
               "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
                  "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
                  "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
                  "the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
                        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
                        "GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                        "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that "
                        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
                        "GNU General Public License for more details.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                         "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
                         "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
                         "the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                         "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
                         "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
                         "the GNU Affero General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
           "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
           "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
           "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
           "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
           "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
           "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
           "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
           "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
           "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
           "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
                    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
                    "with the distribution.",
}
TEMPLATES["BSD-3-Clause"] = (TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                             "derived from this software without specific prior written permission.")

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    """Lower-case ASCII; everything but ASCII letters and digits and characters beyond ASCII is a blank."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).lower()


def dice(a: list | np.ndarray, b: list | np.ndarray) -> float:
    """Dice coefficient of two bags of bigrams."""
    from collections import Counter
    x, y = Counter(np.asarray(a).tolist()), Counter(np.asarray(b).tolist())
    return 2 * sum((x & y).values()) / max(1, x.total() + y.total())


def _bag_windows(codes: np.ndarray, bag: np.ndarray, width: int) -> np.ndarray:
    """Shared bigrams (as bags) of every window of ``width`` positions with a template.

    ``codes`` holds the number of a template bigram at each position, or -1.  Counts are kept while the window moves.
    """
    n = len(codes) - width + 1
    have = [0] * len(bag)
    most, out, shared = bag.tolist(), np.zeros(max(n, 0), np.int64), 0
    values = codes.tolist()
    for i, c in enumerate(values):
        if c >= 0:
            have[c] += 1
            shared += have[c] <= most[c]
        gone = values[i - width] if i >= width else -1
        if gone >= 0:
            shared -= have[gone] <= most[gone]
            have[gone] -= 1
        if i >= width - 1:
            out[i - width + 1] = shared
    return out


def _spans(codes: np.ndarray, times: np.ndarray, least: float, size: int, shortest: int, longest: int) -> list[tuple[float, int, int]]:
    """(Dice, width, start) of all windows from one shared bigram to another that reach the least coefficient."""
    at = np.flatnonzero(codes >= 0)
    hits = codes[at]
    # A bigram counts in a window if the occurrence that uses up its number in the template lies before the window.
    lag = np.full(len(at), -1)
    order = np.argsort(hits, kind="stable")
    number = times[hits[order]]
    back = np.arange(len(order)) - number
    same = (back >= 0) & (hits[order][np.maximum(back, 0)] == hits[order])
    lag[order[same]] = order[back[same]]
    reach = np.searchsorted(at, at + longest) - np.arange(len(at))
    starts = np.flatnonzero(reach >= shortest)
    found: list[tuple[float, int, int]] = []
    step = max(1, 1_000_000 // max(1, int(reach.max(initial=1))))
    for k in range(0, len(starts), step):
        s = starts[k:k + step, None]
        j = s + np.arange(int(reach[s].max()))
        inside = j < s + reach[s]
        j = np.minimum(j, len(at) - 1)
        counts = inside & (lag[j] < s)
        width = at[j] - at[s] + 1
        score = 2 * np.cumsum(counts, axis=1) / (width + size)
        row, col = np.nonzero(counts & (score >= least))
        found += zip(score[row, col].tolist(), width[row, col].tolist(), at[s[row, 0]].tolist(), strict=True)
    return found


class Templates:
    """Bigrams of the templates, as bags, and all of them sorted for look-up."""

    def __init__(self, texts: dict[str, str], least: float):
        self.names, self.least = list(texts), least
        raw = [normalised(texts[n]) for n in self.names]
        self.bags = []
        for t in raw:
            hashes, _, _ = word_hashes([t])
            self.bags.append(np.unique(sequence_hash(hashes, 2), return_counts=True))
        self.all = np.unique(np.concatenate([b[0] for b in self.bags])) if self.bags else np.zeros(0, np.uint64)

    def matches(self, words: np.ndarray, all_widths: bool = False) -> list[tuple[str, int, int, float]]:
        """(template, first word, end, Dice) of the parts of one text that reach the least coefficient.

        The parts are windows of all widths that can, or of a template's size and the whole text only.
        Of overlapping parts the better one stays, then the longer, then the earlier.
        """
        grams, found = sequence_hash(words, 2), []
        for name, (keys, times) in zip(self.names, self.bags, strict=True):
            size = int(times.sum())
            shortest, longest = int(np.ceil(size * self.least / (2 - self.least) - 1e-9)), int(size * (2 - self.least) / self.least + 1e-9)
            if not size or len(grams) < shortest:
                continue
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            codes = np.where(keys[at] == grams, at, -1)
            if all_widths:
                if (codes >= 0).sum() >= shortest:
                    found += [(*span, name) for span in _spans(codes, times, self.least, size, shortest, longest)]
                continue
            if (codes >= 0).sum() < self.least * (min(size, len(grams)) + size) / 2:
                continue
            widths = {min(size, len(grams))} | ({len(grams)} if shortest <= len(grams) <= longest else set())
            for width in sorted(widths):
                shared = _bag_windows(codes, times, width)
                score = 2 * shared / (width + size)
                found += [(float(score[i]), width, int(i), name) for i in np.flatnonzero(score >= self.least)]
        kept: list[tuple[str, int, int, float]] = []
        taken = bytearray(len(words))
        for score, width, start, name in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            if taken.find(1, start, start + width + 1) < 0:
                taken[start:start + width + 1] = b"\1" * (width + 1)
                kept.append((name, start, start + width + 1, score))
        return sorted(kept, key=lambda k: k[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """One row per input row: doc_id, license (of the best part, or null), dice (0 without one), n_matches, matches.

    ``matches`` lists all parts as template:first word:end:dice.  Null texts count as empty and match nothing;
    repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
    """
    known = TEMPLATES if templates is None else templates

    def rows(batches):
        wanted = Templates(known, least)
        for batch in slices(batches, "text", 1_500_000):
            hashes, counts, _ = word_hashes([normalised(t) for t in batch.column(1).to_pylist()])
            # Texts with no bigram of any template are done; the others are looked at one by one.
            grams = sequence_hash(hashes, 2)
            place = np.minimum(np.searchsorted(wanted.all, grams), max(len(wanted.all) - 1, 0))
            hit = np.zeros(len(hashes), np.int64)
            if len(wanted.all):
                hit[:len(grams)] = wanted.all[place] == grams
            some, at = sums_by_text(hit, counts) > 0, runs(counts)
            names, best, number, listed = [], [], [], []
            for i in range(len(counts)):
                got = wanted.matches(hashes[at[i]:at[i] + counts[i]], True) if some[i] else []
                top = min(got, key=lambda g: (-g[3], -(g[2] - g[1]), g[1]), default=None)
                names.append(top[0] if top else None)
                best.append(top[3] if top else 0.0)
                number.append(len(got))
                listed.append(",".join(f"{n}:{s}:{e}:{d:.4f}" for n, s, e, d in got))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(number, pa.int64()), pa.array(listed, pa.string())],
                                             names=["doc_id", "license", "dice", "n_matches", "matches"])

    raw = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return raw.mapInArrow(rows, "doc_id bigint, license string, dice double, n_matches bigint, matches string")
