"""License scans: Dice coefficient over word bigrams against licence templates.

Segments of a document are its lines, its blocks between blank lines, and the whole text. Each is
normalised (lower case; letters and digits; single spaces) and compared, as a set of word bigrams, with
every template that its size admits: with threshold t, Dice can reach t only if the smaller set has at
least t / (2 - t) of the larger one's bigrams. By the same bound every match holds one of a few words, and
segments without any are passed over. All is DataFrame expressions; templates are literals.

Defined results: a null or empty text has no licence; rows that share a doc_id, null included, are one
document; a segment that is there twice counts once in a row's text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.llm.common import documents

# Parts that licence texts share.
AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
# Notices by which licences are applied to a work, and licence texts.
TEMPLATES = {
    "0BSD text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0 notice": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {NO_WARRANTY} See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "All rights reserved": "All rights reserved.",
    "BSD-2-Clause text": REDISTRIBUTION + AS_IS,
    "BSD-3-Clause text": f"{REDISTRIBUTION}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {AS_IS}",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0 notice": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. {NO_WARRANTY} See the GNU General Public License for more details.",
    "GPL-3.0 full notice": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {NO_WARRANTY} See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT full text": f"{MIT_GRANT} THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT text": MIT_GRANT,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
# Words that say little, since most texts hold them.
FREQUENT = frozenset("a an and any at be but by can for from has in is it no not of on one or that the this to with you".split())
THRESHOLD = 0.8


def normalized(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = normalized(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Sizes of sets that can reach the threshold with one of this size, with a margin of one for rounding."""
    return max(1, int(size * threshold / (2 - threshold))), int(size * (2 - threshold) / threshold) + 1


def needed_words(sets: dict[str, list[str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which any segment that reaches the threshold with any of the templates holds one at least.

    Such a segment has threshold / (2 - threshold) of the template's bigrams. Words are taken, longest
    first among equals, until the bigrams without any of them are fewer than that.
    """
    out: set[str] = set()
    for pairs in sets.values():
        bare = [p for p in pairs if out.isdisjoint(p.split())]
        while bare and len(bare) >= threshold / (2 - threshold) * len(pairs) - 1e-9:
            words = sorted({w for p in bare for w in p.split()})
            word = max(words, key=lambda w: (w not in FREQUENT, len(w) > 4, sum(w in p.split() for p in bare), len(w)))
            out.add(word)
            bare = [p for p in bare if word not in p.split()]
    return sorted(out)


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array column of words."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def segments(text: Column) -> Column:
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))


def matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, segment, license and dice for each segment and template that reach the threshold."""
    sets = {k: bigrams_of(v) for k, v in (templates or TEMPLATES).items()}
    limits = {k: bounds(len(v), threshold) for k, v in sets.items()}
    least, most = min(a for a, _ in limits.values()), max(b for _, b in limits.values())
    # One literal each, folded by the optimizer; a node for each bigram would be thousands of calls.
    listed = lambda pairs: F.split(F.lit("|".join(pairs)), r"\|")
    every = listed(sorted({b for v in sets.values() for b in v}))
    some = rf"(?:{'|'.join(needed_words(sets, threshold))})(?![\p{{L}}\p{{N}}])"
    likely = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.lower("text").rlike(some))
    parts = likely.select("doc_id", F.explode(segments(F.col("text"))).alias("segment")).filter(F.lower("segment").rlike(some))
    plain = F.trim(F.regexp_replace(F.lower("segment"), r"[^\p{L}\p{N}]+", " "))
    parts = parts.withColumn("_plain", plain).filter(F.col("_plain").contains(" ")).withColumn("_words", F.split("_plain", " "))
    # A long text may have few distinct bigrams, so that only a lower bound holds for its words.
    parts = parts.filter(F.size("_words") > least).withColumn("_pairs", bigrams(F.col("_words")))
    parts = parts.withColumn("_n", F.size("_pairs")).filter(F.col("_n").between(least, most)).filter(F.arrays_overlap("_pairs", every))

    def against(name: str) -> Column:
        own, (low, high) = sets[name], limits[name]
        dice = 2.0 * F.size(F.array_intersect("_pairs", listed(own))) / (F.col("_n") + len(own))
        return F.when(F.col("_n").between(low, high), F.struct(F.lit(name).alias("license"), dice.alias("dice")))

    found = parts.select("doc_id", "segment", F.explode(F.filter(F.array(*map(against, sets)), lambda x: x["dice"] >= threshold)).alias("m"))
    return found.select("doc_id", "segment", "m.license", "m.dice")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(documents(spark, sf_dir))
    return found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_segments"))


def _sql_list(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


def oracle_sql() -> str:
    """The same for DuckDB, without size bounds."""
    rows = ", ".join(f"('{k}', {_sql_list(bigrams_of(v))})" for k, v in TEMPLATES.items())
    return rf"""
with templates(license, pairs) as (values {rows}),
parts as (
    select doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'), [text]))) as segment from documents where text is not null
), words as (
    select doc_id, segment, string_split(trim(regexp_replace(lower(segment), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as w from parts
), pairs as (
    select doc_id, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as p from words where len(w) > 1
), scored as (
    select doc_id, license, 2.0::double * len(list_intersect(p, pairs)) / (len(p) + len(pairs)) as dice
    from pairs join templates on list_has_any(p, pairs)
)
select doc_id, license, max(dice) as dice, count(*) as n_segments from scored where dice >= {THRESHOLD} group by all
"""
