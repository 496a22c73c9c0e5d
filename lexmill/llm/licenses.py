"""Operator 5: license scan by diagonal voting.

Every rolling hash of ``GRAM`` words of every document is joined in Spark with the positions of the same hashes in
the license templates (a fixed table of some thousand rows, so it is broadcast). Hits are counted by document,
template and diagonal (document position minus template position). Diagonals no further apart than a share of the
template are merged, as inserted or missing words shift a match; copies on end lie a whole template apart and stay
separate. A merged group is verified by how much of the template its matched words cover and by the length of its span
in the document; where that fails, its best diagonal is verified alone. Where matches of different labels share half of
the shorter one's span, the one that covers more of its template wins, of equal ones the longer template: near neighbours are told apart. Fixed phrases are found beside it and always
keep their labels.

Null texts count as empty and give no label. Rows are told apart by doc_id and text together, so rows that repeat a
doc_id keep labels of their own, and equal rows get equal ones. A doc_id may be null. Of equally good matches all are
listed; the score is the best one's cover. Very long texts are scanned whole. Columns other than doc_id and text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_docs, run_hashes, word_hashes

GRAM = 4
#: Diagonals this near to each other belong to one match: at most so many words, and this share of the template.
SHIFT, SHARE = 6, 0.25
#: Share of a template's words that a match must cover, and the longest span as a multiple of the template.
COVER, STRETCH = 0.6, 1.5

#: Phrases that label a document by themselves.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: License texts and notices, paragraph by paragraph, as widely published, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("cc0", "Statement of Purpose. The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator and subsequent owner(s) of an original work of authorship and/or a database."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
]

#: Upper case to lower, every byte outside words to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def license_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return (text or b"").translate(_FOLD).split()


def template_grams(templates: list[tuple[str, str]], k: int = GRAM) -> list[tuple[int, int, int, str, int]]:
    """(hash, template, position, label, words of the template)."""
    rows = []
    for t, (label, text) in enumerate(templates):
        words = license_words(text.encode())
        if len(words) < k:
            raise ValueError(f"a template has fewer than {k} words: {text!r}")
        rows += [(int(h), t, p, label, len(words)) for p, h in enumerate(run_hashes(word_hashes(words), k).view(np.int64))]
    return rows


def phrase_places(words: list[bytes], h: np.ndarray, phrases: dict[str, str]) -> tuple[int, int | None, int | None, str]:
    """How many places hold a phrase, the first and last of them, and the labels found."""
    n, starts, labels = 0, [], set()
    for phrase, label in phrases.items():
        want = [x.encode() for x in phrase.split()]
        target = word_hashes(want)
        if len(words) < len(want):
            continue
        m = len(words) - len(want) + 1
        at = np.flatnonzero(h[len(want) - 1 : len(want) - 1 + m] == target[-1])  # the last word is the rarest
        at = [i for i in at.tolist() if words[i : i + len(want)] == want]
        if at:
            n += len(at)
            starts += [at[0], at[-1]]
            labels.add(label)
    return n, min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (verified spans)."""
    spark = docs.sparkSession
    keyed = plain_docs(docs).select("doc_id", "text", F.xxhash64("text").alias("body"))
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = license_words(t)
                rows.append((len(words), *phrase_places(words, word_hashes(words), phrases)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], ["doc_id", "body", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                hs = [run_hashes(word_hashes(license_words(t)), GRAM).view(np.int64) for t in c.column(1).cast(pa.binary()).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(h) for h in hs])])
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hs)))], ["doc_id", "body", "hs"])

    table = F.broadcast(spark.createDataFrame(template_grams(templates), "h long, template int, tpos int, label string, t_words int"))
    hits = keyed.mapInArrow(grams, "doc_id long, body long, hs array<long>").select("doc_id", "body", F.posexplode("hs").alias("pos", "h")).join(table, "h")
    # Votes by diagonal: where it starts and ends in the document, and which template words it covers.
    of = ["doc_id", "body", "template", "label", "t_words"]
    votes = hits.groupBy(*of, (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.min("pos").alias("lo"), (F.max("pos") + GRAM).alias("hi"), F.collect_set("tpos").alias("tposes"))
    words = lambda places: F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (GRAM - 1))))))
    order = Window.partitionBy("doc_id", "body", "template").orderBy("diag")
    apart = F.col("diag") - F.lag("diag").over(order) > F.least(F.lit(SHIFT), F.greatest(F.lit(1), (F.col("t_words") * SHARE).cast("int")))
    single = F.struct((words(F.col("tposes")) / F.col("t_words")).alias("cover"), (-F.col("lo")).alias("before"), "lo", "hi")
    merged = votes.withColumn("single", single).withColumn("group", F.sum(F.when(apart, 1).otherwise(0)).over(order)).groupBy(*of, "group").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_distinct(F.flatten(F.collect_list("tposes"))).alias("tposes"), F.max("single").alias("single")
    )
    whole = merged.withColumn("cover", words(F.col("tposes")) / F.col("t_words")).withColumn("fits", F.col("hi") - F.col("lo") <= STRETCH * F.col("t_words") + GRAM)
    found = whole.select(*of, *[F.when(F.col("fits"), F.col(c)).otherwise(F.col(f"single.{c}")).alias(c) for c in ("lo", "hi", "cover")]).where(F.col("cover") >= cover)
    by_doc = found.groupBy(F.col("doc_id").alias("of"), F.col("body").alias("of_body")).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "template", "label", "cover", "t_words"))).alias("every")
    )
    shared = lambda a, b: (F.least(a["hi"], b["hi"]) - F.greatest(a["lo"], b["lo"])) * 2 >= F.least(a["hi"] - a["lo"], b["hi"] - b["lo"])
    better = lambda m: lambda o: (o["label"] != m["label"]) & (F.struct(o["cover"], o["t_words"]) > F.struct(m["cover"], m["t_words"])) & shared(o, m)
    by_doc = by_doc.withColumn("matches", F.filter("every", lambda m: ~F.exists("every", better(m)))).select(
        "of", "of_body", F.array_distinct(F.transform("matches", lambda m: m["label"])).alias("more"), F.array_max(F.transform("matches", lambda m: m["cover"])).alias("best"), "matches"
    )
    out = keyed.mapInArrow(base, "doc_id long, body long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    own = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    return out.join(by_doc, out.doc_id.eqNullSafe(by_doc.of) & (out.body == by_doc.of_body), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), "matches",
    )
