"""Licence scan: a trained paragraph classifier with template comparison, in DataFrame functions alone.

A paragraph is a run of lines: it ends at an empty line and behind a line that closes a sentence, so that hard-wrapped text is
read together and notices of one line stay apart. Its features are its distinct word pairs and triples, hashed. A multinomial
logistic regression with sparse weights is trained (see `train`) on the templates of all families, on pieces of them, and on
plain paragraphs as the unknown class; only pairs and triples of the templates have weights, so a paragraph that shares none
of them is unknown and needs no scoring. The probabilities are calibrated by a temperature on notices that are worded
otherwise than the templates, on notices of licences outside the list, and on plain lines that weren't fitted. A paragraph may
name several licences: what the family found in it has in its templates is taken out and the rest judged again, ROUNDS times
at most. Paragraphs of one family that follow one another are one finding; what two versions share (BSD, GPL) belongs to the
version beside it. It is confirmed if enough of one of the family's templates is in it, and enough of what in that template holds a
number (so that another version's notice isn't taken for this one's), and more than of any other family's template (so that what
two versions of a licence share confirms neither; a family that is found in the same text is no rival). A line without anything but white space, carriage returns and tabs included,
is empty.

The families are those of TEMPLATES; of other licences nothing is said, or what they share with these, unconfirmed.

Null text: as the empty text, without paragraphs. Repeated rows (and equal doc_ids): each row's findings are its own, told
apart by a row number. A very long text is read whole. An empty table gives no row. A text without licence paragraphs gives
no row in `scan`. Only doc_id and text are read, so that other columns' names can't clash.
"""

from __future__ import annotations

import math
import random
from functools import reduce
from operator import and_, or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What public licences say in their texts, notices and short references, one list for each family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "GPL": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License, version 2.0."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "Zlib": [
        "Licensed under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."],
}
#: Families of what several versions share; their names, and that of `proprietary`, are no identifiers.
GENERIC = {"GPL-2.0": "GPL", "GPL-3.0": "GPL", "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD"}
TEMPLATES = {family: [*texts, *([] if family in (*GENERIC.values(), "proprietary") else [f"SPDX-License-Identifier: {family}"])] for family, texts in TEMPLATES.items()}
#: Titles of licences. They are fitted on, but confirm nothing by themselves.
TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Apache License, Version 2.0"],
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "Zlib": ["zlib License"],
}
#: Notices of licences outside the list: every other one is fitted on as unknown, the rest are for the calibration.
OUTSIDE = [
    "Licensed under the Artistic License 2.0.",
    "Licensed under the Academic Free License, version 3.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the Apache License, Version 1.1.",
    "The contents of this file are subject to the Mozilla Public License Version 1.1.",
    "Licensed under the Microsoft Public License.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "Licensed under the Eclipse Public License, version 1.0.",
    "This work is licensed under a Creative Commons Attribution 2.5 License.",
    "Licensed under CC BY-ND 2.0.",
    "Licensed under CC BY-NC 2.5.",
    "Released under the PostgreSQL License.",
    "Released under the Python Software Foundation License.",
    "Licensed under the Open Software License, version 3.0.",
    "Licensed under the W3C Software Notice and License.",
    "This program is licensed under the Q Public License, version 1.0.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "Permission to copy and distribute verbatim copies of this document is granted to everyone.",
    "The publisher reserves all rights of translation, and no part of this report is for sale.",
    "The university reserves the right to change the rights of its members without notice.",
    "You may obtain a copy of the report at the office of the library.",
    "The software of the university is provided to all members of the department.",
    "Permission was granted to the visitors to use the garden for any purpose.",
    "The terms of the license agreement for the building are in the first part of the contract.",
    "A driving license is required under the terms of the contract.",
]
#: Notices in other words, for the calibration alone.
OTHERWISE = {
    "Apache-2.0": ["Distributed under the terms of the Apache License, Version 2.0, see the file", "This file is licensed to you under the Apache License, Version 2.0"],
    "MIT": ["The library is available under the MIT license", "Code in this folder is released under the MIT License, see LICENSE"],
    "ISC": ["The tool is licensed under the ISC license"],
    "GPL-2.0": ["You may copy it under the GNU General Public License, version 2 only", "It comes under the terms of version 2 of the License, the GNU General Public License"],
    "GPL-3.0": ["You may copy it under the GNU General Public License, version 3 only", "It comes under the terms of version 3 of the License, the GNU General Public License"],
    "LGPL-2.1": ["You may link it under the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["You may link it under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["The server is under the GNU Affero General Public License, version 3"],
    "BSD-2-Clause": ["It has the BSD 2-Clause License"],
    "BSD-3-Clause": ["It has the BSD 3-Clause License", "the names of its contributors may be used to endorse or promote products"],
    "MPL-2.0": ["covered by the Mozilla Public License, version 2.0"],
    "EPL-2.0": ["covered by the Eclipse Public License, version 2.0"],
    "CC-BY-4.0": ["The pictures are under a Creative Commons Attribution 4.0 International licence"],
    "CC-BY-SA-4.0": ["The pictures are under a Creative Commons Attribution-ShareAlike 4.0 International licence"],
    "proprietary": ["No part of it may be reproduced without prior written permission"],
}
#: Plain sentences for the unknown class; the corpus adds paragraphs of its own.
PLAIN = ["the software is used in this work by any person", "you may use the first part of the library", "the public library is free of charge", "a copy of the book was included in the work", "this version of the program is used under the old name", "see the following notice for more details", "the terms of the agreement are in the first part", "public domain name of the international work"]
UNKNOWN = "unknown"
#: A family is reported from this probability on, and confirmed from this containment on.
LEAST_PROBABILITY, LEAST_CONTAINMENT = 0.5, 0.6
#: Bound of the corpus sample for the unknown class: about so many documents give one line each. A line that holds more than
#: this share of a template isn't taken for a plain one.
MOST_PLAIN, PLAIN_CONTAINMENT = 400, 0.3
#: The template number of lines of the corpus.
CORPUS = -2
#: A paragraph is judged so many times at most, each time without what the families found in it have in their templates.
ROUNDS = 3
#: A paragraph ends behind a line that closes a sentence.
CLOSED = "[.!?:。！？][)\"'”]*\\s*$"

#: Of the regression: the weight of the penalty, the share of it that is absolute, and the most steps.
SHRINK, LASSO, STEPS = 1e-3, 0.1, 100
#: What tells a paragraph from others.
PLACE = ["doc_id", "row", "line_no", "last_line"]
#: Pairs and triples of these words alone are no features.
COMMON = "a and any are as at be by for in is it not of on or that the this to under was with".split()


def words_of(column: str):
    """The words of a text column in lower case: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col(column)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def grams_of(column: str):
    """The distinct hashed pairs and triples of an array of words."""
    n = F.size(column)
    part = lambda start, less: F.slice(column, start, F.greatest(n - less, F.lit(0)))
    pairs = F.zip_with(part(1, 1), part(2, 1), lambda a, b: F.xxhash64(a, b))
    ends = F.zip_with(part(1, 2), part(3, 2), lambda a, c: F.struct(a.alias("a"), c.alias("c")))
    triples = F.zip_with(ends, part(2, 2), lambda x, b: F.xxhash64(x["a"], b, x["c"]))
    return F.array_distinct(F.concat(pairs, triples))


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no (of the first line, from 0), last_line, words of every paragraph with two words or more."""
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    at = lambda k: F.get("lines", k)
    blank = lambda x: ~x.rlike("\\S")
    opens = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: (k == 0) | blank(at(k)) | blank(at(k - 1)) | at(k - 1).rlike(CLOSED))
    lines = lines.withColumn("opens", opens)
    after = lambda j: F.coalesce(F.get("opens", j + 1), F.size("lines"))
    part = lambda k, j: F.struct(k.alias("line_no"), (after(j) - 1).alias("last_line"), F.array_join(F.slice("lines", k + 1, after(j) - k), " ").alias("paragraph"))
    parts = lines.select("doc_id", "row", F.explode(F.transform("opens", part)).alias("p")).select("doc_id", "row", "p.*")
    return parts.select("doc_id", "row", "line_no", "last_line", words_of("paragraph").alias("words")).where("size(words) > 1")


def _pieces() -> list[tuple[str, str, int, str]]:
    """Training paragraphs: family, kind (template, fit or held back), template number and words."""
    rng, out, number = random.Random(3), [], 0
    for family, templates in TEMPLATES.items():
        for text in templates:
            words = text.split()
            out.append((family, "template", number, text))
            for _ in range(12):
                size = rng.randint(min(max(3, (1 if len(words) > 24 else 2) * len(words) // 3), len(words)), len(words))  # long ones also in smaller parts
                at = rng.randint(0, len(words) - size)
                out.append((family, "fit", number, " ".join(words[at : at + size])))
            for k in range(6 if len(words) > 2 else 0):  # scraps are of no family
                at = rng.randint(0, max(0, len(words) - 3))
                out.append((UNKNOWN, "held" if k % 3 == 2 else "fit", -1, " ".join(words[at : at + 2])))
            number += 1
        out += [(family, "fit", -1, title) for title in TITLES.get(family, []) for _ in range(12)]
    out += [(UNKNOWN, "held" if k % 2 else "fit", -1, text) for k, text in enumerate(OUTSIDE)]
    return out + [(family, "held", -1, t) for family, texts in OTHERWISE.items() for t in texts] + [(UNKNOWN, "fit", -1, t) for t in PLAIN]


def plain_lines(docs: DataFrame) -> list[str]:
    """One line each of about MOST_PLAIN documents, those of hashes under a bound; `train` leaves out those that are notices.

    To the driver go these lines alone, equal ones once.
    """
    n = docs.count()
    share = min(1.0, MOST_PLAIN / max(n, 1))
    few = docs.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("\\S"))
    least = F.array_min(F.transform(lines, lambda x: F.struct(F.xxhash64(x, F.lit(5)).alias("h"), x.alias("line"))))["line"]
    return sorted(r["line"] for r in few.select(least.alias("line")).where("line <> ''").distinct().collect())


def train(docs: DataFrame) -> tuple[DataFrame, dict]:
    """The weights table (gram, family, weight, templates), and the biases of the families and sizes of the templates.

    Fits on the templates' pieces and about MOST_PLAIN lines of the corpus; features are the templates' pairs and triples.
    Both are of a fixed bound; a lasso penalty makes small weights zero.
    """
    from parley.llm.shared import stored

    pieces = _pieces() + [(UNKNOWN, "held" if k % 4 == 3 else "fit", CORPUS, line) for k, line in enumerate(plain_lines(docs))]
    pieces = [(k, *piece) for k, piece in enumerate(pieces)]
    rows = docs.sparkSession.createDataFrame(pieces, "n int, family string, kind string, template int, line string").select("n", "family", "kind", "template", words_of("line").alias("words"))
    common = F.array(*[F.lit(w) for w in COMMON])
    grams = F.array_except(grams_of("words"), _dull("words", common))
    # of a fixed bound; one partition, so that every run adds up in the same order
    rows = stored(rows.select("n", "family", "kind", "template", grams.alias("grams"), F.array_intersect(_numbered("words"), grams).alias("numbered"), F.transform(grams, lambda g: g.cast("string")).alias("terms")).coalesce(1), "licence-lines")

    members: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    numbers: dict[int, int] = {}
    numbered: set[int] = set()
    for r in rows.where("kind = 'template'").select("template", "grams", "numbered").collect():  # the fixed templates
        size[r["template"]], numbers[r["template"]] = len(r["grams"]), len(r["numbered"])
        numbered |= set(r["numbered"])
        for g in r["grams"]:
            members.setdefault(g, []).append(r["template"])
    # a line of the corpus that holds enough of a template is a notice, and no plain line
    owners = docs.sparkSession.createDataFrame([(g, t, 1.0 / size[t]) for g, of in sorted(members.items()) for t in of], "gram long, template int, part double")
    met = rows.where(F.col("template") == CORPUS).select("n", F.explode("grams").alias("gram")).join(F.broadcast(owners), "gram")
    notices = met.groupBy("n", "template").agg(F.sum("part").alias("part")).where(F.col("part") > PLAIN_CONTAINMENT).select("n").distinct()
    rows = rows.join(F.broadcast(notices), "n", "left_anti")
    families, vocabulary = [*TEMPLATES, UNKNOWN], sorted(members)
    label = F.create_map(*[F.lit(v) for i, f in enumerate(families) for v in (f, float(i))])
    features = CountVectorizerModel.from_vocabulary([str(g) for g in vocabulary], "terms", "features", binary=True)
    told = features.transform(rows.withColumn("label", F.try_element_at(label, F.col("family"))))
    fit = told.where("kind <> 'held'")
    fit = fit.join(fit.groupBy("label").agg((1 / F.count("*")).alias("weight")), "label").coalesce(1)
    model = LogisticRegression(family="multinomial", weightCol="weight", elasticNetParam=LASSO, regParam=SHRINK, standardization=False, maxIter=STEPS).fit(fit)
    heat = _temperature(model.transform(told.where("kind = 'held'")))
    unknown = len(families) - 1
    w, b = model.coefficientMatrix, model.interceptVector
    family_of = [f for f, texts in TEMPLATES.items() for _ in texts]
    weights = []
    for i, g in enumerate(vocabulary):
        row = {f: float(w[k, i] - w[unknown, i]) / heat for k, f in enumerate(families[:-1])}
        # a line for each gram and family that has a weight, and one for a gram without any: it counts for the containment
        kept = {f: x for f, x in row.items() if abs(x) > 0.02} or {family_of[members[g][0]]: 0.0}
        weights += [(g, f, x, members[g], g in numbered) for f, x in kept.items()]
    table = docs.sparkSession.createDataFrame(weights, "gram long, family string, weight double, templates array<int>, numbered boolean")
    return table, {"bias": {f: float(b[k] - b[unknown]) / heat for k, f in enumerate(families[:-1])}, "size": size, "numbers": numbers, "heat": heat}


def _grams_where(column: str, wanted):
    """The hashed pairs and triples whose words fit a condition on the list of them."""
    n = F.size(column)
    part = lambda start, less: F.slice(column, start, F.greatest(n - less, F.lit(0)))
    pairs = F.zip_with(part(1, 1), part(2, 1), lambda a, b: F.when(wanted(a, b), F.xxhash64(a, b)))
    ends = F.zip_with(part(1, 2), part(3, 2), lambda a, c: F.struct(a.alias("a"), c.alias("c")))
    triples = F.zip_with(ends, part(2, 2), lambda x, b: F.when(wanted(x["a"], b, x["c"]), F.xxhash64(x["a"], b, x["c"])))
    return F.filter(F.concat(pairs, triples), lambda g: g.isNotNull())


def _dull(column: str, common):
    """Hashed pairs and triples of common words alone."""
    return _grams_where(column, lambda *words: reduce(and_, (F.array_contains(common, w) for w in words)))


def _numbered(column: str):
    """Hashed pairs and triples that hold a number: what tells a licence's versions apart."""
    return F.array_distinct(_grams_where(column, lambda *words: reduce(or_, (w.rlike("^[0-9]+$") for w in words))))


def _temperature(held: DataFrame) -> float:
    """The divisor of the logits (rawPrediction) with the least loss on held-back paragraphs."""
    options = [0.25 * 16 ** (k / 32) for k in range(33)]
    z = vector_to_array("rawPrediction")
    told = held.select(F.transform(z, lambda x: x - F.array_max(z)).alias("z"), F.get(z, F.col("label").cast("int")).alias("mine"), F.array_max(z).alias("top"))
    loss = lambda t: F.avg(F.log(F.aggregate(F.transform("z", lambda x: F.exp(x / t)), F.lit(0.0), lambda a, x: a + x)) - (F.col("mine") - F.col("top")) / t)
    found = told.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(options)]).first()
    return min(zip(found, options, strict=True))[1]


def hits_of(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, row, line_no, last_line, gram, family, weight, templates: the grams of all paragraphs that have weights."""
    grams = paragraphs_of(docs).select("doc_id", "row", "line_no", "last_line", F.explode(grams_of("words")).alias("gram"))
    # the table has a fixed bound: the templates' pairs and triples
    return grams.join(F.broadcast(table), "gram")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, line_no and last_line (from 0), family, probability, containment, confirmed of every finding: paragraphs of one
    family that follow one another, at most one line between them. A paragraph of two licences is part of a finding of each.

    The probability is that of the finding's surest paragraph. A paragraph whose best family stays under LEAST_PROBABILITY is
    of the unknown class and not given.
    """
    from parley.llm.shared import stored

    table, model = train(docs)
    # few rows: written down, texts are read once, and both uses see the same row numbers after a lost executor
    return findings(stored(hits_of(docs, table), "licence-hits"), model)


def judged(hits: DataFrame, bias: dict[str, float]) -> DataFrame:
    """doc_id, row, line_no, last_line, family, probability of the paragraphs whose best family reaches LEAST_PROBABILITY."""
    by_family = hits.groupBy(*PLACE, "family").agg(F.sum("weight").alias("z"))
    prior = F.create_map(*[F.lit(v) for f, b in bias.items() for v in (f, b)])
    by_family = by_family.withColumn("e", F.exp(F.col("z") + F.try_element_at(prior, F.col("family")))).withColumn("base", F.exp(F.try_element_at(prior, F.col("family"))))
    # softmax over the families that have hits, the others at their biases, and unknown at 0
    rest = 1 + math.fsum(math.exp(b) for b in bias.values())
    best = by_family.groupBy(*PLACE).agg(F.max(F.struct("e", "family")).alias("best"), F.sum(F.col("e") - F.col("base")).alias("more"))
    return best.select(*PLACE, F.col("best.family").alias("family"), (F.col("best.e") / (F.col("more") + rest)).alias("probability")).where(F.col("probability") >= LEAST_PROBABILITY)


def findings(hits: DataFrame, model: dict) -> DataFrame:
    """The findings of `scan` from stored hits."""
    from parley.llm.shared import stored

    bias, size = model["bias"], model["size"]
    owner_of = dict(enumerate(f for f, texts in TEMPLATES.items() for _ in texts))
    owner = F.create_map(*[F.lit(v) for pair in owner_of.items() for v in pair])
    # a paragraph that names several licences: what the found ones' templates hold is taken out, and the rest judged again
    found = stored(judged(hits, bias), "licence-paragraphs")
    last, left = found, hits
    for _ in range(ROUNDS - 1):
        known = last.select("row", "line_no", F.col("family").alias("_found"))
        own = F.exists("templates", lambda t: F.try_element_at(owner, t) == F.col("_found"))
        left = left.join(known, ["row", "line_no"]).where(~own).drop("_found")
        last = judged(left, bias)
        found = found.unionByName(last)
    generic = F.try_element_at(F.create_map(*[F.lit(v) for pair in GENERIC.items() for v in pair]), F.col("family"))
    best = found.withColumn("root", F.coalesce(generic, "family")).withColumn("special", F.when(F.col("family") != F.col("root"), F.col("family")))
    best = best.groupBy(*PLACE, "root", "family", "special").agg(F.max("probability").alias("probability"))
    # paragraphs of one family that follow one another; a text's findings are few. What versions share goes with a version beside it
    order = Window.partitionBy("row", "root").orderBy("line_no", F.col("special").asc_nulls_first())
    near = F.col("line_no") <= F.max("last_line").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 2
    told = best.withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("row", "root", "part").orderBy("line_no", F.col("special").asc_nulls_first())
    before = F.last("special", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("turn", F.when(F.coalesce(F.col("special") != before, F.lit(False)), 1).otherwise(0)).withColumn("turn", F.sum("turn").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("run", F.concat_ws("/", "root", "part", "turn"))
    runs = told.groupBy("doc_id", "row", "run", "root").agg(F.coalesce(F.max("special"), F.first("root")).alias("family"), F.min("line_no").alias("line_no"), F.max("last_line").alias("last_line"), F.max("probability").alias("probability"))
    # the share of a template's pairs and triples that the finding has, for the family's closest template
    sizes = F.create_map(*[F.lit(v) for t, n in size.items() for v in (t, n)])
    shared = hits.select("row", "line_no", "gram", "templates", "numbered").distinct().join(told.select("row", "line_no", "run").distinct(), ["row", "line_no"])
    shared = shared.select("row", "run", "gram", "numbered", F.explode("templates").alias("template")).distinct()
    numbers = F.create_map(*[F.lit(v) for t, n in model["numbers"].items() for v in (t, n)])
    told_numbers = F.count_if("numbered") >= LEAST_CONTAINMENT * F.try_element_at(numbers, F.col("template"))
    shared = shared.groupBy("row", "run", "template").agg((F.count("*") / F.try_element_at(sizes, F.col("template"))).alias("part"), told_numbers.alias("true"))
    shared = shared.withColumn("owner", F.try_element_at(owner, F.col("template"))).join(runs.select("row", "run", "family", "root"), ["row", "run"])
    shared = shared.join(found.select("row", F.col("family").alias("owner"), F.lit(True).alias("known")).distinct(), ["row", "owner"], "left")
    mine = F.col("owner") == F.col("family")
    rival = ~mine & (F.col("owner") != F.col("root")) & F.col("known").isNull()
    shared = shared.groupBy("row", "run").agg(F.max(F.when(mine, F.col("part"))).alias("containment"), F.max(F.when(mine & F.col("true"), F.col("part"))).alias("proof"), F.max(F.when(rival, F.col("part"))).alias("other"))
    out = runs.join(shared, ["row", "run"], "left")
    containment = F.coalesce("containment", F.lit(0.0))
    confirmed = (F.coalesce("proof", F.lit(0.0)) >= LEAST_CONTAINMENT) & (containment > F.coalesce("other", F.lit(0.0)))
    return out.select("doc_id", "line_no", "last_line", "family", F.round("probability", 6).alias("probability"), F.round(containment, 6).alias("containment"), confirmed.alias("confirmed"))
