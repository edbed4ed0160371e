"""Licence scans with a trained paragraph classifier, in DataFrame operations alone.

*Training.*  Notices of each family below, notices of licences outside these families, and ordinary sentences that use the same words
are varied by dropping words at either end, cutting lines out of long notices and adding years; they train a multinomial logistic regression over sparse
word 1- to 3-grams on the driver.  Every feature holds at least one *cue*, so a paragraph without cues is unknown without being
scored.  The unknown class is calibrated on what was held out: its bias is raised until at most ``false_share`` of the held-out
ordinary sentences and foreign notices are taken for one of the families and confirmed as such.

*Scan.*  Comment signs are stripped, lines that end within a sentence are joined to the next one, and paragraphs are cut into pieces
of at most ``PIECE`` words, half overlapping, so that a piece's size does not depend on the text's.  Pieces with a cue are cut into
n-grams, joined to the weights, and summed to a score per family.  The best family is confirmed if one of its templates shares
enough word pairs with the piece; else the piece is unknown.  Wording that several families share counts for the one that the
rest of the text confirms, if any.  Weights and templates are bounded by the tables in this module, not by data.

Results depend on the text alone and meet their rows by 128 bits of its hash, so they are the same however rows are dealt.

Defined results: null or empty text has no paragraph; a text without confirmed piece has null family and an empty list; repeated
rows each give a row; ties go to the family first by name; other columns are not read.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from centrova.llm.frames import narrowed, saved

_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_LGPL = "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"
_DISCLAIMED = "in no event shall the {} be liable for any"
#: Public licence notices, lower case, without signs; "." ends a sentence.
TEMPLATES = {
    "agpl-3.0": [_GPL.format("affero general public license") + " either version 3 of the license or at your option any later version", "licensed under the gnu affero general public license version 3 .", "this work is licensed under the gnu agpl version 3 .", "you should have received a copy of the gnu affero general public license along with this program", "spdx license identifier agpl 3.0 or later ."],
    "apache-2.0": [
        "licensed under the apache license version 2.0 .", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "you may obtain a copy of the license at http www apache org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "see the license for the specific language governing permissions and limitations under the license .", "spdx license identifier apache 2.0 .",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    ],
    "bsd-2-clause": ["licensed under the bsd 2 clause license .", "released under the simplified bsd license .", "spdx license identifier bsd 2 clause ."],
    "bsd-3-clause": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "licensed under the bsd 3 clause license .", "use of this source code is governed by a bsd style license that can be found in the license file", "released under the new bsd license .", "spdx license identifier bsd 3 clause ."],
    "cc-by-4.0": ["this work is licensed under a creative commons attribution 4.0 international license .", "licensed under cc by 4.0 .", "available under the creative commons attribution license cc by 4.0 ."],
    "cc-by-nc-4.0": ["licensed under cc by nc 4.0 .", "this work is licensed under a creative commons attribution noncommercial 4.0 international license .", "available under the creative commons attribution non commercial license cc by nc 4.0 ."],
    "cc-by-sa-4.0": ["licensed under cc by sa 4.0 .", "this work is licensed under a creative commons attribution sharealike 4.0 international license .", "text is available under the creative commons attribution share alike license ."],
    "cc0-1.0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "dedicated to the public domain under cc0 1.0 universal .", "released under cc0 1.0 ."],
    "gpl-2.0": [_GPL.format("general public license") + " either version 2 of the license or at your option any later version", _GPL.format("general public license") + " version 2 of the license", "licensed under the gnu general public license version 2 .", "this work is licensed under the gnu general public license version 2 .", "released under the gnu gpl version 2 .", "spdx license identifier gpl 2.0 only ."],
    "gpl-3.0": [_GPL.format("general public license") + " either version 3 of the license or at your option any later version", "this work is licensed under the gnu general public license version 3 .", "licensed under the gnu general public license version 3 .", "released under the gnu gpl version 3 .", "spdx license identifier gpl 3.0 or later ."],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "licensed under the isc license .", "released under the isc license .", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "lgpl-3.0": [_LGPL + " either version 3 of the license or at your option any later version", "licensed under the gnu lesser general public license version 3 .", "released under the gnu lgpl version 3 .", "you should have received a copy of the gnu lesser general public license along with this library"],
    "mit": [
        "released under the mit license .", "licensed under the mit license .", "spdx license identifier mit .",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        _DISCLAIMED.format("authors or copyright holders") + " claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0 .", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"],
    "proprietary": ["all rights reserved .", "copyright 2020 example corporation all rights reserved .", "this file is proprietary and confidential unauthorized copying is strictly prohibited ."],
    "unlicense": ["this is free and unencumbered software released into the public domain .", "released under the unlicense .", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
}
#: Wording of several families, and the families that it may stand for, the first if the text confirms none of them.
SHARED = {
    "bsd-2-clause or bsd-3-clause": (["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", _DISCLAIMED.format("copyright holder or contributors") + " direct indirect incidental special exemplary or consequential damages"], ["bsd-2-clause", "bsd-3-clause"]),
    "gpl of any version": (["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "see the gnu general public license for more details .", "you should have received a copy of the gnu general public license along with this program", "licensed under the gnu general public license ."], ["gpl-2.0", "gpl-3.0", "agpl-3.0", "lgpl-3.0"]),
}
#: Notices of licences outside the families above; they train and calibrate the unknown class.
FOREIGN = [
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2.0", "licensed under the eupl version 1.2 or later", "distributed under the boost software license version 1.0", "this package is free software you may redistribute it under the terms of the artistic license 2.0",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "licensed under the common development and distribution license version 1.0", "this source file is subject to version 3.01 of the php license", "licensed under the open software license version 3.0",
    "this file is licensed under the academic free license version 3.0", "the data is available under the open database license", "licensed under the server side public license version 1", "this software is licensed under the business source license 1.1", "font software is licensed under the sil open font license version 1.1", "licensed under the microsoft public license",
]
#: Ordinary sentences with words of notices.
ORDINARY = [
    "the driver lost his license after the accident .", "a fishing license is required at the lake .", "the warranty on the washing machine ran out last year .", "please note the terms of the offer before you sign .", "the public library is open on monday .",
    "this version of the story is better .", "she was granted permission to leave early .", "copyright law is taught in the second year .", "the software crashed twice this morning .", "they reserved all the seats in the front rows .",
    "the foundation published its annual report .", "free entry for children under ten .", "he gave a copy of the letter to the lawyer .", "the license plate was covered in mud .", "the general spoke to the public in may .",
    "an attribution error is common in reviews .", "the creative team met in the commons room .", "the work is provided by volunteers .", "under the new law the source must be named .", "the university of mit students built a robot .",
    "civil rights were discussed at the meeting .", "this notice appears in the paper every week .", "the binary star was found in 1900 .", "the release of the film was delayed .", "apache helicopters flew over the town .",
    "we distribute food to any person in need .", "licensed plumbers are hard to find .", "the mozilla browser opened a new window .", "the author waived the fee for the talk .", "conditions of any kind of work were poor .",
    "version 3 of the map shows the river .", "the gnu is an antelope that lives in africa .", "the court released the files to the press .", "a permission slip is due on friday .", "the domain name was sold last week .",
    "all rights and duties pass to the buyer .", "reserved tables are next to the window .", "she reserved the right to refuse .", "the confidential letter was copied by mistake .", "the wedding license was issued under the old name .",
]
#: Words without one of which no text is looked at; every feature holds one of these or of MARKS.
CUES = frozenset(
    "affero agpl apache attribution bsd cc cc0 commons confidential contributors copies copying copyright creative disclaimer disclaims endorse gnu gpl granted grants isc lesser lgpl license licensed licenses liable merchantability mit modify mozilla mpl "
    "noncommercial noninfringement permission proprietary redistribute redistribution redistributions reserved sharealike spdx sublicense unencumbered unlicense waived warranties warranty".split()
)
MARKS = CUES | {"version", "v", "only", "later", "program", "library", "1.0", "2", "2.0", "3", "3.0", "4.0", "clause"}
UNKNOWN = "unknown"
WORD = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*|(?<= )\.(?= |$)"
PIECE, LEAST_SHARED = 160, 0.7


def classes_of(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """The classes of the scorer with their notices: families and shared wording."""
    return templates | {c: notices for c, (notices, families) in SHARED.items() if any(f in templates for f in families)}


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if any(w in MARKS for w in words[i : i + n])}


def _variants(text: str, rng: random.Random, how_many: int) -> list[list[str]]:
    words, out = text.split(), [text.split()]
    for i in range(how_many * (1 + len(words) // 24)):
        a, b = rng.randint(0, len(words) // 6), rng.randint(0, len(words) // 5)
        w = words[a : len(words) - b]
        if len(words) > 24 and i % 2:  # a line or two of a long notice
            a = 0 if i % 4 == 1 else rng.randint(0, len(words) - 12)
            w = words[a : a + rng.randint(12, 24)]
        if rng.random() < 0.4:
            w = ["copyright", str(rng.randint(1995, 2025)), *w]
        if rng.random() < 0.3:
            w = [*w, *rng.choice(ORDINARY).split()[:4]]
        out.append(w)
    return out


def confirmed(words: list[str], notices: list[str], least_shared: float = LEAST_SHARED) -> bool:
    """Whether a piece shares enough word pairs with one of the notices; what ``scan`` does with Columns."""
    pairs = lambda w: {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
    own = pairs(words)
    return any(own and len(own & x) >= least_shared * min(len(own), len(x)) for x in (pairs(t.split()) for t in notices))


@lru_cache(maxsize=32)
def train(without: str = "", seed: int = 5, false_share: float = 0.01, rounds: int = 160) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(classes, weights by n-gram, biases); the last class is unknown.  ``without``: a family to leave out, for tests."""
    rng = random.Random(seed)
    notices = classes_of({f: t for f, t in TEMPLATES.items() if f != without})
    classes = [*sorted(notices), UNKNOWN]
    rows, y = [], []
    for c, family in enumerate(classes[:-1]):
        for t in notices[family]:
            for w in _variants(t, rng, 9):
                rows.append(_grams(w))
                y.append(c)
    unknown = [_variants(t, rng, 6) for t in [*ORDINARY, *FOREIGN]]
    # Cues strewn over other text are ordinary too.
    cues = sorted(CUES)
    unknown += [[[rng.choice(cues) if rng.random() < 0.15 else "x" for _ in range(12)]] for _ in range(250)]
    rng.shuffle(unknown)  # variants of one sentence are held out together
    quarter = len(unknown) // 4
    held, kept = ([w for group in part for w in group] for part in (unknown[:quarter], unknown[quarter:]))
    rows += [_grams(w) for w in kept]
    y += [len(classes) - 1] * len(kept)
    names = sorted(set().union(*rows))
    index = {g: i for i, g in enumerate(names)}

    def matrix(sets: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(sets), len(names)), np.float32)
        for i, s in enumerate(sets):
            x[i, [index[g] for g in s if g in index]] = 1
        return x

    x, t = matrix(rows), np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        e = (p / p.sum(axis=1, keepdims=True) - t) / len(t)
        g, h = x.T @ e + 1e-5 * w, e.sum(axis=0)
        gw += g * g
        gb += h * h
        w -= 0.3 * g / np.sqrt(gw)
        b -= 0.1 * h / np.sqrt(gb)
    z = matrix([_grams(x) for x in held]) @ w + b
    best = z[:, :-1].argmax(axis=1)
    taken = np.array([confirmed(x, notices[classes[c]]) for x, c in zip(held, best, strict=True)])
    margin = np.sort(np.where(taken, z[:, :-1].max(axis=1) - z[:, -1], -np.inf))
    over = margin[min(len(margin) - 1, math.ceil((1 - false_share) * len(margin)) - 1)]
    b[-1] += max(0.0, float(over) + 1e-6) if np.isfinite(over) else 0.0
    return classes, {g: w[i].round(5).astype(float).tolist() for g, i in index.items()}, b.round(5).astype(float).tolist()


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of a few thousand constant rows."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _ngrams(words: Column) -> Column:
    def of(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _pairs(words: Column) -> Column:
    at = F.when(F.size(words) >= 2, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, 2), " ")))


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, as a trie: a word start is tried against first letters, not against every word."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [(re.escape(h) if h else "") + (_any_of(rest) if any(rest) else "") for h, rest in sorted(heads.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


ANY_CUE = r"\b" + _any_of(sorted(CUES)) + r"\b"
_COMMENT = r"(?m)^[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|%+|>+|dnl\b|rem\b)[ \t]*)+"


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def pieces(docs: DataFrame) -> DataFrame:
    """k1, k2 (of the text), place, words of the pieces of paragraphs, in lower case, that hold a cue; once for each different text."""
    text = F.col("text").cast("string")
    known = docs.select(*_text_key(text), F.lower(text).alias("text")).filter(F.col("text").rlike(ANY_CUE))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\r", ""), _COMMENT, ""), r"(?<![.:;!?\n])\n(?!\n)", " ")
    lines = known.select("k1", "k2", F.posexplode(F.split(plain, "\n")).alias("line_at", "line")).filter(F.col("line").rlike(ANY_CUE))
    # A stop of its own ends a sentence; so does the end of a paragraph.
    words = F.regexp_extract_all(F.concat(F.regexp_replace("line", r"[.!?;:]+(?=[\"')\]]*(?:\s|$))", " . "), F.lit(" .")), F.lit(f"({WORD})"), F.lit(1))
    lines = lines.select("k1", "k2", "line_at", words.alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - PIECE // 2), F.lit(PIECE // 2))
    cut = lines.select("k1", "k2", "line_at", "words", F.explode(starts).alias("at"))
    cut = cut.select("k1", "k2", F.struct("line_at", "at").alias("place"), F.slice("words", F.col("at"), PIECE).alias("words"))
    cut = cut.filter(F.exists("words", lambda w: w.isin(sorted(CUES))))
    return cut.groupBy("k1", "k2", "place").agg(F.first("words").alias("words"))


def scan(docs: DataFrame, least_shared: float = LEAST_SHARED) -> DataFrame:
    """k1, k2, place, family, probability, shared of the pieces whose family (or shared wording) is confirmed by a template."""
    spark = docs.sparkSession
    classes, weights, biases = train()
    w = _table(spark, [{"gram": g, "w": v} for g, v in weights.items()], "gram:string,w:array<double>")
    n, place = len(classes), ["k1", "k2", "place"]
    scored = pieces(docs).select(*place, "words", F.explode(_ngrams(F.col("words"))).alias("gram")).join(F.broadcast(w), "gram")
    scored = scored.groupBy(*place).agg(F.first("words").alias("words"), *[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)])
    z = F.array(*[F.col(f"z{i}") + F.lit(biases[i]) for i in range(n)])
    scored = scored.select(*place, "words", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(c) for c in classes])
    scored = scored.select(*place, "words", F.element_at(names, F.array_position("z", F.col("top")).cast("int")).alias("family"), (F.lit(1.0) / total).alias("probability"))
    known = scored.filter(F.col("family") != UNKNOWN)
    templates = [{"family": f, "pairs": sorted({" ".join(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)})} for f, many in classes_of(TEMPLATES).items() for t in many]
    t = _table(spark, templates, "family:string,pairs:array<string>")
    own = _pairs(F.col("words"))
    # A long piece may hold a short template, or be a part of a long one.
    shared = F.size(F.array_intersect(own, F.col("pairs"))) / F.least(F.size(own), F.size("pairs"))
    compared = known.join(F.broadcast(t), "family").withColumn("shared", F.when(F.size(own) > 0, shared).otherwise(F.lit(0.0)))
    best = compared.groupBy(*place, "family").agg(F.max("probability").alias("probability"), F.max("shared").alias("shared"))
    return best.filter(F.col("shared") >= least_shared)


def by_text(docs: DataFrame) -> DataFrame:
    """k1, k2, n_paragraphs, families, best (family, probability) of each text with a confirmed piece."""
    found = scan(docs)
    texts = found.groupBy("k1", "k2").agg(F.count("*").alias("n_paragraphs"), F.collect_set("family").alias("all"), F.collect_list(F.struct("probability", "place", "family")).alias("pieces"))

    def resolved(name: Column) -> Column:
        """Shared wording by the families that it may stand for: those that the text confirms, else the first."""
        out = F.array(name)
        for c, (_, families) in SHARED.items():
            many = F.array(*[F.lit(f) for f in families])
            said = F.array_intersect(F.col("all"), many)
            out = F.when(name == c, F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(families[0])))).otherwise(out)
        return out

    families = F.array_sort(F.array_distinct(F.flatten(F.transform("all", resolved))))
    first = F.array_min(F.transform("pieces", lambda p: F.struct((-p["probability"]).alias("p"), p["place"].alias("place"), F.array_min(resolved(p["family"])).alias("family"))))
    return texts.select("k1", "k2", "n_paragraphs", families.alias("families"), F.struct(first["family"].alias("family"), (-first["p"]).alias("probability")).alias("best"))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, family (of the likeliest confirmed piece), probability, n_paragraphs (confirmed pieces), families (all, sorted)."""
    rows = docs.select("doc_id", *_text_key(F.col("text").cast("string")))
    # Saved, so that the join meets a plain table: a small one is broadcast, and the rows of a text with many copies can be split.
    out = rows.join(saved(narrowed(by_text(docs.select("text")))), ["k1", "k2"], "left")
    return out.select("doc_id", F.col("best.family").alias("family"), F.col("best.probability").alias("probability"), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
