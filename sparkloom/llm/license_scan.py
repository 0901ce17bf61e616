"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined to the positions of the templates' k-grams, a table of fixed
size. A hit votes for the diagonal (word position in the text minus position in the template). For a base phrase all votes
must be on one diagonal. For other templates, of any length, neighbouring diagonals are merged and their spans verified:
enough of the template's k-grams must stand in a stretch of at most twice its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import ALNUM, as_long, hash_words, kgrams, materialize, text_chunks, utf8

#: Words of a k-gram: of base phrases, and of other templates.
PHRASE_K = 2
TEMPLATE_K = 4
#: Diagonals at most so far apart are one (words put in or left out).
SHIFT = 3
LEAST_COVERED = 0.75

# The base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notices and license texts with their labels; words only, a line may be any length.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2.0"),
    ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("either version 3 of the license or at your option any later version", "gpl-3.0"),
    ("either version 2 of the license or at your option any later version", "gpl-2.0"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", "bsl-1.0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law", "cc0"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
]


def _template_table(spark) -> DataFrame:
    """(hash, t, q): k-gram q of template t; base phrases come first."""
    rows = []
    for t, (text, k) in enumerate([*((p, PHRASE_K) for p in BASE), *((p, TEMPLATE_K) for p, _ in TEMPLATES)]):
        grams = kgrams(hash_words([text.encode()], ALNUM)[0], k).view(np.int64)
        rows += [(int(h), t, q) for q, h in enumerate(grams)]
    return spark.createDataFrame(rows, "hash long, t int, q int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start. labels adds
    those of other templates of which at least LEAST_COVERED was found. score is the largest found share of any template.
    A null or empty text has no words. Rows that repeat an id are scanned each for itself. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = docs.sparkSession
    id_kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_text"):
            words, _, _, bounds = hash_words(utf8(part.column("_text")), ALNUM)
            short, long = kgrams(words, PHRASE_K), kgrams(words, TEMPLATE_K)
            pieces = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                pieces.append(np.concatenate((np.zeros(1, np.uint64), short[lo : max(lo, hi - PHRASE_K + 1)], long[lo : max(lo, hi - TEMPLATE_K + 1)])))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
            grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), as_long(np.concatenate(pieces)))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(np.diff(bounds), pa.int64()), grams], ["row", "id", "n_words", "grams"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    grams = numbered.mapInArrow(hashed, f"row long, id {id_kind}, n_words long, grams array<long>")
    # entry 0 stands for the row itself, then come the short and the long k-grams
    every = grams.select("row", "id", "n_words", F.posexplode("grams").alias("i", "hash"))
    table = _template_table(spark)
    met = every.join(F.broadcast(table), "hash", "left").where("t is not null or i = 0")  # a few hundred rows, fixed
    shorts = F.greatest(F.col("n_words") - PHRASE_K + 1, F.lit(0))
    at = F.when(F.col("i") > shorts, F.col("i") - 1 - shorts).otherwise(F.col("i") - 1)
    hits = met.select("row", "id", "n_words", F.when(F.col("i") > 0, F.col("t")).alias("t"), F.when(F.col("i") > 0, F.col("q")).alias("q"), at.alias("p"))
    hits = materialize(hits.withColumn("d", F.col("p") - F.col("q")))  # texts without any hit are one row each
    sizes = [len(p.split()) - PHRASE_K + 1 for p in BASE] + [len(p.split()) - TEMPLATE_K + 1 for p, _ in TEMPLATES]
    names = [*BASE.values(), *(label for _, label in TEMPLATES)]
    size, n_base, whose = F.get(F.array(*map(F.lit, sizes)), F.col("t")), len(BASE), ["row", "id", "n_words", "t"]
    # a base phrase: its few k-grams on one diagonal, one place; a text without hits passes here, too, with t null
    places = hits.where(F.col("t").isNull() | (F.col("t") < n_base)).groupBy(*whose, "d").agg(F.bit_or(F.expr("shiftleft(1L, q)")).alias("mask"), F.min("p").alias("lo"))
    places = places.select(*whose, "lo", (F.bit_count("mask") / size).alias("share"))
    # others: islands of neighbouring diagonals, then stretches of twice the template's length, each overlapped by half by the next
    order = Window.partitionBy("row", "t").orderBy("d")
    fresh = F.coalesce(F.col("d") - F.lag("d").over(order) > SHIFT, F.lit(True)).cast("long")
    islands = hits.where(F.col("t") >= n_base).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lo = F.min("p").over(Window.partitionBy("row", "t", "island"))
    stretches = islands.withColumn("w", F.floor((F.col("p") - lo) / size)).select(*whose, "island", "q", "p", F.explode(F.sequence(F.greatest(F.col("w") - 1, F.lit(0)), F.col("w"))).alias("w"))
    spans = stretches.groupBy(*whose, "island", "w").agg(F.size(F.collect_set("q")).alias("found"), F.min("p").alias("lo")).select(*whose, "lo", (F.col("found") / size).alias("share"))
    judged = places.unionByName(spans).withColumn("label", F.get(F.array(*map(F.lit, names)), F.col("t")))
    is_base = (F.col("t") < n_base) & (F.col("share") == 1)
    counted = (F.col("t") >= n_base) & (F.col("share") >= LEAST_COVERED)
    out = judged.groupBy("row", "id", "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("lo"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base | counted, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("share") == 1, 1.0).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
