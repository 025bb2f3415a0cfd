"""Licence scan by sentence rules, in DataFrame operations only.

A text is cut into sentences: behind ``. ! ? : ;`` and at line ends, unless the line goes on: in lower case (indented or not), from
capitals to capitals, with a quote or bracket, or with a word of ``CARRIED``. The colon of an SPDX line does not cut. Normalised
(lower case, anything but letters and digits one blank), a sentence is looked up in a fixed catalogue of known licence
sentences. What a document says is the sequence of their identifiers in order; ordered rules over such sequences name its
licences. A rule of several sentences allows others between them; of the rules of one family the first that holds counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, table

# Names by which sentences refer to a licence, in the order licence: names.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit"],
    "ISC": ["isc license", "isc"],
    "Apache-2.0": ["apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0", "apache 2 0 license"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gnu gpl v3", "gpl v3", "gplv3", "gnu general public license v3 0", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gnu gpl v2", "gpl v2", "gplv2", "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl v3", "lgplv3", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl v3", "agplv3", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "bsd 3 clause"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC0-1.0": ["cc0 1 0", "creative commons zero v1 0 universal license"],
}
REFERENCES = ["licensed under", "licensed under the", "released under the", "distributed under the", "available under the",
              "this work is licensed under the", "this work is licensed under a", "this software is licensed under the",
              "this project is licensed under the", "spdx license identifier"]
# Sentences of full licence texts, identifier: normalised sentence.
SENTENCES = {
    "rights": "all rights reserved",
    "public": "this work is in the public domain",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gnu-gpl": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gnu-gpl-3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gnu-lgpl-3": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gnu-agpl-3": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gnu-either-2": "either version 2 of the license or at your option any later version",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}
#: Families of ordered rules: (licence, sequence of identifiers).
RULES = [
    [("MIT", ["mit-grant", "mit-notice", "mit-warranty"]), ("MIT-like", ["mit-grant"])],
    [("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
     ("BSD-like", ["bsd-grant"])],
    [("Apache-2.0", ["ref:Apache-2.0", "apache-use", "apache-copy"]), ("Apache-2.0", ["ref:Apache-2.0"]), ("Apache-like", ["apache-use", "apache-copy"])],
    [("ISC", ["isc-grant"])],
    [("GPL-3.0", ["gnu-gpl-3"])],
    [("GPL-2.0", ["gnu-gpl", "gnu-either-2"]), ("GPL-like", ["gnu-gpl"])],
    [("LGPL-3.0", ["gnu-lgpl-3"])],
    [("AGPL-3.0", ["gnu-agpl-3"])],
    [("public-domain", ["public"])],
    [("all-rights-reserved", ["rights"])],
    *[[(name, [f"ref:{name}"])] for name in NAMES if name != "Apache-2.0"],
]
#: Capitalised words that licence texts carry over a line end within a sentence.
CARRIED = "Software|License|Licence|Apache|GNU|Foundation"
#: Places where a line goes on, and the end of an SPDX identifier, as (pattern, what stays), in order; the same for both engines but for the sign of a group.
JOINS = [
    (r"\n[ \t]+([a-z])", " {1}"), (r"([Ss][Pp][Dd][Xx]-[Ll]icense-[Ii]dentifier):[ \t]*([^ \t\n]+)", "{1} {2}\u0001"), (r'([A-Z",])\n([A-Z][A-Z])', "{1} {2}"), (r'\n(["(][A-Za-z])', " {1}"),
    (rf"([a-z,])\n((?:{CARRIED})\b)", "{1} {2}"),
]
#: Every known sentence holds one of these, so other sentences need no look-up.
MARKS = "licen|under|permi|redistribut|rights reserved|public domain|warrant|endorse"


def catalogue() -> dict[str, str]:
    """Normalised sentence: identifier."""
    known = {f"{reference} {name}": f"ref:{licence}" for licence, names in NAMES.items() for name in names for reference in REFERENCES}
    return known | {sentence: name for name, sentence in SENTENCES.items()}


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order; empty ones stay as places."""
    for pattern, kept in JOINS:
        text = F.regexp_replace(text, pattern, kept.replace("{", "$").replace("}", ""))
    marked = F.regexp_replace(F.regexp_replace(text, r"\n(?![a-z])", "\u0001"), r"(?<=[.!?:;])\s+", "\u0001")
    cut = F.split(F.lower(marked), "\u0001", -1)
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))


def _holds(sequence: Column, rule: list[str]) -> Column:
    """Whether the identifiers of the rule occur in this order; ``sequence`` is ``|a|b|..|``."""
    return F.rlike(sequence, F.lit(r"(?:\|[^|]+)*".join("\\|" + name.replace(".", "\\.") for name in rule) + r"\|"))


def licences(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: rid, doc_id, n_sentences (known ones), sentence_ids (in order, joined by ``|``),
    licences (sorted, joined by commas).

    Null and empty texts, and texts without known sentences, have none. Rows with null or equal doc_id are told apart by
    rid. Other columns are ignored.
    """
    spark = documents.sparkSession
    rows = numbered(documents.select("doc_id", "text"))
    known = spark.createDataFrame(sorted(catalogue().items()), "sentence string, sentence_id string")
    worth = rows.where(F.rlike(F.lower("text"), F.lit(MARKS))).select("rid", sentences(F.col("text")).alias("all"))
    places = worth.select("rid", F.posexplode("all").alias("place", "sentence")).where(F.rlike("sentence", F.lit(MARKS)))
    found = places.join(F.broadcast(known), "sentence").groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("place", "sentence_id"))).alias("found"))
    named = found.select(
        "rid", F.size("found").alias("n_sentences"),
        F.array_join(F.transform("found", lambda f: f["sentence_id"]), "|").alias("sentence_ids"))
    sequence = F.concat(F.lit("|"), F.col("sentence_ids"), F.lit("|"))
    ruled = []
    for family in RULES:
        first = F.when(_holds(sequence, family[0][1]), family[0][0])
        for licence, rule in family[1:]:
            first = first.when(_holds(sequence, rule), licence)
        ruled.append(first)
    named = named.withColumn("licences", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*ruled)))), ","))
    return rows.select("rid", "doc_id").join(named, "rid", "left").select(
        "rid", "doc_id", F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"),
        F.coalesce("sentence_ids", F.lit("")).alias("sentence_ids"), F.coalesce("licences", F.lit("")).alias("licences"))


def op7(spark, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents")).drop("rid")


def _sql() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in sorted(catalogue().items()))
    def holds(rule):
        pattern = "(?:[|][^|]+)*".join("[|]" + name.replace(".", "[.]") for name in rule) + "[|]"
        return f"regexp_matches('|' || sentence_ids || '|', '{pattern}')"

    cases = ", ".join("CASE " + " ".join(f"WHEN {holds(rule)} THEN '{licence}'" for licence, rule in family) + " END" for family in RULES)
    text = "text"
    for pattern, kept in JOINS:
        text = f"regexp_replace({text}, '{pattern}', '{kept.replace('{', chr(92)).replace('}', '')}', 'g')"
    return rf"""
WITH known(sentence, sentence_id) AS (VALUES {values}),
cut AS (
  SELECT doc_id, string_split(lower(regexp_replace(regexp_replace({text}, '\n([^a-z]|$)', chr(1) || '\1', 'g'), '([.!?:;])\s+', '\1' || chr(1), 'g')), chr(1)) AS parts
  FROM documents),
places AS (SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS part FROM cut),
found AS (
  SELECT doc_id, count(*) AS n_sentences, string_agg(sentence_id, '|' ORDER BY place) AS sentence_ids
  FROM places JOIN known ON sentence = trim(regexp_replace(part, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) GROUP BY doc_id),
named AS (SELECT *, list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))) AS names FROM found)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids,
  coalesce(array_to_string(names, ','), '') AS licences
FROM documents LEFT JOIN named USING (doc_id)
"""


OP7_SQL = _sql()
