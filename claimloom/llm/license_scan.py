"""Licence scan by sentence rules, in DataFrame functions only.

Sentences are normalised and mapped to identifiers of known licence sentences; a document's sequence of
identifiers is then held against ordered licence rules.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Normalised sentences (lower case, letters and digits, single spaces) and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "licensed under cc by 4 0": "cc-by-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-endorse",
    "all rights reserved": "all-rights-reserved",
}

#: The sentences of licence texts in full, where ``SENTENCES`` has only their beginnings.
FULL_SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-grant",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
}

#: A reservation of rights right before one of these belongs to the licence's own header.
HEADED = ["mit-grant", "apache-notice>apache-compliance", "gpl-grant", "bsd-grant"]

#: Sentences end at lines without letters or digits, at ``.``, ``!``, ``?`` or ``;`` before white space, at a colon before a list or licence clause, and before a licence's opening words.
ENDS = r"(?>\r\n|\r|\n)[^A-Za-z0-9\r\n]*(?>\r\n|\r|\n)|[.!?;]\s+|:\s+(?=[^A-Za-z0-9]*(?:[0-9a-z]{1,2}[.)]\s|(?:Redistributions|The above copyright)\b))|:\s+(?=[*\u2022-]\s+Redistributions\b)|\s+(?=Permission is hereby granted, free|Redistribution and use in source)"

#: A rule matches where its identifiers follow each other, with no other identifier between.
RULES = {
    "MIT": [["mit-notice"], ["mit-grant", "mit-condition", "mit-warranty"]],
    "Apache-2.0": [["apache-notice"], ["apache-compliance", "apache-copy"]],
    "GPL-3.0": [["gpl3-notice"], ["gpl-grant", "gpl-warranty"]],
    "CC-BY-NC-4.0": [["cc-by-nc-notice"]],
    "CC-BY-4.0": [["cc-by-notice"]],
    "CC-BY-SA-4.0": [["cc-by-sa-notice"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "proprietary": [["all-rights-reserved"]],
}


def extended(name: str, rules: dict = RULES) -> list[str]:
    """The rules whose sequences go on where one of this rule's ends; where one of them matches, this one doesn't count."""
    return [other for other, seqs in rules.items() if other != name and any(long[: len(own)] == own and len(long) > len(own) for long in seqs for own in rules[name])]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict = SENTENCES | FULL_SENTENCES, rules: dict = RULES) -> DataFrame:
    """``(id, sentence_ids, licenses, n_licenses)`` for every whole text; no shuffle, no join.

    Wrapped lines are joined up to the next of ``ENDS``; where that gives no known sentence, each line is
    one of its own. Normalising lower-cases A-Z and turns every run of other characters into a space.
    ``licenses`` is sorted; of two rules of which one goes on where the other ends, the longer counts. Null text and texts without known sentences give empty arrays; rows with
    repeated or null ids come out one by one; other columns are not read.
    """
    # only pieces that hold a word which all known sentences of some kind share are worth normalising
    stems = "|".join(sorted({max(s.split(), key=len) for s in sentences}))
    known = F.create_map(*map(F.lit, chain.from_iterable(sentences.items())))
    fits = lambda x: F.length(x) >= min(map(len, sentences))
    named = lambda x: F.when(fits(x), F.try_element_at(known, F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))))
    pieces = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), ENDS), lambda x: F.lower(x).rlike(stems))
    whole = F.transform(pieces, lambda x: F.struct(named(x).alias("id"), x.alias("piece")))
    lines = lambda x: F.transform(F.filter(F.split(x, r"[\r\n]+"), lambda y: F.lower(y).rlike(stems)), named)
    ids = F.array_compact(F.flatten(F.transform(whole, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(lines(x["piece"])))))
    found = docs.select(F.col(id_col), ids.alias("sentence_ids")).withColumn("path", F.concat(F.lit(">"), F.array_join("sentence_ids", ">"), F.lit(">")))
    found = found.withColumn("path", F.regexp_replace("path", f">all-rights-reserved(?=>(?:{'|'.join(HEADED)})>)", ""))
    holds = lambda name: F.greatest(*(F.contains("path", F.lit(">" + ">".join(seq) + ">")) for seq in rules[name]), F.lit(False))
    hits = [F.when(reduce(and_, (~holds(longer) for longer in extended(name, rules)), holds(name)), F.lit(name)) for name in sorted(rules)]
    named = found.withColumn("licenses", F.array_compact(F.array(*hits)))
    return named.select(id_col, "sentence_ids", "licenses", F.size("licenses").cast("long").alias("n_licenses"))
