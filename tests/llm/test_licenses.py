import random
import re

from ledgerlark.llm.license_texts import TEMPLATES
from ledgerlark.llm.licenses import BASE_PHRASES, license_scan

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_words(text):
    return re.findall(PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_labels(words, coverage=0.7):
    """Every template at every place."""
    found = set()
    for label, phrase, text in TEMPLATES:
        template, key = brute_words(text), phrase.split()
        for shift in range(-len(template) + 1, len(words)):
            here = range(max(0, shift), min(len(words), shift + len(template)))
            share = sum(words[i] == template[i - shift] for i in here) / len(template)
            if share >= coverage and any(words[i : i + len(key)] == key for i in here if i + len(key) <= here.stop):
                found.add(label)
    return found


def test_scan_equals_all_templates_at_all_places(spark):
    rng = random.Random(8)
    filler = brute_words(" ".join(t for _, _, t in TEMPLATES)) + ["x", "é", "y1"] * 30
    texts = [None, "", "MIT  License!", "the mit\nlicense, MIT-LICENSE and the GNU General Public License", "mit licenses", "apache\xa0license"]
    for _ in range(250):
        text = " ".join(rng.choices(filler, k=rng.randint(0, 60)))
        for _, _, notice in rng.sample(TEMPLATES, rng.randint(0, 2)):
            words = notice.split()
            for _ in range(rng.randint(0, len(words) // 4)):
                words[rng.randrange(len(words))] = "zz"
            text += f" // {' '.join(words)} {rng.choice(filler)}"
        texts.append(text)
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "Released under the MIT License.", "x"), (2, texts[2], "x")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((d, t) for d, t, _ in rows)[r.doc_id]
        words = brute_words(text)
        places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in BASE_PHRASES.items()}
        starts = [i for found in places.values() for i in found]
        base = {label for label, found in places.items() if found}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | brute_labels(words))), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert license_scan(spark.createDataFrame(rows[:0], "doc_id long, text string, labels string")).count() == 0


def test_common_licences_are_told_apart(spark):
    asked = {
        "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa", "Licensed under CC BY-NC 3.0": "cc-by-nc", "is licensed under CC BY-SA 2.0": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "cc-by-nd",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl,gpl",
        "This is free and unencumbered software released into the public domain.": "unlicense", "Distributed under the Boost Software License, Version 1.0.": "bsl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "epl", "a word about cc by nc and others": "",
    }
    asked |= {text: label for label, _, text in TEMPLATES if len(text) > 700 and label in ("mit", "apache", "bsd", "zlib")}
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan(docs).collect()}
    assert got == dict(enumerate(asked.values()))
