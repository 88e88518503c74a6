import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlark.llm.encoder import vocabulary_path
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_pii import BASE, holds
from tests.llm.test_quality import brute as measures


def made(rng):
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(n))
    footer = " ".join(rng.choices(vocabulary, k=20))
    texts = [text(rng.randint(1, 12)) for _ in range(120)]
    texts += [f"{t}\n{footer}" for t in texts[:60]] + [t.replace(t.split()[7], "changed") for t in texts[60:90]]
    texts += [f"{text(6)} mail a{k}@b.org now, 10.0.0.{k}" for k in range(20)] + [f"{footer}\n" * 4 + text(1)] * 5
    texts += ["same words " * 40, "", None]
    return [(k, t, "en", rng.choice(["h1", "h1", None]), len(t or "")) for k, t in enumerate(texts)]


def brute(rows, min_docs=20, share=0.05, keep=0.3):
    kept, lines_of = [], {}
    for doc_id, text, _, host, _ in rows:
        lines_of[doc_id] = [(line, " ".join(line.split()).lower()) for line in (text or "").split("\n")]
    versions = defaultdict(set)
    for doc_id, _, _, host, _ in rows:
        own = frozenset(k for _, k in lines_of[doc_id] if k)
        for key in own:
            versions[host, key].add(own)
    hosts = Counter(r[3] for r in rows if (r[1] or "").strip())
    common = {k for k, docs in versions.items() if len(docs) > min_docs and len(docs) > share * hosts[k[0]]}
    for doc_id, text, _, host, _ in rows:
        n_words, *_, repeated = measures(text)
        cut = sum(len(k.split()) for _, k in lines_of[doc_id] if (host, k) in common)
        if n_words >= 50 and 100 * repeated <= 50 * n_words and n_words - cut >= keep * n_words:
            kept.append((doc_id, "\n".join(line for line, k in lines_of[doc_id] if (host, k) not in common)))
    kept = [d for d, c in zip(kept, components(kept, 5, 80), strict=True) if c[3]]
    out = {}
    for doc_id, text in kept:
        spans = sorted((m.start(), m.end(), kind) for kind, p in BASE.items() for m in re.finditer(p, text) if holds(kind, m[0]))
        for start, end, kind in reversed(spans):
            text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
        out[doc_id] = text
    return out


def test_stages_equal_plain_python(spark, tmp_path):
    rows = made(random.Random(12))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    texts, tokenizer = brute(rows), Tokenizer.from_file(vocabulary_path())
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    assert 100 < len(texts) < len(rows) and set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes()
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows = made(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
