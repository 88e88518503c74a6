import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import merkle
from ledgerlark.llm.merkle import Tree, group_key, manifest, proofs, row_digest


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels(nodes, fanout):
    """All levels of a tree, by its definition."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, idx, fanout):
    found = []
    for level in tree[:-1]:
        run = idx // fanout * fanout
        found.append((level[run:idx], level[idx + 1 : run + fanout]))
        idx //= fanout
    return found


def expected(leaves, fanout):
    """(key, leaf, subroot, root, proof, folded, verified) of rows (group, key, leaf, altered)."""
    groups = {}
    for row in sorted(leaves, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(row[0], []).append(row)
    trees = {g: levels([r[2] for r in rows], fanout) for g, rows in groups.items()}
    top = levels([trees[g][-1][0] for g in sorted(trees)], fanout)
    out = []
    for place, g in enumerate(sorted(trees)):
        for idx, (_, key, leaf, altered) in enumerate(groups[g]):
            path = siblings(trees[g], idx, fanout) + siblings(top, place, fanout)
            reached = altered or leaf
            for before, after in path:
                reached = h(*before, reached, *after)
            out.append((key, leaf, trees[g][-1][0], top[-1][0], h(*(d for b, a in path for d in (*b, *a))), reached, reached == top[-1][0]))
    return out


def leaf(x):
    return hashlib.sha256(repr(x).encode()).hexdigest()


@pytest.mark.parametrize(("fanout", "chunk"), [(2, 4), (3, 9), (2, 4096), (5, 5)])
def test_proofs_equal_the_definition(spark, monkeypatch, fanout, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(b"\x01en", k, leaf(k), leaf(-k) if k % 7 == 0 else None) for k in range(rng.randint(90, 130))]
    rows += [(bytes([1, 65 + k % 11]), rng.choice([None, 3, k]), leaf(k % 9), None) for k in range(60)] + [(b"\x00", 5, leaf("x"), leaf("x"))] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame([(g, k, bytes.fromhex(d), a and bytes.fromhex(a)) for g, k, d, a in rows], "grp binary, key long, digest binary, altered binary").repartition(7)
    got = [tuple(r) for r in proofs(manifest(df, fanout)).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows, fanout), key=repr)


def test_records_are_the_nodes_of_all_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 8)
    leaves = [leaf(k) for k in range(101)]
    df = spark.createDataFrame([(b"g", k, bytes.fromhex(d), None) for k, d in enumerate(leaves)], "grp binary, key long, digest binary, altered binary")
    tree = Tree(df, ["key"])
    assert sorted((r.level, r.idx, r.digest.hex()) for r in tree.records().collect()) == [(k, i, d) for k, level in enumerate(levels(leaves, 2)) for i, d in enumerate(level)]
    assert tree.rounds[0].groupBy("peak_level", "peak_idx").agg(F.countDistinct("n")).count() < 40  # not one stack for each leaf


def test_one_leaf_and_none(spark):
    schema = "grp binary, key long, digest binary, altered binary"
    one = spark.createDataFrame([(b"", 1, bytes.fromhex(leaf(1)), None)], schema)
    assert [tuple(r) for r in proofs(manifest(one)).collect()] == [(1, leaf(1), leaf(1), leaf(1), h(), leaf(1), True)]
    assert proofs(manifest(one.limit(0))).collect() == []
    with pytest.raises(ValueError):
        Tree(one, ["key"], 1)


def test_digest_of_a_row_with_nulls_and_long_texts(spark):
    text = "é" * 300_000
    row = spark.createDataFrame([(7, None, "de", text), (None, "", None, None)], "doc_id long, source string, lang string, text string")
    got = sorted(r[0] for r in row.select(F.hex(row_digest(*(F.col(c) for c in row.columns)))).collect())
    assert got == sorted(hashlib.sha256(t.encode()).hexdigest().upper() for t in (f"1:7-2:de600000:{text}", "-0:--"))
    assert [bytes(r[0]) for r in row.select(group_key(F.col("lang"))).collect()] == [b"\x01de", b"\x00"]
