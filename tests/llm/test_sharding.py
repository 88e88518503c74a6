import random
import zlib
from collections import Counter, defaultdict

from ledgerlark.llm.sharding import balanced_shards, equal_text_links, op2_balanced_shards, propagate, quotas, room_for


def test_counts_are_even_and_equal_texts_stay_together(spark):
    rng = random.Random(3)
    texts = [f"text {rng.randrange(700)}" for _ in range(900)] + ["hot"] * 300 + ["", None, "é"]
    rng.shuffle(texts)
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "null id", "x", 1), (5, texts[5], "x", 1)]
    got = balanced_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string, node int"), shards=7).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    slots, places = defaultdict(list), defaultdict(set)
    for r in got:
        text = (dict((d, t) for d, t, _, _ in rows)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
        slots[r.shard].append(r.slot)
        places[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(len, slots.values()), reverse=True) == room_for(len(rows), 7)
    assert len(places.pop(b"hot")) <= 4 and all(len(p) == 1 for p in places.values())


def test_propagation_keeps_to_the_quotas_and_cuts_fewer_links(spark):
    rng = random.Random(6)
    edges = {(a, b) for c in range(12) for a in range(10 * c, 10 * c + 10) for b in rng.sample(range(10 * c, 10 * c + 10), 4) if a < b}
    links = spark.createDataFrame([*edges, (3, 57), (20, 99)], "a long, b long")
    cut = {}
    for patience in (0, 4):
        shard = {r.node: r.shard for r in propagate(links, [25] * 6, patience).collect()}
        assert max(Counter(shard.values()).values()) <= 25
        cut[patience] = sum(shard[a] != shard[b] for a, b in edges)
    assert cut[4] < 0.6 * cut[0]


def test_query_keeps_every_law_of_its_result(spark, tmp_path):
    rng = random.Random(4)
    texts = [f"text {rng.randrange(900)}" for _ in range(1500)] + ["hot"] * 800 + ["é" * 9000, "", None, None]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_balanced_shards(spark, str(tmp_path)).collect()
    expected = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    hot = places.pop(zlib.crc32(b"hot"))
    assert len(hot) < 25 and sum(len(p) > 1 for p in places.values()) <= len(places) // 50


def test_links_join_equal_texts_and_no_others(spark):
    rng = random.Random(2)
    keys = [f"k{rng.randrange(200)}" for _ in range(600)] + ["hot"] * 500
    nodes = spark.createDataFrame(list(enumerate(keys)), "node long, text_key string")
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in equal_text_links(nodes, len(keys), 90).collect():
        assert keys[a] == keys[b]
        root[find(a)] = find(b)
    assert len({find(i) for i in range(len(keys))}) == len(set(keys))


def test_few_documents_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in balanced_shards(docs).collect()) == [(0, 0), (1, 0)]
    assert balanced_shards(docs.limit(0)).count() == 0


def test_quotas_never_overfill_and_use_cycles_and_room():
    assert quotas([[0, 3, 0], [0, 0, 2], [5, 0, 0]], [0, 0, 0]) == [[0, 2, 0], [0, 0, 2], [2, 0, 0]]
    assert quotas([[0, 3, 0], [0, 0, 2], [0, 0, 0]], [0, 0, 1]) == [[0, 1, 0], [0, 0, 1], [0, 0, 0]]
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(2, 8)
        wanted = [[rng.choice([0, 0, 5, 20]) * (i != j) for j in range(n)] for i in range(n)]
        room = [rng.choice([0, 0, 7]) for _ in range(n)]
        got = quotas(wanted, room)
        assert all(0 <= got[i][j] <= wanted[i][j] for i in range(n) for j in range(n))
        assert all(sum(row[s] for row in got) - sum(got[s]) <= room[s] for s in range(n))
