import random
import re

import cases
import numpy as np
import xxhash

from tabularlab.llm import simhash
from tabularlab.llm.common import Scratch
from tabularlab.llm.components import component_roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits=4):
    """Index of the first member of each fingerprint's component."""
    seen = [-1] * len(fps)
    for i in range(len(fps)):
        if seen[i] < 0:
            seen[i], todo = i, [i]
            while todo:
                x = todo.pop()
                for y in range(len(fps)):
                    if seen[y] < 0 and (fps[x] ^ fps[y]).bit_count() <= max_bits:
                        seen[y] = i
                        todo.append(y)
    return seen


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute_fingerprint(r[1]) for r in rows]
    return sorted(((r[0], f"{f:016x}", rows[c][0]) for r, f, c in zip(rows, fps, brute_components(fps))), key=repr)


def test_groups_equal_brute_force(spark):
    got = simhash.near_duplicates(cases.documents(spark), leaf_homes=2).collect()
    assert sorted(map(tuple, got), key=repr) == expected(cases.rows())


def test_random_and_clustered_fingerprints(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(250)]
    for center in fps[:8]:     # chains and clouds around some of them
        for _ in range(40):
            center ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.append(center)
    fps = sorted(set(fps), key=lambda f: np.uint64(f).astype(np.int64))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for tree in ({"leaf_homes": 8}, {"leaf_homes": 64, "shard_rows": 50}, {"leaf_homes": 8, "segments": 2}):
        with Scratch(spark, "test") as scratch:
            roots = dict(map(tuple, component_roots(simhash.fingerprint_links(nodes, scratch, **tree), scratch).collect()))
        assert [roots.get(x, x) for x in signed] == [signed[c] for c in brute_components(fps)]


def test_one_row_of_each_group_stays(spark):
    docs = cases.crowded(spark)
    kept = simhash.drop_near_duplicates(docs, leaf_homes=2)
    assert kept.columns == docs.columns
    groups = {r[0]: r[2] for r in expected(cases.rows()) if r[0] is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(cases.empty(spark)).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "HASH_BLOCK", 100)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)
