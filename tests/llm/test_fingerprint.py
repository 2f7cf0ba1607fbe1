import hashlib
import random

from chalkline.llm import fingerprint as fpr
from chalkline.llm.links import components, hamming_links, signed


def bits(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def test_pairs_match_sequential(spark, messy):
    docs = messy.filter("doc_id is null or doc_id <> 5").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = set()
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        new = fpr.edited(text, following)
        want.add((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fpr.simhash(text), fpr.simhash(new), fpr.simhash(following)))
    for parts in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = fpr.fingerprint_pairs(docs.repartition(3)).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
        assert {tuple(r) for r in got.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_repeated_rows_and_empty(spark, messy, empty_docs):
    assert fpr.fingerprint_pairs(messy).count() == messy.count()
    assert fpr.fingerprint_pairs(empty_docs).count() == 0
    one = spark.createDataFrame([(1, "only one text")], "doc_id long, text string")
    r = fpr.fingerprint_pairs(one).first()
    assert r.next_fp == r.fp and r.n_chars == 13


def test_edited_text():
    assert fpr.edited("abcdefgh", "XYZ") == "abcdefXY"
    assert fpr.edited("abcdefgh", "X") == "abcdefX"
    assert fpr.edited("abc", "XYZ") == "abc"
    assert fpr.edited("", "XYZ") == ""


def test_simhash_votes():
    text = "a b a b a c"
    words = text.encode().split()
    import numpy as np
    from xxhash import xxh64_intdigest
    m, full = [int(x) for x in fpr._MULTIPLIERS], (1 << 64) - 1
    counts = {}
    for x, y in zip(words, words[1:]):
        h = (xxh64_intdigest(x) * m[0] + xxh64_intdigest(y) * m[1]) & full
        h = (h ^ (h >> 32)) * m[2] & full
        h ^= h >> 29
        counts[h] = counts.get(h, 0) + 1
    want = sum(1 << i for i in range(64) if sum(c.bit_length() * (1 if h >> i & 1 else -1) for h, c in counts.items()) > 0)
    assert fpr.simhash(text) == signed(want)
    assert fpr.simhash("") == 0 and fpr.simhash("A b") == fpr.simhash("a  b")
    assert np.int64(fpr.simhash(text)) == fpr.simhash(text)


def near_group(rng, n, flips):
    base = rng.getrandbits(64)
    out = {base}
    while len(out) < n:
        x = base
        for i in rng.sample(range(64), flips):
            x ^= 1 << i
        out.add(x)
    return sorted(out)


def test_all_fingerprints_within_radius(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(200)] + near_group(rng, 60, 2) + near_group(rng, 40, 3) + [0, (1 << 64) - 1, 1]
    df = spark.createDataFrame([(signed(x),) for x in sorted(set(fps))], "fp long")
    for radius, blocks in ((3, 6), (2, 4)):
        got = [(r.a, r.b, r.bits) for r in fpr.within_radius(df, radius, blocks).collect()]
        want = {(a, b, bits(a, b)) for a in map(signed, set(fps)) for b in map(signed, set(fps)) if a < b and bits(a, b) <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_reach_the_same_components(spark, monkeypatch):
    rng = random.Random(6)
    chain = [rng.getrandbits(64)]
    for i in range(40):
        chain.append(chain[-1] ^ (3 << (i % 62)))
    fps = sorted({signed(x) for x in chain + near_group(rng, 50, 1) + near_group(rng, 80, 2) + [rng.getrandbits(64) for _ in range(100)]})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = groups([(a, b) for a in fps for b in fps if a < b and bits(a, b) <= 2], fps)
    for dense in (512, 8):                                  # the second finds crowded segments through common centres
        monkeypatch.setattr("chalkline.llm.links.DENSE", dense)
        links = [(r.a, r.b) for r in hamming_links(df, 2).collect()]
        assert all(bits(a, b) <= 2 for a, b in links)
        assert groups(links, fps) == want
        found = {r.node: r.root for r in components(hamming_links(df, 2)).collect()}
        assert {n: found.get(n, n) for n in fps} == want
    links3 = hamming_links(df, 3, 2)
    want3 = groups([(a, b) for a in fps for b in fps if a < b and bits(a, b) <= 3], fps)
    assert groups([(r.a, r.b) for r in links3.collect()], fps) == want3
