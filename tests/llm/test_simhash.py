import re

import numpy as np
import pytest
import xxhash

from quern.llm import queries
from quern.llm.bitslice import as_rows, planes, within
from quern.llm.simhash import bucket_edges, components, edges, fingerprint, simhash_components


def definition(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Smallest id reachable through links of two or fewer differing bits."""
    prints = [definition(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d is None, d or 0), f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in df.collect())


def test_fingerprint_definition():
    for t in ("", " \t\n", "one", "One two", "a b c", "a b c d a b c", "Ünï   x\x0by Z", "w " * 400):
        assert fingerprint(t.encode()) == definition(t)


def test_spark_agrees_on_the_hash(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 160)] ^ (np.uint64(1) << rng.integers(0, 64, 160).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 160).astype(np.uint64))
    a, b = np.concatenate([base, near]), near
    assert planes(as_rows(b)).shape == (64, 3)
    q, lane = within(as_rows(a), as_rows(b), radius)
    want = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    assert sorted(zip(q.tolist(), lane.tolist())) == sorted(zip(want[0].tolist(), want[1].tolist()))


def test_forest_spans_large_buckets():
    rng = np.random.default_rng(5)
    prints = np.unique(np.cumsum(rng.integers(0, 2, 1500).astype(np.uint64)) ^ np.uint64(1 << 40))
    u, v = bucket_edges(prints)
    assert len(u) < len(prints)
    link = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    label = np.arange(len(prints))
    while True:
        new = np.where(link, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            break
        label = new
    at = {int(p): i for i, p in enumerate(prints)}
    for a, b in zip(u.tolist(), v.tolist()):
        assert label[at[a]] == label[at[b]]
    assert len(u) == len(prints) - len(set(label.tolist()))


@pytest.mark.parametrize("limit", [4096, 3])
def test_no_link_is_lost_when_buckets_are_dealt_again(spark, limit):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = {int(x) for x in base}
    for x in base:
        for _ in range(60):
            prints.add(int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(prints)]
    reps = spark.createDataFrame(signed, "fp long")
    roots = {r["u"]: r["root"] for r in components(edges(reps, bucket_limit=limit)).collect()}
    values = [p for (p,) in signed]
    group = {v: roots.get(v, v) for v in values}
    arr = np.array(values, np.int64).view(np.uint64)
    link = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2
    for i, j in zip(*np.nonzero(link)):
        assert group[values[i]] == group[values[j]]
    assert len(set(group.values())) >= 1


def test_chains_are_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "u long, v long")
    got_roots = {r["u"]: r["root"] for r in components(links).collect()}
    assert {got_roots.get(i, i) for i in range(201)} == {0}
    assert got_roots[1001] == 1000


def test_similar_texts_are_linked(spark, empty):
    """Copies with a few changed words are found, texts that share half of their words are not."""
    import random

    rng = random.Random(8)

    def text(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    rows, want, n = [], {}, 0
    for _ in range(25):
        base = text(400)
        first = n
        for change in ((), (50,), (100, 300), (7, 200, 390)):
            words = list(base)
            for at in change:
                words[at] = "changed"
            rows.append((n, " ".join(words)))
            want[n] = first
            n += 1
        rows.append((n, " ".join(base[:200] + text(200))))
        want[n] = n
        n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash_components(docs, similarity=0.8).collect()}
    assert found == want
    assert simhash_components(empty, similarity=0.8).count() == 0


def test_query_against_brute_force(spark, sf, texts):
    assert got(queries.op8_simhash(spark, sf)) == brute_components(list(texts.items()))


def test_odd_rows(odd, plain, empty):
    found = simhash_components(odd)
    assert got(found) == brute_components([(r["doc_id"], r["text"]) for r in plain.collect()])
    rows = found.collect()
    assert sum(r["kept"] for r in rows) == len({(r["component_id"], r["fingerprint"]) for r in rows if r["kept"]})
    assert simhash_components(empty).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("radius", [0, 10, 49])
def test_bit_sliced_comparison_of_bytes(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 256, (30, 128), dtype=np.uint8)
    b = np.where(rng.random((90, 128)) < rng.random((90, 1)), a[rng.integers(0, 30, 90)], rng.integers(0, 256, (90, 128), dtype=np.uint8))
    q, lane = within(a, b, radius, 8)
    want = np.nonzero((a[:, None] != b[None]).sum(axis=2) <= radius)
    assert len(want[0]) and sorted(zip(q.tolist(), lane.tolist())) == sorted(zip(want[0].tolist(), want[1].tolist()))


def shingles_of(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def linked_brute(texts):
    """Component roots of texts by shingle similarity and fingerprint, every pair compared."""
    sets, prints = [shingles_of(t) for t in texts], [definition(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) or (prints[i] ^ prints[j]).bit_count() <= 2):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("part", [16, 1024])
def test_crowd_with_one_boilerplate(spark, monkeypatch, part):
    """One passage in all texts fills the buckets; every link of every pair is found, in parts and blocks too."""
    from quern.llm import shingle_links

    monkeypatch.setattr(shingle_links, "PART", part)
    rng = np.random.default_rng(12)
    shared = [f"s{i}" for i in range(120)]
    texts = []
    for k in range(150):
        own = [f"k{k}w{i}" for i in range(int(rng.integers(5, 60)))]
        texts.append(shared + own)
        other = list(texts[-1])
        for at in rng.integers(0, len(other), int(rng.integers(0, 5))):
            other[at] = f"x{rng.integers(1 << 30)}"
        texts.append(other)
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash_components(docs, similarity=0.8).collect()}
    assert [found[i] for i in range(len(texts))] == linked_brute(texts)


def test_shingles_do_not_depend_on_blocks():
    from quern.llm.shingle_links import shingle_set, word_blocks

    text = " ".join(f"Wort{i % 977}" for i in range(20_000)).encode()
    assert [w for block in word_blocks(text, 100) for w in block] == text.lower().split()
    assert len(shingle_set(text)) == 977
    assert shingle_set(b"a b c").tolist() == shingle_set(b" A  b\nc ").tolist() != shingle_set(b"a c b").tolist()
    long = " ".join(f"Wort{i % 977}" for i in range(160_000))  # more than one block
    assert len(shingle_set(long.encode())) == 977 and fingerprint(long.encode()) == definition(long)


def test_bands_find_pairs_at_the_similarity():
    from quern.llm.shingle_links import band_keys, minima

    rng = np.random.default_rng(6)
    for _ in range(2000):  # 80 of 100 shingles shared
        pool = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        assert (band_keys(minima(pool[:90])) == band_keys(minima(pool[10:]))).any()


def test_similarity_is_exact_on_both_sides_of_the_bound(spark):
    """Texts of distinct words that share a run: at 0.8 linked, a little under it not."""
    rows, want = [], {}
    for k in range(60):
        shared = 72 if k % 2 else 71  # of 90 and of 89 shingles
        words = [f"k{k}w{i}" for i in range(shared + 4)]
        a, b = words + [f"k{k}a{i}" for i in range(9)], words + [f"k{k}b{i}" for i in range(9)]
        a, b = " ".join(a), " ".join(b)
        for n, t in ((2 * k, a), (2 * k + 1, b)):
            rows.append((n, t))
        linked = jaccard(a, b) >= 0.8 or (definition(a) ^ definition(b)).bit_count() <= 2
        want[2 * k], want[2 * k + 1] = 2 * k, 2 * k if linked else 2 * k + 1
    assert {jaccard(rows[0][1], rows[1][1]), jaccard(rows[2][1], rows[3][1])} == {71 / 89, 72 / 90}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash_components(docs, similarity=0.8).collect()} == want
