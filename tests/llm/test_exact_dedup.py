import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.exact_dedup import SEGMENT, Hasher, _same, exact_dedup


@settings(deadline=None, max_examples=40)
@given(st.binary(max_size=5000), st.binary(max_size=5000))
def test_fingerprints_compose(a, b):
    h = Hasher()
    pa, pb, pab = h.many([a, b, a + b])
    assert h.join(pa, pb) == pab


def test_fingerprint_against_definition():
    h = Hasher()
    for text in (b"", b"\0", b"\0\0", b"abc", bytes(range(256)) * 9, b"z" * (SEGMENT + 17)):
        n, *residues = h.many([text])[0]
        assert n == len(text)
        for base, r in zip(h.bases, residues):
            value = 0
            for byte in text:
                value = (value * base + byte) % h.prime
            assert value == r


def test_huge_texts_are_composed_of_pieces(spark, odd):
    from quern.llm.common import narrow
    from quern.llm.exact_dedup import fingerprints

    docs = narrow(odd, "doc_id", "text")
    whole = Counter(map(tuple, fingerprints(docs).collect()))
    for huge in (1, 20, 100_000):
        assert Counter(map(tuple, fingerprints(docs, huge=huge).collect())) == whole
    check(odd, huge=20)


def test_chunkwise_comparison():
    assert _same(b"a" * 200_000, b"a" * 200_000)
    assert not _same(b"a" * 200_000, b"a" * 199_999 + b"b")
    assert not _same(b"", b"a")


def expect(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((r["doc_id"], best[r["text"] or ""], len(groups[r["text"] or ""]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows), len(groups)


def check(df, **options):
    want, classes = expect(df.select("doc_id", "text").collect())
    got = exact_dedup(df, **options).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == classes and len({r["text_sha256"] for r in kept}) == classes
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_odd_rows(odd, empty):
    check(odd)
    assert exact_dedup(empty).count() == 0


def test_real_rows(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_collisions_are_split(spark):
    """A hasher of one tiny base modulo 3 makes different texts of a length collide."""
    rows = [(i, "abcdefgh"[i % 8] + "xyz"[i % 3]) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), hasher=Hasher(bases=(1,), prime=3))


def test_hot_group(spark):
    rows = [(i, "the same text") for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
