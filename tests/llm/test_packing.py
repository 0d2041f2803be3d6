import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm.packing import Packer, encoder, pack, text_blocks

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer_file(texts, plain):
    slow = Tokenizer.from_file(PATH)
    fast = encoder(PATH)
    more = [r["text"] or "" for r in plain.collect()]
    for t in [*texts.values(), *more, "a  b \n\n c\t", "don't  'll  1234   漢字"]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids
    for t in (" " * 300_000, "a" + "\n \t" * 50_000 + "b", "x" * 200_000, "one two " * 300_000):
        assert np.array_equal(fast(t), slow.encode(t, add_special_tokens=False).ids)


def test_special_strings_are_encoded_as_the_library_does():
    slow, fast = Tokenizer.from_file(PATH), encoder(PATH)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    assert special
    for token in special:
        for t in (token, f"hello {token} x", f"a{token}{token}\n b", f"{token[:-1]} {token[1:]}"):
            assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids
    assert len(fast(f"hello {special[0]} x")) == 4


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet=st.sampled_from(list("ab1 \n\t.'é漢\u00a0\u2003")), max_size=60), st.integers(1, 8))
def test_blocks_do_not_cut_tokens(text, size):
    slow, fast = Tokenizer.from_file(PATH), encoder(PATH)
    assert [i for block in text_blocks(text, size) for i in fast(block).tolist()] == slow.encode(text, add_special_tokens=False).ids


def test_open_windows_stay_few():
    rng = np.random.default_rng(9)
    packer, most = Packer(2048), 0
    for i, n in enumerate(rng.integers(1, 2048, 2000).tolist()):
        list(packer.add(i, np.zeros(n, np.uint32)))
        most = max(most, packer.n_open)
    assert most < 1000


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(1, 200), max_size=120), st.integers(1, 40))
def test_every_id_lies_in_one_piece(sizes, most):
    packer, sequences = Packer(64, max_open=most), []
    for i, n in enumerate(sizes):
        sequences += packer.add(i, np.arange(n, dtype=np.uint32))
        assert packer.n_open <= most + 1
    sequences += packer.close()
    seen = defaultdict(list)
    for s in sequences:
        total = sum(len(ids) for _, _, ids in s)
        assert total <= 64 and total & (total - 1) == 0  # no padding
        for tag, start, ids in s:
            assert ids.tolist() == list(range(start, start + len(ids)))
            seen[tag] += ids.tolist()
    assert {t: sorted(v) for t, v in seen.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = Packer(32)
    for i in range(400):
        n = int(rng.integers(1, 32))
        before = packer.counts.copy()

        def cost(level):
            after = before.copy()
            if level:
                after[level] -= 1
            if level + n < 32:
                after[level + n] += 1
            return int((after[1:32].astype(object) ** 2).sum())

        options = [0, *(h for h in range(1, 33 - n) if before[h] > 0)]
        assert cost(packer._level(n)) == min(map(cost, options))
        list(packer.add(i, np.zeros(n, np.uint32)))


def check(df, rows):
    slow = Tokenizer.from_file(PATH)
    docs = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        docs[r["doc_id"]].append([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, lists in docs.items():
        for ids in lists:
            own = [r for r in pieces[doc_id, len(ids)]]
            for r in own:
                part = ids[r["start"] : r["start"] + r["length"]]
                if len(lists) == 1:
                    assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
            if len(lists) == 1:
                assert sum(r["length"] for r in own) == len(ids)
    assert sum(r["length"] for r in rows) == sum(len(ids) for lists in docs.values() for ids in lists)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_real_and_odd_rows(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, pack(docs).collect())
    check(odd, pack(odd).collect())
    assert pack(empty).count() == 0
    withheld = pack(docs.limit(3), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in withheld)
