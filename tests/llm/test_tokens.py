"""Encoders against the tokenizers library, packing, sharding, token files."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sunloom.llm import packing, sharding, tokenfile
from sunloom.llm.bytebpe import ByteBpe, digest_documents, encode_documents
from sunloom.llm.queries import vocabulary
from sunloom.llm.wordbpe import WordEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", "   ", "<|endoftext|>", "a<|endoftext|>b  ", "\n\n a", "x" * 5000, " " * 300 + "a", "é" * 700, "ΑΣ ΣΑΣ. İx ǅ", "﻿a​b", "éa ́b", "don't we'LL I'm 'tis", "日本語 中the ing\x85\xa0\x1c", "Thea, thea. THEA!! th3a", "İ' İ. ª, º", "a\u180e.\u2003b \x1c,1\x1f\u3000x"]


def random_texts(n):
    rng = random.Random(1)
    letters = "aab  bc'sStdé\n\t 12!?<|endoftext|>ünd日the ing"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)]


def some(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r.text for r in rows]


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)


def test_byte_bpe_equals_library(spark):
    tok, bpe = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), ByteBpe(vocabulary("byte_bpe_50k.json"), max_words=3000)
    texts = ODD + random_texts(1500) + some(spark)
    for text, want, (ids, said) in zip(texts, tok.encode_batch(texts, add_special_tokens=False), bpe.encode_all(texts), strict=True):
        assert ids.tolist() == want.ids and said == "".join(f"{i}," for i in want.ids).encode()
        assert bpe.decode(ids).decode() == tok.decode(want.ids, skip_special_tokens=False)
    assert bpe.exact > 0


def test_byte_bpe_proposals_are_mostly_checked_not_merged(spark):
    bpe = ByteBpe(vocabulary("byte_bpe_50k.json"))
    bpe.learn([" the", " house", " walking", "ing", " water"])
    assert bpe.exact == 0


def test_word_encoder_equals_library_and_forgets(spark):
    path = vocabulary("word_bpe_49k.json")
    tok, texts = Tokenizer.from_file(path), ODD + random_texts(1500) + some(spark)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    enc = WordEncoder(path, max_words=2000)
    for _ in range(2):
        got = [x for k in range(0, len(texts), 40) for x in enc.encode_all(texts[k : k + 40])]
        assert got == want
    assert enc.encode_all([None]) == [b""] and enc.encode_all([]) == []


def test_words_of_one_hash_keep_their_own_ids(spark):
    """Thue-Morse words and their complements have one polynomial hash, whatever its base; then all hashes are made to collide."""
    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)

    def want(texts):
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]

    word = "".join("ab"[k.bit_count() & 1] for k in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    pairs = [t for n in (64, 256, 1024, 2048, 4096) for t in (word[:n], other[:n])]
    assert WordEncoder(path).encode_all(pairs) == want(pairs)
    enc = WordEncoder(path)
    words_of = enc._words
    enc._words = lambda raw, gap: (lambda a, b, h: (a, b, h % np.uint64(5)))(*words_of(raw, gap))
    assert enc.encode_all(ODD * 2) == want(ODD * 2)
    docs = table(spark, pairs).coalesce(1)
    rows = {r.doc_id: r for r in packing.pack_documents(docs, path).where("start = 0").collect()}
    ids = [x + (2).to_bytes(4, "little") for x in want(pairs)]
    assert all(rows[k].ids_crc32 == zlib.crc32(x[: 4 * 4096]) and rows[k].doc_tokens == len(x) // 4 for k, x in enumerate(ids))


def test_very_long_texts_are_cut_at_any_white_space():
    path = vocabulary("word_bpe_49k.json")
    text = "x" * 700_000 + "\n" + "日本語 テキスト\n" * 30_000 + "Word, word. " * 100_000
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert WordEncoder(path).encode_all(["a", text])[1] == np.array(want, dtype="<u4").tobytes()


def test_digests_of_nulls_and_empty_tables(spark):
    docs = table(spark, ["", None, "the"])
    rows = {r.doc_id: r for r in digest_documents(docs, vocabulary("byte_bpe_50k.json")).collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == 0 and rows[0].ids_sha256 == rows[1].ids_sha256 and rows[2].n_tokens == 1
    assert digest_documents(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
    assert [r.decoded for r in encode_documents(docs, vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect()] == ["", "", "the"]


def test_token_file_round_trip(spark, tmp_path):
    texts = [*ODD, None, *some(spark)]
    path = vocabulary("word_bpe_49k.json")
    docs = table(spark, texts).orderBy(F.rand(3))
    tokenfile.write_token_orc(docs, str(tmp_path / "t"), path)
    tok, start = Tokenizer.from_file(path), 0
    rows = {r.doc_id: r for r in tokenfile.token_digests(spark, str(tmp_path / "t")).collect()}
    for k, text in enumerate(texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert (rows[k].start, rows[k].n_tokens) == (start, len(ids)) and rows[k].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    found = tokenfile.find_documents(spark, str(tmp_path / "t"), [3, 5])
    assert {r.doc_id for r in found.collect()} == {3, 5}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_first_fit_decreasing_equals_plain_search():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 40))]
        free, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(len(sizes))]


def test_packing_keeps_every_id(spark):
    texts = [*ODD, None, "word " * 9000, *some(spark)]
    docs = table(spark, texts)
    rows = packing.pack_documents(docs.unionByName(docs.limit(3)), vocabulary("word_bpe_49k.json"), group_rows=50).collect()
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, set()).add((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, text in enumerate(texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for start, length, crc, n in sorted(by_doc[k]):
            assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def least_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, room = (lo + hi) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed,summary", [(1, 4), (2, 7), (3, 100), (4, 3)])
def test_minimax_search_is_exact(seed, summary):
    rng = random.Random(seed)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 9, 40, 300]) for _ in range(rng.randrange(1, 120))]
        shards = rng.randrange(1, 9)
        line = np.cumsum(sizes).tolist()

        def summarise(windows, line=line):
            got, base = {}, 0
            for (a, b), width in zip(windows, sharding.block_widths(windows, summary), strict=True):
                for e in line:
                    if a <= e <= b:
                        got.setdefault(base + (e - a) // width, []).append(e)
                base += (b - a) // width + 1
            return [(min(v), max(v), len(v)) for v in got.values()]

        cap, cuts = sharding.minimax_cuts(sharding._Ends(line[-1], summarise), shards)
        assert cap == least_capacity(sizes, shards)
        ends = [0, *cuts, line[-1]]
        assert all(b - a <= cap for a, b in zip(ends, ends[1:], strict=False)) and set(cuts) <= {0, *line}


def test_shards_of_copies_nulls_and_clashing_columns(spark):
    rng = random.Random(5)
    texts = ["copy " * 50] * 300 + [None, ""] + [f"text {k} " * rng.randrange(1, 40) for k in range(500)]
    docs = table(spark, texts).withColumns({"shard": F.lit(9), "slot": F.lit(9), "size": F.lit(9)})
    rows = sharding.shard_documents(docs.unionByName(docs.where("doc_id = 7")), 24).collect()
    assert len(rows) == len(texts) + 1
    by, sizes = {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        by.setdefault(r["shard"], []).append(r.slot)
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r.size
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in rows if r.doc_id < 300}) == 1 and max(sizes.values()) >= 300 * 258
    assert sharding.shard_documents(docs.limit(0), 24).count() == 0


def test_equal_rows_spread_over_groups(spark):
    docs = table(spark, ["the same text"]).select("*", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("col")
    rows = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), group_rows=300).collect()
    sizes = {}
    for r in rows:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 3000 and len(sizes) == 10 and max(sizes.values()) < 420
    assert sorted((r.sequence_id, r.offset) for r in rows) == sorted({(r.sequence_id, r.offset) for r in rows})
