"""Encoding, counts and records against the library itself."""

import random
import weakref

import public_tokenizers as P
import pytest

from orelode.llm import bpe, records, runtime, token_counts, tokens
from orelode.llm.tokens import Encoder, unpack

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
SAMPLES = [None, "", " ", "a", "Don't we'll  SEE\n\n it's  x", "éÀß <|endoftext|> b<|endoftext|>", "日本語テスト text é 가", "x" * 300, "a\x1cb\x85c\xa0d", "12345 ½²", "###!!!%%% &&&"]


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_character_of_the_fast_path(path):
    enc, want = Encoder(path), library(path)
    for o in range(0x180):
        for s in ("a{0}b", "1{0}2", "!{0}?", " {0} ", "a {0}{0} b", "a{0}{0}{0}b\n{0}\nx", "{0}", "'{0}s", "x{0} y\t{0}'s"):
            text = s.format(chr(o))
            assert unpack(enc.encode(text)).tolist() == want(text), hex(o)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_small_cache(path):
    enc, want, rng = Encoder(path, entries=20), library(path), random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab c'd\n  éx9#") for _ in range(rng.randrange(400)))
        assert unpack(enc.encode(text)).tolist() == want(text)


def texts():
    rng = random.Random(7)
    out = list(SAMPLES)
    for alphabet in ("ab", "the quick and es tion ", "é日x ", "'s t re'll \n", "0123 ab", "abcdefghijklmnopqrstuvwxyz"):
        for n in (50, 500, 3000):
            out.append("".join(rng.choice(alphabet) for _ in range(n)))
    out += ["word" * 2000, "\n" * 1000 + "x", "ab " * 1000, "é" * 700, "tion<|endoftext|>" * 200]
    return out


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_of_small_leaves(path):
    from tokenizers import Tokenizer

    enc, want, t = Encoder(path), library(path), Tokenizer.from_file(path)
    for leaf in (64, 700):
        for text in texts():
            leaves = []
            for k, (part, special) in enumerate(bpe.segments(enc, text or "")):
                if special < 0 and enc.library.normalizer is not None:
                    part = enc.library.normalizer.normalize_str(part)
                cuts = bpe.cut_positions(len(part), leaf)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    run = bpe.encode_leaf(enc, part[a:b], 0)
                    leaves.append({"segment": k, "special": special, "text": part[a:b], "starts": run.starts.tobytes(), "ends": run.ends.tobytes(), "counts": run.counts.tobytes(), "ids": run.ids.tobytes()})
            ids = unpack(bpe.whole(enc, leaves)).tolist()
            assert ids == want(text), (leaf, (text or "")[:40])
            assert bpe.decode(enc, ids) == t.decode(ids, skip_special_tokens=False)


def test_splices_by_tokens(monkeypatch):
    """Long runs without a split are joined from their halves, not encoded anew."""
    enc, want, rng = Encoder(WORD), library(WORD), random.Random(3)
    done = []
    whole = bpe.by_model
    monkeypatch.setattr(bpe, "by_model", lambda e, u: done.append(len(u)) or whole(e, u))
    text = "".join(rng.choice("abcdefghinorst") for _ in range(20_000))
    cuts = bpe.cut_positions(len(text), 1000)
    runs = [bpe.encode_leaf(enc, text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert bpe.tree(enc, text, runs, cuts).ids.tolist() == want(text)
    assert max(done) <= 1300


def docs(spark, rows):
    return spark.createDataFrame(rows, "ids string, doc_id long, text string, Decoded int")


def rows():
    return [("x", i if i % 7 else None, t, 1) for i, t in enumerate([*texts(), *texts()[:8], "ab " * 9000, "ab " * 9000])]


def test_encode_decode(spark):
    for leaf, long in ((64, 128), (bpe.LEAF, bpe.LONG)):
        out = bpe.encode_decode(docs(spark, rows()), WORD, leaf=leaf, long=long).collect()
        want = library(WORD)
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(((r.doc_id, unpack(r.ids).tolist()) for r in out), key=key) == sorted(((d, want(t)) for _, d, t, _ in rows()), key=key)
    assert bpe.encode_decode(docs(spark, []), WORD).collect() == []


def test_repeated_long_rows(spark):
    out = bpe.encode_decode(docs(spark, [("", 5, "tion " * 400, 0)] * 3), WORD, leaf=64, long=128).collect()
    assert len(out) == 3 and len(set(out)) == 1


def test_token_counts(spark):
    want = library(BYTE)
    for sample in (2_000, 3):
        out = token_counts.token_counts(docs(spark, rows()), BYTE, limit=100, sample=sample).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(map(tuple, out), key=key) == sorted(((d, len((t or "").encode()), n := len(want(t)), n > 100) for _, d, t, _ in rows()), key=key)
    assert token_counts.token_counts(docs(spark, []), BYTE).collect() == []


def test_records(spark):
    want = library(BYTE)
    out = sorted(records.round_trip(docs(spark, rows()), BYTE, end=0).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == len(rows())
    at = 0
    for r in out:
        assert r.start == at
        at += len(unpack(r.ids))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, unpack(r.ids).tolist()) for r in out), key=key) == sorted(((d, [*want(t), 0]) for _, d, t, _ in rows()), key=key)
    assert records.round_trip(docs(spark, []), BYTE, end=0).collect() == []


def test_index_and_damage(spark, tmp_path):
    parts = records.write_records(docs(spark, rows()), BYTE, str(tmp_path / "r"), end=0)
    part, n, _ = parts[0]
    whole = records.read_records(spark, str(tmp_path / "r"), parts).collect()
    doc, ids = records.read_record(records.qualified(spark, str(tmp_path / "r")), part, n - 1)
    assert (doc, ids.tolist()) in [(r.doc_id, unpack(r.ids).tolist()) for r in whole]
    f = tmp_path / "r" / records.name(part, "rec")
    raw = bytearray(f.read_bytes())
    raw[20] ^= 1
    f.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, str(tmp_path / "r"), parts).collect()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_by_rank(path):
    enc, rng = Encoder(path), random.Random(11)
    assert enc.merge is not None
    tokens = [t for t in enc.bare.get_vocab() if t.isascii()]
    for _ in range(20_000):
        word = "".join(rng.choice(tokens).removesuffix("</w>") for _ in range(rng.randrange(1, 4)))
        from orelode.llm.tokens import byte_level

        assert unpack(enc.piece(word)).tolist() == [t.id for t in enc.bare.model.tokenize(byte_level(word))], word


def test_record_width_and_stores(spark, tmp_path):
    """Ids over 65,535 take 32 bits or are refused, never wrapped; folders go where Spark resolves them."""
    assert not records.is_wide(BYTE, 0) and records.is_wide(BYTE, 70_000)
    some = docs(spark, [("x", 1, "a b c", 1)])
    out = records.round_trip(some, BYTE, end=70_000).collect()
    assert unpack(out[0].ids).tolist()[-1] == 70_000
    with pytest.raises(Exception, match="fit the records"):
        records.write_records(some, BYTE, str(tmp_path / "n"), end=70_000, wide=False)
    assert records.qualified(spark, "/a/b") == "file:/a/b"
    assert records.opened("file:/a/b")[1] == records.opened("file:///a/b")[1] == "/a/b"
    with pytest.raises(ValueError, match="qualified"):
        records.opened("/a/b")


def test_letters_first_splits_alike():
    """The expressions that try letters before contractions against those in the pre-tokenizers' order."""
    import random
    import re

    from orelode.llm import tokens as T

    first = "'s|'t|'re|'ve|'m|'ll|'d"
    byte = re.compile(rf"{first}| ?[{T.LETTERS}]+| ?[{T.DIGITS}]+| ?[^\s{T.LETTERS}{T.DIGITS}]+|\s+(?!\S)|\s+")
    word = re.compile(rf"{first}|[{T.LETTERS}]+|[{T.DIGITS}]|[^\s{T.LETTERS}{T.DIGITS}]+")
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choices(["'", "'s", "'re", "'ll", "l", "v", "e", "é", " ", "\n", "1", "²", "!", "\xa0", "_"], k=rng.randrange(12)))
        assert T.BYTE_PIECES.findall(text) == byte.findall(text) and T.WORD_PIECES.findall(text) == word.findall(text)
        assert (T.UNSURE.search(text) is None) or not text.isascii()
    assert {chr(i) for i in range(128) if T.UNSURE.search(chr(i))} == set(T.ASCII_UNSURE)


def test_encoders_go_with_their_operator():
    runtime.let_go("packing")
    held = weakref.ref(tokens.encoder(BYTE))
    held().encode("some words that are cached")
    runtime.let_go("packing")
    assert held() is not None
    runtime.let_go("simhash")
    assert held() is None and tokens.encoder(BYTE).encode("some")
