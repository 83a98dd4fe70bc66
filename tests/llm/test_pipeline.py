"""The stages against plain versions, over the small documents."""

from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from orelode.llm import secret_scan, simhash
from orelode.llm.tokens import unpack
from tests.llm.test_quality import plain as plain_quality
from tests.llm.test_simhash import plain_components, similarity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(f"file://{top}/{k}")
        out.append(spark.read.parquet(f"file://{top}/{k}"))
    return [x.toPandas() for x in out]


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:-1])


def test_quality(stages):
    before, after = stages[0], stages[1]
    assert sorted(after.doc_id) == sorted(d for d, t in zip(before.doc_id, before.text, strict=True) if plain_quality(t)["kept"])
    assert 0 < len(after) < len(before)


def test_dedup(stages):
    before, after = stages[1], stages[2]
    sets = {d: frozenset(simhash.shingle_set(t, 5).tolist()) for d, t in zip(before.doc_id, before.text, strict=True)}
    ids = list(sets)
    group = plain_components([(a, b) for i, a in enumerate(ids) for b in ids[:i] if similarity(sets[a], sets[b]) >= 0.8], ids)
    assert sorted(group[d] for d in after.doc_id) == sorted(set(group.values()))
    assert 0 < len(after) < len(before)


def test_secrets(stages):
    before, after = (s.set_index("doc_id") for s in stages[2:4])
    assert sorted(before.index) == sorted(after.index)
    for d in before.index:
        text = before.text[d]
        assert after.text[d] == secret_scan.redacted(text, secret_scan.spans(text)[1])
        assert after.n_chars[d] == len(after.text[d])


def test_packing(stages):
    docs, out = stages[3].set_index("doc_id"), stages[4]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    of = defaultdict(list)
    for r in out.itertuples():
        of[r.doc_id].append(r)
    assert sorted(of) == sorted(docs.index)
    for d, own in of.items():
        own.sort(key=lambda r: r.start)
        assert np.concatenate([unpack(r.ids) for r in own]).tolist() == [*t.encode(docs.text[d], add_special_tokens=False).ids, 1]


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[-1])


def test_odd_documents(spark):
    rows = [(None, None, "en", "s", None, "x"), (1, None, None, None, 0, "x"), (1, "", "en", "s", 0, "y")] + [(2, "many words here " + " ".join(f"w{i}" for i in range(30)), "en", "s", 9, "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").coalesce(1)
    for part in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, part, SF)
            assert out.columns == docs.columns, name
            n = out.count()
            assert n == (0 if part is not docs else {"quality rules": 3, "simhash near-dedup": 2, "secret scans": 6}[name])
        packed = corpus_pipeline.pack(spark, part, SF)
        assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
        want = sorted(len(t.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in rows) if part is docs else []
        assert sorted(r.length for r in packed.collect()) == want  # all fit one window, so each is one piece
