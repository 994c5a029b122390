"""The registered queries without SQL, whole, against plain versions of what they promise."""

import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import public_tokenizers as P
from tests.llm.test_documents import base_secrets, brute_groups, shingles
from tests.llm.test_others import brute_cost, plain_alignment
from tests.llm.test_pipeline import noisy_or
from waywright.llm import bpe, chroma, queries, toxicity

SF = "/root/testdata/sf0.001"


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, texts):
    got = rows(spark, "op1_secrets")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = base_secrets(t)
        written = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("random")] == written


def test_op2(spark, texts):
    got, sets = rows(spark, "op2_superminhash"), {i: shingles(t, 4) for i, t in texts.items()}
    want = brute_groups(sets)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def test_op4(spark, texts):
    got, library, start = rows(spark, "op4_token_files"), Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op6(spark):
    said = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        said.setdefault(r.conv_id, []).append(r)
    costs = {}
    for r in queries.QUERIES["op6_role_repair"](spark, SF).collect():
        costs.setdefault(r.conv_id, []).append(r.cost)
    assert {i: len(c) for i, c in costs.items()} == {i: len({(m.turn, m.role, m.text) for m in own}) for i, own in said.items()}
    short = [i for i, own in said.items() if len(own) <= 5 and len({m.turn for m in own}) == len(own)][:60]
    for i in short:
        assert sum(costs[i]) == brute_cost([(m.role or "").strip().lower() for m in sorted(said[i], key=lambda m: m.turn)]), i


def test_op7(spark, texts):
    got = rows(spark, "op7_byte_bpe")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.read_ranks(f.read())), special_tokens={})
    for i, t in texts.items():
        ids = own.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op8(spark):
    """All pairs, at all offsets, by plain loops over runs and bits."""
    prints = {r.rec_id: np.frombuffer(r.print, "<u4") for r in chroma.fingerprints(chroma.melodies(spark.read.parquet(f"{SF}/embeddings.parquet")), chroma.RATE, chroma.play).collect()}
    want = plain_alignment({i: p for i, p in prints.items() if len(p)})
    got = {(r.query_id, r.match_id, r.offset_frames, r.hits, r.frames, r.bit_errors) for r in queries.QUERIES["op8_chroma"](spark, SF).collect()}
    assert got == want and len(want) >= 10
    # By bit errors over 100 frames or more alone, without any rule of hits.
    alike = set()
    for q in [i for i in prints if i % 50 == 0]:
        for d, p in prints.items():
            for offset in range(100 - len(p), len(prints[q]) - 99):
                frames, errors = chroma._bits(prints[q], p, offset)
                if d != q and errors <= 0.2 * 32 * frames:
                    alike.add((q, d))
    assert len(alike & {(q, d) for q, d, *_ in got}) >= 0.9 * len(alike) and len(alike) >= 10


def test_op9(spark, texts):
    got = rows(spark, "op9_toxicity")
    model = toxicity.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    for i, t in texts.items():
        assert abs(got[i].score - noisy_or(model, t)) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_op10(spark, texts):
    got = rows(spark, "op10_kd_shards")
    assert {i: (r.size, r.text_crc32, r.law, r.grown_shard) for i, r in got.items()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t in texts.items()}
    total, largest = sum(r.size for r in got.values()), max(r.size for r in got.values())
    for shard in range(8):
        own = [r for r in got.values() if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= 3 * largest
    places = {}
    for i, r in got.items():
        places.setdefault(texts[i], set()).add(r.shard)
    assert all(len(s) == 1 for s in places.values())
