import base64
import dataclasses
import hashlib
import json
import math
import random
import re
import string
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers as P
from tests.llm.made import docs, empty, hard
from waywright.llm import bpe, kdshard, mixing, neardup, queries, secrets, tokenfiles, toxicity
from waywright.llm.scratch import Scratch


def odd_texts(n=1500):
    r = random.Random(3)
    parts = [" ", "\n", "\t", "a", "b", "é", "1", ".", "'", "s", " ", "\x1c", "　", "日", "\r", "ll", "\x0b", "\x85", "²", "_", "word", "'s", "  ", "\U0001f600", "<|endoftext|>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def test_bpe_equals_tiktoken_and_round_trips(spark, ranks):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.read_ranks(ranks)), special_tokens={})
    texts = odd_texts()
    got = bpe.encode_documents(docs(spark, list(enumerate(texts))), ranks, P.PATTERN).collect()
    for r in got:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_tokens * 4 == len(r.token_ids) and r.ids_sha256 == hashlib.sha256(r.token_ids).hexdigest()


def test_bpe_takes_whole_pieces_that_merges_miss():
    """A vocabulary with a token that no merge reaches, and ranks with gaps."""
    content = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in [(bytes([b]), b) for b in range(256)] + [(b"ab", 300), (b"xyz", 301)])
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.read_ranks(content)), special_tokens={})
    codec = bpe.Codec(bpe.read_ranks(content), P.PATTERN)
    for t in ("xyz", "xyzab", "abab xyz", "ab"):
        got = np.frombuffer(codec.encode([t])[0], "<u4").tolist()
        assert got == own.encode_ordinary(t) and codec.decode(np.array(got, "<u4").tobytes()) == t.encode()


def test_bpe_hard_cases(spark, ranks):
    rows = bpe.encode_documents(hard(spark), ranks, P.PATTERN, ids=False).collect()
    assert len(rows) == 10 and {r.doc_id: r.n_tokens for r in rows}[2] == 0 and {r.doc_id: r.n_tokens for r in rows}[3] == 0
    assert bpe.encode_documents(empty(spark), ranks, P.PATTERN).count() == 0


def test_token_files_equal_the_library(spark):
    texts = [t.replace("<|endoftext|>", "") for t in odd_texts(400)]
    with open(P.path("byte_bpe_50k.json")) as f:
        spec = f.read()
    folder = Scratch(spark, "t").path("tokens")
    parts = tokenfiles.write_token_files(docs(spark, list(enumerate(texts))).repartition(3), folder, spec, P.PATTERN, end_id=2)
    rows = {r.doc_id: r for r in tokenfiles.read_token_files(spark, folder).collect()}
    start = 0
    for i, e in enumerate(Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)):
        ids = [*e.ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sum(p["n_tokens"] for p in parts) == start


@pytest.mark.parametrize("changed", [{}, {"lstrip": True, "rstrip": True}, {"single_word": True}])
def test_token_files_take_added_tokens_as_the_library_does(spark, changed):
    texts = ["end <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "plain words", None, *(t for t in odd_texts(400) if "<|endoftext|>" in t)]
    with open(P.path("byte_bpe_50k.json")) as f:
        spec = json.loads(f.read())
    spec["added_tokens"] = [t | changed for t in spec["added_tokens"]] + [spec["added_tokens"][0] | {"id": 70_000, "content": "b<|endo"}] * bool(changed)
    spec = json.dumps(spec)
    library = Tokenizer.from_str(spec)
    folder = Scratch(spark, "t").path("added")
    tokenfiles.write_token_files(docs(spark, list(enumerate(texts))).repartition(3), folder, spec, P.PATTERN, end_id=2)
    rows = {r.doc_id: r for r in tokenfiles.read_token_files(spark, folder).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_token_files_spread_an_id_of_many_rows(spark):
    """Two thirds of the rows have one id, half of these one text; ranges cut them, and the files still go by id."""
    with open(P.path("byte_bpe_50k.json")) as f:
        spec = f.read()
    rows = [(7, "same words" if i % 2 else f"words {i}") for i in range(4000)] + [(i, f"other {i}") for i in range(2000)]
    folder = Scratch(spark, "t").path("hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        parts = tokenfiles.write_token_files(docs(spark, rows).repartition(8), folder, spec, P.PATTERN, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokenfiles.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows) and max(p["n_docs"] for p in parts) < 0.6 * len(rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_token_files_hard_cases(spark):
    with open(P.path("byte_bpe_50k.json")) as f:
        spec = f.read()
    folder = Scratch(spark, "t").path("hard")
    tokenfiles.write_token_files(hard(spark), folder, spec, P.PATTERN, end_id=2)
    rows = tokenfiles.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8] and rows[2].n_tokens == rows[3].n_tokens == 1
    folder = Scratch(spark, "t").path("none")
    assert tokenfiles.write_token_files(empty(spark), folder, spec, P.PATTERN) == [] and tokenfiles.read_token_files(spark, folder).count() == 0


def brute_groups(sets, percent=80):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize(("width", "bits"), [(4, 64), (5, 64), (4, 4)])
def test_near_duplicates_equal_brute_force(spark, width, bits):
    """Groups around the threshold: edits of one to eight words of forty, chains, copies, short texts; with ``bits`` of 4 most sets share an identity at first."""
    r = random.Random(width)
    words = ["".join(r.choices(string.ascii_lowercase, k=4)) for _ in range(400)]
    rows = []
    for _ in range(25):
        base = r.choices(words, k=r.choice([3, 6, 40, 120]))
        for _ in range(r.randint(1, 9)):
            new = list(base)
            for _ in range(r.randint(0, 3)):
                new[r.randrange(len(new))] = r.choice(words)
            rows.append((len(rows), " ".join(new)))
            base = new if r.random() < 0.3 else base
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, " ")]
    want = brute_groups({i: shingles(t, width) for i, t in rows})
    got = {x.doc_id: x for x in neardup.near_duplicates(docs(spark, rows), width=width, identity_bits=bits).collect()}
    assert {i: x.component_id for i, x in got.items()} == want and len(set(want.values())) < len(rows) * 0.8
    assert all(got[i].n_shingles == len(shingles(t, width)) and got[i].kept == (want[i] == i) for i, t in rows)


def test_near_duplicates_hard_cases(spark):
    rows = neardup.near_duplicates(hard(spark)).collect()
    assert len(rows) == 10
    by = {x.doc_id: x for x in rows}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept and by[2].n_shingles == 0 and by[2].kept and by[3].component_id == 3
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_one_id_with_several_texts(spark):
    a, b = ("".join(f"{c}{i} " for i in range(40)) for c in "ab")
    rows = [(7, a), (7, b), (3, b + "more"), (9, a), (7, a)]
    got = neardup.near_duplicates(docs(spark, rows), tag=F.xxhash64("text")).collect()
    sets = {r.tag: r for r in got}
    assert len(sets) == 3 and sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), (9, 7, False)]


def test_superminhash_misses_next_to_nothing():
    """The chance that a pair at the threshold shares no band, or agrees in too few slots to be compared, by the binomial law of plain MinHash."""
    n, p = neardup.SLOTS, 0.8
    assert (1 - p**neardup.ROWS) ** neardup.BANDS < 1e-6
    least = n * p - neardup.DEVIATIONS * (n * p * (1 - p)) ** 0.5
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(math.ceil(least))) < 2e-9


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    for n in (5, 60, 900):
        gaps = []
        for _ in range(60):
            u = np.unique(r.integers(0, 2**63, int(n * 1.3) + 2).astype(np.uint64))
            a, b = u[:n], u[len(u) - n :]
            s = neardup.superminhash([a, b], 180)
            shared = len(np.intersect1d(a, b))
            gaps.append((s[0] == s[1]).mean() - shared / (2 * n - shared))
        assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.05


def base_secrets(text):
    keyword = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    out = [(m.start(), 0, m.end()) for m in re.finditer(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets_base_scan():
    r = random.Random(2)
    parts = ["PassWord", "token", "api_key", "APIKEY", "secret", " = ", ":", '"', "'", " ", "é", "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "abc.def-ghi_jkl", "toKen", "=", "xyz"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert secrets.base_spans(t) == base_secrets(t), t


def test_secrets_battery_by_plain_formulas():
    """Chi-squared around its mean and spread, runs around the middle, correlation at lag one, joined by Fisher's method."""
    r = random.Random(15)
    for name, alphabet in secrets.ENCODINGS:
        for n in (20, 33, 64):
            token = "".join(r.choices(alphabet, k=n))
            found, place = secrets.encoding_of(token)
            if found != name:
                continue
            x = np.array([place[c] for c in token], float)
            size, expected = len(alphabet), n / len(alphabet)
            chi = sum((token.count(c) - expected) ** 2 / expected for c in alphabet)
            p = [0.5 * math.erfc((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n)) / math.sqrt(2))]
            high = x >= size / 2
            n1, n0 = high.sum(), (~high).sum()
            mean = 2 * n1 * n0 / n + 1
            variance = 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
            p.append(math.erfc(abs(1 + (np.diff(x >= size / 2) != 0).sum() - mean) / math.sqrt(variance) / math.sqrt(2)))
            d = x - x.mean()
            p.append(math.erfc(abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n) / math.sqrt(2)))
            fisher = -2 * sum(map(math.log, p))
            want = math.exp(-fisher / 2) * sum((fisher / 2) ** k / math.factorial(k) for k in range(3))
            assert abs(secrets.randomness(token) - want) < 1e-9, (name, token)


def test_secrets_battery_finds_random_tokens_only(spark):
    r = random.Random(4)
    words = ["".join(r.choice(["the", "ing", "ou", "re", "st", "and", "er", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    planted = {i: "".join(r.choices(string.ascii_letters + string.digits, k=40)) for i in range(0, 1500, 10)}
    rows = [(i, " ".join([*r.choices(words, k=80), planted.get(i, ""), "some/ordinary-path_to/things-that-are/words", *r.choices(words, k=60)])) for i in range(1500)]
    d = docs(spark, rows)
    found = {x.doc_id: x for x in secrets.scan(d, secrets.calibrate(d)).collect()}
    hits = sum(f"random:{rows[i][1].index(t)}:{rows[i][1].index(t) + 40}" in found[i].spans for i, t in planted.items())
    assert hits >= 0.9 * len(planted) and sum(x.n_random for x in found.values()) <= hits + 4


def test_secrets_battery_tests_lower_case_keys(spark):
    """Keys of a to z, some with a capital first, among long words; many long words don't hide other random tokens."""
    r = random.Random(11)
    parts = ["the", "ing", "ou", "re", "st", "and", "er", "ti"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    long = ["".join(r.choice(parts) for _ in range(16)) for _ in range(3000)]
    planted = {i: "".join(r.choices(string.ascii_lowercase, k=40)) for i in range(0, 1500, 10)}
    planted |= {i: t.capitalize() for i, t in planted.items() if i % 20 == 0} | {i: "".join(r.choices(string.ascii_letters + string.digits, k=40)) for i in range(5, 1500, 10)}
    rows = [(i, " ".join([*r.choices(words, k=80), planted.get(i, ""), *r.choices(long, k=2), *r.choices(words, k=60)])) for i in range(1500)]
    d = docs(spark, rows)
    limits = secrets.calibrate(d)
    found = {x.doc_id: x for x in secrets.scan(d, limits).collect()}
    hits = {i for i, t in planted.items() if f"random:{rows[i][1].index(t)}:{rows[i][1].index(t) + 40}" in found[i].spans}
    for kind in (0, 5, 10):  # with a capital, letters and digits, lower case
        own = [i for i in planted if (5 if i % 2 else i % 20) == kind]
        assert sum(i in hits for i in own) >= 0.9 * len(own), kind
    assert sum(x.n_random for x in found.values()) <= 1.1 * len(hits)
    clean = {x.doc_id: x.text for x in secrets.redact(d, limits).collect()}
    assert all(planted[i] not in clean[i] for i in hits)


def test_secrets_levels_of_ordinary_text():
    """Levels of many pieces at once, in each family's alphabet, are those of single tokens."""
    r = random.Random(12)
    alphabets = {26: string.ascii_lowercase, 36: string.ascii_lowercase + string.digits, 52: string.ascii_letters, 62: string.ascii_letters + string.digits}
    for n in secrets.JOINED:
        for sizes, most in (((26, 36), 26), ((52, 62), 52)):
            texts = ["".join(r.choices(alphabets[most][: r.choice([8, most])], k=n)) for _ in range(100)] + ["a" * n, alphabets[most][-1] * n]
            got = secrets.levels(np.array([[alphabets[most].index(c) for c in t] for t in texts], np.uint8), sizes)
            for size, found in zip(sizes, got, strict=True):
                for t, lev in zip(texts, found.tolist(), strict=True):
                    assert lev == min(secrets.MOST_BIN, int(-8 * math.log10(p)) if (p := battery(t, alphabets[size])) > 0 else secrets.MOST_BIN), (t, size)
    words = secrets.WORD.findall("Some words, (not) these2 BUT a ..these. éa\n" + "x" * 20)
    joined = secrets.joined_words(words)
    assert bytes(joined + 97) == b"somewordsthese" and "".join(string.ascii_letters[i] for i in secrets.in_capitals(words, joined)) == "SomeWordsThese"


def battery(token, alphabet):
    """The battery's p value in a given alphabet, by plain formulas."""
    at, n, size = [alphabet.index(c) for c in token], len(token), len(alphabet)
    chi = sum(at.count(c) ** 2 for c in set(at)) * size / n - n
    tests = [max(1e-300, math.erfc((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n) / math.sqrt(2)) / 2)]
    high = [2 * x >= size for x in at]
    ones = sum(high)
    if 0 < ones < n:
        mean = 1 + 2 * ones * (n - ones) / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        tests.append(math.erfc(abs(1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / spread / math.sqrt(2)))
    else:
        tests.append(2.0 ** (1 - n))
    middle = sum(at) / n
    power = sum((x - middle) ** 2 for x in at)
    lag = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / power if power else 1.0
    tests.append(math.erfc(abs(lag + 1 / n) * math.sqrt(n) / math.sqrt(2)))
    x = -sum(math.log(max(p, 1e-300)) for p in tests)
    return min(1.0, math.exp(-x) * (1 + x + x * x / 2)) if x < 700 else 0.0


KEYS = {
    "base62 of 40": lambda r: "".join(r.choices(string.ascii_letters + string.digits, k=40)), "base62 of 24": lambda r: "".join(r.choices(string.ascii_letters + string.digits, k=24)),
    "base64": lambda r: base64.b64encode(r.randbytes(32)).decode(), "HEX": lambda r: r.randbytes(16).hex().upper(), "base32": lambda r: base64.b32encode(r.randbytes(25)).decode(),
    "prefixed": lambda r: "sk_live_" + "".join(r.choices(string.ascii_letters + string.digits, k=32)), "decimal of 30": lambda r: "".join(r.choices(string.digits, k=30)),
    "UUID": lambda r: str(uuid.UUID(bytes=r.randbytes(16))), "base36 of 24": lambda r: "".join(r.choices(string.ascii_lowercase + string.digits, k=24)),
}


def test_secrets_of_every_form_in_the_given_documents(spark):
    """Keys of nine forms and ten times as many long names, planted in the driver's documents: most keys are found, and few names."""
    r = random.Random(7)
    parts = "get set user account information connection manager service request response handler default configuration initial value update delete insert remove create build parse render message event".split()
    shapes = [lambda w: w[0] + "".join(map(str.capitalize, w[1:])), "_".join, "/".join, lambda w: "-".join(w) + str(r.randint(1, 99)), lambda w: "".join(map(str.capitalize, w)) + str(r.randint(1, 9999))]
    planted = [(form, make(r)) for form, make in KEYS.items() for _ in range(40)] + [("name", r.choice(shapes)(r.choices(parts, k=r.randint(3, 6)))) for _ in range(400)]
    r.shuffle(planted)
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for n, (_, token) in enumerate(planted):
        texts[n % len(texts)] += f" {token} end"
    d = docs(spark, list(enumerate(texts)))
    limits = secrets.calibrate(d)
    found = {i: [(int(a), int(b)) for kind, a, b in (s.split(":") for s in x.spans.split(",") if s)] for i, x in ((x.doc_id, x) for x in secrets.scan(d, limits).collect())}
    hits = Counter(form for n, (form, token) in enumerate(planted) for at in [texts[n % len(texts)].index(f" {token} end") + 1] if any(a <= at and b >= at + len(token.rstrip("=")) for a, b in found[n % len(texts)]))
    for form in KEYS:
        assert hits[form] >= (0.7 if "24" in form else 0.85) * 40, (form, hits)
    assert sum(hits[f] for f in KEYS) >= 0.88 * 40 * len(KEYS) and hits["name"] <= 0.05 * 400
    # The spans are those of a plain walk over tokens with the same limits.
    for i, text in enumerate(texts[:400]):
        base = base_secrets(text)
        want = [(a, b) for a, _, b in base]
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            if not any(a < m.end() and b > m.start() for a, _, b in base):
                body = m.group().rstrip("=")
                groups = [g for g in re.split("[-_]+", body) if g]
                tried = [body] + [g for g in groups if 16 <= len(g) < len(body)]
                if "-" in body or "_" in body:
                    whole = "".join(groups)
                    tried = [whole] if len(whole) >= 24 and any(set(whole) <= set(s) for s in (string.digits, string.digits + "abcdef", string.digits + "ABCDEF")) else tried
                if any((w := secrets.judged(u))[1] <= limits.get(w[0], -1) for u in tried):
                    want.append((m.start(), m.end()))
        assert sorted(found[i]) == sorted(want), i


def test_secrets_copies_of_a_text_are_one_evidence(spark):
    """A text whose words look random holds a third of the rows."""
    r = random.Random(13)
    words = ["".join(r.choice(["the", "ing", "ou", "re", "st", "and", "er", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    odd = " ".join("".join(r.choices(string.ascii_lowercase, k=8)) for _ in range(200))
    planted = {i: "".join(r.choices(string.ascii_letters + string.digits, k=40)) for i in range(0, 600, 10)}
    rows = [(i, " ".join([*r.choices(words, k=80), planted.get(i, ""), *r.choices(words, k=60)])) for i in range(600)]
    d = docs(spark, rows + [(i, odd) for i in range(600, 900)]).repartition(5)
    found = {x.doc_id: x.n_random for x in secrets.scan(d, secrets.calibrate(d)).collect()}
    assert sum(found[i] for i in planted) >= 0.9 * len(planted) and sum(found.values()) <= len(planted) + 4


def test_secrets_few_long_documents_are_evidence_enough(spark):
    r = random.Random(14)
    words = ["".join(r.choice(["the", "ing", "ou", "re", "st", "and", "er", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    rows = [(i, " ".join(w for n in [22, 40] * 20 for w in (*r.choices(words, k=100), "".join(r.choices(string.ascii_letters + string.digits, k=n))))) for i in range(6)]
    d = docs(spark, rows)
    spans = ",".join(x.spans for x in secrets.scan(d, secrets.calibrate(d)).collect()).split(",")
    sizes = [int(b) - int(a) for kind, a, b in (s.split(":") for s in spans if s) if kind == "random"]
    assert sizes.count(40) >= 0.8 * 120 and sizes.count(22) > 0


def test_secrets_hard_cases_and_redaction(spark):
    d = hard(spark)
    limits = secrets.calibrate(d)
    rows = {x.doc_id: x for x in secrets.scan(d, limits).collect()}
    assert len(rows) == 9 and rows[2].spans == rows[3].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.calibrate(empty(spark)) == {} and secrets.scan(empty(spark), {}).count() == 0
    one = docs(spark, [(1, 'a token = "deadbeefdeadbeef01" b'), (2, None), (3, "clean")])
    assert [x.text for x in secrets.redact(one, {}).orderBy("doc_id").collect()] == ['a [SECRET]" b', None, "clean"]


def toxic_docs(n=1200):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(500)]
    bad = ["zorgle", "zorgling", "zorgles", "kwimp", "kwimping"]
    rows, labels = [], []
    for i in range(n):
        s = [" ".join(r.choices(words, k=r.randint(3, 12))) for _ in range(r.randint(1, 12))]
        toxic = i % 8 == 0
        if toxic:
            k = r.randrange(len(s))
            s[k] += f" {r.choice(bad)} and {r.choice(bad)}"
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_docs()
    d = docs(spark, rows)
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 200 and sum(got[i].predicted == labels[i][2] for i in held) >= 0.98 * len(held)
    for i in held:
        if labels[i][2] and got[i].predicted:
            assert any(b in rows[i][1][got[i].worst_start : got[i].worst_end] for b in ("zorgl", "kwimp"))


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    rows, labels = toxic_docs(400)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    d = docs(spark, rows)
    a, b = (toxicity.train(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a == b


def log_likelihood(model, found, toxic):
    """Of labels under the noisy-or, less the penalty, by plain loops; found: each document's sentences as lists of features."""
    total = -toxicity.L2 / 2 * (sum(w * w for w in model.weights.values()) + model.bias**2)
    for sentences, y in zip(found, toxic, strict=True):
        none = 1 - model.leak
        for s in sentences:
            none *= 1 - 1 / (1 + math.exp(-model.bias - sum(model.weights[f] for f in s)))
        total += math.log(1 - none if y else none)
    return total


def test_toxicity_fit_is_where_the_likelihood_is_greatest():
    r = random.Random(9)
    found, toxic = [], []
    for _ in range(300):
        found.append([sorted(r.sample(range(5), r.randint(1, 3))) for _ in range(r.randint(0, 4))])
        found[-1] += found[-1][:1] * r.randint(0, 2)  # sentences of one kind
        toxic.append(int(any(0 in s or {1, 2} <= set(s) for s in found[-1]) or r.random() < 0.1))
    kinds = [sorted(Counter(map(tuple, s)).items()) for s in found]
    w, bias, leak = toxicity.fit([[k for k, _ in s] for s in kinds], [[n for _, n in s] for s in kinds], toxic, 5, steps=1500)
    best = toxicity.Model(dict(enumerate(w.tolist())), bias, leak)
    top = log_likelihood(best, found, toxic)
    for step in (-0.02, 0.02):
        others = [dataclasses.replace(best, weights=best.weights | {f: best.weights[f] + step}) for f in range(5)]
        others += [dataclasses.replace(best, bias=bias + step), dataclasses.replace(best, leak=leak * (1 + step))]
        assert all(log_likelihood(x, found, toxic) < top + 1e-3 for x in others)


def test_toxicity_scores_are_the_noisy_or_of_sentences():
    model = toxicity.Model({"bad": 2.0, "ba*": 0.5, "worse*": 3.0, "nasty*": 1.5, "nas*": -0.5}, -1.5, 0.03)
    p = lambda w: 1 / (1 + math.exp(1.5 - w))
    got = toxicity.Scorer(model)("A BAD one, bad! Nothing here.\nWorsening and nasty; bad. Nasty.")
    assert abs(got[0] - (1 - 0.97 * (1 - p(2.0)) * (1 - p(3.0 + 2.0 + 1.0)) * (1 - p(1.0)))) < 1e-12
    assert got[1:3] == (30, 55) and abs(got[3] - p(6.0)) < 1e-12
    assert toxicity.Scorer(model)("")[0] == toxicity.Scorer(model)(None)[0] == 0.03


def test_toxicity_of_documents_held_out(spark):
    """Learnt from the labelled documents of the small tables, the held-out ones are told apart."""
    sf = "/root/testdata/sf0.1"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(d, toxicity.train(d, labels)).filter(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    toxic, clean = ([x.predicted for x in got if x.toxic == k] for k in (1, 0))
    assert len(toxic) > 10 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.05 * len(clean), (len(toxic), sum(toxic), len(clean), sum(clean))


def test_toxicity_hard_cases(spark):
    labels = spark.createDataFrame([(1, 0, 1), (4, 0, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(hard(spark), labels)
    assert toxicity.score(hard(spark), model).count() == 10 and toxicity.score(empty(spark), model).count() == 0
    assert toxicity.train(hard(spark), labels.limit(0)).leak == 0.0 and toxicity.train(empty(spark), labels).leak == 0.0


def test_kd_shards_balance_and_keep_texts_together(spark):
    r = random.Random(6)
    rows = [(i, "t" * r.randint(0, 900) + str(i // 3), r.choice(["en", "de", None]), f"src{r.randrange(20)}", r.randrange(900)) for i in range(3000)]
    got = kdshard.kd_shards(docs(spark, rows), ("lang", "source", "n_chars"), shards=8).toPandas()
    share = got.groupby("shard")["size"].sum() / got["size"].sum() * 8
    assert len(share) == 8 and share.min() > 0.97 and share.max() < 1.03
    assert (got.groupby(["text_crc32", "size"]).shard.nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    text = {i: t for i, t, *_ in rows}
    assert all(zlib.crc32(text[i].encode()) == c and s == len(text[i]) + 1 for i, c, s in zip(got.doc_id, got.text_crc32, got["size"], strict=True))


def test_kd_shards_cut_a_text_that_outweighs_a_shard(spark):
    got = kdshard.kd_shards(docs(spark, [(i, "x" * 100 if i % 2 else f"{i:0100d}", "en", "s", 100) for i in range(2000)]), ("lang", "source"), shards=8).toPandas()
    share = got.groupby("shard")["size"].sum() / got["size"].sum() * 8
    assert share.max() < 1.15 and share.min() > 0.85


def places_by_hand(values, sizes):
    """The share of all bytes at smaller values, nulls lowest, in 2^20ths."""
    order = sorted({v for v in values}, key=lambda v: (v is not None, v if v is not None else 0))
    weight = {v: 0 for v in order}
    for v, s in zip(values, sizes, strict=True):
        weight[v] += s
    before, out = 0, {}
    for v in order:
        out[v] = int(before / sum(sizes) * ((1 << 20) - 1))
        before += weight[v]
    return [out[v] for v in values]


@pytest.mark.parametrize("shards", [8, 13])
def test_kd_shards_are_a_tree_of_medians_along_the_widest_dimension(spark, shards):
    """Sources that share long prefixes count as different; every node is cut near its weighted median on its widest dimension."""
    r = random.Random(8)
    rows = [(i, f"{i} " + "t" * r.randint(0, 400), r.choice(["en", "de", "fr", None]), f"https://example.org/source_{r.randrange(30)}", r.choice([None, *range(50)])) for i in range(2500)]
    got = {x.doc_id: x for x in kdshard.kd_shards(docs(spark, rows), ("lang", "source", "n_chars"), shards=shards).collect()}
    size = [len(t) + 1 for _, t, *_ in rows]
    place = list(zip(*(places_by_hand([row[k] for row in rows], size) for k in (2, 3, 4)), strict=True))
    assert len({p[1] for p in place}) == 30
    used = set()

    def check(own, first, n):
        if n == 1:
            assert all(got[i].shard == first for i in own)
            return
        width = [max(place[i][d] for i in own) - min(place[i][d] for i in own) for d in range(3)]
        d = width.index(max(width))
        used.add(d)
        left, right = [i for i in own if got[i].shard < first + n // 2], [i for i in own if got[i].shard >= first + n // 2]
        assert max(place[i][d] for i in left) <= min(place[i][d] for i in right)
        total = sum(size[i] for i in own)
        assert abs(sum(size[i] for i in left) - total * (n // 2) / n) <= 450 + 1e-3 * total
        check(left, first, n // 2)
        check(right, first + n // 2, n - n // 2)

    check(list(range(len(rows))), 0, shards)
    assert len(used) > 1


def test_kd_shards_of_many_leaves(spark):
    rows = [(i, f"{i}", "en", f"s{i % 50}", i % 977) for i in range(6000)]
    got = kdshard.kd_shards(docs(spark, rows), ("source", "n_chars"), shards=260).toPandas()
    assert got.groupby("shard")["size"].sum().max() < 3 * got["size"].sum() / 260 and got.shard.nunique() > 255


def test_kd_shards_hard_cases(spark):
    got = kdshard.kd_shards(hard(spark), ("lang", "source", "n_chars"), target_bytes=50_000).toPandas()
    assert len(got) == 10 and got.shard.between(0, 3).all() and (got[got.doc_id == 2]["size"] == 1).all()
    assert kdshard.kd_shards(empty(spark), ("lang",), shards=8).count() == 0


def test_mixing_budgets_add_up(spark):
    rows = [(i, "abcd" * (1 + i % 5), ["en", "de"][i % 2], f"src{i % 7}") for i in range(700)]
    d = docs(spark, rows)
    leaves = mixing.plan(d, queries.mixing_levels(), queries.mixing_weights(), (7, 10), 2, 11)
    total, budget = leaves.agg(F.sum("tokens"), F.sum("budget")).first()
    assert budget == total * 7 // 10 and leaves.filter("budget > 2 * tokens").count() == 0
    taken = mixing.apply_plan(d, leaves, queries.mixing_levels(), 11)
    by = {(x.domain, x.lang, x.source): x.n for x in taken.withColumns(queries.mixing_levels()).groupBy("domain", "lang", "source").agg(F.sum(mixing.tokens_of() * F.col("mix_epochs")).alias("n")).collect()}
    for x in leaves.collect():  # a prefix passes its budget by less than one document
        assert x.budget <= by.get((x.domain, x.lang, x.source), 0) < x.budget + 5


def test_mixing_gives_shortages_to_siblings_first(spark):
    """Source a of domain one is short; b takes what it can't, and domain two keeps its half."""
    levels = {"domain": F.col("lang"), "source": F.col("source")}
    rows = [(i, "x" * 4, "one", "a") for i in range(10)] + [(100 + i, "x" * 4, "one", "b") for i in range(200)] + [(900 + i, "x" * 4, "two", "c") for i in range(200)]
    got = {(x.domain, x.source): x.budget for x in mixing.plan(docs(spark, rows), levels, {}, (1, 2), 1).collect()}
    assert got == {("one", "a"): 10, ("one", "b"): 93, ("two", "c"): 102}


def test_mixing_hard_cases(spark):
    levels = queries.mixing_levels()
    d = hard(spark).withColumn("mix_epochs", F.lit("x"))
    leaves = mixing.plan(d, levels, queries.mixing_weights(), (1, 1), 1)
    taken = mixing.apply_plan(d, leaves, levels)
    assert taken.count() >= 7 and taken.columns.count("mix_epochs") == 1 and taken.agg(F.max("mix_epochs")).first()[0] == 1
    none = mixing.plan(empty(spark), levels, {}, (1, 2))
    assert none.count() == 0 and mixing.apply_plan(empty(spark), none, levels).count() == 0
