"""Operators that SQL cannot express, against plain versions."""

import base64
import gzip
import hashlib
import itertools
import json
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, decontaminate, license_scan, line_dedup, near_copies, quality, secrets, simhash, topk, warc

SF = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(open(public_tokenizers.path(bpe.VOCABULARY), "rb").read())
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.PrefixCoder(RANKS)
ODD = st.text(st.sampled_from("aabehinortsé 'sß\n\t 1.!漢🙂"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ODD | st.text(max_size=40))
def test_bpe_equals_tiktoken(text):
    ids = CODER.encode(text)
    assert ids == TIK.encode_ordinary(text) and CODER.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(ODD, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 9), ODD), max_size=4))
def test_bpe_edits_equal_encoding_anew(text, edits):
    own = bpe.EncodedText(CODER, text)
    for start, size, new in edits:
        start = min(start, len(own.text))
        own.edit(start, min(len(own.text), start + size), new)
        assert own.tokens() == TIK.encode_ordinary(own.text)


def test_bpe_append_is_linear_and_exact():
    piece = bpe.EncodedPiece(CODER)
    rnd = random.Random(2)
    for _ in range(200):
        piece.append(bytes(rnd.choice(b"theraning") for _ in range(rnd.randint(1, 5))))
    for length in (1, 7, 50, len(piece.text)):
        text = bytes(piece.text[:length])
        assert text in RANKS or piece.tokens(length) == TIK.encode_ordinary(text.decode())
    assert len(CODER.encode("a" * 200_000)) > 1000  # one piece


def test_bpe_edit_keeps_far_pieces():
    own = bpe.EncodedText(CODER, "some words here. " * 500)
    before = own.encoded
    own.edit(4000, 4003, "XYZ ")
    assert own.encoded - before < 10 and own.tokens() == TIK.encode_ordinary(own.text)


def test_bpe_query_equals_tiktoken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = TIK.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect()} == want


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in fps}


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text or "") for r in docs.collect()}
    roots = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{fps[d]:016x}", roots[d]) for d in fps}


def test_simhash_links_lose_nothing(spark, monkeypatch):
    """Dense clusters and a chain, for each number of blocks, with groups divided early."""
    rnd = random.Random(11)
    fps = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rnd.randint(0, 7)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    for i in range(0, 63, 3):
        fps.add((1 << i) - 1)
    fps |= {0, (1 << 64) - 1}
    want = plain_components({x: x for x in fps})
    signed = [int(np.uint64(x).astype(np.int64)) for x in sorted(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for blocks, heavy in ((4, 8), (5, 8), (5, 2048), (6, 2048)):
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, blocks=blocks)).collect()}
        groups, expected = {}, {}
        for s in signed:
            groups.setdefault(roots.get(s, s), set()).add(s)
            expected.setdefault(want[s & (1 << 64) - 1], set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())), (blocks, heavy)


def test_simhash_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for t in license_scan.PHRASES:
        own = t.text.split(" ")
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        labels |= {t.label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan_base(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["MIT License mit-license MIT, LICENSE", "the General\nPublic  License general public license", "MİT license, mit licenSe Kit license", "apache license apache license mit", "licensed under the Apache License, Version 2.0", None, "", "mit", "mit license " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: plain_scan(t) for i, t in enumerate(texts)}


def test_license_scan_notices(spark):
    notice = license_scan.NOTICES[1].text
    words = notice.split()
    texts = ["x y " + notice.upper() + " z", " ".join(words[:4] + ["odd"] + words[4:]), " ".join(words[:3] + words[4:]), " ".join(words[:5]), "nothing at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert ["gpl-3.0" in got[i].labels for i in range(5)] == [True, True, True, False, False]
    assert got[0].score == 1.0 and 0.8 <= got[1].score <= 1.0 and got[4].score == 0.0


def plain_best(words, item, similarity=0.8):
    k = min(5, len(item))
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    n, own = min(len(item), len(words)), grams(item)
    best = 0.0
    for s in range(len(words) - n + 1):
        here = grams(words[s : s + n])
        both = sum((here & own).values())
        best = max(best, both / max(1, sum(here.values()) + sum(own.values()) - both))
    return best if best >= similarity else None


def test_decontamination(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 6, 20, 45])))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 90))
        if d % 2:
            passage = rnd.choice(items[:12])[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                passage[rnd.randrange(len(passage))] = "changed"
            if rnd.random() < 0.3:
                passage.insert(rnd.randrange(len(passage)), "more")
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, ", ".join(words).upper() if d % 3 else "\n".join(words)))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, item in items[:12]:
            best = plain_best(re.findall(r"\w+", text.lower()), item.split())
            if best:
                want[d, i] = round(best, 9)
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in decontaminate.clean(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_at_exactly_the_similarity():
    """A window whose needed shingles are a whole number, which floats round up: 56 of 63 left intact are 56/70."""
    for n in (67, 130, 256):
        item = [f"w{i}" for i in range(n)]
        left = (n - 4) * 8 // 9 + 4
        words = item[:left] + [f"x{i}" for i in range(n - left)]
        assert plain_best(words, item) == 0.8
        found = decontaminate.Items([(1, " ".join(item))]).matches(decontaminate.word_hashes(decontaminate.normalise(" ".join(words).encode())))
        assert [(m[0], m[4]) for m in found] == [(1, 0.8)], n


def test_decontamination_of_repeating_items():
    """Two alternating words against themselves shifted by one: 8/10, with fingerprints far apart."""
    rnd = random.Random(8)
    bits = []
    for n in range(20):
        item = [f"a{n}", f"b{n}"] * 6 + [f"a{n}"]
        text = item[1:] + item[1:2]
        found = decontaminate.Items([(n, " ".join(item))]).matches(decontaminate.word_hashes(decontaminate.normalise(" ".join(text).encode())))
        assert [(m[0], m[4]) for m in found] == [(n, plain_best(text, item))] == [(n, 0.8)]
        bits.append(found[0][3])
    assert max(bits) > 24
    for _ in range(200):
        item, text = rnd.choices("ab", k=rnd.randint(5, 14)), rnd.choices("ab", k=rnd.randint(0, 60))
        found = decontaminate.Items([(1, " ".join(item))]).matches(decontaminate.word_hashes(decontaminate.normalise(" ".join(text).encode())))
        assert (found[0][4] if found else None) == plain_best(text, item)


def test_decontamination_long_text_in_chunks(monkeypatch):
    text = decontaminate.normalise(("Some, words. here " * 300).encode())
    whole = decontaminate.word_hashes(text)
    monkeypatch.setattr(decontaminate, "CHUNK", 64)
    assert (decontaminate.word_hashes(text) == whole).all() and len(whole) == 900


def test_top_k_shards_and_ties(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 6) / 8]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ints = {i: np.floor(np.array(v) * 1024).astype(int) for i, v in rows}
    want = set()
    for q in range(0, 700, 100):
        order = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(order)}
    for shard, block in ((64, 3), (10_000, 512)):
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, shard=shard, block=block).collect()} == want


def test_warc_ranges_and_false_magic(spark, tmp_path):
    """Any range size gives the same records; bytes like the magic inside stored members are no records."""
    rnd = random.Random(9)
    pages = [(i, f"http://h/{i}", "".join(rnd.choice("abc é<>\n") for _ in range(rnd.choice([0, 50, 3000])))) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2)
    path = str(tmp_path / "own")
    warc.write_warc(df, path)
    want = sorted((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in pages)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    odd = tmp_path / "odd"
    odd.mkdir()
    body = lambda i: warc.MAGIC * 3 + bytes([i]) * 40 + warc.MAGIC + b"tail"
    with open(odd / "a.warc", "wb") as f:
        for i in range(40):
            f.write(gzip.compress(warc.record("response", "u", i, "", 50, body(i), None), 0))
    try:
        for size in ("300b", "4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read_warc(spark, path, payloads=True).collect()
            assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
            assert all(bytes(r.payload).decode() == pages[r.page_id][2] for r in got if r.record_type == "response")
            got = warc.read_warc(spark, str(odd), payloads=True).collect()
            assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(i, body(i)) for i in range(40)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_large_record_ends_in_an_empty_member():
    made = warc.member(b"\x00" * ((1 << 24) + 5))
    assert made[-1] == 0 and len(gzip.decompress(made)) == (1 << 24) + 5


def plain_spans(text):
    kinds = [r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]
    out = []
    for k, (p, least) in enumerate(zip(kinds, (8, 16, 32), strict=True)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text, re.A) if len(m[1] if k == 0 else m[0]) >= least]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_base(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["é🙂 PassWd='abcd1234' api_key: xyzxyzxyz", "token token=short secret= longenough1", "AKIA AKIA1234567890AB AKIAshort", "AKIAAKIA" + "A" * 20, "f" * 40 + " " + "A" * 40, "ſecret=abcdefgh1", "apikey\"  :  'aaaaaaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in secrets.find_secrets(df).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:80]
        assert r.n_assign + r.n_access + r.n_hex == len([x for x in want.split(",") if x])
        assert set(want.split(",")) <= set(r.spans.split(","))


def der(tag, *parts):
    body = b"".join(parts)
    n = (len(body).bit_length() + 7) // 8
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 + n]) + len(body).to_bytes(n, "big")
    return bytes([tag]) + size + body


def test_secrets_structure():
    rsa = der(0x30, der(2, b"\0"), *[der(2, b"\x01" + bytes([i + 1]) * n) for i, n in enumerate((127, 3, 127, 63, 63, 63, 63, 63))])
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, b"k" * 32)))
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = field(b"ssh-ed25519") + field(b"p" * 32)
    web = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    token = ".".join([web(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), web(json.dumps({"sub": "1"}).encode()), "c2ln"])
    lines = re.sub("(.{64})", r"\1\n", base64.b64encode(rsa).decode())

    def found(text):
        return [(text[a:b], secrets.KINDS[k]) for a, b, k in secrets.confirmed_spans(text, text.encode())]

    assert found(f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----") == [(lines, "der")]
    assert found(f"key {lines}\nThe next line of text") and found(f"é {base64.b64encode(pkcs8).decode()} end") == [(base64.b64encode(pkcs8).decode(), "der")]
    assert found(f"x {pkcs8.hex()} y") == [(pkcs8.hex(), "der")]
    assert found(f"ssh-ed25519 {base64.b64encode(ssh).decode()} me") == [(base64.b64encode(ssh).decode(), "keyfile")]
    assert found(f"bearer {token},") == [(token, "token")]
    broken = pkcs8[:-1]
    for text in (base64.b64encode(broken).decode(), broken.hex(), "A" * 80, token.replace("ey", "xx"), "word " * 99, web(b'{"typ":1}') + "." + web(b"{}" * 9) + ".x", "." * 60, "a." * 40):
        assert found(text) == []


def test_secrets_in_every_line_of_a_run():
    """Keys behind keys, behind other lines and among them, and hex runs with a digit too many."""
    field = lambda x: len(x).to_bytes(4, "big") + x
    plain = lambda x: base64.b64encode(x).rstrip(b"=").decode()
    wrapped = lambda x, n: re.sub("(.{%d})(?=.)" % n, r"\1\n", plain(x))
    ed = [der(0x30, der(2, b"\0"), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, bytes([k]) * 32))) for k in range(3)]
    rsa = der(0x30, der(2, b"\0"), *[der(2, b"\x01" + bytes([i + 1]) * n) for i, n in enumerate((127, 3, 127, 63, 63, 63, 63, 63))])
    ssh = [field(b"ssh-ed25519") + field(bytes([k]) * 32) for k in range(2)]
    private = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(ssh[0]) + field(b"k" * 136)
    assert len(plain(ed[0])) == 64

    def found(text):
        return [(text[a:b], secrets.KINDS[k]) for a, b, k in secrets.confirmed_spans(text, text.encode())]

    keys = [(plain(x), "der") for x in ed]
    digest = "0123456789abcdef" * 4
    for between in ("\n", "\r\n", "\n" + digest + "\n", "\nword\n"):
        assert found(between.join(k for k, _ in keys)) == keys
        assert found(digest + between + between.join(k for k, _ in keys)) == keys
    whole = [(wrapped(rsa, 64), "der"), (wrapped(private, 70), "keyfile"), *[(plain(x), "keyfile") for x in ssh], (wrapped(ssh[0], 44), "keyfile"), keys[0]]
    for order in (whole, whole[::-1]):
        assert found("\n".join(k for k, _ in order)) == order
        assert found("\n".join(digest + "\n" + k for k, _ in order)) == order
    assert found("\n".join([digest] * 500)) == [] and found(plain(ed[0][:-1]) + "\n" + plain(ed[1])) == [keys[1]]
    assert found("x " + ed[0].hex() + "0 y") == found("x 0" + ed[0].hex() + " y") == [(ed[0].hex(), "der")]


def test_cuckoo_filter_insert_delete():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 1 << 64, 4000, np.uint64, endpoint=False)
    own = line_dedup.CuckooFilter.sized(3000)
    assert own.insert(keys[:3000]) and own.contains(keys[:3000]).all() and own.contains(keys[3000:]).mean() < 0.01
    own.delete(keys[:1500])
    assert own.contains(keys[1500:3000]).all() and own.contains(keys[:1500]).mean() < 0.01
    again = line_dedup.CuckooFilter.load(own.dump())
    assert again.contains(keys[1500:3000]).all()
    small = line_dedup.CuckooFilter(4)
    assert not small.insert(keys[:100])


def test_line_index_is_reversible(spark):
    rnd = random.Random(6)
    lines = [f"line number {i} that is long enough to count as one" for i in range(30)] + ["short"]
    texts = {d: "\n".join(rnd.choices(lines, k=6)) for d in range(60)}
    frame = lambda ids: spark.createDataFrame([(d, texts[d]) for d in ids], "doc_id bigint, text string")

    def state(index):
        return {bytes(r.key): (r.n_docs, r.keeper) for r in index.state.refs.collect()}

    def truth(ids):
        out = {}
        for d in ids:
            for key in {line_dedup.line_key(x.encode()) for x in texts[d].split("\n")} - {None}:
                n, top = out.get(key, (0, -1))
                out[key] = (n + 1, max(top, d))
        return out

    index = line_dedup.LineIndex(spark, 3)
    index.insert(frame(range(0, 30)))
    assert state(index) == truth(range(30))
    index.insert(frame(range(20, 60)))
    assert state(index) == truth(range(60))
    index.delete(frame([59, 3, 58, 777 % 60]).select("doc_id"))
    left = [d for d in range(60) if d not in (59, 3, 58, 777 % 60)]
    assert state(index) == truth(left)
    index.delete(frame(range(5, 57)).select("doc_id"))
    few = [d for d in left if not 5 <= d < 57]
    assert state(index) == truth(few)
    keys = spark.createDataFrame([(bytearray(line_dedup.line_key(x.encode())),) for x in lines[:30]], "key binary")
    seen = {bytes(r.key): r.seen for r in index.may_hold(keys).collect()}
    assert all(seen[k] for k in truth(few))
    index.insert(frame(range(60)))
    assert state(index) == truth(range(60))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    models = quality.fit(docs, labels.where(~hidden), sample=2_000, pool=1_000)
    scored = quality.score_documents(docs.join(labels.where(hidden).select("doc_id"), "doc_id", "left_semi"), models)
    rows = scored.join(labels.where(hidden), "doc_id").toPandas()
    low, toxic = rows["quality"] == 0, rows["toxic"] == 1
    assert ((rows["low_score"] >= 0.5) == low).mean() > 0.98
    assert ((rows["toxic_score"] >= 0.5) == toxic).mean() > 0.975  # a tenth of the toxic rows hold nothing toxic
    clean = ~low & ~toxic
    assert rows["keep"][clean].mean() > 0.99
    again = quality.fit(docs, labels.where(~hidden), sample=2_000, pool=1_000)
    assert np.allclose(again["toxic"].mix, models["toxic"].mix)


def plain_near_copies(texts):
    """Components of five-word Jaccard similarity of 0.8 or more, by the smallest id."""
    parts = {}
    for d, text in texts.items():
        words = text.lower().split()
        parts[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if 5 * len(parts[a] & parts[b]) >= 4 * len(parts[a] | parts[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in texts}


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10**6)}"
    return words


def test_near_copies(spark, monkeypatch):
    """Copies on both sides of 0.8 and exactly there, a large group, common passages, and sets of few words."""
    rnd = random.Random(21)
    passage = [f"p{i}" for i in range(30)]
    texts = ["", " \n", "one", "One", "one two three", "a b c d e", "A b  c d e"]
    for _ in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 200))]
        texts += [" ".join(edited(rnd, base, rnd.randint(0, 5))) for _ in range(4)]
    large = [f"v{i}" for i in range(120)]
    texts += [" ".join(edited(rnd, large, rnd.randint(0, 4))) for _ in range(80)]
    texts += [" ".join(passage + [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(3, 40))]) for _ in range(60)]
    exact = [f"u{i}" for i in range(94)]  # 90 shingles; 80 of them in both, and 10 more in one
    texts += [" ".join(exact[:84]), " ".join(exact), " ".join(exact + [f"u{i}" for i in range(94, 104)])]
    rows = dict(enumerate(texts))
    want = plain_near_copies(rows)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(5)
    for common, often in ((near_copies.COMMON, 2), (0, 2), (near_copies.COMMON, 10**6)):
        monkeypatch.setattr(near_copies, "COMMON", common)
        monkeypatch.setattr(near_copies, "OFTEN", often)
        assert {r.doc_id for r in near_copies.keep_one(df).collect()} == set(want.values())
    over = [d for d in want if want[d] != d and (plain_fingerprint(rows[d]) ^ plain_fingerprint(rows[want[d]])).bit_count() > 3]
    assert len(over) > 20


def test_near_copies_come_through_fingerprints(spark, monkeypatch):
    """Sets with fingerprints of 3 bits or fewer apart are told by SimHash, and the stage takes its links from there."""
    rnd = random.Random(23)
    texts = []
    for _ in range(30):
        base = [f"w{rnd.randrange(3000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(edited(rnd, base, 1)), " ".join(base[:-1])]
    rows = dict(enumerate(texts))
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(5)
    own = near_copies.sets(df).collect()
    told = {(r.a, r.b) for r in near_copies.fingerprint_pairs(spark.createDataFrame(own, "doc_id bigint, node bigint, sketch binary, fp bigint")).collect()}
    joined = {node: node for r in own for node in [r.node]}
    for _ in own:
        for a, b in told:
            joined[a] = joined[b] = min(joined[a], joined[b])
    close = [(x.node, y.node) for x, y in itertools.combinations(own, 2) if ((x.fp ^ y.fp) & (2**64 - 1)).bit_count() <= 3]
    assert len(close) > 10 and all(joined[a] == joined[b] for a, b in close)
    calls, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: calls.append(1) or links(*a, **b))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert calls and kept == set(plain_near_copies(rows).values())


def test_pipeline_run(spark, tmp_path):
    """All stages in a row against plain ones; without labels the first one keeps everything."""
    rnd = random.Random(22)
    items = [(i, " ".join(f"b{rnd.randrange(500)}" for _ in range(67))) for i in range(3)]
    often = [f"this line number {i} stands in a good many documents" for i in range(3)]
    texts = {}
    for d in range(160):
        words = texts[rnd.randrange(d)].split() if d and rnd.random() < 0.5 else [f"w{rnd.randrange(2000)}" for _ in range(rnd.randint(8, 150))]
        text = " ".join(edited(rnd, words, rnd.randint(0, 2)))
        if rnd.random() < 0.1:
            text += " " + " ".join(rnd.choice(items)[1].split()[: rnd.choice([50, 60, 67])] + ["x", "y", "z"] * 6)
        texts[d] = text + "\n" + rnd.choice(often) if rnd.random() < 0.3 else text
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lines = {}
    for d, text in texts.items():
        for line in set(text.split("\n")):
            lines.setdefault(line, []).append(d)
    keeper = {line: max(ids) for line, ids in lines.items() if len(ids) >= 5 and len(line.strip()) >= 40}
    now = {d: "\n".join(x for x in text.split("\n") if keeper.get(x, d) == d) for d, text in texts.items()}
    roots = plain_near_copies(now)
    now = {d: text for d, text in now.items() if roots[d] == d}
    clean = {d: text for d, text in now.items() if not any(plain_best(re.findall(r"\w+", text.lower()), item.split()) for _, item in items)}
    assert len(texts) > len(now) > len(clean) > 20
    got = {r.doc_id: (list(r.tokens), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: (TIK.encode_ordinary(text), len(TIK.encode_ordinary(text))) for d, text in clean.items()}
