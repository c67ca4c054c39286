"""The training-data operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import glob
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from test_tries_alignment_rules import brute_alignment, brute_counts, brute_trie

from evigrade.llm import bpe, exact_dedup, language_id, media, near_dedup, packing, pii, quality, registry, sharding, simhash_dedup, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, fp string, size long, norm string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(40)) for i in rng.integers(len(WORDS), size=n))


TEXTS = [None, "", " \n", "a b", "a  b\n", "A b", prose(1), prose(1), prose(1).replace(" ", "\t"), prose(2) + " extra", prose(2), "x" * 60_000, "mail me@x.org, +1 (555) 010-9999 or 4111 1111 1111 1111 at 10.0.0.1", "é" * 500 + " 🙂"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(None, "a b", None, None, None, None), (3, "a b", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {f.rpartition('/')[2][:-8]} AS SELECT * FROM '{f}'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(repr(tuple(r[want.columns.index(n)] for n in names)) for r in want.fetchall())


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_exact(rows):
    """(doc_id, keep_id, group_size, kept, digest) of (doc_id, text) rows, sorted."""
    groups, out = {}, []
    for i, t in rows:
        groups.setdefault(normal(t), []).append((i, t or ""))
    for norm, members in groups.items():
        members.sort(key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, members[0][0], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, (i, _) in enumerate(members)]
    return sorted(out, key=repr)


def test_exact_dedup(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact_dedup.exact_dedup(docs, digest_all=True).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == brute_exact(rows)
    few = exact_dedup.exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in few), key=repr) == [r[:4] for r in brute_exact(rows)]
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first_copies(docs).collect()
    assert len(kept) == len({normal(t) for _, t in rows}) and sorted(r.doc_id for r in kept) == sorted(r[0] for r in brute_exact(rows) if r[3])
    assert exact_dedup.keep_first_copies(empty).count() == 0


def test_simhash(docs, empty):
    rows = simhash_dedup.simhash_components(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    fps = {i: r.fp for i, r in by.items()}
    root = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            for j in fps:
                if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: r.component_id for i, r in by.items()} == root
    assert by[0].fp == by[1].fp == by[2].fp == 0 and by[3].component_id == by[5].component_id == 3
    # Long postings are linked another way, with the same links.
    spread = [int(x) for x in np.random.default_rng(3).integers(0, 1 << 62, 40)]
    near = sorted({b ^ (1 << k) for b in spread for k in (0, 3, 9)} | set(spread))
    frame = docs.sparkSession.createDataFrame([(x,) for x in near], "fp long")
    comps = lambda most: sorted((r.node, r.root) for r in simhash_dedup.connected_components(simhash_dedup.links(frame, most)).collect() if r.node in near)
    groups = lambda pairs: sorted(sorted(n for n, r in pairs if r == k) for k in {r for _, r in pairs})
    assert groups(comps(64)) == groups(comps(1)) and len(groups(comps(64))) == 40
    assert simhash_dedup.simhash_components(empty).count() == 0


def test_near_duplicates(spark, docs, empty):
    words = prose(9, 200).split()
    texts = [" ".join(words), " ".join(words[:50] + ["changed"] + words[51:]), prose(10, 200), " ".join(words[:100] + prose(11, 100).split())]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    c = {r.doc_id: r.component for r in near_dedup.near_duplicates(frame).collect()}
    assert c[0] == c[1] and len(set(c.values())) == 3
    assert sorted(r.doc_id for r in near_dedup.keep_one_of_near(frame).collect()) == [0, 2, 3]
    assert near_dedup.keep_one_of_near(docs).columns == docs.columns and near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one_of_near(empty).count() == 0


def test_bpe(docs, empty):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode_texts(docs)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in coded.collect() if r.doc_id not in (None, 3)}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(TEXTS) if i != 3}
    back = {r.doc_id: bytes(r.text) for r in bpe.decode_ids(coded).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(TEXTS))
    assert bpe.encode_texts(empty).count() == 0
    replay = bpe.MergeReplay(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    odd = ["  a   b\n\n c  \n", "a\n b", "\x00 a", "it's  we'll 12 34　x", "<|endoftext|> z"]
    assert [np.frombuffer(x, "<u4").tolist() for x in replay.encode(odd)] == [own.encode_ordinary(t) for t in odd]


def test_packing(docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    marked = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y <|endoftext| > z"]
    texts = TEXTS + marked
    more = docs.sparkSession.createDataFrame([(len(TEXTS) + k, m, "en", "x", 1, "y") for k, m in enumerate(marked)], SCHEMA)
    rows = packing.pack(docs.unionByName(more)).collect()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        if i != 3:
            assert [s for s, *_ in own] == [0, *np.cumsum([n for _, n, *_ in own])[:-1]] and sum(n for _, n, *_ in own) == len(ids)
        assert all(c == zlib.crc32(ids[s : s + n].tobytes()) and d == len(ids) for s, n, c, d in own)
    for k in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == k)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 1024
    assert packing.pack(empty).count() == 0
    ids = {r.doc_tokens for r in rows if r.doc_id == len(TEXTS)}
    assert ids == {len(t.encode(marked[0], add_special_tokens=False).ids) + 1} == {5}
    groups = packing.pack_block([600, 500, 500, 424])
    assert sorted(i for g in groups for i in g) == [0, 1, 2, 3] and len(groups) == 2


def test_units_that_come_again_are_encoded_once():
    """A small store: units of each batch stay known though others come and go, and ids are those of a large one."""
    path, said = packing.public_path(packing.TOKENIZER), []
    small, large = packing.Units(path, 3), packing.Units(path)
    one = small.one
    small.one = lambda u: said.append(u) or one(u)
    batches = [["x the and of", f"y the w{k} of <|endoftext|> and v{k}"] for k in range(5)]
    assert [small.encode(b) for b in batches] == [large.encode(b) for b in batches]
    assert len(said) == len(set(said)) and len(small.known) + len(small.aside) <= 24


def test_cuts_before_spaces_are_unsafe_beside_white_space_only():
    unsafe = re.compile(r" \s|\s |\x00")
    white = [chr(c) for c in range(0x10000) if re.match(r"\s", chr(c))]
    texts = ["", " ", "a b", " a", "a ", "\x00", *[f"a{c}b c" for c in white], *[f"a{c} b" for c in white], *[f"a {c}b" for c in white], "é\u3000b c\nd", "a\nb \u2028c"]
    assert [bpe.is_unsafe(t) for t in texts] == [bool(unsafe.search(t)) for t in texts]


def test_warc(spark):
    rows = [(1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u v", None), (4, "u", ""), (5, "u", "é" * 1000), (None, "u", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (7, 1 << 16):
        got = {r.page_id: r for r in warc.read_records(warc.chunk_table(pages, chunk_bytes=chunk)).collect()}
        assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), None: ("revisit", 1)}
        for i, _, html in rows:
            raw = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].intact) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), True)
    assert warc.read_records(warc.chunk_table(pages.limit(0))).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for o, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), o, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


PII_TEXTS = [
    *TEXTS, "a@b.c.d..e@f.g x@y a.b@c.d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 01.002.3.255", "4111-1111-1111-1111 4111 1111 1111 1112 123456789012345678901234567890", "+1 +49 (30) 123-456 +123456789 +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6",
    "é🙂 x@y.zz 🙂 10.0.0.1é", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and me at host dot org', " ".join(f"u{i}@x{i}.org +1555010{i:04d}" for i in range(1500)), "1" * 20_000, "a." * 20_000 + "@", "@" * 5000,
]


def parsed_records(data):
    """Records of a WARC file, read by length alone."""
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        block, data = data[:n], data[n:]
        assert data[:4] == b"\r\n\r\n"
        out.append((fields, block))
        data = data[4:]
    return out


def test_warc_chunks_join_to_a_file_that_others_read(spark):
    rows = [(1, "http://a/", "<p>a</p>" * 30), (2, None, "<p>a</p>" * 30), (3, "u v", None), (4, "u", "é\r\n\r\nx" * 50)]
    chunks = warc.chunk_table(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk_bytes=64).collect()
    records = {}
    for c in sorted(chunks, key=lambda c: (c.record, c.chunk)):
        records.setdefault(c.page_id, []).append(bytes(c.data))
    found = {i: parsed_records(b"".join(parts)) for i, parts in records.items()}
    assert all(len(x) == 1 for x in found.values()) and len(parsed_records(b"".join(b"".join(p) for p in records.values()))) == 4
    for i, _, html in rows:
        fields, block = found[i][0]
        _, _, body = block.partition(b"\r\n\r\n")
        raw = (html or "").encode()
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert body == (b"" if fields["WARC-Type"] == "revisit" else raw) and (fields["WARC-Type"] == "revisit") == (i == 2)
    assert max(len(c.data) for c in chunks) < 64 + 600


def test_pii(spark, docs, empty):
    frame = spark.createDataFrame(list(enumerate(PII_TEXTS)) + [(None, "me@x.org"), (1, "me@x.org")], "doc_id long, text string")
    got = pii.spans(frame).select("doc_id", pii.written(pii.F.col("base")).alias("b"), pii.written(pii.F.array_sort(pii.F.concat("base", "added"))).alias("every")).collect()
    by = {r.doc_id: r.b for r in got if r.doc_id not in (None, 1)}
    assert by == {i: ",".join(brute_spans(t)) for i, t in enumerate(PII_TEXTS) if i != 1} and len(got) == len(PII_TEXTS) + 2
    assert all(set(filter(None, r.b.split(","))) <= set(r.every.split(",")) for r in got)
    # Redaction: what the spans say, replaced by hand.
    every = {r.doc_id: r.every for r in got}
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    for i, t in enumerate(PII_TEXTS):
        at, want = 0, ""
        for kind, s, e in (x.split(":") for x in every[i].split(",") if x and i != 1):
            want += (t[at : int(s)] + f"[{kind.upper()}]") if int(s) >= at else ""
            at = max(at, int(e))
        assert i == 1 or clean[i] == (t if t is None else want + t[at:])
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[12] == "mail [EMAIL], [PHONE] or [CARD] at [IP]"
    assert pii.spans(empty).count() == 0 and pii.redact(empty).count() == 0 and pii.redact(docs).columns == docs.columns


def test_reliabilities_follow_planted_labelers():
    """Votes drawn by known reliabilities of two classes: expectation-maximisation finds which patterns are which."""
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.5
    votes = {v: np.where(rng.random(4000) < 0.85, np.where(truth, 1, -1), np.where(truth, -1, 1)) for v in pii.LABELERS}
    counts = {}
    for row in zip(*votes.values(), strict=True):
        counts[tuple(map(int, row))] = counts.get(tuple(map(int, row)), 0) + 1
    rows = [{"k": "email", "count": n} | dict(zip(pii.LABELERS, p, strict=True)) for p, n in counts.items()]
    chance, belief = pii.reliabilities(rows)
    assert all(abs(chance[v][1][1] - 0.85) < 0.05 for v in pii.LABELERS) and all((b > 0.5) == (sum(p) > 0) for p, b in belief.items())


def test_media(docs, empty):
    for kind in media.STORED:
        blob = media.store(media.padded(b"hello"), kind)
        assert media.read_back(blob) == media.padded(b"hello")
        assert [(k, s, e) for k, s, e, _ in media.sniff(b"BM junk RIFF" + blob + b"tail")] == [(kind, 12, 12 + len(blob))]
        assert media.sniff(blob[:-1] if kind != "png" else blob[:-5]) == []
    kept = media.stored_texts(docs)
    found = {r.doc_id: r for r in media.sniff_media(kept, "doc_id", "media", "declared").collect()}
    assert all((r.media_type if r.media_type != "unknown" else r.embedded[0].media_type) in media.STORED for r in found.values()) and media.stored_texts(empty).count() == 0
    null = docs.sparkSession.createDataFrame([(1, None, None)], "doc_id long, blob binary, declared string")
    assert media.sniff_media(null, "doc_id", "blob", "declared").first().media_type == "unknown"


def test_media_query(spark):
    """Every field of the query by hand; the payload is carved or read in place."""
    got = {r.doc_id: r for r in registry.QUERIES["op9_media"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = media.padded(raw)
        kind = media.STORED[zlib.crc32(raw) % 4]
        medium = media.store(payload, kind)
        stored = medium.join(media.CARRIER) if zlib.crc32(raw) % 5 == 0 else medium
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.carved_bytes, r.carved_sha256) == (len(medium), hashlib.sha256(medium).hexdigest()) and r.feature.split(":")[0] == kind
    assert {r.feature.split(":")[3] for r in got.values()} == {"kept", "corrected", "carved"}


def test_language(spark, docs, empty):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(20)] + [(i, f"der hund und die katze {i}", "de") for i in range(20, 40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the dog"), (2, "die hunde"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and 0 <= got[1].score <= 1
    assert language_id.predict(docs, language_id.train(empty)).first().lang_pred == "und"
    odd = spark.createDataFrame([(1, "² ½ ① ٣"), (2, "the²dog"), (3, "_ 1 _"), (4, "é")], "doc_id long, text string")
    marks = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert marks[1] == marks[3] == ("und", 0.0) and marks[2] == (got[1].lang_pred, got[1].score) and marks[4][0] != "und"


def test_words_are_runs_of_letters():
    for text in ("ab²c d_e", "İx", "l'été 1a", "", "٣ a", "ǅ ª"):
        want = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        assert language_id.words_of(text) == want


def test_quality(spark, docs, empty):
    good = [(i, prose(i), 1) for i in range(30)]
    bad = [(i, "Foo " * (40 + i), 0) for i in range(30, 60)]
    frame = spark.createDataFrame([(i, t, i % 7, y) for i, t, y in good + bad], "doc_id long, text string, junk long, y int")
    labels = frame.select("doc_id", frame.y.alias("quality"))
    model = quality.fit(frame, labels)
    scores = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert np.mean([(scores[i] >= quality.THRESHOLD) == (y == 1) for i, _, y in good + bad]) > 0.95
    assert quality.score(docs, model).count() == len(TEXTS) + 2 and quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).first().score == 1.0


def test_sharding(docs):
    claimed = sharding.lookup_table(["a", "b", "c"], 101)
    assert sorted(claimed.count(k) for k in range(3)) == [33, 34, 34]
    fewer = sharding.lookup_table(["a", "b"], 101)
    assert sum(x != y for x, y in zip(claimed, fewer, strict=True) if x < 2) < 30
    rows = sharding.shard(docs, ["a", "b", "c"], slots=101).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        slot = zlib.crc32(("null" if r.doc_id is None else str(r.doc_id)).encode()) % 101
        assert (r.slot, r.shard) == (slot, "abc"[claimed[slot]])


def test_shards_hold_whole_rows(spark, docs, empty, tmp_path):
    shards = ["a", "b", "c"]
    written = sharding.write_shards(docs, shards, str(tmp_path / "s"), slots=101)
    want = sorted(map(repr, docs.collect()))
    assert sorted(map(repr, written.select(*docs.columns).collect())) == want
    assert {(r.doc_id, r.shard) for r in written.collect()} == {(r.doc_id, r.shard) for r in sharding.shard(docs, shards, slots=101).collect()}
    said = sharding.balance(written).collect()
    assert sum(r.rows for r in said) == len(want) and sum(r.bytes for r in said) == sum(len((t or "").encode()) for t in [*TEXTS, "a b", "a b"])
    assert sharding.write_shards(empty, shards, str(tmp_path / "e"), slots=101).count() == 0
    clash = docs.withColumn("shard", pii.F.lit("mine")).withColumn("slot", pii.F.lit(-1))
    assert {r.shard for r in sharding.place(clash, shards, slots=101).collect()} <= set(shards)


def test_quality_by_exact_cosines(spark):
    """Scores are the similarity-weighted labels of the nearest of all voters, by comparing with each."""
    rows = [(i, prose(i, 20 + i), 1) for i in range(20)] + [(i, "Foo BAR " * (5 + i), 0) for i in range(20, 40)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, ""), (1, "again")], "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    for r, text in zip(quality.score(frame, model).collect(), [t for _, t, _ in rows] + ["", "again"], strict=True):
        v = quality.vectors([quality.terms_of(text.encode())], model["idf"]) @ model["space"]
        cosines = (quality.unit(v) @ model["voters"].T)[0]
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[near], 1e-6)
        assert abs(r.score - (weight * model["labels"][near]).sum() / weight.sum()) < 0.02 and 0 <= r.score <= 1


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Tables with nulls, empty and very long texts, ties, repeated rows, under the names of the given ones; and empty ones."""
    out = []
    for name, texts in (("full", [*TEXTS, "é" * 30_000, "word " * 20_000, prose(1), None]), ("none", [])):
        at = tmp_path_factory.mktemp(name)
        rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)] + ([(None, "null id", None, None, None), (1, "", "en", "s", 0)] if texts else [])
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
        spark.createDataFrame([(i // 3 if i % 7 else None, i % 3 or None, None if i % 5 == 0 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
        out.append((str(at), len(rows)))
    return out


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "pipeline"])
def test_queries_on_odd_and_on_empty_tables(spark, small_tables, name):
    (full, n), (none, _) = small_tables
    got = registry.QUERIES[name](spark, full)
    assert registry.QUERIES[name](spark, none).count() == 0
    if name == "op7_packing":
        assert got.select("doc_id", "doc_tokens").distinct().count() >= n - 3
    elif name == "op11_prefix_trie":
        rows = [tuple(r) for r in spark.read.parquet(f"{full}/conversations.parquet").collect()]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)
    else:
        assert got.count() == (n if name != "op1_warc" else n - 2)


def test_query_values_on_odd_tables(spark, small_tables):
    """Null ids and texts, repeats and very long texts: the values of queries, each against its own brute force."""
    import public_tokenizers
    import tiktoken

    full = small_tables[0][0]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{full}/documents.parquet").collect()]
    collected = lambda name, *columns: sorted((tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, full).collect()), key=repr)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    ids = [(i, np.array(encode(t or ""), "<u4"), (t or "").encode()) for i, t in rows]
    assert collected("op5_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(((i, len(x), sha(x.tobytes()), sha(raw)) for i, x, raw in ids), key=repr)
    assert collected("op10_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)
    assert collected("op12_token_alignment", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == brute_alignment([r for r in rows if len(r[1] or "") < 10_000] + [r for r in rows if len(r[1] or "") >= 10_000])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected("op13_quality_rules", "doc_id", *counts) == sorted(((i, *brute_counts(t)) for i, t in rows), key=repr)


def test_pipeline(spark, small_tables):
    """Every stage keeps its promise on the tables, on odd rows and on none, and sequences are gapless."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.cut(stage(spark, docs, SF), f"test-{k}")
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
        if name == "exact dedup":
            assert docs.count() == len({normal(r.text) for r in before.collect()})
        if name == "simhash near-dedup":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            root = list(range(len(rows)))
            for i, j in brute_links([t for _, t in rows]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            assert sorted(r.doc_id for r in docs.collect()) == [rows[i][0] for i in sorted(set(root))]
        if name == "pii":
            assert docs.count() == before.count() and not [r.text for r in docs.collect() if brute_spans(r.text)]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    for k in {r.sequence_id for r in docs.collect()}:
        own = sorted((r.offset, r.length) for r in docs.where(docs.sequence_id == k).collect()) if k < 3 else []
        assert not own or ([o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 1024)
    for at, _ in small_tables:
        corpus_pipeline.run(spark, at).count()


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_links(texts, similarity=0.8):
    sets = [shingle_set(t) for t in texts]
    return [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]


def missed(spark, texts):
    """Links by brute force, and those of them whose ends aren't in one component."""
    c = {r.doc_id: r.component for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    links = brute_links(texts)
    return links, [(i, j) for i, j in links if c[i] != c[j]]


def test_near_duplicates_of_every_kind_of_edit(spark):
    """Added and replaced blocks, short texts, repeated lines (similarity is that of sets) and common passages: every link of brute force is found."""
    texts, made = [" ".join([prose(100 + k, 20)] * copies) for k in range(30) for copies in (5, 8, 40)], iter(range(10**6))
    texts += [" ".join([f"p{i}" for i in range(60)] + [f"q{k}x{j}" for j in range(6 + k % 9)]) for k in range(40)]
    new = lambda n: [f"v{next(made)}" for _ in range(n)]
    for _ in range(12):
        for n, more in ((200, 48), (1000, 240), (40, 8), (9, 1), (12, 1), (200, 20), (4, 0), (5, 1)):
            words = new(n)
            texts += [" ".join(words), " ".join(words + new(more))]
        words = new(200)
        texts += [" ".join(words), " ".join(words[:90] + new(17) + words[107:])]
    links, lost = missed(spark, texts)
    assert len(links) >= 12 * 7 + 90 and lost == []


def test_components_are_those_of_brute_force(spark):
    """Random edits of a few texts, by words, blocks and ends: the same components as by comparing all pairs."""
    rng, texts = np.random.default_rng(7), []
    for base in range(12):
        words = prose(50 + base, int(rng.integers(3, 150))).split()
        for _ in range(14):
            w = list(words)
            for _ in range(int(rng.integers(0, 5))):
                at = int(rng.integers(len(w)))
                w[at : at + int(rng.integers(0, 4))] = [f"n{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 6)))]
                w = w or ["x"]
            texts.append(" ".join(w))
    root = list(range(len(texts)))
    for i, j in brute_links(texts):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    groups = lambda of: sorted(sorted(i for i in range(len(texts)) if of[i] == k) for k in {of[i] for i in range(len(texts))})
    kept = near_dedup.keep_one_of_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(g[0] for g in groups(root))


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Near copies that are all apart at first: the rounds compare few pairs a member, and leave the components of brute force."""
    rng, made, texts = np.random.default_rng(3), [], []
    for k in range(200):
        w = [f"b{i}" for i in range(150)]
        for j in range(int(rng.integers(1, 4))):
            w[int(rng.integers(150))] = f"n{k}x{j}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_dedup.sketches(docs, "doc_id", "text", 5)
    known = near_dedup.rare_first(near_dedup.candidate_sets(docs, "text", rows, near_dedup.candidate_nodes(rows, 0.8), 5), 0.8)
    cut = near_dedup.cut

    def counted(df, name, **options):
        out = cut(df, name, **options)
        if name == "near-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "cut", counted)
    roots = near_dedup.settled(known, spark.createDataFrame([], "node long, component long"), 0.8)
    c = {r.doc_id: r.component or r.node for r in rows.select("doc_id", "node").join(roots, "node", "left").collect()}
    links = brute_links(texts)
    assert len(links) > 20 * len(texts) and not [x for x in links if c[x[0]] != c[x[1]]]
    assert sum(made) < 20 * len(texts), made


def test_stages_with_clashing_columns_and_repeats(spark):
    """Columns that operators could use themselves, null and repeated ids, repeated rows: all columns stay as they are."""
    names = ["doc_id", "text", "_row", "all", "mark", "row", "id", "spans", "base", "f", "node", "email", "c1"]
    text = prose(3, 60)
    rows = [(1, text), (1, text), (2, text + " more"), (None, text + " "), (None, "call me@x.org"), (None, "call me@x.org"), (None, "q"), (5, "mm"), (5, "m   m"), (6, None), (7, "")]
    frame = spark.createDataFrame([(i, t, *[f"{c}{k}" for c in names[2:]]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names[2:]))
    redacted = pii.redact(frame)
    assert redacted.columns == names and sorted(r["all"] for r in redacted.collect()) == sorted(r["all"] for r in frame.collect())
    assert [r.text for r in redacted.collect() if r.text and "call" in r.text] == ["call [EMAIL]"] * 2
    exact = exact_dedup.keep_first_copies(frame).collect()
    assert sorted((repr(r.doc_id), r.text) for r in exact if r.text) == sorted([("None", text + " "), ("2", text + " more"), ("None", "call me@x.org"), ("None", "q"), ("5", "m   m")]) and sum(not r.text for r in exact) == 1
    near = near_dedup.keep_one_of_near(frame)
    assert near.columns == names and sorted((repr(r.doc_id), r.text or "") for r in near.collect()) == sorted([("1", text), ("None", "call me@x.org"), ("None", "q"), ("5", "mm"), ("5", "m   m"), ("6", "")])


def test_exact_dedup_keeps_each_text_of_an_id(spark):
    """Texts that repeat under one id, or under none, are documents of their own; the longest original of each stays."""
    rows = [(i, t) for i in (7, None) for t in ("a b", "a  b", "a b", "c d", "c d", "e", "e ", "f")] + [(8, "g"), (9, "g")]
    got = exact_dedup.keep_first_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(7, "a  b"), (7, "c d"), (7, "e "), (7, "f"), (8, "g")]
    alone = exact_dedup.keep_first_copies(spark.createDataFrame([r for r in rows if r[0] is None], "doc_id long, text string")).collect()
    assert sorted(r.text for r in alone) == ["a  b", "c d", "e ", "f"]


def test_language_scores_words_below_the_cut(spark):
    """However few words are broadcast, known words are scored by their log frequency."""
    rows = [(i, f"the cat and the dog w{'abcdefgh'[i % 8]}q {prose(i, 30)}", "en") for i in range(20)] + [(i, f"der hund und die katze {prose(i, 30)}", "de") for i in range(20, 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "the dog waq"), (2, "die hunde zzz"), (3, None), (None, "katze katze cat")], "doc_id long, text string")
    few, all_ = ({r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language_id.predict(asked, language_id.train(train, max_words=n)).collect()} for n in (2, 10**6))
    assert few == all_ and len(few) == 4


def brute_language(train, asked):
    """(language, score) of each text by word frequencies and backoff, from plain counts."""
    runs = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    padded = lambda w, k: [(f"_{w}_" if k > 1 else w)[i : i + k] for i in range(max(1, len(f"_{w}_" if k > 1 else w) - k + 1))]
    langs, counts = sorted({lang for _, lang in train}), {}
    for text, lang in train:
        for w in runs(text):
            for k, items in ((0, [w]), *((k, padded(w, k)) for k in (1, 2, 3, 4))):
                for x in items:
                    own = counts.setdefault((lang, k), {})
                    own[x] = own.get(x, 0) + 1
    log = lambda lang, k, x: math.log((counts[lang, k].get(x, 0) + 0.5) / (sum(counts[lang, k].values()) + 1))
    known = lambda k, x: any(x in counts[lang, k] for lang in langs)

    def word(lang, w):
        if known(0, w):
            return log(lang, 0, w)
        for k in (4, 3, 2, 1):
            if hits := [x for x in padded(w, k) if known(k, x)]:
                return sum(log(lang, k, x) for x in hits) / len(hits)
        return language_id.FLOOR

    out = []
    for text in asked:
        words = runs(text)
        if not words:
            out.append(("und", 0.0))
            continue
        mean = [sum(word(lang, w) for w in words) / len(words) for lang in langs]
        p = [math.exp(language_id.SHARPNESS * (m - max(mean))) for m in mean]
        out.append((langs[mean.index(max(mean))], max(p) / sum(p)))
    return out


@pytest.mark.parametrize(("words", "grams"), [(10**6, 10**6), (3, 10**6), (10**6, 5), (2, 0), (0, 40)])
def test_language_against_plain_counts(spark, words, grams):
    """However few words and grams are broadcast, scores are those of plain counts."""
    train = [(f"the cat and the dog {prose(i, 20)}", "en") for i in range(9)] + [(f"der hund und die katze über {prose(i + 50, 9)}", "de") for i in range(9)]
    asked = ["the dog zzzq", "die hunde", "qqq", "öö ß", "12", "alpha7 beta catze the the", "kater katze x", prose(77, 30)]
    model = language_id.train(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, text string, lang string"), max_words=words, max_grams=grams)
    got = sorted(language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect())
    for r, (lang, score) in zip(got, brute_language(train, asked), strict=True):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_exact_dedup_groups_survivors_only(docs):
    rows = exact_dedup.refined(docs, digest_all=True).collect()
    copies = Counter(normal(r.text) for r in docs.collect())
    assert all((r.full is None) != (r.rest is None) for r in rows)
    assert sum(r.full is not None for r in rows) <= sum(n for n in copies.values() if n > 1) + 2
