"""Prefix tries, token alignment and quality rules against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evigrade.llm import prefix_trie, quality_rules, token_alignment

NONE = hashlib.sha256().hexdigest()


def brute_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows, sorted."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    built = {}
    for c in own:
        own[c].sort()
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        built[c] = [x[3:] for x in own.get(base, [])[:h]] + [x[3:] for x in own[c][h:]]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
            leaves[k[:d]] += not children[k]
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items()), key=repr
    )


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(1)
    rows = [(c, rng.choice([None, i, i, i]), rng.choice(["user", None, "a"]), rng.choice(["x", "yy", "é", None])) for c in [*range(-7, 40), 1000, 1001] for i in range(rng.choice([1, 2, 5, 9, 12, 20]))]
    rows += [(c, i, "user", "same") for c in range(100, 140) for i in range(10)] + [(None, 1, "a", "b"), (3, 0, "a", "b"), (3, 0, "a", "b")]
    return rows, spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, kind string, level long, path long")


@pytest.mark.parametrize("segment", [2, 5, 256])
def test_trie(talks, segment):
    rows, df = talks
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df, segment).collect()), key=repr) == brute_trie(rows)


def test_trie_of_one_long_talk_and_of_none(spark, talks):
    rows = [(5, i, "user", str(i)) for i in range(700)] + [(6, i, "user", str(i)) for i in range(300)] + [(13, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df, 64).collect()), key=repr) == brute_trie(rows)
    assert prefix_trie.prefix_trie(talks[1].where("conv_id > 5000")).count() == 0


def test_hot_talks_are_split_between_shards(spark):
    rows = [(5 * i, 0, "user", "hello") for i in range(4000)] + [(5 * i, 1, "user", str(i % 3)) for i in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = prefix_trie.rebuilt(df).selectExpr("conv_id", "level", "path", "X'' AS root")
    walls = prefix_trie.splitters(segments, 8, 4000)
    shards = Counter(bisect.bisect_right(walls, (b"", bytes(r["path"]), r["conv_id"])) for r in segments.collect())
    assert len(shards) == 8 and max(shards.values()) < 1500
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df, shard=500).collect()), key=repr) == brute_trie(rows)


def brute_alignment(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of (doc_id, text) rows, by whole texts and the tokenizers' own libraries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        of_a = [bytes(byte[c] for c in a.id_to_token(x)) for x in a_ids]
        of_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in b_ids]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
            found.append((doc_id, 0, 0, 0, "", []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        cuts = sorted(set(end_a) & set(end_b))
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(map(str, ids[bisect.bisect_right(ends, low) : bisect.bisect_right(ends, high)])) for ids, ends in ((a_ids, end_a), (b_ids, end_b))))
        links, first = [], 0
        for i, e, x in zip(a_ids, end_a, of_a, strict=True):
            first = bisect.bisect_right(end_b, e - len(x))
            links += [(i, b_ids[k]) for k in range(first, bisect.bisect_left(end_b, e) + 1)]
        counts.update(set(links))
        found.append((doc_id, len(a_ids), len(b_ids), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(((*r[:4], len(r[5]), sum(counts[k] == best[k[0]] for k in r[5]), sum(counts[k] for k in r[5]), r[4]) for r in found), key=repr)


ODD = [None, "", " ", "  ", "a  b", "a\n b ", "x▁y z", "<|endoftext|> a<s> </s>", "\x00 z", "é" * 300 + " 🙂", "a" * 700, "it's  we'll　ok", " lead", "tab\t x", "a  b c", "don 't", "\x1c b", "a b", "a b", "the cat sat on the mat. " * 9]


@pytest.mark.parametrize("head", [token_alignment.HEAD, 6, 0])
def test_alignment(spark, head):
    rows = [*enumerate(ODD), (None, "a b"), (4, "a b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row long, pairs string")
    assert sorted((tuple(r) for r in token_alignment.aligned_and_counted(df, head=head).collect()), key=repr) == brute_alignment(rows)
    assert token_alignment.aligned_and_counted(df.where("doc_id > 900"), head=head).count() == 0


def test_leaves_are_all_shared_ends():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2))
        assert token_alignment.leaves(a, b) == [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, seen, repeated = Counter(windows), set(), 0
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), n < 50 or 100 * len(covered) > 50 * n


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rng.choice("abcdefghijk") for _ in range(n)) + "."


TEXTS = [None, "", " \n", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "a b a b a b " * 40, "é\xa0è ü\x0bö z # $|", "w " * 30_000, "z" * 50_000, *[prose(i) for i in range(40)], *[re.sub(r"\b(\w+)", r"\1***", prose(i)) for i in range(8)], *[prose(i).upper().replace(" ", "!! ") for i in range(8)], prose(3), prose(3)]


def test_quality_rules(spark):
    rows = [*enumerate(TEXTS), (None, "a b"), (3, prose(9))]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, n_words long, words string, kept boolean")
    got = quality_rules.judged(df).collect()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r.doc_id, *(r[c] for c in counts)) for r in got), key=repr) == sorted(((i, *brute_counts(t)) for i, t in rows), key=repr)
    # The verdict again, by estimation over rows instead of patterns.
    voted = [r for r in got if not r.base_failed]
    prior, chance = quality_rules.estimated(np.array([[r[v] for v in quality_rules.RULES] for r in voted]), np.ones(len(voted)))
    for r in got:
        like = [prior, 1 - prior]
        for v, p in zip(quality_rules.RULES, chance, strict=True):
            like = [x * (1 if r[v] == 0 else q if r[v] == 1 else 1 - q) for x, q in zip(like, p, strict=True)]
        assert abs(r.posterior - like[0] / sum(like)) < 1e-9
        assert r.kept == (not r.base_failed and r.posterior >= quality_rules.KEEP)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(11, 51)) and not any(by[i].kept for i in range(51, 67))


def test_quality_rules_on_little(spark):
    schema = "doc_id long, text string"
    assert quality_rules.judged(spark.createDataFrame([], schema)).count() == 0
    assert [r.kept for r in quality_rules.judged(spark.createDataFrame([(1, "short")], schema)).collect()] == [False]
    assert quality_rules.judged(spark.createDataFrame([(1, prose(1))], schema)).first().kept


def test_variety_of_whole_texts(spark):
    """Distinct words count beyond the first thousand: of two texts that begin alike, one goes on with ten words only."""
    begin, rng = [f"w{i}" for i in range(1000)], random.Random(5)
    texts = [" ".join(begin), " ".join(begin + [f"v{i}" for i in range(1500)]), " ".join(begin + rng.choices([f"w{i}" for i in range(10)], k=19_000)), "", None, "a a b"]
    rows = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    blocks = lambda words: sum(len(set(words[at : at + 1000])) for at in range(0, len(words), 1000))
    assert [rows[i].n_distinct for i in range(len(texts))] == [blocks((t or "").split()) for t in texts]
    assert [rows[i].variety for i in range(3)] == [1, 1, -1]
