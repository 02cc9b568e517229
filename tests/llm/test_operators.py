"""The ten operators against brute force, round trips and held-out accuracy, with their edge cases."""

import hashlib
import itertools
import json
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

from gridlore.llm import bpe, common, components, exact_dedup, media, mixing, pretokens, quality, registry, simhash, token_counts, token_files, toxicity, url_filter

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "  \t\n", "a", "A b", "a  B\t", "<|endoftext|>a<|startoftext|> b<|endoftext|>", "İstanbul ΣΑΣ Σ", "á éᲉ x", "日本語 😀😀 ok \U00010d50",
    "x" * 5000, "ab" * 3000 + "!" * 2000, "don't WE'LL 123 4.5", "   a b", "\x1c\x1d a", "the " * 4000, "the " * 4000, "a", "b a",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None, 0.5) for i, t in enumerate(ODD)] + [(3, "a", None, None, 1, None), (None, "null id", "en", "s", 2, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer(name))


def test_bpe(odd, docs, none):
    lib, path = library("word_bpe_49k.json"), registry.tokenizer("word_bpe_49k.json")
    for df in (odd, docs):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        want = []
        for i, t in texts:
            ids = lib.encode(t, add_special_tokens=False).ids
            text = lib.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.encode_decode(df, path).collect())
    assert bpe.encode_decode(none, path).count() == 0


def test_bpe_streams_in_bounded_memory():
    encoder = bpe.word_encoder(registry.tokenizer("word_bpe_49k.json"))
    lib, merges = library("word_bpe_49k.json"), encoder.merges
    for word in ("".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(40_000)), "a" * 9_999, "ab" * 5_000 + "b" * 3_001, "the" * 7_000):
        encoder.transducer.peak = 0
        assert encoder.word_ids(word) == lib.encode(word, add_special_tokens=False).ids
        assert 0 < encoder.transducer.peak <= 2 * encoder.transducer.check < len(word)
    emitted = encoder.transducer.feed("the" * 7_000)
    held = len(encoder.transducer.text)
    assert emitted and held <= encoder.transducer.check
    encoder.transducer.finish()
    text = "some words of a text, " * 20_000
    assert max(map(len, encoder.portions(text))) < 70_000 and "".join(encoder.portions(text)) == text


def merge_all(word, merges):
    """Plain byte-pair encoding: the first merge of the list that applies, leftmost first, until none does."""
    tokens = list(word)
    while found := min(((merges.index((a, b)), i) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if (a, b) in merges), default=None):
        at = found[1]
        tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]
    return tokens


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_suffices(tmp_path, seed):
    """A token with lookahead symbols after it stays, whatever follows; on every word of a small merge list."""
    rng, tokens, merges = np.random.default_rng(seed), ["a", "b"], []
    while len(merges) < 6:
        pair = tuple(rng.choice([t for t in tokens if len(t) < 4], 2).tolist())
        if pair not in merges and "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges]}}))
    merge_list = bpe.MergeList(str(path))
    n, look = 12, merge_list.lookahead
    paths = {"".join(w): merge_all("".join(w), merges) for size in range(1, n + 1) for w in itertools.product("ab", repeat=size)}
    for word, path_ in paths.items():
        if len(word) < n:
            continue
        for cut in range(look + 1, n):
            at = 0
            for i, token in enumerate(paths[word[:cut]]):
                at += len(token)
                if at + look > cut:
                    break
                assert path_[i] == token, (merges, word, cut)
    transducer = bpe.Transducer(merge_list)
    for word in ["".join(rng.choice(["a", "b"], 400).tolist()) for _ in range(4)]:
        assert [tokens[i] for i in transducer.feed(word) + transducer.finish()] == merge_all(word, merges)


def test_incremental_decoder():
    tokens = dict(enumerate(pretokens.to_byte_alphabet("é😀 x")))
    decoder = bpe.ByteTextDecoder(tokens, join=None)
    assert "".join([decoder.feed([i]) for i in tokens] + [decoder.finish()]) == "é😀 x"


def test_token_counts(odd, docs, none):
    lib, path = library("byte_bpe_50k.json"), registry.tokenizer("byte_bpe_50k.json")
    for df in (odd, docs):
        want = [(r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in df.collect()]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in token_counts.token_counts(df, path).collect())
    assert token_counts.token_counts(none, path).count() == 0


def test_token_files(odd, docs, none):
    lib, path = library("byte_bpe_50k.json"), registry.tokenizer("byte_bpe_50k.json")
    def tie(text):  # rows of one doc_id lie in the order of the text's hash, a null text's being the seed
        v = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return v - (1 << 64) if v >> 63 else v

    for df in (odd, odd.unionByName(odd).repartition(7), docs):
        start, want = 0, []
        for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, tie(r.text))):
            ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in token_files.token_files(df, path).collect())
    assert token_files.token_files(none, path).count() == 0


def test_token_files_in_many_shards(odd, monkeypatch):
    """A third of all rows are one document: its rows may lie in several shards, and offsets stay whole."""
    path = registry.tokenizer("byte_bpe_50k.json")
    hot = odd.unionByName(odd.where("doc_id = 4").crossJoin(odd.sparkSession.range(40)).drop("id"))
    want = sorted(map(repr, token_files.token_files(hot, path).collect()))
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2000)
    assert token_files.shard_count(hot) > 10
    assert sorted(map(repr, token_files.token_files(hot, path).collect())) == want


def test_split_all_against_the_pattern():
    """Random strings of every class, contractions and white space, alone and beside others, and portions of long ones."""
    rng = np.random.default_rng(8)
    alphabet = [*"abstmdrevl", "'", "'", " ", " ", "\n", "\t", "\u00a0", "\u2003", "1", "٣", "!", "-", "é", "日", "😀", "\x1c", "\u0345", "'s", "'re", "'ll", "'ve", "ʼ"]
    plain = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"\s", f"[{pretokens.SPACES}]").replace(f"[^[{pretokens.SPACES}]", f"[^{pretokens.SPACES}").replace(r"\S", f"[^{pretokens.SPACES}]"))
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(rng.integers(1, 30))]
        found = pretokens.split_all(texts)
        ends = found.ends.tolist()
        for text, a, b in zip(texts, [0, *ends], ends, strict=False):
            got = [found.distinct[k].decode() for k in found.numbers[a:b]]
            assert got == plain.findall(text) == pretokens.TextSplitter(pretokens.BYTE_SPLIT).findall(text), text
    encoder = token_counts._counter(registry.tokenizer("byte_bpe_50k.json"))
    long = "some words' and don't 12 more\n\n x" * 500
    cut = encoder.portions(long, 300)
    assert len(cut) > 20 and "".join(cut) == long and [w for c in cut for w in plain.findall(c)] == plain.findall(long)


def test_bounded_cache_admits_on_second_sight():
    made = []
    cache = pretokens.BoundedCache(lambda w: made.append(w) or len(w), entries=4, longest=5)
    assert [cache[w] for w in ("a", "a", "bb", "bb", "longer", "longer")] == [1, 1, 2, 2, 6, 6]
    assert made == ["a", "bb", "longer", "longer"] and set(cache) == {"a", "bb"}  # there is room for all words at first
    assert cache["c"] == 1 and set(cache) == {"c"} and set(cache.old) == {"a", "bb"}
    assert [cache["d"], cache["a"], cache["d"], cache["d"]] == [1] * 4 and made[4:] == ["c", "d", "d"]
    for w in "cdefg" * 3:
        assert cache[w] == 1
    assert len(cache) <= 2 and len(cache.old) <= 2
    asked = []
    for words in (list("cdef"), ["longer", "g", "h"], list("hgcx"), list("hgcx")):
        assert cache.all(words, lambda w: asked.append(w) or list(map(len, w))) == list(map(len, words))
    assert len(cache) <= 2 and len(cache.old) <= 2 and "longer" not in cache


@pytest.mark.parametrize("common", [1, 8, 1000])
def test_token_counts_in_small_slices(odd, docs, monkeypatch, common):
    lib, path = library("byte_bpe_50k.json"), registry.tokenizer("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "SLICE_ROWS", 3)
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 900)
    monkeypatch.setattr(token_counts, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(token_counts, "COMMON", common)
    df = odd.unionByName(odd).select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(60))
    want = [(r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
    got = token_counts.token_counts(df, path).select("doc_id", "n_tokens").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_each_distinct_pretoken_is_in_one_bucket(docs):
    """Pre-tokens that are common in a slice are in at most SALTS buckets, all others in one, so these are counted once."""
    encoder, rare, often = token_counts._counter(registry.tokenizer("byte_bpe_50k.json")), defaultdict(set), defaultdict(set)
    texts = [r.text or "" for r in docs.collect()]
    for salt in range(20):
        some = texts[salt * 10 : salt * 10 + 10]
        seen = [{w for kind, part in encoder.segments(t) if kind == "words" for w in part} for t in some]
        found = set()
        for bucket, packed in token_counts.slice_rows(list(range(10)), some, encoder, 97, salt)[1]:
            words, spread, doc, n = token_counts.pairs_of(packed)
            assert len(words) == len(spread) and spread.sum() == len(doc) == len(n)
            for w, k in zip(words, spread.tolist(), strict=True):
                assert k == sum(w.decode() in s for s in seen)
                (often if k * token_counts.COMMON > 10 else rare)[w].add(bucket)
                found.add(w.decode())
        assert found == set().union(*seen)
    assert all(len(b) == 1 for b in rare.values()) and 1 < max(map(len, often.values())) <= token_counts.SALTS


def test_exact_groups(odd, docs, none):
    for df in (odd, docs):
        groups = defaultdict(list)
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        for i, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((i, t))
        want = []
        for i, t in rows:
            norm = re.sub(r"[\x20\x09-\x0D]", "", t)
            keep = min(groups[norm], key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
            want.append((i, keep, len(groups[norm]), keep == i, hashlib.sha256(norm.encode()).hexdigest()))
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in exact_dedup.exact_groups(df).collect())
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


#: Null ids, ids with several texts, and rows that repeat: (doc_id, text, lang).
SHARED = [
    (None, "a lone text", "en"), (None, "copy one", "en"), (1, "copy one", "en"), (None, "copyone", "en"),
    (2, "copy two", "en"), (2, "other text", "en"), (3, "copy two", "en"), (3, "third text", "en"), (1, "copy  two", "en"),
    (4, "again", "en"), (4, "again", "en"), (4, "again", "fr"), (5, "ag ain", "en"), (5, "aga in", "en"),
    (None, "no ids", "en"), (None, "no ids", "en"), (None, "no ids", "de"), (None, "n o ids", "en"),
    (6, None, "en"), (6, "", "en"), (7, " ", "en"), (8, "unique", None), (9, "uni que now", "en"), (9, "x", "en"),
]


@pytest.fixture(params=["broadcast", "shuffled"])
def joined_by(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(common, "fits_broadcast", lambda *_: False)
        monkeypatch.setattr(common, "HOT_GROUPS", 8)


def test_drop_copies_of_rows_with_null_and_repeated_ids(spark, joined_by):
    docs = spark.createDataFrame(SHARED, "doc_id long, text string, lang string").repartition(5)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    groups = defaultdict(list)
    for i, t, lang in SHARED:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t, lang))
    found = {re.sub(r"[\x20\x09-\x0D]", "", r.text or ""): tuple(r) for r in got.collect()}
    assert got.count() == len(groups) and found.keys() == groups.keys()
    for norm, members in groups.items():
        rank = lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0)
        assert found[norm] in members and rank(found[norm]) == min(map(rank, members))
    assert exact_dedup.drop_copies(docs.where("1 = 0")).count() == 0
    many = spark.createDataFrame([(None, "same", "en")] * 200 + SHARED, "doc_id long, text string, lang string")
    assert exact_dedup.drop_copies(many).count() == len(groups) + 1


def test_drop_near_copies_of_rows_with_null_and_repeated_ids(spark, joined_by):
    words = [f"word{k}" for k in range(400)]
    near = " ".join([*words, "end"]), " ".join([*words, "END"]), " ".join(words).title() + " end"
    far = [" ".join(f"{c}{k * k % 97}" for k in range(60)) for c in "pqrstu"]
    rows = [
        (None, near[0], "a"), (None, near[1], "a"), (None, near[1], "b"), (None, near[2], "a"),
        (1, far[0], "a"), (1, far[1], "a"), (None, far[1], "a"), (0, far[1], "b"),
        (2, far[2], "a"), (2, far[2], "a"), (2, far[2].upper(), "a"), (None, far[3], "a"), (3, far[4], "a"), (3, far[5], "a"), (4, None, "a"), (None, "", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    groups = defaultdict(list)
    for r in rows:
        groups[brute_fingerprint(r[1] or "")].append(r)
    assert len(groups) == 8 and all((a ^ b).bit_count() > 2 for a in groups for b in groups if a != b)
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted(brute_fingerprint(r[1] or "") for r in kept) == sorted(groups)
    for r in kept:
        members = groups[brute_fingerprint(r[1] or "")]
        assert r in members and r[0] == min((m[0] for m in members if m[0] is not None), default=None)
    assert simhash.drop_near_copies(docs.where("1 = 0")).count() == 0
    ties = docs.where("lang = 'a'").unionByName(docs.where("lang = 'b'"))
    assert sorted(map(repr, simhash.drop_near_copies(ties.repartition(2)).collect())) == sorted(map(repr, got.collect()))


def test_mixed_documents_by_leaf(spark):
    """One id, or none, in several leaves: each row comes as often as its own leaf says."""
    leaves = [("en", "a"), ("fr", "a"), ("fr", "b"), (None, "b"), ("en", None)]
    rows = [(i, f"{'w ' * (k + 1)}{i}", *leaf) for k, leaf in enumerate(leaves) for i in (None, 1, 2, 3, 4, 5, 6)] + [(1, "w 1", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    weights = {("a", "en"): 10.0, ("a", "fr"): 0.1, ("b", "fr"): 5.0}
    for options in ({"budget": 60, "weights": weights}, {"budget": 150, "weights": weights}, {"levels": [F.col("lang"), F.col("source"), F.lit("x")], "budget": 50}):
        epochs = {(r.doc_id, r.domain, r.language, r.source): r.epochs for r in mixing.mix(docs, **options).collect()}
        want = []
        for r in rows:
            leaf = (r[2], r[3], "x") if "levels" in options else (r[3] and re.match("[A-Za-z]*", r[3])[0], r[2], r[3])
            want += [r] * epochs.get((r[0], *leaf), 0)
        got = mixing.mixed_documents(docs, **options)
        assert got.columns == docs.columns
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("hot_groups", [1, 3, 4096])
def test_join_groups(spark, monkeypatch, hot_groups):
    """Groups of 30, 10 and 2 of 44 rows: whichever of them count as hot, every row meets its own group once."""
    monkeypatch.setattr(common, "HOT_GROUPS", hot_groups)
    keys = ["a"] * 30 + ["b"] * 10 + ["c"] * 2 + ["x", "y"]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    groups = spark.createDataFrame([("a", 30), ("b", 10), ("c", 2)], "k string, n long")
    sizes = {"a": 30, "b": 10, "c": 2}
    got = common.join_groups(rows, groups, ["k"], "n").select("i", "k", "n").collect()
    assert sorted(map(tuple, got)) == [(i, k, sizes.get(k)) for i, k in enumerate(keys)]
    assert common.join_groups(rows.limit(0), groups.limit(0), ["k"], "n").count() == 0


def test_exact_groups_survive_hash_collisions(spark):
    keyed = spark.createDataFrame([("h", "a"), ("h", "b"), ("i", "c"), ("i", "c"), ("j", "d")], "hash string, norm string")
    assert [r.hash for r in exact_dedup.colliding_hashes(keyed).collect()] == ["h"]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_near_groups(odd, docs, none):
    for df in (odd.where("doc_id is not null"), docs):
        rows = [(r.doc_id, brute_fingerprint(r.text or "")) for r in df.collect()]
        parent = list(range(len(rows)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                    parent[root(i)] = root(j)
        least = defaultdict(lambda: 1 << 60)
        for i, r in enumerate(rows):
            least[root(i)] = min(least[root(i)], r[0])
        want = [(r[0], f"{r[1]:016x}", least[root(i)]) for i, r in enumerate(rows)]
        assert sorted(want) == sorted(map(tuple, simhash.near_groups(df).collect()))
    assert simhash.near_groups(none).count() == 0


def test_near_links_at_two_bits(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 3, base ^ 0xF, base ^ 0xFF0, base ^ (1 << 62) ^ 1, -1, -1 ^ (1 << 63) + 5, 0]
    fps = [f - (1 << 64) if f >> 63 and f > 0 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in fps if -(1 << 63) <= f < 1 << 63], "fp long"))
    found = {r.u: r.root for r in components.components(links).collect()}
    assert {found[f] for f in (base, base ^ 3, base ^ 0xF)} == {min(base, base ^ 3, base ^ 0xF, base ^ (1 << 62) ^ 1)}
    assert base ^ 0xFF0 not in found


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(7, 7), (None, 1), (200, 199), (199, 200)]
    found = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 100 for i in range(100, 141)} | {i: 0 for i in range(50)} | {199: 199, 200: 199}


def brute_adpcm(data, block):
    out = []
    for at in range(0, len(data) // block * block, block):
        value, index = struct.unpack_from("<hB", data, at)
        index = min(index, 88)
        out.append(value)
        for b in data[at + 4 : at + block]:
            for code in (b & 15, b >> 4):
                step = int(media.STEP_SIZES[index])
                size = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
                value = max(-32768, min(32767, value - size if code & 8 else value + size))
                index = max(0, min(88, index + int(media.INDEX_STEPS[code & 7])))
                out.append(value)
    return out


def test_media_codecs():
    data = bytes((i * 73 + i // 7) % 256 for i in range(1024))
    assert media.decode_adpcm(data, 256).tolist() == brute_adpcm(data, 256)
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    for tag in (media.MULAW, media.ALAW):
        assert len(media.samples(media.decode_media(media.wav(data, tag)))[0]) == 2048
    assert media.decode_media(b"junk") is None and media.decode_media(None) is None


@pytest.mark.parametrize("n", [0, 3, 4, 5, 255, 256, 257, 259, 260, 261, 700, 1023])
def test_adpcm_keeps_a_short_last_block(n):
    data = bytes((i * 73 + i // 7) % 256 for i in range(n))
    rest = data[n // 256 * 256 :]
    want = brute_adpcm(data, 256) + (brute_adpcm(rest, len(rest)) if len(rest) >= 4 else [])
    assert media.decode_adpcm(data, 256).tolist() == want
    assert len(want) == n // 256 * 505 + (len(rest) * 2 - 7 if len(rest) >= 4 else 0)
    if n:
        assert media.samples(media.wav(data, media.IMA_ADPCM, bits=4, block=256))[0].tolist() == want


def plain_mulaw(code):
    """A sample of G.711 mu-law by its segments, without a table."""
    code = 255 - code
    sign, segment, step = code >> 7, code >> 4 & 7, code & 15
    size = (2 * step + 33) * 2**segment - 33
    return -4 * size if sign else 4 * size


def plain_alaw(code):
    code ^= 0x55
    sign, segment, step = code >> 7, code >> 4 & 7, code & 15
    size = (2 * step + 1) if segment == 0 else (2 * step + 33) * 2 ** (segment - 1)
    return 8 * size if sign else -8 * size


def plain_feature(pcm):
    energy = sum(v * v for v in pcm) // len(pcm)
    crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
    return f"n={len(pcm)},peak={max(map(abs, pcm))},energy={energy},crossings={crossings}"


def plain_wav(tag, rate, bits, block, rate_bytes, data, extra):
    head = struct.pack("<HHIIHH", tag, 1, rate, rate_bytes, block, bits) + extra
    chunks = b"WAVEfmt " + len(head).to_bytes(4, "little") + head + b"data" + len(data).to_bytes(4, "little") + data
    return b"RIFF" + len(chunks).to_bytes(4, "little") + chunks


def test_media_columns(odd, none):
    texts = defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text or "")
    got = media.media_columns(odd, with_media=True).collect()
    assert len(got) == odd.count()
    for r in got:
        payload = plain = None
        for text in texts[r.doc_id]:  # an id may have several texts
            raw = text.encode()
            plain = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            if hashlib.sha256(plain).hexdigest() == r.payload_sha256:
                payload = plain
                assert r.n_bytes == len(raw)
        assert payload is not None
        stored = plain_wav(7, 8000, 8, 1, 8000, payload, b"\0\0")
        assert r.media == stored and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.payload_bytes, r.tail_crc32) == (len(payload), zlib.crc32(payload[-64:]))
        mulaw = [plain_mulaw(b) for b in payload]
        kinds = {"mulaw": mulaw, "alaw": [plain_alaw(b) for b in payload], "adpcm": brute_adpcm(payload, 64)}
        assert r.feature == ";".join(f"{k}:{plain_feature(v)}" for k, v in kinds.items())
        pcm = []
        for a, b in zip(mulaw, [*mulaw[1:], mulaw[-1]], strict=True):  # 8 to 16 kHz: each sample and the middle to the next
            pcm += [a, (a + b + 1) // 2]
        want = plain_wav(1, 16_000, 16, 2, 32_000, struct.pack(f"<{len(pcm)}h", *pcm), b"")
        assert r.pcm == want and (r.pcm_bytes, r.pcm_sha256) == (len(want), hashlib.sha256(want).hexdigest())
    assert media.media_columns(none).count() == 0


def test_files_that_cannot_be_read_are_null():
    data = bytes(range(200))
    for bad in (
        media.wav(data, media.IMA_ADPCM, bits=4, block=256).replace(struct.pack("<HH", 256, 4), struct.pack("<HH", 0, 4)),
        media.wav(data, media.IMA_ADPCM, bits=4, block=256).replace(struct.pack("<HH", 256, 4), struct.pack("<HH", 2, 4)),
        media.wav(data, media.MULAW, rate=0), media.wav(data, media.PCM, bits=24), media.wav(data, 85), media.wav(data, media.MULAW)[:30], b"RIFF1234WAVE",
    ):
        assert media.decode_media(bad) is None


def test_channels_and_eight_bits():
    left, right = [100, -200, 32767, -32768], [300, -100, 32767, 32767]
    both = struct.pack("<8h", *[v for pair in zip(left, right, strict=True) for v in pair])
    assert media.samples(media.wav(both, media.PCM, bits=16, channels=2))[0].tolist() == [(a + b) // 2 for a, b in zip(left, right, strict=True)]
    assert media.samples(media.wav(bytes([0, 128, 255]), media.PCM, bits=8))[0].tolist() == [-32768, 0, 127 << 8]
    assert media.samples(media.wav(bytes([0x80, 0x00, 0xFF, 0xFF]), media.MULAW, channels=2))[0].tolist() == [0, 0]
    blocks = [bytes((i * 73 + c * 11) % 256 for i in range(32)) for c in range(2)]
    words = b"".join(blocks[c][4 + 4 * i : 8 + 4 * i] for i in range(7) for c in range(2))
    mixed = [(a + b) // 2 for a, b in zip(*[brute_adpcm(b, 32) for b in blocks], strict=True)]
    assert media.samples(media.wav(blocks[0][:4] + blocks[1][:4] + words, media.IMA_ADPCM, bits=4, block=64, channels=2))[0].tolist() == mixed


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda r: len(r[0] + r[1]), default=None)


def test_url_filter(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    urls = [None, "", "no scheme", "http://", "http://com/en/", "http://Example.COM/en/78?x#y", "ftp://a.b.example.com/en/6", "x://netz/de/", "http://a.net/de/81", "http://m.example.net/de/8",
            "http://example.net#/de/8", "http://casino.example.org/fr/", "http://casinos.example.org/", "http://cheap-pills.com/es/", "http://a://b.org/es/", "http://x.org/es/é", "http://www.spam-farm.net/de/1"]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), registry.URL_RULES)
    for r in got.collect():
        host, path, rule = brute_rule(urls[r.page_id], rules)
        own = bool(re.search(r"\b(casino|free-bets|cheap-pills|spam-farm)\b", host))
        assert (r.host, r.path, r.rule) == (host, path, rule[0] + rule[1] if rule else None), urls[r.page_id]
        assert r.verdict == (rule[2] if rule else "block" if own else "allow"), urls[r.page_id]


def test_url_rules_with_capitals_and_without_tokens(spark):
    rules = [url_filter.prefix_rule("Shop.Example", "/About/", "block"), url_filter.prefix_rule("", "/", "allow"), url_filter.prefix_rule("shop.example", "/About/Us", "allow")]
    urls = {"http://SHOP.example/About/x": "shop.example/About/", "http://a.shop.example/about/": "/", "http://shop.example/About/Us": "shop.example/About/Us", "http://other": None}
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules).collect()
    # A rule without a host fits hosts that end in a dot only, as every host is a subdomain of its own name.
    assert [r.rule for r in sorted(got)] == ["shop.example/About/", None, "shop.example/About/Us", None]


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    for made, label, bar in ((quality.score(known, quality.fit(docs, labels)), "quality", 0.9), (toxicity.score(known, toxicity.fit(docs, labels)), "toxic", 0.7)):  # a third of these toxic rows have no toxic word
        rows = made.where("held_out").join(labels, "doc_id").select("score", label, "predicted").toPandas()
        ranks, y = rows["score"].rank().to_numpy(), rows[label].to_numpy()
        auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
        print(label, "AUC", auc, "recall", rows[y == 1]["predicted"].mean(), "false", rows[y == 0]["predicted"].mean())
        assert auc > bar, label


def test_classifiers_on_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(19)] + [(None, 1, 1), (2, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for made in (quality, toxicity):
        scored = made.score(odd, made.fit(odd, labels)).collect()
        assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
        assert made.score(none, made.fit(none, labels)).count() == 0
        made.score(odd, made.fit(odd, labels.where("1 = 0"))).count()


def test_ordinary_dictionary_trains_on_whole_texts(monkeypatch):
    trained = []
    monkeypatch.setattr(toxicity, "train_content", lambda samples, size, **_: trained.append(samples) or b"")
    texts = [" ".join(f"w{i}x{k}" for k in range(6000)) for i in range(8)] + ["bad words"] * 8
    toxicity.fit_texts(list(range(16)), texts, np.array([0] * 8 + [1] * 8))
    used = {t for i, t in enumerate(texts[:8]) if zlib.crc32(b"fold" + str(i).encode()) % 2 == 0}
    assert used and all(len(t) > 40_000 for t in used)
    assert sum(map(len, trained[0])) == sum(map(len, used)) and all(t.encode() in b"".join(trained[0]) for t in used)


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_isotonic_pools_ties():
    x, y = quality.isotonic(np.array([1.0, 1, 1, 1, 2]), np.array([0.0, 0, 1, 1, 1]))
    assert x.tolist() == [1.0, 2.0] and y.tolist() == [0.5, 1.0]
    rng = np.random.default_rng(5)
    for _ in range(50):  # against the minimax form of isotonic regression
        at = rng.integers(0, 6, 30).astype(float)
        v = rng.integers(0, 2, 30).astype(float)
        x, y = quality.isotonic(at, v)
        assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
        levels = np.unique(at)
        means = {(a, b): v[(at >= a) & (at <= b)].mean() for a in levels for b in levels if a <= b}
        want = {c: max(min(means[a, b] for b in levels if b >= c) for a in levels if a <= c) for c in levels}
        pool = {c: y[np.searchsorted(np.unique(list(want.values())), want[c])] for c in levels}
        assert all(abs(pool[c] - want[c]) < 1e-12 for c in levels)


def test_fit_is_repeatable_with_repeated_ids(spark):
    rows = [(i, f"word{i} good text {k}") for i in range(40) for k in range(3)] + [(i, None) for i in range(5)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = common.one_text(docs).collect()
    assert len(one) == 40 and all(r.text is not None for r in one)
    scores = [sorted(map(tuple, m.score(d, m.fit(d, labels)).collect())) for m in (quality, toxicity) for d in (docs.repartition(3, "text"), docs.repartition(7).orderBy(F.desc("text")))]
    assert scores[0] == scores[1] and scores[2] == scores[3]
    small = toxicity.fit(docs, labels, max_train_bytes=100)  # whole texts within the bound
    assert len(small.ordinary) < len(toxicity.fit(docs, labels).ordinary)


def test_ridge_against_a_plain_solution(spark):
    """Statistics, features and normal equations in one process, without partitions."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, n_fourier=24, ridge=0.3)
    texts, known = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    ids = sorted(i for i in known if i in texts and zlib.crc32(str(i).encode()) % 4 != 2 and known[i] is not None)
    stats = np.array([quality.statistics(texts[i]) for i in ids])
    assert np.allclose(model.centre, stats.mean(axis=0)) and np.allclose(model.scale, np.maximum(stats.std(axis=0), 1e-6))
    x = np.clip((stats - stats.mean(axis=0)) / np.maximum(stats.std(axis=0), 1e-6), -6, 6)
    z = np.hstack([np.sqrt(2 / 24) * np.cos(x @ model.weights + model.phases), x / 6, np.ones((len(x), 1))])

    def fold(i):
        h = xxhash.xxh64_intdigest
        v = h(struct.pack("<i", 11), h(struct.pack("<q", i), 42))
        return (v - (1 << 64) if v >> 63 else v) % 5

    train = np.array([fold(i) != 0 for i in ids])
    y = np.array([known[i] for i in ids], float)
    # Ridge as least squares with rows that pull every weight to zero.
    wide = np.vstack([z[train], np.sqrt(0.3) * np.eye(z.shape[1])])
    want = np.linalg.lstsq(wide, np.concatenate([y[train], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.ridge, want, atol=1e-6)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    kx, ky = quality.isotonic(z[~train] @ want, y[~train])
    assert np.allclose([got[i] for i in ids], np.clip(np.interp(z @ want, kx, ky), 0, 1), atol=1e-6)


def test_gains_against_plain_compression():
    model = toxicity.fit_texts(list(range(200)), [f"plain words {i} " * 9 + ("horrid scoundrel " * (i % 2)) for i in range(200)], np.arange(200) % 2)
    text = "a horrid scoundrel said plain words " * 60
    want = []
    for part in toxicity.windows(text, 512):
        sizes = []
        for content in (model.toxic + model.ordinary, model.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(
                strategy=model.strategy, min_match=4, window_log=16, hash_log=14, chain_log=14, search_log=4, target_length=32, write_content_size=False, write_dict_id=False,
            )
            sizes.append(len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(part)))
        want.append(sizes[1] - sizes[0])
    assert b"".join(toxicity.windows(text, 512)).decode() == text and len(want) > 3
    assert model.gains(text).tolist() == want and max(want) > 0


def test_smallest_doc_id_of_all(spark):
    docs = spark.createDataFrame([(-(1 << 63), "a b"), ((1 << 63) - 1, "a b"), (None, "ab ")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_groups(docs).collect()} == {-(1 << 63)}

def water(given, kids):
    """kids: name -> (weight, capacity). The water level is found by halving, not by order."""
    kids = {k: (w, c) for k, (w, c) in kids.items() if w > 0 and c > 0}
    given, low, high = min(given, sum(c for _, c in kids.values())), 0.0, 1e18
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for w, c in kids.values()) < given else (low, mid)
    return {k: min(c, w * high) for k, (w, c) in kids.items()}


def brute_budgets(leaves, given, max_epochs, weights, alpha):
    """leaves: path -> tokens; by recursion from the root."""
    out = {}

    def down(path, given):
        if len(path) == 3:
            out[path] = given
            return
        kids = {}
        for leaf, n in leaves.items():
            if leaf[: len(path)] == path:
                kids[leaf[len(path)]] = kids.get(leaf[len(path)], 0) + n
        shares = water(given, {k: (weights.get((*path, k), float(n) ** alpha), n * max_epochs) for k, n in kids.items()})
        for k in kids:
            down((*path, k), shares.get(k, 0.0))

    down((), min(given, max_epochs * sum(leaves.values())))
    return out


def budgets_of(spark, leaves, **options):
    rows = spark.createDataFrame([(*p, n, 1) for p, n in leaves.items()], "domain string, language string, source string, tokens long, rows long")
    return {(r.domain, r.language, r.source): r.leaf_budget for r in mixing.budgets(rows, **options).collect()}


def test_shortages_are_settled_among_siblings_before_ancestors(spark):
    leaves = {("d", "en", "a"): 100, ("d", "en", "b"): 10, ("d", "fr", "c"): 50}
    even = {p: 1.0 for p in [("d",), ("d", "en"), ("d", "fr"), *leaves]}
    assert budgets_of(spark, leaves, budget=100, max_epochs=1, weights=even) == {("d", "en", "a"): 40, ("d", "en", "b"): 10, ("d", "fr", "c"): 50}
    assert budgets_of(spark, leaves, budget=140, max_epochs=1, weights=even) == {("d", "en", "a"): 80, ("d", "en", "b"): 10, ("d", "fr", "c"): 50}
    assert budgets_of(spark, {}) == {}


@pytest.mark.parametrize("seed", range(5))
def test_budgets_against_plain_recursion(spark, seed):
    rng = np.random.default_rng(seed)
    names = [None, "a", "b", "c"]
    leaves = {tuple(rng.choice(names, 3).tolist()): int(rng.choice([0, 1, 7, 400, 90_000])) for _ in range(18)}
    weights = {p[:d]: float(rng.choice([0, 0.1, 1, 5])) for p in leaves for d in (1, 2) if rng.random() < 0.6}
    for given in (0.0, 0.3, 1.0, 2.5, 9.0):
        total = given * sum(leaves.values())
        got = budgets_of(spark, leaves, corpus_epochs=given, max_epochs=3, weights=weights, alpha=0.7)
        want = brute_budgets(leaves, total, 3, weights, 0.7)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 1 + 1e-6 * want[p] for p in want), (given, leaves, weights)


def test_production_mixture_runs_short(spark):
    """Some leaves of the production call are full, so their shortage is redistributed; nothing is taken beyond the budget."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.asDict() for r in registry.op2_mixing(spark, "/root/testdata/sf0.01").collect()]
    levels = dict(zip(mixing.LEVELS, mixing.level_columns(registry.mixture()["levels"]), strict=True))
    known = docs.select(*levels.values(), mixing.word_tokens().alias("n")).groupBy(*mixing.LEVELS).agg(F.sum("n").alias("n")).collect()
    leaves = {(r.domain, r.language, r.source): r.n for r in known}
    want = brute_budgets(leaves, 1.5 * sum(leaves.values()), 4, registry.TARGET_WEIGHTS, 0.8)
    full = [p for p, n in leaves.items() if want[p] >= 4 * n - 1e-6]
    assert len({p[0] for p in leaves}) == 4 and 0 < len(full) < len(leaves)
    used = defaultdict(int)
    for r in rows:
        used[r["domain"], r["language"], r["source"]] += r["n_tokens"] * r["epochs"]
        assert abs(r["leaf_budget"] - want[r["domain"], r["language"], r["source"]]) <= 1 and r["epochs"] <= 4
    assert all(used[p] <= want[p] + 1 for p in leaves) and all(used[p] == 4 * leaves[p] for p in full)


@pytest.mark.parametrize("rows", [512, 3])
def test_mixing(docs, none, odd, rows, monkeypatch):
    """Against a plain loop over each leaf's hash order, with one and with many ranges a leaf and blocks of them."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    monkeypatch.setattr(mixing, "BLOCK_RANGES", rows)
    monkeypatch.setattr(mixing, "fits_broadcast", lambda *_: rows > 3)
    got = {r.doc_id: (r.epochs, r.leaf_budget) for r in mixing.mix(docs, alpha=0.5).collect()}
    leaves = defaultdict(list)
    for r in docs.collect():
        n = len(re.findall(r"[^ \t-\r]+", r.text or ""))
        leaves[(re.match("[A-Za-z]*", r.source)[0], r.lang, r.source)].append((r.doc_id, n))
    sums = {k: sum(n for _, n in v) for k, v in leaves.items()}
    plan = {k: int(v + 1e-6) for k, v in brute_budgets(sums, sum(sums.values()), 4, {}, 0.5).items()}
    want = {}
    for leaf, members in leaves.items():
        whole, rest = divmod(plan[leaf], sums[leaf]) if sums[leaf] else (0, 0)
        run = 0

        def order(x, whole=whole):
            h = xxhash.xxh64_intdigest
            seed = h(struct.pack("<i", whole), h(struct.pack("<i", 7), 42))
            v = h(struct.pack("<q", x[0]), seed)
            return v - (1 << 64) if v >> 63 else v

        for i, n in sorted(members, key=order):
            run += n
            if epochs := whole + (run <= rest):
                want[i] = (epochs, plan[leaf])
    assert got == want
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    taken = mixing.mix(odd, budget=3000).agg(F.sum(F.col("epochs"))).first()[0]
    extra = odd.withColumn("leaf_budget", F.lit(1)).withColumn("epochs", F.lit("x")).withColumn("domain", F.lit("y"))
    made = mixing.mixed_documents(extra, budget=3000)
    assert made.columns == extra.columns and made.count() == taken
