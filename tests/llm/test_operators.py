"""The training-data operators against brute force on small fixtures with
nulls, empty and long texts, ties, repeated rows and clashing columns."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import (
    chat,
    exact_topk,
    license_scan,
    mixing,
    nearest,
    packing,
    quality,
    sharding,
    simhash,
    url_filter,
)
from tidemark.llm.queries import URL_RULES, tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
DOC = "doc_id long, text string, source string, place int, row string, size int"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "  \n", "one", "two words", prose(40, 1), prose(40, 1), prose(40, 2) + " tail",
             prose(40, 2) + " end", prose(5000, 3), prose(300, 4), "É\u00a0x  y\tz <|endoftext|>"]
    rows = [(i, t, ["b", "a", None][i % 3], 1, "x", 2) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id", "a", 1, "x", 2)]
    return spark.createDataFrame(rows, DOC)


def plain_fingerprint(text):
    """The contract's fingerprint, bit by bit, with another hashing library call."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(docs):
    got = simhash.simhash_components(docs).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.product(range(len(rows)), repeat=2):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (doc, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    want = sorted((str(d), f"{f:016x}", str(least[r])) for (d, f), r in zip(rows, root))
    assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == want


@pytest.mark.parametrize("hot_bucket", [1, 10_000])
@pytest.mark.parametrize("max_bits", [2, 3, 4])
def test_near_pairs_lose_no_link(spark, hot_bucket, max_bits):
    rng = random.Random(max_bits)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            v = base
            for b in rng.sample(range(64), rng.randrange(4)):
                v ^= 1 << b
            values.add(v - (1 << 64) if v >> 63 else v)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r.a, r.b) for r in simhash.near_pairs(fps, max_bits, hot_bucket).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in values for b in values
                   if a < b and bin((a ^ b) & mask).count("1") <= max_bits}


def test_one_row_of_each_component_stays(docs):
    got = simhash.one_per_component(docs)
    assert got.columns == docs.columns
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert 5 in ids and 6 not in ids and 0 in ids and not {1, 2} & set(ids)


def test_mixing_hits_targets_and_limits(docs):
    rows = mixing.mix_sources(docs, block_words=8).collect()
    assert len(rows) == docs.count()
    assert rows == mixing.mix_sources(docs, block_words=8).collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 16
        assert v[0].source_size == sum(r.size for r in v)
        assert v[0].target <= 3 * v[0].source_size + 1e-6


def test_mixed_texts_hold_the_words_taken(docs):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(plain, block_words=8).collect()}
    out = mixing.mixed_documents(plain, n_chars=None, block_words=8)
    assert out.columns == docs.columns
    got = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect()}
    assert got == {k: v for k, v in taken.items() if v}


def test_shards_have_exact_sizes(docs):
    rows = sharding.shard_documents(docs, shards=4).collect()
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert sorted(map(len, sizes)) == [3, 3, 4, 4]
    assert all(s == list(range(len(s))) for s in sizes)
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
                  for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want


def test_communication_matrix_sums_and_mean():
    counts = [10, 0, 25, 7]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = np.array(sharding.communication_matrix(counts, 3, seed))
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == [14, 14, 14]
        total += m
    assert np.abs(total / 400 - np.outer(counts, [1 / 3] * 3)).max() < 0.35


def test_urls_equal_plain_rules(spark):
    hosts = ["org", "example.org", "a.Example.ORG", "notexample.org", "x.com", "com", "net", "", "org.", "a..org"]
    paths = ["", "/", "/es/1", "/es", "/en/1x", "/en/2", "/fr/", "/de/é", "?/es/", "#/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "example.org/es/", "x://y://org/"]
    urls += ["http://" + "a." * 20_000 + "com/de/", "http://example.org/es/" + "x" * 100_000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, host string")

    def judged(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, URL_RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls + urls[:5])}


def test_url_intervals_end_exactly(spark):
    rules = [*URL_RULES, ("block", "org", ""), ("block", "a.com", "/xa"), ("allow", "com", "/xabc"),
             ("block", "net", "no-slash"), ("block", "co.uk", "/")]
    urls = [f"http://{h}{p}" for h in ("com", "a.com", "organic", "org", "x.org", "no-slash.net", "net", "co.uk",
                                       "co.ukx", "xco.uk", "y.co.uk", "com􏿿", "cn")
            for p in ("", "/", "/de/", "/de/􏿿z", "/de0", "/de/", "/xabc", "/xab", "/xa􏿿")]

    def judged(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in rules
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, "allow")

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {i: judged(*re.match("http://([^/]*)(.*)", u).groups()) for i, u in enumerate(urls)}


VECTORS = [(i, [float((i * 7 + j * 3) % 11) / 7 - 0.6 for j in range(6)], 0) for i in range(150)]
VECTORS += [(200, None, 0), (201, [None, 1.0], 0), (202, [float("nan")] * 6, 0), (300, [0.0] * 6, 0), (100, [0.5] * 6, 0)]
VECTOR = "vec_id long, embedding array<float>, score int"


def test_exact_topk_equals_brute_force(spark):
    df = spark.createDataFrame(VECTORS, VECTOR)
    good = [(i, np.floor(np.float32(v).astype(float) * 1024)) for i, v, _ in VECTORS
            if v and all(x is not None and np.isfinite(x) for x in v)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score)
                 for r in exact_topk.exact_topk(df, k=4, block_rows=40, query_rows=2).collect())
    want = []
    for n, (i, q) in enumerate(good):
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(good) if m != n)[:4]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("size, width", [(10.0, 64), (5e4, 64), (1.55e6, 4), (2.0 ** 60, 3)])
def test_exact_topk_of_large_components(spark, size, width):
    """Reaches below 2^53, below and above 2^63, and components past 2^53."""
    rng = np.random.default_rng(int(size) % 97)
    data = (rng.integers(-10 ** 6, 10 ** 6, (120, width)) / 10 ** 6 * size / (1 if size < 2 ** 50 else 2 ** 40))
    if size > 2 ** 50:
        data[3], data[7] = [2.0 ** 80, 0, 0], [0, 0, 2.0 ** 70]     # orthogonal, so no score is too large
        data[:, 0] = np.where(np.arange(120) == 3, data[:, 0], 0)
        data[:, 2] = np.where(np.arange(120) == 7, data[:, 2], 0)
    exact = [[math.floor(x * 1024) if abs(x) < 2 ** 53 else int(x) * 1024 for x in row] for row in data.tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score)
                 for r in exact_topk.exact_topk(df, k=5, every=20, block_rows=50).collect())
    want = []
    for i in range(0, 120, 20):
        score = {j: sum(a * b for a, b in zip(exact[i], exact[j])) for j in range(120) if j != i}
        want += [(i, r, j, score[j]) for r, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:5], 1)]
    assert got == want


def test_a_score_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(i, [1e300, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="range of a long"):
        exact_topk.exact_topk(df).collect()


def test_nearest_vectors_recall(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((400, 16)) + 3 * rng.integers(0, 3, (400, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = nearest.nearest_vectors(df, every=50, block_rows=128).collect()
    hits = 0
    for i in range(0, 400, 50):
        gaps = np.sqrt(((data - data[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(400), gaps)) if j != i][:10]
        own = sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(r.score == pytest.approx(gaps[r.vec_id], abs=1e-12) for r in own)
        hits += len({r.vec_id for r in own} & set(want))
    assert hits >= 72


def test_nearest_vectors_of_odd_rows(spark):
    """Null, NaN, infinite and zero vectors take no part; ties go to the smaller
    id; copies and null ids are rows of their own."""
    rows = [(0, [0.0, 1.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (3, [0.0, 3.0]), (2, [0.0, -1.0]),
            (5, [2.0, 1.0]), (None, [0.0, 1.5]), (7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]),
            (200, [0.0, 0.0]), (11, [float("inf"), 0.0]), (300, []), (12, [0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    usable = [(i, v) for i, v in rows
              if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = []
    for n, (q, a) in enumerate(usable):
        if q is None or q % 100:
            continue
        others = sorted((math.dist(a, b), (i is not None, i or 0)) for m, (i, b) in enumerate(usable) if m != n)
        want += [(q, r + 1, i if known else None, d) for r, (d, (known, i)) in enumerate(others[:10])]
    got = [tuple(r) for r in nearest.nearest_vectors(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_packing_is_best_fit_decreasing(docs):
    rows = packing.pack_documents(docs, tokenizer_path(), capacity=64).collect()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(str(r.doc_id), n, s, k, zlib.crc32(np.array(ids[s:s + k], dtype="<u4").tobytes()))
                 for n, (s, k) in enumerate(packing.cut(len(ids), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        ends = list(itertools.accumulate(k for _, k in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    room = []
    for k in sorted((r.length for r in rows), reverse=True):
        fit = [i for i, x in enumerate(room) if x >= k]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= k
        else:
            room.append(64 - k)
    assert len(held) == len(room)


def test_classifier_scores_and_order(spark):
    rows = [(i, prose(30, i) if i % 3 else " ".join(w.upper() + "!!" for w in prose(30, i).split()))
            for i in range(300)]
    docs = spark.createDataFrame(rows + [(900, ""), (901, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)] + [(None, 1), (7, None)],
                                   "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert all(r.predicted == int(bool(r.doc_id % 3)) for r in held)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_classifier_fits_a_bounded_number_of_rows_and_features(spark):
    rows = [(i, prose(30, i) if i % 3 else " ".join(w.upper() + "!!" for w in prose(30, i).split()))
            for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    copies = docs.where("doc_id = 1").crossJoin(spark.range(3000)).select("doc_id", "text")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(200)], "doc_id long, quality int")
    once, often = (quality.train(d, labels) for d in (docs, docs.unionByName(copies)))
    assert all(np.array_equal(once[k], often[k]) for k in once)     # a repeated id counts once
    seen = docs.where(~quality.held_out(docs["doc_id"])).collect()
    total = sum(len(quality.Ngrams().of(r.text)) for r in seen)
    less = quality.train(docs, labels, train_features=total // 4)
    used = np.count_nonzero(less["squares"] != np.median(less["squares"]))
    assert 0 < used <= total // 4 and not np.array_equal(less["weights"], once["weights"])


def test_license_places(spark):
    pad, mit = prose(500, 8), license_scan.TEMPLATES["MIT notice"]
    near = mit.replace("copy, modify", "copy, and modify")
    texts = [None, "", "MIT", f"{pad} {mit} {pad}", f"{pad}\n{near}", "Released under the MIT License.",
             f"{pad} licensed under cc by-nc 4.0 {pad}", pad]
    df = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id long, text string")
    got = sorted((r.doc_id, r.template, r.containment == 1) for r in license_scan.scan_licenses(df).collect())
    assert got == [(3, "MIT notice", True), (4, "MIT notice", False), (5, "MIT line", True),
                   (5, "MIT line", True), (6, "CC-BY-NC-4.0 line", True)]


def _cheapest(roles):
    """Least cost over all ways, turn by turn."""
    best = {0: 0}
    for r in roles:
        new = {}
        for s, t, cost, *_ in chat.options(r if r in chat.ROLES else None):
            if s in best:
                new[t] = min(new.get(t, math.inf), best[s] + cost)
        best = new
    return min(c + chat.INSERT * len(chat.closing(s)) for s, c in best.items())


def test_chats_are_repaired_at_least_cost(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), f"t{t}")
            for c in [*range(12), None] for t in range(rng.randrange(1, 7))]
    rows += [(99, t, rng.choice(["user", "assistant"]), None) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.format_chats(df, task_rows=20).collect()
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.turn)
        assert sum(r.cost for r in mine) == _cheapest([r.role for r in mine])
        text = "".join(r.rendered for r in mine)
        order = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert text.count("<|im_end|>") == len(order) and order[-1] == "assistant"
        order = order[order[0] == "system":]
        assert order == ["user", "assistant"] * (len(order) // 2)


def test_equal_turns_are_dealt_to_many_tasks(spark):
    """Rows equal in every column, null ids and all, do not land in one task, and
    are repaired as one conversation."""
    n = 3000
    df = spark.createDataFrame([(None, None, "user", "same")] * n, "conv_id long, turn int, role string, text string")
    out = chat.format_chats(df, task_rows=200)
    rows = out.collect()
    assert len(rows) == n and sum(r.cost for r in rows) == sum(
        r.cost for r in chat.format_chats(df, task_rows=10 ** 6).collect())
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < n / 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    vectors = spark.createDataFrame([], VECTOR)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    for df in (simhash.simhash_components(docs), simhash.one_per_component(docs), mixing.mix_sources(docs),
               mixing.mixed_documents(docs), sharding.shard_documents(docs), license_scan.scan_licenses(docs),
               packing.pack_documents(docs, tokenizer_path()), quality.quality_scores(docs, labels),
               exact_topk.exact_topk(vectors), nearest.nearest_vectors(vectors), chat.format_chats(chats),
               url_filter.judge_urls(pages, URL_RULES)):
        assert df.collect() == []


def test_encoder_equals_the_tokenizer_library():
    rng = random.Random(5)
    letters = [*" \t\n\r'.,;:!?-_0123456789abcdefghijklmnopqrstuvwxyzABCéèßüñ ­\u0085中\U0001f600",
               "  ", "'ll", "'RE", "<|endoftext|>", "\n\n", " the", "ing"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(5000)]
    texts += ["a" * 5000, " " * 5000, "a" * 900 + " " * 900 + "!" * 999, "", "x中", "x中"]
    texts.append("hello <|endoftext|> there")
    encoder = packing.Encoder(tokenizer_path())
    assert encoder.fast is not None
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer_path())       # untouched
    assert plain.encode(texts[-1], add_special_tokens=False).ids == [31373, 220, 50256, 612]
    want = [np.array(e.ids, dtype="<u4").tobytes()
            for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert list(encoder.encode(texts)) == want
    encoder.fast = None  # a vocabulary that tiktoken cannot run
    assert list(encoder.encode(texts)) == want
