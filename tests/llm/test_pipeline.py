"""The pipeline's stages, each held against a plain version, and the whole run."""

import itertools
import os
import random
import re
from collections import Counter

import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import quality  # noqa: E402
from tidemark.llm.queries import tokenizer_path  # noqa: E402
from tidemark.session import ensure_checkpoint_dir  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, row string"
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "alpha beta gamma delta epsilon zeta".split() for b in range(40)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60)))
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())          # what labels call bad
        rows.append((i, text, "en", ["a", "b", None][i % 3], len(text), 1, "x"))
    rows += [(200 + i, rows[i + 1][1], "en", "a", 1, 1, "x") for i in range(9)]           # exact copies
    rows += [(300 + i, rows[i + 1][1] + " tail", "en", "b", 1, 1, "x") for i in range(9)]  # near copies
    rows += [(400, None, "en", "a", None, 1, "x"), (401, "", None, "b", 0, 1, "x"), (None, "no id here", "en", "a", 9, 1, "x"),
             (500, " ".join(rng.choice(words) for _ in range(9000)), "en", "b", 1, 1, "x"), rows[5], rows[5]]
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(bool(i % 4))) for i in range(120)], "doc_id long, quality int") \
        .write.parquet(f"{base}/labels.parquet")
    return base


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fingerprint(text):
    """Bit by bit, by the contract."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_quality_stage_rejects_by_score(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    assert out.columns == docs.columns
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in scored if r.score >= 0.3)
    kept = {r.doc_id for r in out.collect()}
    assert sum(i in kept for i in range(120) if i % 4) >= 88 and sum(i in kept for i in range(0, 120, 4)) <= 2


def test_one_document_of_each_component_stays(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        key = (r.doc_id is None, r.doc_id or 0)
        least[find(i)] = min(least.get(find(i), key), key)
    out = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted(least.values())


def test_whole_rows_move_once_in_near_dedup(spark, sf_dir):
    out = corpus_pipeline.drop_near_copies(spark, documents(spark, sf_dir), sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(id#" in line for line in plan.splitlines()) <= 2   # rows, and keys


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    from tokenizers import Tokenizer
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {f for f in os.listdir(folder) if f.endswith(".parquet")}
    before = tables()
    packed = corpus_pipeline.run(spark, sf_dir)
    rows = packed.collect()
    left = tables() - before
    assert len(left) == 1                                     # the last stage's input alone
    docs = spark.read.parquet(f"{folder}/{left.pop()}").collect()
    source = Counter()
    for r in documents(spark, sf_dir).collect():
        source[r.doc_id] = max(source[r.doc_id], len(WORD.findall(r.text or "")))
    assert docs and all(0 < len(WORD.findall(d.text)) <= 3 * source[d.doc_id] for d in docs)
    assert all(d.n_chars == len(d.text) for d in docs)
    plain = Tokenizer.from_file(tokenizer_path())
    want = {d.doc_id: len(plain.encode(d.text, add_special_tokens=False).ids) + 1 for d in docs}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    for _, part in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)),
                                     key=lambda r: r.sequence_id):
        part = list(part)
        ends = list(itertools.accumulate(r.length for r in part))
        assert [r.offset for r in part] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_empty_documents(spark, sf_dir, tmp_path):
    documents(spark, sf_dir).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
